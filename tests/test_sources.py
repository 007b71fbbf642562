"""Readers and writers on small files; builders on hand-written register and minutes documents."""

import json
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions.clean import parse_money
from plenum.operators.search import build_postings, match_docs, parse_query
from plenum.plans import chamber, disclosure, documents, minutes, people
from plenum.sources import readers, writers
from plenum.sources.search_index import open_index, write_index


def test_tsv_with_quoted_multiline_cells(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('Id\tXml\n1\t"<a x=""1"">\nline\tb</a>"\n2\t\n', encoding="utf-8")
    df = readers.read_tsv(spark, str(tmp_path / "a.tsv"), "id int, xml string")
    assert {r.id: r.xml for r in df.collect()} == {1: '<a x="1">\nline\tb</a>', 2: None}


def test_ballot_file_by_position(spark, tmp_path):
    cells = [f"v{i}" for i in range(32)]
    cells[0], cells[9], cells[31] = "5", "2020-01-01 12:00:00", "HE 1/2020 vp"
    rows = [["h"] * 32, cells[:1] + ["1"] + cells[2:], cells[:1] + ["2"] + cells[2:]]
    (tmp_path / "b.tsv").write_text("\n".join("\t".join(r) for r in rows), encoding="utf-8")
    out = chamber.build_ballots(readers.read_tsv(spark, str(tmp_path / "b.tsv"), chamber.BALLOT_RAW))
    row = out.select("*", F.unix_seconds("start_time").alias("epoch")).collect()
    assert len(row) == 1
    assert (row[0].id, row[0].title, row[0].parliament_id, row[0].epoch) == (5, "v12", "he 1/2020 vp", 1577872800)


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("'Etunimet';'Tuen maara'\n'Anna';'1 234,50'\n'Ö, x';''\n", encoding="utf-8")
    df = readers.read_quoted_csv(spark, str(tmp_path / "c.csv"), {"Etunimet": "first_name", "Tuen maara": "amount"})
    got = df.select("first_name", parse_money("amount").cast("double").alias("n")).collect()
    assert [tuple(r) for r in got] == [("Anna", 1234.5), ("Ö, x", 0.0)]


def test_json_lobby(spark, tmp_path):
    target = {"contactedTargetId": 3, "contactMethods": ["mail", "call"]}
    project = {"fi": "Laki", "projectId": "P1"}
    raw = [
        {"companyId": "A", "otherCompanyId": None, "termId": 1, "topics": [
            {"id": 1, "contactTopicOther": "muu", "contactTopicProject": project, "contactedTargets": [target]},
            {"id": 1, "contactTopicOther": "abc", "contactTopicProject": None, "contactedTargets": []}, None]},
        {"companyId": None, "otherCompanyId": "B", "termId": 2, "topics": []},
        {"companyId": None, "otherCompanyId": "C", "termId": 2, "topics": [
            {"id": 2, "contactTopicOther": "x", "contactTopicProject": None,
             "contactedTargets": [{"contactedTargetId": 4, "contactMethods": ["mail"]},
                                  {"contactedTargetId": 3, "contactMethods": []}]}]},
    ]
    (tmp_path / "n.json").write_text(json.dumps(raw), encoding="utf-8")
    (tmp_path / "t.json").write_text(json.dumps([
        {"id": 30, "fi": {"id": 3, "name": "Anna Berg"}}, {"id": 40, "fi": {"id": 4, "name": "-"}},
        {"id": 50, "fi": {"id": 5, "name": "Solo"}}]), encoding="utf-8")
    noted = disclosure.notifications(readers.read_json(spark, str(tmp_path / "n.json"), disclosure.LOBBY_NOTIFICATION))
    topics = disclosure.build_lobby_topics(noted)
    assert sorted(map(tuple, topics.collect())) == [(1, "Laki", "P1"), (2, "x", None)]
    assert disclosure.build_lobby_topics(noted, parity=True).count() == 3
    targets = readers.read_json(spark, str(tmp_path / "t.json"), disclosure.LOBBY_TARGET).select("fi.id", "fi.name")
    persons = spark.createDataFrame([(9, "Anna", "Berg")], "id int, first_name string, last_name string")
    member = spark.createDataFrame([(9, None)], "person_id int, end_date date")
    actions = disclosure.build_lobby_actions(noted, targets, member, persons).collect()
    assert sorted((r.lobby_id, r.topic_id, r.person_id, str(r.contact_method)) for r in actions) == [
        ("A", 1, 9, "call"), ("A", 1, 9, "mail"), ("C", 2, 9, "None")]


def test_lobbies_prefer_a_known_industry(spark):
    df = spark.createDataFrame(
        [("A", None, "New", None), ("A", None, "Old", "Mining"), (None, "B", "Z", None)], disclosure.LOBBY_COMPANY)
    assert sorted(map(tuple, disclosure.build_lobbies(df).collect())) == [("A", "Old", "Mining"), ("B", "Z", None)]


def test_promises_know_the_nickname(spark):
    raw = spark.createDataFrame([('Ritva "Kike"', "Elomaa", "p")], disclosure.PROMISE)
    persons = spark.createDataFrame([(1, "Ritva", "Elomaa")], "id int, first_name string, last_name string")
    member = spark.createDataFrame([(1, None)], "person_id int, end_date date")
    assert disclosure.build_promises(raw, member, persons).first().person_id == 1


def test_photos(spark, tmp_path):
    for name in ("Zed-Ben-web-301.jpg", "a-7.png"):
        (tmp_path / name).write_bytes(b"x")
    photos = readers.file_id_map(spark, str(tmp_path))
    assert {r.id: r.photo for r in photos.collect()} == {"301": "Zed-Ben-web-301.jpg", "7": "a-7.png"}


def test_routing_and_tables(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "VASKI_JULKVP_Record_fi"), (2, "VASKI_JULKVP_Record_sv"), (3, "VASKI_JULKVP_Law_fi"), (4, "x")], "id int, xml string")
    writers.route_by_type(df, "xml", str(tmp_path / "docs"))
    back = readers.load(spark, str(tmp_path / "docs"))
    assert {(r.id, r.doctype) for r in back.collect()} == {(1, "Record_fi"), (3, "Law_fi")}
    assert back.where("doctype = 'Law_fi'").count() == 1
    writers.write_table(writers.conform(df.select(F.col("id").alias("ballot_id"), F.lit("yes").alias("vote")), "votes"),
                        str(tmp_path / "votes"))
    assert [f.simpleString() for f in readers.load(spark, str(tmp_path / "votes")).schema] == [
        "ballot_id:int", "person_id:int", "vote:string"]


def test_index_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, f"w{i} common" + " both" * (i % 2)) for i in range(50)], "doc_id int, segment bigint, text string")
    write_index(build_postings(df), str(tmp_path / "p"), buckets=4)
    index = open_index(spark, str(tmp_path / "p"))
    assert match_docs(index, parse_query("w3")).first().doc_id == 3
    assert match_docs(index, parse_query("common -w3")).count() == 49
    assert match_docs(index, parse_query("nowhere")).count() == 0 and match_docs(index, None).count() == 0
    assert index.documents_of(["common", "both", "w7", "nowhere"]) == {"common": 50, "both": 25, "w7": 1, "nowhere": 0}
    assert {r.doc_id for r in match_docs(index, parse_query("w3 common or both w4")).collect()} == {3}


def test_index_reads_wanted_buckets_and_terms_only(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, f"w{i} common") for i in range(50)], "doc_id int, segment bigint, text string")
    index = write_index(build_postings(df), str(tmp_path / "p"), buckets=16)
    plan = index.postings(["common"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (IN|=|INSET)", plan)
    assert "EqualTo(term,common)" in plan
    # The rare word's documents are broadcast, so the common word's postings are cut before they are grouped.
    both = match_docs(index, parse_query("common w3"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in both and "LeftSemi" in both
    assert len(list((tmp_path / "p" / "postings").glob("bucket=*"))) > 8


MEMBER = """<Henkilo><HenkiloNro>5</HenkiloNro><a>Anna</a><b>Berg</b><c/><d/><e/><f>09</f><g/><h/><i>Juristi</i><j>1970</j>
<k>Oulu</k><l/><m/><n/><o>Espoo</o><KansanedustajuusPaattynytPvm>{end}</KansanedustajuusPaattynytPvm>
<Sidonnaisuudet>{interests}</Sidonnaisuudet><Eduskuntaryhmat><NykyinenEduskuntaryhma><Nimi>{group}</Nimi>
<AlkuPvm>1.2.2019</AlkuPvm></NykyinenEduskuntaryhma><EdellisetEduskuntaryhmat>{former}</EdellisetEduskuntaryhmat>
</Eduskuntaryhmat><NykyisetToimielinjasenyydet><Toimielin OnkoValiokunta="true"><Nimi>Lakivaliokunta</Nimi>
<Jasenyys><AlkuPvm>1.3.2019</AlkuPvm><LoppuPvm/><Rooli>Jäsen</Rooli></Jasenyys></Toimielin>
<Toimielin OnkoValiokunta="false"><Nimi>Kerho</Nimi></Toimielin></NykyisetToimielinjasenyydet>
<AiemmatToimielinjasenyydet><Toimielin OnkoValiokunta="true"><Nimi>Vanha valiokunta</Nimi><Jasenyys><AlkuPvm>2001</AlkuPvm>
<LoppuPvm>2003</LoppuPvm><Rooli>Varajäsen</Rooli></Jasenyys><Jasenyys><AlkuPvm/><LoppuPvm/><Rooli>Jäsen</Rooli></Jasenyys>
</Toimielin></AiemmatToimielinjasenyydet></Henkilo>"""
ONE = "<Sidonnaisuus><RyhmaOtsikko>Tulot</RyhmaOtsikko><Sidonta>Palkka</Sidonta></Sidonnaisuus>"
FORMER = "<Eduskuntaryhma><Nimi>Keskustan eduskuntaryhmä</Nimi><Jasenyys><AlkuPvm>1.1.2001</AlkuPvm><LoppuPvm>2.1.2003</LoppuPvm></Jasenyys></Eduskuntaryhma>"


@pytest.fixture(scope="module")
def members(spark):
    rows = [
        (5, "Berg", " Anna", MEMBER.format(end="", interests=ONE * 2, group="Vihreä eduskuntaryhmä", former=FORMER)),
        (6, "Old", "O", MEMBER.format(end="1.5.2005", interests="", group="", former=FORMER * 2)),
        (7, "Older", "O", MEMBER.format(end="1.5.1999", interests=ONE.replace("Palkka", schemas.NOTHING_TO_DECLARE[1]),
                                        group="kesk", former="")),
    ]
    return spark.createDataFrame(rows, "personId int, lastname string, firstname string, XmlDataFi string")


def test_register(spark, members):
    photos = spark.createDataFrame([("5", "p.jpg")], "id string, photo string")
    p = {r.id: r for r in people.build_persons(members, photos).collect()}
    assert (p[5].first_name, p[5].full_name, p[5].year_of_birth, p[5].place_of_residence, p[5].photo, p[5].email) == (
        "Anna", "Anna Berg", 1970, "Espoo", "p.jpg", None)
    assert p[6].photo is None
    assert [r.person_id for r in people.build_interests(members).collect()] == [5, 5]
    m = people.build_group_memberships(members).collect()
    assert sorted((r.person_id, r.pg_id, str(r.end_date)) for r in m) == [
        (5, "kesk", "2003-01-02"), (5, "vihr", "None"), (6, "kesk", "2003-01-02"), (6, "kesk", "2003-01-02"), (7, "kesk", "None")]
    groups = people.build_parliamentary_groups(members)
    assert sorted(map(tuple, groups.collect())) == [("kesk", "Keskustan eduskuntaryhmä"), ("vihr", "Vihreä eduskuntaryhmä")]
    assert people.build_parliamentary_groups(members, parity=True).count() == 3
    c = people.build_committee_memberships(members).collect()
    assert sorted((r.person_id, r.committee_name, r.start_date, r.end_date, r.role) for r in c) == [
        (5, "Lakivaliokunta", date(2019, 3, 1), None, "member"),
        (5, "Vanha valiokunta", date(2001, 1, 1), date(2003, 12, 31), "associate")]
    found = people.build_assemblies(spark, members).where("code IS NULL").collect()
    assert [r.name for r in found] == ["Vanha valiokunta"]
    assert people.build_ministers(members)[0].count() == 0


def speech(number, person, minute, *, role=None, note=None, paras=("Hyvä.",), chair=None):
    paragraphs = "".join(f"<sis:KappaleKooste>{p}</sis:KappaleKooste>" for p in paras)
    said = (f"<vsk:PuheenjohtajaRepliikki><vsk1:PuheenjohtajaTeksti>Puhemies</vsk1:PuheenjohtajaTeksti>"
            f"<sis:KappaleKooste>{chair}</sis:KappaleKooste></vsk:PuheenjohtajaRepliikki>") if chair else ""
    asema = f"<org1:AsemaTeksti>{role}</org1:AsemaTeksti>" if role else ""
    tarkenne = f"<vsk1:TarkenneTeksti>{note}</vsk1:TarkenneTeksti>" if note else ""
    return (f'<vsk:PuheenvuoroToimenpide vsk1:puheenvuoroLuokitusKoodi="V" vsk1:puheenvuoroAloitusHetki="2024-07-01T12:{minute:02}:00">'
            f'<org:Henkilo met1:muuTunnus="{person}">{asema}</org:Henkilo>{tarkenne}'
            f'<vsk:PuheenvuoroOsa met1:muuTunnus="{number}">{paragraphs}{said}</vsk:PuheenvuoroOsa></vsk:PuheenvuoroToimenpide>')


def test_minutes(spark):
    response = schemas.RESPONSE_NOTE
    speeches = [
        speech("1", "10", 0, note=response), speech("2", "11", 1, paras=("A", "Loppu"), chair="B"),
        speech("3", "12", 2, role="valtiovarainministeri", note=response), speech("4", "13", 3, role="pääsihteeri"),
        speech("5", " ", 4), speech("6", "14", 5, note=response, chair="Muu"),
    ]
    xml = ('<r><jme:JulkaisuMetatieto met1:laadintaPvm="2024-07-02"/><asi:EduskuntaTunniste><met1:AsiakirjaTyyppiTeksti>PTK'
           '</met1:AsiakirjaTyyppiTeksti><asi1:AsiakirjaNroTeksti>7</asi1:AsiakirjaNroTeksti><asi1:ValtiopaivavuosiTeksti>2024'
           '</asi1:ValtiopaivavuosiTeksti></asi:EduskuntaTunniste><ptk:Poytakirja vsk1:kokousAloitusHetki="2024-07-01T12:00:00">'
           '<vsk:Asiakohta met1:muuTunnus="SKT 1"><vsk:KohtaNimeke><met1:NimekeTeksti> Kysely  tunti </met1:NimekeTeksti>'
           "</vsk:KohtaNimeke>" + "".join(speeches[:3]) + "</vsk:Asiakohta>"
           '<vsk:Asiakohta met1:eduskuntaTunnus="HE 1/2024 vp"><vsk:KohtaNimeke><met1:NimekeTeksti>' + schemas.BAD_AGENDA_TITLE +
           "</met1:NimekeTeksti></vsk:KohtaNimeke>" + "".join(speeches[3:]) + "</vsk:Asiakohta></ptk:Poytakirja></r>")
    raw = spark.createDataFrame([(xml,), (xml,)], "XmlData string").limit(1)
    assert [tuple(r) for r in minutes.build_records(raw).collect()] == [
        ("EK", 7, 2024, date(2024, 7, 1), date(2024, 7, 2), None)]
    assert [(r.parliament_id, r.title) for r in minutes.build_agenda_items(raw).collect()] == [("skt 1", "Kysely tunti")]
    got = {r.id: r for r in minutes.build_speeches(raw).collect()}
    # A response with no root before it is its own root; one in a later item follows the last root of the document.
    assert {k: r.response_to for k, r in got.items()} == {
        "2024/1": "2024/1", "2024/2": "2024/2", "2024/3": "2024/2", "2024/6": "2024/2"}
    assert got["2024/2"].speech == "A\n\nLoppu\n\n**Puhemies**: B"
    assert got["2024/6"].speech == "Hyvä.\n\n**Puhemies**: Muu"


def test_documents(spark):
    body = ("<{0}><met:Nimeke><met1:NimekeTeksti>Nimi</met1:NimekeTeksti></met:Nimeke>"
            "<asi:Allekirjoittaja asi1:allekirjoitusLuokitusKoodi=\"EnsimmainenAllekirjoittaja\"><org:Henkilo met1:muuTunnus=\"5\">"
            "<org1:EtuNimi>A</org1:EtuNimi></org:Henkilo></asi:Allekirjoittaja><asi:Allekirjoittaja><org:Henkilo met1:muuTunnus=\"5\">"
            "<org1:EtuNimi>A</org1:EtuNimi></org:Henkilo></asi:Allekirjoittaja><asi:Allekirjoittaja/></{0}>")

    def doc(number, tag=None):
        inner = body.format(tag) if tag else ""
        return (f'<s><jme:JulkaisuMetatieto met1:laadintaPvm="2024-01-02" met1:eduskuntaTunnus="{number}"/>{inner}</s>',)

    persons = spark.createDataFrame([(5, "A", "B")], "id int, first_name string, last_name string")
    handling = spark.createDataFrame([("1", "<x/>", None, None, "HE 1/2024 vp")], documents.DOCUMENT_RAW)
    raw = spark.createDataFrame(
        [doc("HE 1/2024 vp", "he:HallituksenEsitys"), doc("HE 2/2024 vp", "he:HallituksenEsitys"), doc("HE 1/2024 vp"),
         doc("RP 1/2024 rd", "he:HallituksenEsitys")], "XmlData string")
    props, signed = documents.build_government_proposals(raw, handling, persons)
    # A document without any status document is open, like one whose status names no decision.
    assert sorted((r.id, r.title, r.status, r.summary) for r in props.collect()) == [
        ("he 1/2024 vp", "Nimi", "open", None), ("he 2/2024 vp", "Nimi", "open", None)]
    assert sorted((r.proposal_id, r.person_id, r.first) for r in signed.collect()) == [
        ("he 1/2024 vp", 5, True), ("he 2/2024 vp", 5, True)]


def test_files_of_a_type_follow_its_size(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.concat(F.lit("<x>VASKI_JULKVP_"), F.when(F.col("id") % 100 != 0, "Record").otherwise("Law"), F.lit("_fi "), F.sha2(F.col("id").cast("string"), 512), F.lit("</x>")).alias("xml"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        writers.route_by_type(rows, "xml", str(tmp_path / "docs"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "docs").glob("doctype=*")}
    assert files["doctype=Law_fi"] == 1 < 4 < files["doctype=Record_fi"]
    assert readers.load(spark, str(tmp_path / "docs")).count() == 60_000
