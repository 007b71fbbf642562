"""Canonical XML against a parser, and builders on documents written in unusual but valid ways."""

import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from plenum.functions import xmltext as x
from plenum.plans import documents, minutes, people
from plenum.sources.readers import parse_xml


def tree(text):
    """(tag, attributes, text, children, tail) of a document; comments and instructions are left out by the parser."""
    def of(e):
        return e.tag, tuple(sorted(e.attrib.items())), e.text or "", [of(c) for c in e], e.tail or ""

    return of(ElementTree.fromstring(text))


def random_document(rng):
    def words():
        return "".join(rng.choice(["a", "b ", "&#228;", "&#xE4;", "&amp;", "&lt;", "&#60;", "&#38;", ">", "'", '"', "€", "😀", "&#128512;", "\n"]) for _ in range(rng.randint(0, 6)))

    def value():
        quote = rng.choice("\"'")
        inner = words().replace(quote, "").replace("\n", " ")
        return quote + inner + (">" if rng.random() < 0.3 else "") + quote

    def extra():
        return rng.choice(["", "", "<!-- <b x='1'> -- >-->".replace("-- >", "> "), "<![CDATA[<c>&amp;]] >'\"]]>", "<?pi a='>' ?>"])

    def element(depth):
        tag = rng.choice(["a", "b", "c-d"])
        attributes = "".join(f" {n}{rng.choice(['=', ' = ', '= '])}{value()}" for n in rng.sample(["x", "y", "z"], rng.randint(0, 3)))
        if depth > 3 or rng.random() < 0.2:
            return f"<{tag}{attributes}/>"
        inner = "".join(words() + extra() + element(depth + 1) for _ in range(rng.randint(0, 3)))
        return f"<{tag}{attributes}>{inner}{words()}{extra()}</{tag}>"

    return rng.choice(["", "<?xml version='1.0'?>\n", "<!DOCTYPE a [<!ENTITY q 'x>y'>]>"]) + element(0)


def test_canonical_documents_say_the_same(spark):
    rng = random.Random(4)
    docs = [random_document(rng) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, t string").select("i", "t", x.canonical("t").alias("c")).collect()
    for r in rows:
        assert tree(r["c"]) == tree(r["t"]), r["t"]
        assert "<!" not in r["c"] and "<?" not in r["c"] and "&#" not in r["c"]
    again = spark.createDataFrame([(r["c"],) for r in rows], "c string").select("c", x.canonical("c").alias("d")).collect()
    assert all(r["c"] == r["d"] for r in again)


def test_canonical_leaves_null_and_plain_documents(spark):
    rows = [(None,), ("",), ('<a x="1">b&amp;c</a>',), ("no markup &# here",), ("&#xD800;&#0;&#99999999999;<!",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(x.canonical("t")).collect()]
    assert got[:4] == [r[0] for r in rows[:4]] and got[4].startswith("&#xD800;&#0;&#99999999999;")


HOSTILE_MEMBER = """<?xml version='1.0'?><!-- <Henkilo/> --><m:Henkilo xmlns:m='u'>
<Sidonnaisuudet><!-- <Sidonnaisuus><Sidonta>old</Sidonta></Sidonnaisuus> --><Sidonnaisuus laji='a > b'><RyhmaOtsikko>Ty&#246;</RyhmaOtsikko>
<Sidonta><![CDATA[A & B <Oy>]]></Sidonta></Sidonnaisuus></Sidonnaisuudet>
<Eduskuntaryhmat><NykyinenEduskuntaryhma><Nimi>Vihre&#xE4; eduskuntaryhm&#228;</Nimi><AlkuPvm>1.2.2019</AlkuPvm></NykyinenEduskuntaryhma>
<EdellisetEduskuntaryhmat/></Eduskuntaryhmat>
<NykyisetToimielinjasenyydet><Toimielin x="1>2" OnkoValiokunta='true'><Nimi>Laki<!-- x -->valiokunta</Nimi>
<Jasenyys><AlkuPvm>1.3.2019</AlkuPvm><LoppuPvm/><Rooli>Jäsen</Rooli></Jasenyys></Toimielin></NykyisetToimielinjasenyydet>
<m:Muut><m:ValtioneuvostonJasenyydet><Jasenyys><Ministeriys>M</Ministeriys><Nimi>Ministeri &amp; muu</Nimi><Hallitus>H</Hallitus><AlkuPvm>2001</AlkuPvm>
<LoppuPvm>2003</LoppuPvm></Jasenyys></m:ValtioneuvostonJasenyydet></m:Muut></m:Henkilo>"""


def test_member_register_written_unusually(spark):
    raw = spark.createDataFrame([(5, HOSTILE_MEMBER), (6, "<broken"), (7, None)], "personId int, XmlDataFi string")
    assert [(r.person_id, r.category, r.interest) for r in people.build_interests(raw).collect()] == [(5, "Työ", "A & B <Oy>")]
    assert [r.pg_id for r in people.build_group_memberships(raw).collect()] == ["vihr"]
    seats = people.build_committee_memberships(raw).collect()
    assert [(r.person_id, r.committee_name, str(r.start_date), r.end_date, r.role) for r in seats] == [(5, "Lakivaliokunta", "2019-03-01", None, "member")]
    posts = people.build_ministers(raw)[0].collect()
    assert [(r.person_id, r.minister_position, str(r.end_date)) for r in posts] == [(5, "Ministeri & muu", "2003-12-31")]


HOSTILE_LAW = """<s:Siirto xmlns:s='u'><j:JulkaisuMetatieto  m:laadintaPvm='2024-05-06'  m:eduskuntaTunnus = 'LA 1/2024 vp' m:x='a>b'/>
<!-- <e:EduskuntaAloite><a:Allekirjoittaja/></e:EduskuntaAloite> --><e:EduskuntaAloite><n:Nimeke><n:NimekeTeksti>Aloite &#228;&amp;<![CDATA[<b>]]></n:NimekeTeksti></n:Nimeke>
<a:AsiaKuvaus><k:KappaleKooste>Tiivis&#x20AC;</k:KappaleKooste></a:AsiaKuvaus>
<a:PonsiOsa><k:SuppeaLista u:ulkoasuKoodi='Numeropiste'><k:KappaleKooste>yksi</k:KappaleKooste><k:KappaleKooste>kaksi</k:KappaleKooste></k:SuppeaLista></a:PonsiOsa>
<a:Allekirjoittaja a:allekirjoitusLuokitusKoodi='{first}'><o:Henkilo m:muuTunnus='7' x="p>q"><o:EtuNimi>A</o:EtuNimi><o:SukuNimi>B</o:SukuNimi></o:Henkilo></a:Allekirjoittaja>
<!-- <a:Allekirjoittaja><o:Henkilo m:muuTunnus="8"><o:EtuNimi>Gone</o:EtuNimi><o:SukuNimi>C</o:SukuNimi></o:Henkilo></a:Allekirjoittaja> -->
</e:EduskuntaAloite></s:Siirto>"""


def test_proposal_written_unusually(spark):
    from plenum import schemas

    raw = spark.createDataFrame([(HOSTILE_LAW.replace("{first}", schemas.FIRST_SIGNER_CLASS),)], "XmlData string")
    docs = documents.with_body(raw, "mp_law")
    row = documents.extract_sections(docs, ("summary", "motion")).first()
    assert (row.id, str(row.date), row.title, row.summary) == ("la 1/2024 vp", "2024-05-06", "Aloite ä&<b>", "Tiivis€")
    assert row.motion == "1. yksi\n\n2. kaksi" and row.markup_error is None
    assert [(r.person_id, r.first_name, r["first"]) for r in documents.extract_signers(docs).collect()] == [("7", "A", True)]


def test_minutes_written_unusually(spark):
    text = """<s:Siirto><j:JulkaisuMetatieto m:laadintaPvm='2024-01-16'/><a:EduskuntaTunniste><m:AsiakirjatyyppiKoodi>PTK</m:AsiakirjatyyppiKoodi>
    <a:AsiakirjaNroTeksti>&#49;2</a:AsiakirjaNroTeksti><a:ValtiopaivavuosiTeksti>2024</a:ValtiopaivavuosiTeksti></a:EduskuntaTunniste>
    <p:Poytakirja v:kokousAloitusHetki='2024-01-15T10:00:00' tila='>'><v:Asiakohta m:eduskuntaTunnus='HE 1/2023 vp'><v:KohtaNimeke><m:NimekeTeksti>Asia &#8364;
    </m:NimekeTeksti></v:KohtaNimeke><!-- <v:Asiakohta m:eduskuntaTunnus="HE 2/2023 vp"/> --></v:Asiakohta></p:Poytakirja></s:Siirto>"""
    raw = spark.createDataFrame([(text,)], "XmlData string")
    record = minutes.build_records(raw).first()
    assert (record.number, record.year, str(record.meeting_date), str(record.creation_date)) == (12, 2024, "2024-01-15", "2024-01-16")
    assert [(r.parliament_id, r.title) for r in minutes.build_agenda_items(raw).collect()] == [("he 1/2023 vp", "Asia €")]


def test_schema_reads_wanted_fields_only(spark):
    raw = spark.createDataFrame([(HOSTILE_MEMBER,)], "t string")
    plan = parse_xml(raw, "t", people.INTERESTS).select(F.size("doc.Sidonnaisuudet.Sidonnaisuus"))._jdf.queryExecution().executedPlan().toString()
    assert "Nimi" not in plan and "Python" not in plan


@pytest.mark.parametrize("text", ["<a>" + "<b x='1'>t</b>" * 20_000 + "</a>", "<a x='" + "y>" * 50_000 + "'/>"])
def test_long_documents(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(x.canonical("t").alias("c")).first()["c"]
    assert tree(got) == tree(text)


def test_tables_of_statutes_in_a_proposal(spark):
    grid = "<t:table><t:tgroup><t:colspec/><t:colspec/><t:row><t:entry>A</t:entry><t:entry>B</t:entry></t:row><t:row><t:entry>{0}</t:entry><t:entry>2</t:entry></t:row></t:tgroup></t:table>"
    law = "<s:SaadosOsa><s:Saados><s:Pykala><s:PykalaTunnusKooste>{0} §</s:PykalaTunnusKooste><s:MomenttiKooste>Eka." + grid + "</s:MomenttiKooste>" + grid.format("x") + "</s:Pykala></s:Saados></s:SaadosOsa>"
    body = "<e:EduskuntaAloite><a:AsiaKuvaus><k:KappaleKooste>T</k:KappaleKooste></a:AsiaKuvaus>" + law.format(1) + law.format(2) + "</e:EduskuntaAloite>"
    raw = spark.createDataFrame([("<s:Siirto><j:JulkaisuMetatieto m:eduskuntaTunnus='LA 1/2024 vp'/>" + body + "</s:Siirto>",)], "XmlData string")
    row = documents.extract_sections(documents.with_body(raw, "mp_law")).first()

    def shown(n):
        return f"**{n} §**\n\nEka.\n\n| A | B |\n| --- | --- |\n| {n} | 2 |\n\n| A | B |\n| --- | --- |\n| x | 2 |"

    assert row.law_changes == shown(1) + "\n\n---\n\n" + shown(2) and row.summary == "T" and row.markup_error is None


def test_proposals_are_made_in_many_tasks(spark, tmp_path):
    """Adaptive execution joined the narrow rows in a few tasks, each of which then made and cut long documents."""
    from plenum.catalog import register

    d = str(tmp_path)
    spark.range(50).selectExpr("id o_orderkey", "id o_custkey", "DATE '2024-01-02' o_orderdate", "'1-URGENT' o_orderpriority", "'F' o_orderstatus").write.parquet(f"{d}/orders.parquet")
    spark.range(90).selectExpr("id % 45 l_orderkey", "cast(1 + id % 2 as int) l_linenumber", "id l_partkey", "id % 5 l_suppkey").write.parquet(f"{d}/lineitem.parquet")
    spark.range(5).selectExpr("id s_suppkey", "concat('S', id) s_name").write.parquet(f"{d}/supplier.parquet")
    docs = register.proposal_xml(spark, d)
    assert docs.rdd.getNumPartitions() >= 8 * register.TASKS and docs.count() == 50
    assert sorted(r.seq for r in docs.where("XmlData LIKE '%Allekirjoittaja%'").collect()) == [i for i in range(45) if i % 9]
