"""Costly steps are done once, in enough tasks, and shuffle little: read from plans; results on rows that repeat."""

from pyspark.sql import functions as F

from plenum import schemas
from plenum.operators import search as t
from plenum.operators.resolve import resolve_signers
from plenum.plans import documents, people
from plenum.sources.readers import widen
from plenum.sources.search_index import write_index

PERSONS = [(7, "Given", "Seven"), (8, "Given", "Eight")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def law(n, kind="LA", first=""):
    return (
        f'<s:Siirto><j:JulkaisuMetatieto m:laadintaPvm="2024-05-06" m:eduskuntaTunnus="{kind} {n}/2024 vp"/><h:HallituksenEsitys>'
        f'<a:AsiaKuvaus><k:KappaleKooste>T {n}</k:KappaleKooste></a:AsiaKuvaus><a:Allekirjoittaja><o:Henkilo{first}><o:EtuNimi>Given</o:EtuNimi>'
        "<o:SukuNimi>Eight</o:SukuNimi></o:Henkilo></a:Allekirjoittaja></h:HallituksenEsitys></s:Siirto>"
    )


def test_f1_swedish_twins_are_told_apart_without_reading_documents_again(spark):
    raw = spark.createDataFrame([(law(1),), (law(2, "RP"),), (None,)], "XmlData string").repartition(2).withColumn("XmlData", F.upper(F.lower("XmlData")))
    handling = spark.createDataFrame([], "Id string, Eduskuntatunnus string, XmlData string")
    persons = spark.createDataFrame(PERSONS, "id int, first_name string, last_name string")
    plain = spark.createDataFrame([(law(1),), (law(2, "RP"),), (None,)], "XmlData string")
    got = documents.build_government_proposals(plain, handling, persons)[0].collect()
    assert [(r.id, r.summary, r.status) for r in got] == [("la 1/2024 vp", "T 1", "open")]
    lines = plan(documents.build_government_proposals(raw, handling, persons)[0]).split("\n")
    assert not [line for line in lines if "Filter" in line and "JulkaisuMetatieto" in line]


def test_f3_signers_are_cut_out_once(spark):
    persons = spark.createDataFrame(PERSONS, "id int, first_name string, last_name string")
    raw = spark.createDataFrame([(law(1),), (law(2, first=' m:muuTunnus="7"'),), (law(3, first=' m:muuTunnus="*"'),)], "XmlData string")
    found = documents.signatures(documents.with_body(raw, "government"), persons, "proposal_id")[0]
    assert sorted((r.proposal_id, r.person_id) for r in found.collect()) == [("la 1/2024 vp", 8), ("la 2/2024 vp", 7)]
    assert len([line for line in plan(found).split("\n") if "Generate" in line and "Allekirjoittaja" in line]) == 1


def test_f3_signers_of_any_kind_keep_their_rows(spark):
    rows = [("a", "7", "X", "Y"), ("a", "7", "X", "Y"), ("b", None, "given", "Eight kok"), ("c", None, "Who", "Else"), ("d", "*", "Given", "Eight"),
            ("e", None, "", "Eight"), ("f", None, None, None), (None, "9", None, None)]
    persons = spark.createDataFrame([*PERSONS, (9, None, None), (10, "", "Eight")], "id int, first_name string, last_name string")
    found, missing = resolve_signers(spark.createDataFrame(rows, "doc string, person_id string, first_name string, last_name string"), persons)
    assert sorted((r.doc or "", r.person_id) for r in found.collect()) == [("", 9), ("a", 7), ("a", 7), ("b", 8)]
    assert [tuple(r) for r in missing.collect()] == [("c", "who", "else")]


MEMBER = """<Henkilo><KansanedustajuusPaattynytPvm>{0}</KansanedustajuusPaattynytPvm><NykyisetToimielinjasenyydet><Toimielin OnkoValiokunta="true">
<Nimi>Laki</Nimi><Jasenyys><AlkuPvm>1.3.2019</AlkuPvm><LoppuPvm/><Rooli>jäsen</Rooli></Jasenyys></Toimielin></NykyisetToimielinjasenyydet>
<ValtioneuvostonJasenyydet><Jasenyys><Nimi>M</Nimi><Ministeriys>x</Ministeriys></Jasenyys></ValtioneuvostonJasenyydet></Henkilo>"""


def test_f13_f18_members_are_parsed_once(spark):
    rows = [(1, MEMBER.format("")), (2, MEMBER.format("1.1.1980")), (3, MEMBER.format("1.1.2020")), (4, None)]
    raw = spark.createDataFrame(rows, "personId int, XmlDataFi string").repartition(4)
    seats, posts = people.build_committee_memberships(raw), people.build_ministers(raw)[0]
    assert sorted(r.person_id for r in seats.collect()) == [1, 3] and sorted(r.person_id for r in posts.collect()) == [1, 2, 3]
    for df in (seats, posts, people.build_assemblies(spark, raw), people.build_interests(raw), people.build_group_memberships(raw)):
        assert plan(df).lower().count("from_xml") + plan(df).lower().count("xmltostructs") == 1


def test_f8_narrow_rows_of_a_split_become_several_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    assert widen(spark.range(100).coalesce(1), 16).rdd.getNumPartitions() == 16 * cores
    assert widen(spark.range(0, 100, 1, 3 * cores), 16).rdd.getNumPartitions() == 48 * cores


def test_f15_words_are_not_shuffled(spark):
    rows = [(1, 0, "b a b"), (1, 0, "a c"), (None, 0, "x"), (None, 0, "y x"), (2, 0, None), (3, 0, "the d"), (3, 1, "d e"), (4, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, segment long, text string")
    got = {(r.doc_id, r.segment, r.term): r.positions for r in t.build_postings(docs, ["the"], whole=True).collect()}
    assert got == {
        (1, 0, "a"): [1, 2], (1, 0, "b"): [1, 3], (1, 0, "c"): [2], (None, 0, "x"): [1, 2], (None, 0, "y"): [1], (3, 0, "d"): [2],
        (3, 1, "d"): [3], (3, 1, "e"): [4],
    }
    known = docs.where("doc_id IS NOT NULL AND segment = 0").withColumn("segment", F.lit(0).cast("long"))
    grouped = [line for line in plan(t.build_postings(known, whole=True)).split("\n") if "Aggregate [" in line]
    assert any("collect_list(text" in g for g in grouped)


def test_f12_dictionary_counts_documents(spark, tmp_path):
    def terms(rows, name):
        docs = spark.createDataFrame(rows, "doc_id long, segment long, text string")
        index = write_index(t.build_postings(docs), str(tmp_path / name))
        return {r.term: (r.documents, r.hits) for r in index.dictionary(["a", "b"]).collect()}, index

    single, index = terms([(1, 0, "a b a"), (2, 0, "a"), (None, 0, "a b")], "single")
    assert single == {"a": (2, 4), "b": (1, 2)}
    assert sorted((r.doc_id or 0, r.positions) for r in index.postings(["a"]).collect()) == [(0, [1]), (1, [1, 3]), (2, [1])]
    assert terms([(1, 0, "a b"), (1, 1, "a"), (2, 0, "a")], "several")[0] == {"a": (2, 3), "b": (1, 1)}
