"""Search on a small corpus, checked by brute force."""

import random
import re
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from plenum.operators import search as s

DOCS = {
    1: "budget law and tax law", 2: "tax on cars", 3: "the budget of cars, then more words and the tax",
    4: "Laki: verotuksesta", 5: "tax tax budget tax", 6: "", 7: "law-and order or tax",
}


@pytest.fixture(scope="module")
def postings(spark):
    df = spark.createDataFrame([(k, 0, v) for k, v in DOCS.items()], "doc_id int, segment bigint, text string")
    return s.build_postings(df).cache()


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def has_phrase(text, phrase):
    w, p = words(text), words(phrase)
    return any(w[i:i + len(p)] == p for i in range(len(w)))


def brute_rank(text, terms):
    """Sum over minimal covers of all terms."""
    w = words(text)
    spans = []
    for i in range(len(w)):
        for j in range(i, len(w)):
            if set(terms) <= set(w[i:j + 1]):
                spans.append((i, j))
                break
    minimal = [x for x in spans if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in spans)]
    return sum(0.1 / (1 + (j - i) - (sum(t in terms for t in w[i:j + 1]) - 1)) for i, j in minimal)


CASES = {
    "tax": lambda t: "tax" in words(t),
    "TAX budget": lambda t: {"tax", "budget"} <= set(words(t)),
    "cars or laki": lambda t: {"cars", "laki"} & set(words(t)),
    "tax -law": lambda t: "tax" in words(t) and "law" not in words(t),
    "-tax": lambda t: "tax" not in words(t),
    '"tax law"': lambda t: has_phrase(t, "tax law"),
    '-"tax law" budget': lambda t: "budget" in words(t) and not has_phrase(t, "tax law"),
    "law-and": lambda t: has_phrase(t, "law and"),
    '"budget law" or cars tax -then': lambda t: has_phrase(t, "budget law")
    or ({"cars", "tax"} <= set(words(t)) and "then" not in words(t)),
    "nothing": lambda t: False,
}


@pytest.mark.parametrize("q", list(CASES))
def test_matches(spark, postings, q):
    all_docs = spark.createDataFrame([(k,) for k in DOCS], "doc_id int")
    got = {r.doc_id for r in s.match_docs(postings, s.parse_query(q), all_docs).collect()}
    assert got == {k for k, t in DOCS.items() if CASES[q](t)}


@pytest.mark.parametrize("q", ["tax", "tax budget", "budget tax law", "law and"])
def test_rank(postings, q):
    got = {r.doc_id: round(r["rank"], 9) for r in s.match_docs(postings, s.parse_query(q)).collect()}
    assert got == {k: round(brute_rank(t, words(q)), 9) for k, t in DOCS.items() if set(words(q)) <= set(words(t))}


@pytest.mark.parametrize("q", [None, "", "  ", "-", '""', "or"])
def test_blank_queries_find_nothing(postings, q):
    assert s.parse_query(q) is None
    assert s.match_docs(postings, s.parse_query(q)).count() == 0


def test_stop_words_only_find_nothing_and_keep_positions(spark):
    df = spark.createDataFrame([(1, 0, "laki ja vero")], "doc_id int, segment bigint, text string")
    p = s.build_postings(df, ["ja"])
    assert {r.term: r.positions for r in p.collect()} == {"laki": [1], "vero": [3]}
    assert s.parse_query("ja", ["ja"]) is None
    assert s.match_docs(p, s.parse_query('"laki ja vero"', ["ja"])).count() == 1


def test_postings_filter_is_applied_before_grouping(postings, spark):
    df = spark.createDataFrame([(1, 0, "a b")], "doc_id int, segment bigint, text string")
    plan = s.match_docs(s.build_postings(df), s.parse_query("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [doc_id#") < plan.rindex("Filter")


def brute_covers(text, clauses):
    """Sum over the minimal covers of alternatives, each a list of phrases."""
    w = words(text)
    terms = {t for c in clauses for p in c for t in words(p)}
    places = {p: [(i, i + len(words(p)) - 1) for i in range(len(w)) if w[i:i + len(words(p))] == words(p)] for c in clauses for p in c}
    stretches = [
        (i, j) for i in range(len(w)) for j in range(i, len(w))
        if any(all(any(i <= a and z <= j for a, z in places[p]) for p in c) for c in clauses)
    ]
    minimal = [x for x in stretches if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in stretches)]
    return sum(0.1 / (1 + (j - i) - (sum(t in terms for t in w[i:j + 1]) - 1)) for i, j in minimal)


RANKED = {
    '"a b" c': [["a b", "c"]], "a b c": [["a", "b", "c"]], '"a b" or c d': [["a b"], ["c", "d"]], '"a a" b': [["a a", "b"]],
    '"a b" "b c"': [["a b", "b c"]], 'a or "b a" c or d': [["a"], ["b a", "c"], ["d"]], '"a b a" a': [["a b a", "a"]],
}


@pytest.mark.parametrize("q", list(RANKED))
def test_rank_of_phrases_and_alternatives(spark, q):
    rng = random.Random(q)
    texts = {i: " ".join(rng.choice("aabbccde") for _ in range(rng.randint(0, 25))) for i in range(60)}
    df = spark.createDataFrame([(k, 0, v) for k, v in texts.items()], "doc_id int, segment bigint, text string")
    got = {r.doc_id: round(r["rank"], 9) for r in s.match_docs(s.build_postings(df), s.parse_query(q)).collect()}
    want = {k: round(brute_covers(t, RANKED[q]), 9) for k, t in texts.items()}
    assert got == {k: v for k, v in want.items() if v}


def test_phrases_and_covers_go_across_parts(spark):
    rows = [(1, 0, "a b c"), (1, 1, "d e a"), (1, 2, "b x"), (2, 0, "e"), (2, 1, "a b")]
    split = s.build_postings(spark.createDataFrame(rows, "doc_id int, segment bigint, text string"))
    whole = s.build_postings(spark.createDataFrame([(1, 0, "a b c d e a b x"), (2, 0, "e a b")], "doc_id int, segment bigint, text string"))
    for q in ['"c d"', '"e a b"', '"a b"', "c d", "a e x", '"a b x" or "e a"']:
        found = [sorted((r.doc_id, round(r["rank"], 9)) for r in s.match_docs(p, s.parse_query(q)).collect()) for p in (split, whole)]
        assert found[0] == found[1] and found[0], q


def test_phrase_of_very_many_hits_takes_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, 0, "of the " * n)], "doc_id int, segment bigint, text string")
        postings = s.build_postings(df).cache()
        postings.count()
        began = time.time()
        assert s.match_docs(postings, s.parse_query('"of the" the')).first()["rank"] > 0
        return time.time() - began

    seconds(100)
    small, large = min(seconds(10_000) for _ in range(2)), min(seconds(40_000) for _ in range(2))
    assert large < 8 * small + 1


def test_one_segment_documents_meet_no_join(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string").select("doc_id", F.lit(0).cast("long").alias("segment"), "text")
    assert "Join" not in s.build_postings(df)._jdf.queryExecution().optimizedPlan().toString()


def proposals(spark):
    filler = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame(
        [
            (1, "mp_law", date(2020, 1, 1), "Tax law", filler + " the tax here. " + filler, None, None, "open"),
            (2, "mp_law", date(2021, 1, 1), "Other", "plain summary", "a tax reason", None, "open"),
            (3, "mp_law", date(2022, 1, 1), "Taxes", None, None, "tax change", "open"),
            (4, "mp_law", date(2023, 1, 1), "Tax", "only the title", None, None, "open"),
            (5, "mp_law", date(2023, 1, 1), "Nope", "taxing", None, None, "open"),
        ],
        "id int, ptype string, date date, title string, summary string, reasoning string, law_changes string, status string",
    )


def test_proposal_search(spark):
    props = proposals(spark)
    postings = s.build_postings(s.proposal_docs(props))
    rows = s.search_proposals(props, postings, "tax", 10, 0).collect()
    assert [(r.id, r.total_hits) for r in rows] == [(1, 4), (4, 4), (3, 4), (2, 4)]
    by_id = {r.id: r for r in rows}
    assert by_id[1].title == "<mark>Tax</mark> law"
    assert "the <mark>tax</mark> here." in by_id[1].content_snippet
    assert len(by_id[1].content_snippet.split()) == 30
    assert by_id[2].content_snippet == "a <mark>tax</mark> reason"
    assert by_id[3].content_snippet == "<mark>tax</mark> change"
    assert by_id[4].content_snippet == "only the title"
    assert [r.id for r in s.search_proposals(props, postings, "tax", 2, 2).collect()] == [3, 2]
    assert s.search_proposals(props, postings, " ", 10, 0).count() == 0


def test_signer_names_are_searched_and_overflow_into_segments(spark):
    props = proposals(spark)
    people = spark.createDataFrame([(i, f"First{i}", f"Last{i}") for i in range(9)], "id int, first_name string, last_name string")
    signed = spark.createDataFrame([(2, i) for i in range(9)] + [(5, 0)], "proposal_id int, person_id int")
    docs = s.proposal_docs(props, signed, people, limit=4)
    assert docs.where("doc_id = 2").count() > 1
    postings = s.build_postings(docs)
    for q, expected in [("first8", {2}), ("first0", {2, 5}), ("plain last7 last1", {2}), ('"first3 last3"', {2})]:
        assert {r.doc_id for r in s.match_docs(postings, s.parse_query(q)).collect()} == expected


def test_person_search(spark):
    people = spark.createDataFrame(
        [(1, "Anna", "Berg"), (2, "Berg", "Bergbom"), (3, None, "Lindberg"), (4, "Ville", "100%_x")],
        "id int, first_name string, last_name string")
    m = spark.createDataFrame(
        [(3, "sd", date(2019, 1, 1), None), (3, "kok", date(2015, 1, 1), date(2019, 1, 1))],
        "person_id int, pg_id string, start_date date, end_date date")
    groups = spark.createDataFrame([("sd", "Demarit"), ("kok", "Kokoomus")], "id string, name string")
    ministers = spark.createDataFrame(
        [(1, "Vanha", date(2000, 1, 1), date(2001, 1, 1)), (1, "Uusi", date(2002, 1, 1), None)],
        "person_id int, minister_position string, start_date date, end_date date")
    docs = s.person_docs(people, m, groups, ministers)
    # The index text prefers the ended post, the shown title the current one.
    assert docs.where("id = 1").first().text == "Anna Berg  Vanha"

    def find(q, **kw):
        return s.search_persons(people, docs, m, ministers, q, **kw).collect()

    rows = find("berg")
    assert [(r.id, round(r["rank"], 3), r.total_hits) for r in rows] == [(1, 2.1, 3), (2, 2.1, 3), (3, 0.1, 3)]
    assert rows[0].minister_position == "Uusi" and rows[2].party_id == "kok"
    assert [r.id for r in find("kokoomus")] == [3]
    assert [r.id for r in find("%")] == [4]
    assert len(find("%", parity=True)) == 4
    assert find("") == [] and find(None) == []
    assert [r.id for r in find("berg", limit=1, offset=1)] == [2]


def test_headline_prefers_the_densest_stretch(spark):
    text = "tax " + "x " * 50 + "tax and tax again " + "y " * 50
    df = s.with_headline(spark.createDataFrame([(text,), (None,), ("none here",)], "t string"), "t", ["tax"], "h", 6)
    rows = [r.h for r in df.select("h").collect()]
    assert rows[0] == "x <mark>tax</mark> and <mark>tax</mark> again y"
    assert rows[1:] == ["", "none here"]
