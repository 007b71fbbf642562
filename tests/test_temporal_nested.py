"""Latest-row policies, thread roots, nesting; also when one group holds most rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from plenum.operators import nested as n
from plenum.operators import temporal as t


@pytest.fixture(scope="module")
def memberships(spark):
    return spark.createDataFrame(
        [
            (1, "ended", date(2015, 1, 1), date(2019, 1, 1)), (1, "ongoing", date(2019, 1, 2), None),
            (2, "x", date(2011, 1, 1), None), (2, "y", date(2011, 1, 1), None),
            (3, "unknown", None, None), (3, "known", date(2000, 1, 1), date(2001, 1, 1)),
        ],
        "person_id int, pg_id string, start_date date, end_date date",
    )


@pytest.mark.parametrize(
    "policy, expected",
    [
        ("ended_first", {1: "ended", 2: "y", 3: "known"}),
        ("current_first", {1: "ongoing", 2: "y", 3: "unknown"}),
        ("by_start", {1: "ongoing", 2: "y", 3: "known"}),
        ("last_by_start", {1: "ongoing", 2: "y", 3: "unknown"}),
    ],
)
def test_policies(memberships, policy, expected):
    got = t.latest_interval(memberships, ["person_id"], policy, ties=["pg_id"])
    assert {r.person_id: r.pg_id for r in got.collect()} == expected


def test_latest_is_limited_before_the_shuffle(memberships):
    plan = t.latest_interval(memberships, ["person_id"], "by_start")._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Exchange")[1]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_unknown_policy():
    with pytest.raises(ValueError):
        t.interval_order("newest")


def roots_by_hand(rows):
    last, out = {}, {}
    for doc, pos, rid, root in sorted(rows):
        if root:
            last[doc] = rid
        out[rid] = last.get(doc, rid)
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_thread_roots(spark, block):
    # Document 0 holds most rows; document 9 starts with a response.
    rows = [(0, p, f"0/{p}", p % 7 == 2) for p in range(60)] + [(9, p, f"9/{p}", p == 3) for p in range(6)]
    df = spark.createDataFrame(rows, "doc int, pos int, id string, root boolean")
    got = t.thread_roots(df, ["doc"], "pos", F.col("root"), "id", block=block)
    assert {r.id: r.response_to for r in got.collect()} == roots_by_hand(rows)


@pytest.fixture(scope="module")
def skewed(spark):
    # Key 1 has 1,000 of 1,020 rows, a third of them with the same leading order value.
    return spark.range(1020).select(
        F.when(F.col("id") < 1000, 1).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("o"),
        "id",
    )


def nested_rows(df, limit, **kw):
    out = n.nest_sorted(df, ["k"], [F.col("o"), F.col("id")], ["id"], limit=limit, **kw)
    return [(r.k, r.part, [x.id for x in r["items"]]) for r in out.collect()]


def test_nesting_in_one_part(skewed):
    rows = nested_rows(skewed, 100_000)
    assert len(rows) == 21 and all(part == 0 for _, part, _ in rows)


@pytest.mark.parametrize("limit", [1, 7, 100, 999])
def test_a_hot_group_is_split_and_stays_whole_and_ordered(skewed, limit):
    whole = {k: items for k, _, items in nested_rows(skewed, 100_000)}
    rows = sorted(nested_rows(skewed, limit))
    assert all(len(items) <= limit for _, _, items in rows)
    joined = {}
    for k, _, items in rows:
        joined.setdefault(k, []).extend(items)
    assert joined == whole
    assert len([1 for k, _, _ in rows if k == 1]) >= 1000 // limit


def test_last_element_of_an_empty_list(spark):
    df = spark.sql("SELECT array() AS a UNION ALL SELECT array(1, 2)")
    assert {r[0] for r in df.select(n.last_element("a")).collect()} == {None, 2}


def test_explodes(spark):
    df = spark.createDataFrame([(1, [1, None]), (2, []), (3, None)], "k int, a array<int>")
    assert [(r.k, r.a) for r in n.explode_drop(df, "a").collect()] == [(1, 1)]
    assert sorted((r.k, str(r.a)) for r in n.explode_keep(df, "a").collect()) == [
        (1, "1"), (1, "None"), (2, "None"), (3, "None")]


@pytest.mark.parametrize("sample", [1, 5, n.SAMPLE])
@pytest.mark.parametrize("limit", [1, 3, 250])
def test_parts_follow_from_the_place_alone(skewed, limit, sample):
    df = skewed.withColumn("k", F.when(F.col("k") > 2, F.col("k")))  # many rows of the null key
    want = {}
    for r in df.orderBy("o", "id").collect():
        want.setdefault(r.k, []).append(r.id)
    cut = {(k, p): ids[p * limit : (p + 1) * limit] for k, ids in want.items() for p in range(-(-len(ids) // limit))}
    assert {(k, p): ids for k, p, ids in nested_rows(df, limit, sample=sample)} == cut


def test_unnest_and_children(spark):
    df = spark.sql("SELECT 7 AS key, named_struct('a', 1, 'b', 2) AS s, array(named_struct('x', 1, 'y', 2)) AS kids")
    assert n.unnest(df, "s", drop=["b"]).columns == ["key", "kids", "a"]
    assert n.flatten_children(df, ["key"], "kids", ["y"]).collect() == [(7, 2)]


def test_other_values(spark):
    df = spark.sql(
        "SELECT array(named_struct('pg_id','a'), named_struct('pg_id','-'), named_struct('pg_id','b'), "
        "named_struct('pg_id','a'), named_struct('pg_id','c')) AS g")
    got = df.select(n.other_values("g", "pg_id", F.lit("c"), "-").alias("v")).first().v
    assert got == ["a", "b"]


def test_with_nested_gives_empty_lists(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    nested = n.nest_sorted(spark.createDataFrame([(1, 5)], "k int, v int"), ["k"], [F.col("v")], ["v"])
    got = {r.k: len(r["items"]) for r in n.with_nested(left, nested, ["k"], "items").collect()}
    assert got == {1: 1, 2: 0}
