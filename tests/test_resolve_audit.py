"""Signers, roll calls, lookups, keys, paging, change detection, audits."""

from datetime import date

from pyspark.sql import functions as F

from plenum import schemas
from plenum.operators import aggregate as a
from plenum.operators import audits as q
from plenum.operators import resolve as r

SIGNER = "doc int, person_id string, first_name string, last_name string"


def persons(spark):
    return spark.createDataFrame(
        [(7, "Matti", "Meikäläinen"), (9, "Matti", "Meikäläinen"), (3, "Eva", "von Konner")],
        "id bigint, first_name string, last_name string",
    )


def test_signers(spark):
    rows = [
        (1, "42", None, None), (2, "*", "Eva", "von Konner"), (3, "4x", "Eva", "von Konner"),
        (4, None, "MATTI ", "Meikäläinen kok"), (5, None, "eva", "Von Konner"), (6, None, "", "von Konner"),
        (7, None, "Sihteeri", "Saari"), (8, None, None, None),
    ]
    found, missing = r.resolve_signers(spark.createDataFrame(rows, SIGNER), persons(spark))
    # A homonym resolves to the smallest id; stars, odd ids and nameless rows are skipped.
    assert {x.doc: x.person_id for x in found.collect()} == {1: 42, 4: 7, 5: 3}
    assert [x.doc for x in missing.collect()] == [7]


def test_homonyms_fan_out_in_the_plain_name_join(spark):
    people = persons(spark).select(F.col("id").alias("person_id"), "first_name", "last_name")
    df = spark.createDataFrame([("Matti", "Meikäläinen"), (None, "x")], "first_name string, last_name string")
    assert sorted(x.person_id for x in r.resolve_by_name(df, people).collect()) == [7, 9]


def test_active_persons(spark):
    m = spark.createDataFrame(
        [(7, None), (7, None), (9, date(2024, 6, 1)), (3, date(2023, 1, 1))], "person_id bigint, end_date date")
    assert [x.person_id for x in r.active_persons(m, persons(spark)).collect()] == [7]
    after = r.active_persons(m, persons(spark), schemas.LOBBY_TARGET_CUTOFF)
    assert sorted(x.person_id for x in after.collect()) == [7, 9]


def test_rollcalls(spark):
    calls = spark.createDataFrame(
        [("PTK 1/2015 vp", 1), ("EDK-1", 2), ("EDK-2", 3), (schemas.BAD_ROLLCALL_IDS[0], 4), ("EDK-3", 5)],
        "id string, person_id int")
    records = spark.createDataFrame(
        [("EK", 12, 2016, "EDK-1"), ("HaV", 1, 2016, "EDK-3"), ("EK", 13, 2016, None)],
        "assembly_code string, number int, year int, rollcall_id string")
    found, lost = r.resolve_rollcalls(calls, records, schemas.BAD_ROLLCALL_IDS)
    assert {(x.person_id, x.record_number, x.record_year) for x in found.collect()} == {(1, 1, 2015), (2, 12, 2016)}
    assert sorted(x.id for x in lost.collect()) == ["EDK-2", "EDK-3"]


def test_lookups(spark):
    left = spark.createDataFrame([(1,), (2,)], "id int")
    dim = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "z", 0)], "id int, v string, n int")
    assert {x.id: x.v for x in r.lookup_first(left, dim, "id", "v", [F.col("n")]).collect()} == {1: "a", 2: None}
    assert {x.id: x.n for x in r.count_per_key(left, dim.select(F.col("id").alias("k")), "id", "k", "n").collect()} == {
        1: 2, 2: 0}
    assert {x.id: x.s for x in r.exists_flag(left, dim, "id", "y", "n", "s").collect()} == {1: "y", 2: "n"}
    assert [x.id for x in r.not_in(left, dim, ["id"]).collect()] == [2]
    assert [x.id for x in r.semi_by_id(left, dim, ["id"]).collect()] == [1]


def test_changed_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "x")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None), (5, "new")], "id int, v string")
    assert sorted(x.id for x in a.changed_rows(old, new, "id", ["v"]).collect()) == [3, 4]


def test_pages_make_up_the_whole(spark):
    df = spark.range(23).select((F.col("id") % 5).alias("o"), "id")
    order = [F.col("o").desc(), F.col("id")]
    whole = [x.id for x in df.orderBy(*order).collect()]
    pages = [x.id for i in range(3) for x in a.page(df, order, 10, i).collect()]
    assert pages == whole
    assert a.page(df, order, 10, 5).count() == 0
    info = df.agg(F.count(F.lit(1)).alias("n")).select(*a.page_info("n", 2, 10)).first()
    assert tuple(info) == (21, 23, 3)


def test_with_total_keeps_the_true_total_past_the_end(spark):
    df = a.with_total(spark.range(7))
    assert {x.total_hits for x in df.collect()} == {7}


def test_active_row_count_counts_rows(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    m = spark.createDataFrame([(1, None), (1, None), (2, date(2020, 1, 1))], "person_id int, end_date date")
    # Two open rows, none for the ended one, one for the person without any.
    assert a.active_row_count(people, m).first()[0] == 3


def test_groups_and_names(spark):
    df = spark.createDataFrame([(1, None, "b"), (1, None, "a"), (1, "g", "c")], "k int, g string, v string")
    got = {(x.k, x.g): [i.v for i in x["items"]] for x in a.group_rows(df, ["k"], "g", [F.col("v")], ["v"]).collect()}
    assert got == {(1, ""): ["a", "b"], (1, "g"): ["c"]}
    assert a.agg_names(df, ["k"], "v", [F.col("v")]).first().names == "a b c"


def test_audits(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    child = spark.createDataFrame(
        [(1, "a", "yes", "ok"), (1, "a", "maybe", "far too long"), (3, "c", None, None), (None, "c", "yes", None)],
        "k int, x string, vote string, text string")
    assert [tuple(x) for x in q.audit_fk(child, parent, ["k"], ["id"]).collect()] == [(3, 1)]
    assert [tuple(x) for x in q.audit_fk(child, parent, ["k", "x"], ["id", "x"]).collect()] == [(3, "c", 1)]
    assert [tuple(x) for x in q.audit_keys(child, ["k", "x"]).collect()] == [(1, "a", 2)]
    assert dict(map(tuple, q.audit_nulls(child, ["k", "text"]).collect())) == {"k": 1, "text": 2}
    assert [tuple(x) for x in q.audit_domain(child, {"vote": schemas.VOTES}).collect()] == [("vote", "maybe", 1)]
    assert [tuple(x) for x in q.audit_length(child, {"text": 5}).collect()] == [("text", 12, 5, False)]


def test_schema_tables_are_complete():
    assert len(schemas.TABLES) == 32
    for child, cols, parent, parent_cols in schemas.REFERENCES:
        names = [n for n, _ in schemas.columns_of(child)]
        targets = [n for n, _ in schemas.columns_of(parent)]
        assert set(cols) <= set(names) and set(parent_cols) <= set(targets)
    for table, limits in schemas.LENGTHS.items():
        assert set(limits) <= {n for n, _ in schemas.columns_of(table)}
