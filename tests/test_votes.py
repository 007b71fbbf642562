"""Ties, absent modes, NULL votes, several groups and periods."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plenum.operators import votes as v


@pytest.fixture(scope="module")
def tables(spark):
    votes = spark.createDataFrame(
        [
            (1, 1, "yes"), (1, 2, "no"),                      # a tie inside group a
            (2, 1, "absent"), (2, 2, "absent"), (2, 3, "yes"),  # absent is the mode of a
            (3, 1, "yes"), (3, 2, "yes"), (3, 3, None),         # a NULL vote
        ],
        "ballot_id int, person_id bigint, vote string",
    )
    d = date(2019, 1, 1)
    memberships = spark.createDataFrame(
        [
            (1, "a", d, None), (2, "a", d, date(2020, 1, 1)), (2, "a", date(2021, 1, 1), None),  # two periods in a
            (3, "a", d, None), (3, "b", d, None),                                                # two groups
        ],
        "person_id bigint, pg_id string, start_date date, end_date date",
    )
    return memberships, votes


def brute(memberships, votes):
    pairs = [
        (m.pg_id, x.ballot_id, m.person_id, x.vote)
        for m in memberships.collect() for x in votes.collect() if m.person_id == x.person_id
    ]
    counts = {}
    for pg, ballot, _, vote in pairs:
        counts[pg, ballot, vote] = counts.get((pg, ballot, vote), 0) + 1
    order = ["yes", "no", "abstain", "absent", None]
    modes = {}
    for pg, ballot in {(k[0], k[1]) for k in counts}:
        options = [(-n, order.index(vote), vote) for (p, b, vote), n in counts.items() if (p, b) == (pg, ballot)]
        modes[pg, ballot] = min(options)[2]
    scores = {}
    for person in {p for _, _, p, _ in pairs}:
        mine = [(modes[pg, b], vote) for pg, b, p, vote in pairs if p == person]
        contra = sum(0 if (vote is not None and vote in (mode, "absent")) else 1 for mode, vote in mine)
        counted = sum(vote is not None for _, vote in mine)
        scores[person] = contra / counted if counted else None
    return counts, modes, scores


def test_against_brute_force(tables):
    memberships, votes = tables
    counts, modes, scores = brute(memberships, votes)
    got = v.group_vote_counts(memberships, votes)
    assert {(r.pg_id, r.ballot_id, r.vote): r["count"] for r in got.collect()} == counts
    assert {(r.pg_id, r.ballot_id): r.mode_vote for r in v.group_mode(got).collect()} == modes
    result = v.contra_vote_scores(memberships, votes).collect()
    assert {r.person_id: r.contra_vote_score for r in result} == scores


def test_tie_goes_to_the_first_enum_value(spark):
    counts = spark.createDataFrame(
        [("a", 1, "absent", 2), ("a", 1, "no", 2), ("a", 1, None, 2)],
        "pg_id string, ballot_id int, vote string, count bigint",
    )
    assert v.group_mode(counts).first().mode_vote == "no"


def test_counts_add_up_to_the_join(tables):
    memberships, votes = tables
    total = v.group_vote_counts(memberships, votes).agg(F.sum("count")).first()[0]
    assert total == memberships.join(votes, "person_id").count()


def test_only_null_votes_give_no_score(spark):
    m = spark.createDataFrame([(1, "a", None, None)], "person_id bigint, pg_id string, start_date date, end_date date")
    x = spark.createDataFrame([(1, 1, None)], "ballot_id int, person_id bigint, vote string")
    assert v.contra_vote_scores(m, x).first().contra_vote_score is None


def test_as_of_counts_only_memberships_in_force(spark):
    m = spark.createDataFrame(
        [(1, "old", date(2019, 1, 1), date(2019, 3, 15)), (1, "new", date(2019, 3, 16), None)],
        "person_id bigint, pg_id string, start_date date, end_date date",
    )
    x = spark.createDataFrame([(1, 1, "yes"), (2, 1, "no"), (3, 1, "no")], "ballot_id int, person_id bigint, vote string")
    b = spark.createDataFrame(
        [(1, datetime(2019, 3, 15, 12)), (2, datetime(2019, 3, 16, 12)), (3, datetime(2018, 1, 1))],
        "id int, start_time timestamp",
    )
    got = {(r.pg_id, r.ballot_id) for r in v.group_vote_counts(m, x, b).collect()}
    assert got == {("old", 1), ("new", 2)}


def test_votes_meet_memberships_once(spark):
    from pyspark.sql import functions as F

    members = spark.range(400).select((F.col("id") % 50).alias("person_id"), (F.col("id") % 7).cast("string").alias("pg_id"))
    votes = spark.range(2000).select((F.col("id") % 40).alias("ballot_id"), (F.col("id") % 50).alias("person_id"), F.element_at(F.array(*map(F.lit, ["yes", "no", "absent"])), (F.col("id") % 3 + 1).cast("int")).alias("vote"))
    df = v.contra_vote_scores(members, votes)
    assert len(df.collect()) == 50
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    # The salted exchange that both the counts and the scores read is computed once.
    assert any("ReusedExchange" in line and "_salt" in line for line in final.split("\n"))
