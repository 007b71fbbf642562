"""Voting behaviour: votes per group, the usual vote of a group, the rebel score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.operators.temporal import latest_per_key
from plenum.schemas import VOTES

# Parts of a group's votes in a ballot, a power of two.
SALTS = 32


def vote_ordinal(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_position(F.array(*[F.lit(v) for v in VOTES]), c)


def votes_by_group(memberships: DataFrame, votes: DataFrame, ballots: DataFrame | None = None) -> DataFrame:
    """(pg_id, ballot_id, person_id, vote, n): each vote under every group of its voter.

    Without ``ballots`` the dates are ignored: a vote counts in every group the
    person ever belonged to, once per membership period. Memberships are folded
    to one row per (person, group) first, so repeated periods cost nothing in
    the join. With ``ballots`` only memberships in force at the ballot count;
    the join then runs on (person, month), which also splits a busy person.
    """
    if ballots is None:
        folded = memberships.groupBy("person_id", "pg_id").agg(F.count(F.lit(1)).alias("n"))
        return votes.select("ballot_id", "person_id", "vote").join(folded, "person_id")

    held = ballots.select(F.col("id").alias("ballot_id"), F.to_date("start_time").alias("held_on"))
    last_day = held.agg(F.max("held_on").alias("d")).scalar()
    stop = F.least(F.coalesce("end_date", last_day), last_day)
    periods = (
        memberships.select("person_id", "pg_id", "start_date", "end_date", stop.alias("_stop"))
        .where(F.col("start_date") <= F.col("_stop"))
        .withColumn(
            "_month",
            F.explode(
                F.sequence(F.trunc("start_date", "MM"), F.trunc("_stop", "MM"), F.expr("interval 1 month"))
            ),
        )
    )
    dated = (
        votes.select("ballot_id", "person_id", "vote")
        .join(held, "ballot_id")
        .withColumn("_month", F.trunc("held_on", "MM"))
    )
    return (
        dated.join(periods, ["person_id", "_month"])
        .where(
            (F.col("start_date") <= F.col("held_on"))
            & (F.col("end_date").isNull() | (F.col("held_on") <= F.col("end_date")))
        )
        .select("person_id", "ballot_id", "vote", "pg_id", F.lit(1).cast("long").alias("n"))
    )


def group_vote_counts(memberships: DataFrame, votes: DataFrame, ballots: DataFrame | None = None) -> DataFrame:
    """Votes per (group, ballot, vote)."""
    return (
        votes_by_group(memberships, votes, ballots)
        .groupBy("pg_id", "ballot_id", "vote")
        .agg(F.sum("n").alias("count"))
    )


def group_mode(counts: DataFrame) -> DataFrame:
    """Most common vote per (group, ballot); ties go to the first enum value, a NULL vote last."""
    order = [F.col("count").desc(), vote_ordinal("vote").asc_nulls_last()]
    return latest_per_key(counts, ["pg_id", "ballot_id"], order).withColumnRenamed("vote", "mode_vote")


def contra_vote_scores(memberships: DataFrame, votes: DataFrame, ballots: DataFrame | None = None) -> DataFrame:
    """Share of a person's votes that differ from the mode of their group.

    An absent vote is never contra but stays in the denominator; a NULL vote is
    contra and does not.
    """
    # Votes meet the memberships once: both uses below read one exchange, of which a group's ballot is SALTS parts, never one.
    cast_votes = (
        votes_by_group(memberships, votes, ballots)
        .select("person_id", "pg_id", "ballot_id", "vote", "n")
        .withColumn("_salt", F.xxhash64("person_id").bitwiseAND(F.lit(SALTS - 1).cast("long")))
        .repartition("pg_id", "ballot_id", "_salt")
    )
    # Counted with the voters, so that the exchange has the same columns for both.
    parts = cast_votes.groupBy("pg_id", "ballot_id", "_salt", "vote").agg(F.sum(F.when(F.col("person_id").isNotNull(), F.col("n"))).alias("n"))
    modes = group_mode(parts.groupBy("pg_id", "ballot_id", "vote").agg(F.sum("n").alias("count"))).select(
        "pg_id", "ballot_id", "mode_vote", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("_salt")
    )
    loyal = (F.col("vote") == F.col("mode_vote")) | (F.col("vote") == F.lit("absent"))
    contra = F.sum(F.when(loyal, F.lit(0)).otherwise(F.col("n"))).cast("double")
    counted = F.sum(F.when(F.col("vote").isNotNull(), F.col("n")).otherwise(0)).cast("double")
    return (
        cast_votes.join(modes, ["pg_id", "ballot_id", "_salt"])
        .groupBy("person_id")
        .agg((contra / F.nullif(counted, F.lit(0.0))).alias("contra_vote_score"))
    )
