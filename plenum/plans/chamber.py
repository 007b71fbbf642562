"""Ballots, votes, sessions, election seasons and absences -> typed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions.clean import date_prefix, helsinki_ts, lower_id, map_codes, project
from plenum.operators.resolve import resolve_rollcalls

# The ballot file has 32 columns; those in use, by position (fixed values).
BALLOT_FIELDS = {
    0: "id", 1: "language", 9: "start_time", 12: "title", 21: "session_item_title",
    28: "results_url", 30: "minutes_url", 31: "parliament_id",
}
BALLOT_RAW = ", ".join(f"`{BALLOT_FIELDS.get(i, f'c{i}')}` string" for i in range(32))
VOTE_RAW = "person_id int, ballot_id int, vote string"


def build_ballots(raw: DataFrame) -> DataFrame:
    """Ballots in Finnish; times are local."""
    return project(
        raw.where(F.col("language") == "1"),
        {
            "id": F.col("id").try_cast("int"),
            "title": "title",
            "session_item_title": "session_item_title",
            "start_time": helsinki_ts("start_time"),
            "parliament_id": lower_id("parliament_id"),
            "minutes_url": "minutes_url",
            "results_url": "results_url",
        },
    )


def build_votes(raw: DataFrame) -> DataFrame:
    """Votes with a known code."""
    return map_codes(raw, "vote", schemas.VOTE_CODES).select("ballot_id", "person_id", "vote")


def build_sessions(raw: DataFrame) -> DataFrame:
    return project(raw, {"id": "id", "date": date_prefix("date")})


def build_election_seasons(raw: DataFrame) -> DataFrame:
    return project(raw, {"start_date": date_prefix("start_date"), "end_date": date_prefix("end_date")})


def build_absences(
    absentees: DataFrame, records: DataFrame, excluded: Sequence[str] = tuple(schemas.BAD_ROLLCALL_IDS)
) -> tuple[DataFrame, DataFrame]:
    """Absentees (id = roll call, person_id, work_related) with their meeting; and the unmatched rest."""
    found, unmatched = resolve_rollcalls(absentees, records, excluded)
    return found.drop("id"), unmatched
