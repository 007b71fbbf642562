"""Queries on voting behaviour."""

from pyspark.sql import functions as F

from plenum import bindings as b
from plenum.catalog.bits import BALLOTS, MEMBERSHIPS, PERSONS, VOTES, with_
from plenum.operators import votes as v
from plenum.plans import readmodels as rm

COUNTS = """
counts AS (
  SELECT m.pg_id, v.ballot_id, v.vote, count(*) AS n
  FROM memberships m JOIN votes v ON m.person_id = v.person_id GROUP BY ALL),
modes AS (
  SELECT pg_id, ballot_id, vote AS mode_vote, n FROM counts
  QUALIFY row_number() OVER (PARTITION BY pg_id, ballot_id
    ORDER BY n DESC, list_position(['yes', 'no', 'abstain', 'absent'], vote)) = 1)"""

# Ballots of the year 2024 are moved 26 years back, into the time of the memberships.
AS_OF = """
dated AS (
  SELECT v.ballot_id, v.person_id, v.vote, m.pg_id
  FROM votes v JOIN ballots b ON v.ballot_id = b.id
  JOIN memberships m ON m.person_id = v.person_id
   AND m.start_date <= (b.start_time - INTERVAL 312 MONTH)::DATE
   AND (m.end_date IS NULL OR (b.start_time - INTERVAL 312 MONTH)::DATE <= m.end_date)),
counts AS (SELECT pg_id, ballot_id, vote, count(*) AS n FROM dated GROUP BY ALL),
modes AS (
  SELECT pg_id, ballot_id, vote AS mode_vote, n FROM counts
  QUALIFY row_number() OVER (PARTITION BY pg_id, ballot_id
    ORDER BY n DESC, list_position(['yes', 'no', 'abstain', 'absent'], vote)) = 1)"""

SCORE = """round(CAST(sum(CASE WHEN vote = mode_vote OR vote = 'absent' THEN 0 ELSE 1 END) AS DOUBLE)
  / nullif(count(vote), 0), 9) AS contra_vote_score"""


def _scores(df):
    return df.withColumn("contra_vote_score", F.round("contra_vote_score", 9))


def _bundle_text(df):
    text = F.expr(
        "array_join(transform(ballots, x -> concat_ws(':', cast(x.ballot_id as string), x.title, x.vote, "
        "x.results_url)), '|')"
    )
    return df.select(
        "person_id", "parliament_id", "part", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        "minutes_url", "session_item_title", text.alias("ballots"),
    )


QUERIES = {
    "contra_vote_scores": (
        lambda s, d: _scores(v.contra_vote_scores(b.memberships(s, d), b.votes(s, d))),
        with_(VOTES, MEMBERSHIPS, COUNTS)
        + f"""SELECT m.person_id, {SCORE}
        FROM modes k JOIN memberships m USING (pg_id)
        JOIN votes v ON v.ballot_id = k.ballot_id AND v.person_id = m.person_id GROUP BY m.person_id""",
    ),
    "group_vote_counts": (
        lambda s, d: v.group_vote_counts(b.memberships(s, d), b.votes(s, d)),
        with_(VOTES, MEMBERSHIPS, COUNTS) + """SELECT pg_id, ballot_id, vote, n AS "count" FROM counts""",
    ),
    "group_mode_vote": (
        lambda s, d: v.group_mode(v.group_vote_counts(b.memberships(s, d), b.votes(s, d))),
        with_(VOTES, MEMBERSHIPS, COUNTS) + """SELECT pg_id, ballot_id, mode_vote, n AS "count" FROM modes""",
    ),
    "group_mode_vote_as_of": (
        lambda s, d: v.group_mode(
            v.group_vote_counts(b.memberships(s, d), b.votes(s, d), b.ballot_dates_in_order_time(s, d))
        ),
        with_(VOTES, BALLOTS, MEMBERSHIPS, AS_OF) + """SELECT pg_id, ballot_id, mode_vote, n AS "count" FROM modes""",
    ),
    "contra_vote_scores_as_of": (
        lambda s, d: _scores(
            v.contra_vote_scores(b.memberships(s, d), b.votes(s, d), b.ballot_dates_in_order_time(s, d))
        ),
        with_(VOTES, BALLOTS, MEMBERSHIPS, AS_OF)
        + f"SELECT person_id, {SCORE} FROM dated JOIN modes USING (pg_id, ballot_id) GROUP BY person_id",
    ),
    "votes_clean": (
        lambda s, d: b.votes(s, d),
        with_(VOTES) + "SELECT ballot_id, person_id, vote FROM votes",
    ),
    "person_votes": (
        lambda s, d: rm.newest_first(
            rm.person_votes(b.votes(s, d), b.ballots(s, d)).select(
                "person_id", "ballot_id", "title", "session_item_title", "vote_label", "minutes_url", "results_url",
                F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
            ),
            "person_id", "start_time", "ballot_id",
        ),
        with_(VOTES, BALLOTS)
        + """SELECT v.person_id, v.ballot_id, b.title, b.session_item_title,
        CASE v.vote WHEN 'yes' THEN 'Jaa' WHEN 'no' THEN 'Ei' WHEN 'abstain' THEN 'Tyhjä' ELSE 'Poissa' END AS vote_label,
        b.minutes_url, b.results_url, strftime(b.start_time, '%Y-%m-%d %H:%M:%S') AS start_time
        FROM votes v LEFT JOIN ballots b ON b.id = v.ballot_id""",
    ),
    "person_votes_bundled": (
        lambda s, d: _bundle_text(rm.person_vote_bundles(b.votes(s, d), b.ballots(s, d))),
        with_(VOTES, BALLOTS)
        + """SELECT v.person_id, b.parliament_id, 0 AS part,
        strftime(max(b.start_time), '%Y-%m-%d %H:%M:%S') AS start_time,
        arg_max(b.minutes_url, b.start_time) AS minutes_url,
        arg_max(b.session_item_title, b.start_time) AS session_item_title,
        string_agg(v.ballot_id || ':' || b.title || ':' || v.vote || ':' || b.results_url, '|'
                   ORDER BY b.start_time DESC, v.ballot_id DESC) AS ballots
        FROM votes v JOIN ballots b ON b.id = v.ballot_id GROUP BY 1, 2""",
    ),
    "proposal_ballots": (
        lambda s, d: rm.proposal_ballots(
            b.ballots(s, d).select(F.col("parliament_id").alias("id")).distinct(), b.ballots(s, d)
        ).select("parliament_id", "ballot_id", "title", "results_url"),
        with_(BALLOTS) + "SELECT parliament_id, id AS ballot_id, title, results_url FROM ballots",
    ),
    "most_rebellious": (
        lambda s, d: _scores(v.contra_vote_scores(b.memberships(s, d), b.votes(s, d)))
        .join(b.persons(s, d).select(F.col("id").alias("person_id"), "first_name", "last_name"), "person_id"),
        with_(VOTES, MEMBERSHIPS, PERSONS, COUNTS)
        + f"""SELECT m.person_id, {SCORE}, any_value(p.first_name) AS first_name, any_value(p.last_name) AS last_name
        FROM modes k JOIN memberships m USING (pg_id)
        JOIN votes v ON v.ballot_id = k.ballot_id AND v.person_id = m.person_id
        JOIN persons p ON p.id = m.person_id GROUP BY m.person_id""",
    ),
}
