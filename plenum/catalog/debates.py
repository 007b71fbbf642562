"""Queries on debates: threads, responses, participants, speech bodies."""

from pyspark.sql import functions as F

from plenum import bindings as b
from plenum.catalog.bits import MEMBERSHIPS, PERSONS, SPEECHES, with_
from plenum.functions import clean as c
from plenum.operators.temporal import thread_roots
from plenum.plans import readmodels as rm


def _threaded(s, d):
    spoken = b.speeches(s, d).where("role <> 'system'")
    return thread_roots(spoken, ["item_id"], "pos", F.col("is_root"), "id")


def _spoken(s, d, parity=False):
    return rm.speeches_with_speakers(_threaded(s, d), b.persons(s, d), b.memberships(s, d), parity)


THREADED = SPEECHES + """,
threaded AS (
  SELECT *, coalesce(last_value(CASE WHEN is_root THEN id END IGNORE NULLS) OVER (
      PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), id) AS response_to
  FROM speeches WHERE role <> 'system')"""

SPOKEN = """
spoken AS (
  SELECT t.*, p.first_name, p.last_name, p.photo, g.pg_id
  FROM threaded t LEFT JOIN persons p ON p.id = t.person_id LEFT JOIN (
    SELECT person_id, pg_id FROM memberships QUALIFY row_number() OVER (
      PARTITION BY person_id ORDER BY end_date DESC NULLS LAST, start_date DESC, pg_id DESC) = 1
  ) g ON g.person_id = t.person_id)"""


def _agenda(s, d):
    """An item appears in up to three records, under two titles."""
    t = b.table(s, d, "conversations")
    return t.select(
        F.col("conv_id").alias("parliament_id"),
        (F.col("turn") % 3).alias("record_number"),
        F.concat(F.lit("Item "), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") % 2).cast("string")).alias("title"),
    ).distinct()


AGENDA = """
agenda AS (
  SELECT DISTINCT conv_id AS parliament_id, turn % 3 AS record_number, 'Item ' || conv_id || '/' || (turn % 2) AS title
  FROM conversations)"""


def _bodies(s, d):
    """The chair repeats the last paragraph and says one thing that the body lacks."""
    t = b.table(s, d, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("paras"))
    last = F.try_element_at(F.filter(F.transform("paras", lambda p: F.trim(p)), lambda p: p != ""), F.lit(-1))
    chair = F.array(
        F.struct(F.lit("Puhemies").alias("name"), last.alias("text")),
        F.struct(F.lit("Puhemies").alias("name"), F.lit("Kiitos!").alias("text")),
        F.struct(F.lit("").alias("name"), last.alias("text")),
    )
    return t.select("conv_id", "turn", c.assemble_bodies("paras", chair).alias("body"))


QUERIES = {
    "speech_threads": (
        lambda s, d: _threaded(s, d).select("id", "item_id", "pos", "response_to"),
        with_(THREADED) + "SELECT id, item_id, pos, response_to FROM threaded",
    ),
    "debate_nested": (
        lambda s, d: rm.debate_threads(_spoken(s, d)).select(
            "item_id", "id", "person_id", "last_name", "pg_id", "part",
            F.expr(
                "array_join(transform(responses, x -> concat_ws(':', x.id, cast(x.person_id as string), "
                "coalesce(x.pg_id, '-'))), '|')"
            ).alias("responses"),
        ),
        with_(PERSONS, MEMBERSHIPS, THREADED, SPOKEN)
        + """, r AS (SELECT item_id, response_to, string_agg(id || ':' || person_id || ':' || coalesce(pg_id, '-'), '|'
                     ORDER BY start_time, id) AS t
              FROM spoken WHERE response_to <> id GROUP BY 1, 2)
        SELECT s.item_id, s.id, s.person_id, s.last_name, s.pg_id, 0 AS part, coalesce(r.t, '') AS responses
        FROM spoken s LEFT JOIN r ON r.item_id = s.item_id AND r.response_to = s.id WHERE s.response_to = s.id""",
    ),
    "debate_by_start_time": (
        lambda s, d: _spoken(s, d, parity=True).select("item_id", "id", "person_id", "pg_id", "response_to"),
        with_(PERSONS, MEMBERSHIPS, THREADED, SPOKEN)
        + """SELECT item_id, id, person_id, pg_id, response_to FROM spoken
        QUALIFY row_number() OVER (PARTITION BY item_id, start_time ORDER BY id) = 1""",
    ),
    "debate_participants": (
        lambda s, d: rm.debate_participants(_spoken(s, d)).drop("photo"),
        with_(PERSONS, MEMBERSHIPS, THREADED, SPOKEN)
        + """SELECT item_id, person_id, first_name, last_name, pg_id AS party_id FROM spoken
        QUALIFY row_number() OVER (PARTITION BY item_id, person_id ORDER BY start_time, id) = 1""",
    ),
    "orphaned_responses": (
        lambda s, d: rm.orphaned_responses(_threaded(s, d).where("id NOT LIKE '%/0' AND id NOT LIKE '%/1'")).select(
            "item_id", "id", "response_to"
        ),
        with_(THREADED)
        + """, kept AS (SELECT * FROM threaded WHERE id NOT LIKE '%/0' AND id NOT LIKE '%/1')
        SELECT item_id, id, response_to FROM kept k WHERE response_to <> id
        AND NOT EXISTS (SELECT 1 FROM kept r WHERE r.item_id = k.item_id AND r.id = k.response_to AND r.response_to = r.id)""",
    ),
    "speech_item_fanout": (
        lambda s, d: rm.person_speeches(
            b.speeches(s, d).withColumnRenamed("item_id", "agenda_item_parliament_id"), _agenda(s, d)
        ).select("id", "person_id", "title"),
        with_(SPEECHES, AGENDA)
        + """SELECT s.id, s.person_id, min(a.title) AS title FROM speeches s JOIN agenda a ON a.parliament_id = s.item_id
        GROUP BY 1, 2""",
    ),
    "speech_by_start_time": (
        lambda s, d: rm.person_speeches(
            b.speeches(s, d).withColumnRenamed("item_id", "agenda_item_parliament_id"), _agenda(s, d), parity=True
        ).select("id", "person_id", "title"),
        with_(SPEECHES, AGENDA)
        + """SELECT s.id, s.person_id, a.title FROM speeches s JOIN agenda a ON a.parliament_id = s.item_id
        QUALIFY row_number() OVER (PARTITION BY s.person_id, s.start_time ORDER BY s.id, a.title) = 1""",
    ),
    "speech_bodies": (
        lambda s, d: _bodies(s, d),
        """WITH p AS (
          SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
                                            lambda x: x <> '') AS paras FROM conversations),
        q AS (SELECT *, paras[-1] AS c, list_position(paras, paras[-1]) AS pos FROM p)
        SELECT conv_id, turn, array_to_string(
          CASE WHEN c IS NULL THEN ['**Puhemies**: Kiitos!']
          ELSE paras[1:pos - 1] || paras[pos + 1:] || ['**Puhemies**: ' || c, '**Puhemies**: Kiitos!'] END,
          chr(10) || chr(10)) AS body FROM q""",
    ),
}
