"""Queries on roll calls, dates, document routing, refresh and audits."""

from pyspark.sql import functions as F

from plenum import bindings as b
from plenum import schemas
from plenum.catalog.bits import BALLOTS, MEMBERSHIPS, MINISTERS, PERSONS, PROPOSALS, ROLLCALLS, SIGNATURES, VOTES, with_
from plenum.functions import clean as c
from plenum.operators import aggregate as a
from plenum.operators import audits as q
from plenum.plans import chamber
from plenum.sources.writers import with_doc_type


def _iso(col):
    return F.date_format(col, "yyyy-MM-dd")


def _absences(s, d):
    absentees = b.rollcalls(s, d).withColumn("work_related", c.has_note(F.array(F.lit("(e)"), F.lit("x"))))
    return chamber.build_absences(absentees, b.records(s, d), b.rollcall_exclusions(s, d))


# A PTK id is its own meeting; any other needs a plenary record.
RESOLVED = """
resolved AS (
  SELECT r.person_id, 'EK' AS record_assembly_code,
         CASE WHEN r.id LIKE 'PTK%' THEN split_part(split_part(r.id, ' ', 2), '/', 1)::INT ELSE m.number END AS record_number,
         CASE WHEN r.id LIKE 'PTK%' THEN split_part(split_part(r.id, '/', 2), ' ', 1)::INT ELSE m.year END AS record_year
  FROM rollcalls r LEFT JOIN (SELECT * FROM records WHERE assembly_code = 'EK') m ON m.rollcall_id = r.id
  WHERE r.id LIKE 'PTK%' OR m.rollcall_id IS NOT NULL)"""


def _new_documents(s, d):
    k = F.col("id")
    return b.documents(s, d).select(
        "id",
        F.when(k % 13 == 0, F.lit(None)).when(k % 9 == 0, F.concat("summary", F.lit("!"))).otherwise(F.col("summary"))
        .alias("summary"),
        "reasoning",
    )


def _model(s, d):
    """The given tables as the model's, every seventh person and every fifth record gone and some titles cut off, so that each audit finds something."""
    k = F.col("id")
    return {
        "persons": b.persons(s, d).where(k % 7 != 0),
        "ballots": b.ballots(s, d).where(k % 6 != 0),
        "votes": b.votes(s, d).withColumn("vote", F.when(F.col("ballot_id") == 9, "maybe").otherwise(F.col("vote"))),
        "mp_parliamentary_group_memberships": b.memberships(s, d).drop("seq"),
        "ministers": b.minister_posts(s, d).drop("seq"),
        "proposals": b.proposals(s, d).select(
            k.cast("string").alias("id"), F.when(k % 4 != 0, F.col("ptype")).otherwise("else").alias("ptype"),
            F.when(k % 5 == 0, F.repeat("title", F.lit(100))).otherwise(F.col("title")).alias("title")),
        "proposal_signatures": b.signatures(s, d).withColumn("proposal_id", F.when(F.col("person_id") % 9 != 0, F.col("proposal_id").cast("string"))),
        "records": b.records(s, d).where("number % 5 <> 0"),
        "absences": _absences(s, d)[0].withColumn("record_year", F.when(F.col("person_id") % 3 != 0, F.col("record_year"))),
    }


MODEL = """
m_persons AS (SELECT * FROM persons WHERE id % 7 <> 0),
m_ballots AS (SELECT * FROM ballots WHERE id % 6 <> 0),
m_votes AS (SELECT ballot_id, person_id, CASE WHEN ballot_id = 9 THEN 'maybe' ELSE vote END AS vote FROM votes),
m_mp_parliamentary_group_memberships AS (SELECT * FROM memberships),
m_ministers AS (SELECT * FROM ministers),
m_proposals AS (SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 4 <> 0 THEN ptype ELSE 'else' END AS ptype,
                CASE WHEN id % 5 = 0 THEN repeat(title, 100) ELSE title END AS title FROM proposals),
m_proposal_signatures AS (SELECT CASE WHEN person_id % 9 <> 0 THEN CAST(proposal_id AS VARCHAR) END AS proposal_id, person_id FROM signatures),
m_records AS (SELECT * FROM records WHERE number % 5 <> 0),
m_absences AS (SELECT person_id, record_assembly_code, record_number, CASE WHEN person_id % 3 <> 0 THEN record_year END AS record_year FROM resolved)"""
# What the tables above have of the model's columns.
MODEL_COLUMNS = {
    "persons": "id first_name last_name photo", "ballots": "id title session_item_title parliament_id minutes_url results_url",
    "votes": "ballot_id person_id vote", "mp_parliamentary_group_memberships": "pg_id person_id start_date end_date",
    "ministers": "person_id minister_position start_date end_date", "proposals": "id ptype title", "proposal_signatures": "proposal_id person_id first",
    "records": "assembly_code number year rollcall_id", "absences": "person_id record_assembly_code record_number record_year work_related",
}


def _model_sql():
    """Each audit of the declared model as a count of its own."""
    columns = {t: c.split() for t, c in MODEL_COLUMNS.items()}
    rows = []

    def add(table, audit, subject, count):
        rows.append(f"SELECT '{table}' AS \"table\", '{audit}' AS audit, '{subject}' AS subject, ({count}) AS n")

    for t, there in columns.items():
        key = schemas.TABLES[t][1]
        if set(key) <= set(there):
            add(t, "key", ",".join(key), f"SELECT count(*) FROM (SELECT 1 FROM m_{t} GROUP BY {', '.join(key)} HAVING count(*) > 1)")
        for c in key:
            if c in there:
                add(t, "null", c, f"SELECT count(*) FROM m_{t} WHERE {c} IS NULL")
        for c, values in schemas.DOMAINS.get(t, {}).items():
            if c in there:
                add(t, "domain", c, f"SELECT count(*) FROM m_{t} WHERE {c} NOT IN ({', '.join(repr(v) for v in values)})")
        for c, limit in schemas.LENGTHS.get(t, {}).items():
            if c in there:
                add(t, "length", c, f"SELECT count(*) FROM m_{t} WHERE length({c}) > {limit}")
    for child, cols, parent, keys in schemas.REFERENCES:
        if child in columns and parent in columns and set(cols) <= set(columns[child]):
            same = " AND ".join(f"p.{k} = c.{c}" for c, k in zip(cols, keys))
            given = " AND ".join(f"c.{c} IS NOT NULL" for c in cols)
            add(child, "reference", f"{','.join(cols)} -> {parent}",
                f"SELECT count(*) FROM m_{child} c WHERE {given} AND NOT EXISTS (SELECT 1 FROM m_{parent} p WHERE {same})")
    return with_(VOTES, BALLOTS, MEMBERSHIPS, PERSONS, MINISTERS, PROPOSALS, SIGNATURES, ROLLCALLS, RESOLVED, MODEL) + (
        "SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE n > 0")


QUERIES = {
    "audit_model": (lambda s, d: q.audit_model(_model(s, d)), _model_sql()),
    "rollcall_resolution": (
        lambda s, d: _absences(s, d)[0].select(
            "person_id", "record_assembly_code", "record_number", "record_year",
            F.col("work_related").cast("int").alias("work_related"),
        ),
        with_(ROLLCALLS, RESOLVED) + "SELECT *, 1 AS work_related FROM resolved",
    ),
    "rollcall_unmatched": (
        lambda s, d: _absences(s, d)[1].groupBy("id").agg(F.count(F.lit(1)).alias("n")),
        with_(ROLLCALLS)
        + """SELECT id, count(*) AS n FROM rollcalls WHERE id NOT LIKE 'PTK%'
        AND id NOT IN (SELECT rollcall_id FROM records WHERE assembly_code = 'EK') GROUP BY 1""",
    ),
    "rollcall_numbers": (
        lambda s, d: b.rollcalls(s, d).select(
            "id", F.array_join(F.transform(c.ints_in("id"), lambda x: x.cast("string")), "/").alias("numbers")
        ),
        """SELECT id, array_to_string(regexp_extract_all(id, '\\d+'), '/') AS numbers FROM (
        SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'PTK ' || o_orderkey || '/' || year(o_orderdate) || ' vp'
               ELSE 'EDK-' || year(o_orderdate) || '-AK-' || o_orderkey END AS id FROM orders)""",
    ),
    "partial_dates": (
        lambda s, d: b.raw_dates(s, d).select(
            "id", _iso(c.complete_date("raw", "start")).alias("start_date"),
            _iso(c.complete_date("raw", "end")).alias("end_date"), _iso(c.parse_dmy("raw")).alias("full_date"),
        ),
        """SELECT o_orderkey AS id,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN year(o_orderdate) || '-01-01'
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start_date,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN year(o_orderdate) || '-12-31'
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS end_date,
        CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN NULL
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS full_date
        FROM orders""",
    ),
    "iso_utc_dates": (
        lambda s, d: b.iso_times(s, d).select("id", _iso(c.iso_utc_date("raw")).alias("day")),
        "SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day FROM events",
    ),
    "helsinki_times": (
        lambda s, d: b.iso_times(s, d).select(
            "id", F.unix_seconds(c.helsinki_ts(F.substring("raw", 1, 19))).alias("epoch")
        ),
        # January: two hours ahead of UTC.
        "SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) - 7200 AS epoch FROM events",
    ),
    "ballots": (
        lambda s, d: chamber.build_ballots(
            b.table(s, d, "events").select(
                F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 2).cast("string").alias("language"),
                F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_time"), F.col("event_type").alias("title"),
                F.col("props").alias("session_item_title"), F.lit("/r").alias("results_url"),
                F.lit("/m").alias("minutes_url"),
                F.concat(F.lit("HE "), F.col("user_id").cast("string"), F.lit("/2024 vp")).alias("parliament_id"),
            )
        ).select("id", "title", "session_item_title", "parliament_id", F.unix_seconds("start_time").alias("epoch")),
        """SELECT event_id::INT AS id, event_type AS title, props AS session_item_title,
        'he ' || user_id || '/2024 vp' AS parliament_id, CAST(floor(epoch(ts)) AS BIGINT) - 7200 AS epoch
        FROM events WHERE event_id % 2 = 1""",
    ),
    "sessions": (
        lambda s, d: chamber.build_sessions(
            b.iso_times(s, d).select("id", F.col("raw").alias("date"))
        ).select("id", _iso("date").alias("date")),
        "SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS date FROM events",
    ),
    "election_seasons": (
        lambda s, d: chamber.build_election_seasons(
            b.table(s, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
                F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("start_date"),
                F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("end_date"),
            )
        ).select(_iso("start_date").alias("start_date"), _iso("end_date").alias("end_date")),
        """SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS start_date, strftime(max(o_orderdate), '%Y-%m-%d') AS end_date
        FROM orders GROUP BY year(o_orderdate)""",
    ),
    "documents_by_type": (
        lambda s, d: with_doc_type(b.raw_documents(s, d), "xml", "_fr").select("doc_id", "doctype"),
        "SELECT doc_id, source || '_' || lang AS doctype FROM documents WHERE lang = 'fr'",
    ),
    "type_counts": (
        lambda s, d: with_doc_type(b.raw_documents(s, d), "xml", "").groupBy("doctype").agg(F.count(F.lit(1)).alias("n")),
        "SELECT source || '_' || lang AS doctype, count(*) AS n FROM documents GROUP BY 1",
    ),
    "empty_twins": (
        lambda s, d: c.drop_empty_twins(b.documents_with_twins(s, d), "id", "summary").select("id"),
        "SELECT doc_id AS id FROM documents WHERE doc_id % 70 <> 0",
    ),
    "lonely_empties": (
        lambda s, d: c.lonely_empties(b.documents_with_twins(s, d), "id", "summary"),
        "SELECT doc_id AS id FROM documents WHERE doc_id % 70 = 0",
    ),
    "changed_rows": (
        lambda s, d: a.changed_rows(
            b.documents(s, d).select("id", "summary", "reasoning"), _new_documents(s, d), "id", ["summary", "reasoning"]
        ).select("id", F.length("summary").alias("length")),
        """SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE length(text) + 1 END AS length
        FROM documents WHERE doc_id % 13 = 0 OR doc_id % 9 = 0""",
    ),
    "squashed_titles": (
        lambda s, d: b.documents(s, d).select("id", c.clean_title(F.concat(F.lit("  a -— b \t"), "title")).alias("title")),
        """SELECT doc_id AS id, trim(regexp_replace('a - b ' || split_part(text, chr(10), 1), '[\\s\\p{Z}\\x{0b}\\x{85}]+', ' ', 'g'))
        AS title FROM documents""",
    ),
    "count_rows": (
        lambda s, d: a.count_rows(b.documents(s, d)),
        'SELECT count(*) AS "count" FROM documents',
    ),
    "audit_keys": (
        lambda s, d: q.audit_keys(b.memberships(s, d), ["pg_id", "person_id", "start_date"]).select(
            "pg_id", "person_id", _iso("start_date").alias("start_date"), "n"
        ),
        with_(MEMBERSHIPS)
        + """SELECT pg_id, person_id, strftime(start_date, '%Y-%m-%d') AS start_date, count(*) AS n FROM memberships
        GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    ),
    "audit_fk": (
        lambda s, d: q.audit_fk(
            b.votes(s, d), b.persons(s, d).where("id % 7 <> 0"), ["person_id"], ["id"]
        ),
        with_(VOTES) + "SELECT person_id, count(*) AS n FROM votes WHERE person_id % 7 = 0 GROUP BY 1",
    ),
    "audit_nulls": (
        lambda s, d: q.audit_nulls(
            b.memberships(s, d).join(b.persons(s, d).withColumnRenamed("id", "person_id"), "person_id"),
            ["person_id", "end_date", "photo"],
        ),
        with_(MEMBERSHIPS)
        + """SELECT * FROM (SELECT 'person_id' AS "column", 0 AS nulls
        UNION ALL SELECT 'end_date', count(*) FROM memberships WHERE end_date IS NULL
        UNION ALL SELECT 'photo', count(*) FROM memberships WHERE person_id % 3 = 0)""",
    ),
    "audit_domain": (
        lambda s, d: q.audit_domain(
            b.proposals(s, d), {"ptype": schemas.PROPOSAL_TYPES[1:], "status_code": ["PassedChanged"]}
        ),
        """SELECT 'ptype' AS "column", 'government' AS value, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT 'status_code', 'Passed', count(*) FROM orders WHERE o_orderstatus = 'F'""",
    ),
    "audit_length": (
        lambda s, d: q.audit_length(b.documents(s, d), {"title": 1000, "summary": 100_000, "ptype": 1}).withColumn(
            "ok", F.col("ok").cast("int")
        ),
        """SELECT "column", longest, allowed, (longest <= allowed)::INT AS ok FROM (
        SELECT 'title' AS "column", max(length(split_part(text, chr(10), 1))) AS longest, 1000 AS allowed FROM documents
        UNION ALL SELECT 'summary', max(length(text)), 100000 FROM documents
        UNION ALL SELECT 'ptype', max(length(lang)), 1 FROM documents)""",
    ),
    "audit_table": (
        lambda s, d: q.audit_table(
            "memberships", b.memberships(s, d), ["pg_id", "person_id", "start_date"], ["end_date", "person_id"],
            {"pg_id": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]}, {"pg_id": 10},
        ),
        with_(MEMBERSHIPS)
        + """SELECT 'memberships' AS "table", audit, subject, n FROM (
        SELECT 'key' AS audit, 'pg_id,person_id,start_date' AS subject, count(*) AS n FROM (
          SELECT 1 FROM memberships GROUP BY pg_id, person_id, start_date HAVING count(*) > 1)
        UNION ALL SELECT 'null', 'end_date', count(*) FROM memberships WHERE end_date IS NULL
        UNION ALL SELECT 'domain', 'pg_id', count(*) FROM memberships
          WHERE pg_id NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
        UNION ALL SELECT 'length', 'pg_id', max(length(pg_id)) FROM memberships HAVING max(length(pg_id)) > 10)
        WHERE n > 0""",
    ),
}
