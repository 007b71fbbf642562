"""Queries on proposals, signatures, reports and their status."""

from pyspark.sql import functions as F

from plenum import bindings as b
from plenum.catalog.bits import PROPOSALS, SIGNATURES, SUPPLIER_PERSONS, with_
from plenum.functions import clean as c
from plenum.operators import aggregate as a
from plenum.operators import resolve as r
from plenum.operators.temporal import dedupe_by
from plenum.plans import readmodels as rm

# A supplier signs; its groups change with the years of a few orders of the same number.
SIGNER_MEMBERSHIPS = """
memberships AS (
  SELECT o_custkey % 100 AS person_id, o_orderpriority AS pg_id, o_orderdate::DATE AS start_date
  FROM orders WHERE o_custkey % 100 <> 13)"""

SIGNERS = """
signers AS (
  SELECT p.id, p.first_name, p.last_name, m.pg_id FROM persons p JOIN (
    SELECT person_id, pg_id FROM memberships
    QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY start_date DESC NULLS LAST, pg_id DESC) = 1
  ) m ON m.person_id = p.id)"""


def _memberships(s, d):
    return b.table(s, d, "orders").where("o_custkey % 100 <> 13").select(
        (F.col("o_custkey") % 100).alias("person_id"), F.col("o_orderpriority").alias("pg_id"),
        F.to_date("o_orderdate").alias("start_date"),
    )


def _signatures(s, d):
    """One row per (proposal, person): a first signature wins."""
    return b.signatures(s, d).groupBy("proposal_id", "person_id").agg(F.max("first").alias("first"))


def _persons(s, d):
    return b.supplier_persons(s, d).withColumn("photo", F.lit(None).cast("string"))


def _proposals(s, d):
    return b.proposals(s, d).withColumn("status", c.map_status("status_code")).drop("status_code")


def _signature_text(col):
    return F.expr(
        f"array_join(transform({col}, x -> concat_ws(':', cast(x.id as string), x.first_name, x.last_name, "
        "cast(cast(x.first as int) as string), x.party_id)), '|')"
    )


DEDUPED = SIGNATURES.replace("signatures AS", "all_signatures AS") + """,
signatures AS (SELECT proposal_id, person_id, bool_or(first) AS first FROM all_signatures GROUP BY ALL)"""

NESTED_SQL = """
nested AS (
  SELECT s.proposal_id, string_agg(p.id || ':' || p.first_name || ':' || p.last_name || ':' || s.first::INT || ':' || p.pg_id,
         '|' ORDER BY s.first DESC, p.last_name, p.first_name, p.id) AS signatures
  FROM signatures s JOIN signers p ON p.id = s.person_id GROUP BY 1)"""

REPORTS = "reports AS (SELECT l_orderkey AS proposal_id FROM lineitem WHERE l_returnflag = 'R')"

QUERIES = {
    "proposal_signatures_nested": (
        lambda s, d: rm.proposal_signatures(_signatures(s, d), _persons(s, d), _memberships(s, d)).select(
            "proposal_id", "part", _signature_text("signatures").alias("signatures")
        ),
        with_(SUPPLIER_PERSONS, SIGNER_MEMBERSHIPS, DEDUPED, SIGNERS, NESTED_SQL)
        + "SELECT proposal_id, 0 AS part, signatures FROM nested",
    ),
    "proposal_list": (
        lambda s, d: rm.proposal_list(
            _proposals(s, d), _signatures(s, d), _persons(s, d), _memberships(s, d), b.reports(s, d)
        ).select(
            "id", "ptype", "status", "title", F.date_format("date", "yyyy-MM-dd").alias("date"), "part",
            "committee_report_count", _signature_text("signatures").alias("signatures"),
        ),
        with_(PROPOSALS, SUPPLIER_PERSONS, SIGNER_MEMBERSHIPS, DEDUPED, SIGNERS, NESTED_SQL, REPORTS)
        + """SELECT p.id, p.ptype, p.status, p.title, strftime(p.date, '%Y-%m-%d') AS date, 0 AS part,
        (SELECT count(*) FROM reports r WHERE r.proposal_id = p.id) AS committee_report_count,
        coalesce(n.signatures, '') AS signatures
        FROM proposals p LEFT JOIN nested n ON n.proposal_id = p.id""",
    ),
    "proposal_page": (
        lambda s, d: rm.proposal_page(_proposals(s, d), 10, 3).select("id", "ptype", "title"),
        with_(PROPOSALS) + "SELECT id, ptype, title FROM proposals ORDER BY date DESC, id LIMIT 10 OFFSET 30",
    ),
    "proposal_report_count": (
        lambda s, d: r.count_per_key(b.proposals(s, d).select("id"), b.reports(s, d), "id", "proposal_id", "n"),
        with_(PROPOSALS, REPORTS)
        + "SELECT p.id, (SELECT count(*) FROM reports r WHERE r.proposal_id = p.id) AS n FROM proposals p",
    ),
    "own_initiatives": (
        lambda s, d: rm.own_initiatives(
            _signatures(s, d).withColumn("proposal_id", F.col("proposal_id").cast("string")),
            _proposals(s, d).select(
                F.col("id").cast("string"), "ptype", "date", "title", "status",
                F.lit(None).cast("string").alias("summary"),
                F.repeat(F.concat("title", F.lit(" ")), (F.col("id") % 40).cast("int")).alias("reasoning"),
            ),
        ).select("person_id", "proposal_id", "title", F.date_format("date", "yyyy-MM-dd").alias("date"), "excerpt",
                 "status_label"),
        with_(PROPOSALS, DEDUPED)
        + """, long AS (SELECT *, repeat(title || ' ', (id % 40)::INT) AS reasoning FROM proposals)
        SELECT s.person_id, s.proposal_id::VARCHAR AS proposal_id, p.title, strftime(p.date, '%Y-%m-%d') AS date,
        CASE WHEN len(string_split(p.reasoning, ' ')) <= 80 THEN p.reasoning
             ELSE array_to_string(string_split(p.reasoning, ' ')[1:80], ' ') || '...' END AS excerpt,
        CASE p.status WHEN 'passed' THEN 'Hyväksytty' WHEN 'passed_changed' THEN 'Hyväksytty muutettuna'
                      ELSE 'Avoin' END AS status_label
        FROM signatures s JOIN long p ON p.id = s.proposal_id WHERE s.first AND p.ptype <> 'government'""",
    ),
    "signature_dedupe": (
        lambda s, d: _signatures(s, d).withColumn("first", F.col("first").cast("int")),
        with_(DEDUPED) + "SELECT proposal_id, person_id, first::INT AS first FROM signatures",
    ),
    "signature_distinct_rows": (
        lambda s, d: b.signatures(s, d).distinct().groupBy("proposal_id").agg(F.count(F.lit(1)).alias("n")),
        with_(SIGNATURES)
        + "SELECT proposal_id, count(*) AS n FROM (SELECT DISTINCT * FROM signatures) GROUP BY 1",
    ),
    "signature_first_seen": (
        lambda s, d: dedupe_by(
            b.table(s, d, "lineitem").select(
                F.col("l_orderkey").alias("report_id"), F.col("l_suppkey").alias("person_id"), "l_linenumber", "l_partkey"
            ),
            ["report_id", "person_id"], [F.col("l_linenumber"), F.col("l_partkey")],
        ),
        """SELECT l_orderkey AS report_id, l_suppkey AS person_id, l_linenumber, l_partkey FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) = 1""",
    ),
    "signer_names": (
        lambda s, d: a.agg_names(
            _signatures(s, d).join(_persons(s, d).withColumnRenamed("id", "person_id"), "person_id"),
            ["proposal_id"], F.concat_ws(" ", "first_name", "last_name"), [F.col("person_id")],
        ),
        with_(SUPPLIER_PERSONS, DEDUPED)
        + """SELECT proposal_id, 0 AS part, string_agg(first_name || ' ' || last_name, ' ' ORDER BY person_id) AS names
        FROM signatures JOIN persons ON id = person_id GROUP BY 1""",
    ),
    "map_status": (
        lambda s, d: _proposals(s, d).select("id", "status"),
        with_(PROPOSALS) + "SELECT id, status FROM proposals",
    ),
    "status_lookup_first": (
        lambda s, d: r.lookup_first(
            b.proposals(s, d).select("id"),
            b.table(s, d, "lineitem").select(
                F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey",
                F.when(F.col("l_returnflag") == "R", "Rejected").when(F.col("l_returnflag") == "A", "PassedUrgent").alias("code"),
            ),
            "id", "code", [F.col("l_linenumber"), F.col("l_partkey"), F.col("code").asc_nulls_first()],
        ).select("id", c.map_status("code").alias("status")),
        with_(PROPOSALS)
        + """, f AS (SELECT l_orderkey, l_returnflag FROM lineitem
          QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                                     (['', 'passed_urgent', 'rejected'])[list_position(['N', 'A', 'R'], l_returnflag)]) = 1)
        SELECT id, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'passed_urgent' ELSE 'open' END AS status
        FROM proposals LEFT JOIN f ON l_orderkey = id""",
    ),
    "handled_flag": (
        lambda s, d: r.exists_flag(
            b.proposals(s, d).where("ptype = 'mp_petition'").select("id"),
            b.reports(s, d).select(F.col("proposal_id").alias("id")), "id", "handled", "open", "status",
        ),
        with_(PROPOSALS, REPORTS)
        + """SELECT id, CASE WHEN id IN (SELECT proposal_id FROM reports) THEN 'handled' ELSE 'open' END AS status
        FROM proposals WHERE ptype = 'mp_petition'""",
    ),
    "union_kinds": (
        lambda s, d: a.union_kinds(
            {
                k: b.proposals(s, d).where(F.col("ptype") == k).select("id", "title")
                for k in ("government", "mp_law", "mp_petition")
            }
        ),
        with_(PROPOSALS) + "SELECT id, title, ptype FROM proposals",
    ),
    "surrogate_keys": (
        lambda s, d: r.assign_key(
            b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]
        )
        .groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("n").agg(F.count(F.lit(1)).alias("keys")),
        """SELECT n, count(*) AS "keys" FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) GROUP BY 1""",
    ),
}
