"""Queries on lobbying and campaign money."""

from pyspark.sql import functions as F

from plenum import bindings as b
from plenum import schemas
from plenum.catalog.bits import SUPPLIER_MEMBERSHIPS, SUPPLIER_PERSONS, with_
from plenum.functions import clean as c
from plenum.operators.temporal import first_per_key
from plenum.plans import disclosure as p

# Notifications with a topic: not of every fifth or seventh order.
NOTIFIED = """
lines AS (
  SELECT 'C' || o.o_custkey AS lobby_id, year(o.o_orderdate)::INT AS term_id, o.o_orderkey % 1000 AS topic_id,
         CASE WHEN o.o_orderkey % 2 = 0 THEN o.o_orderpriority ELSE 'other ' || o.o_orderstatus END AS topic,
         'P' || (o.o_orderkey % 13) AS project, o.o_orderkey AS seq,
         l.l_suppkey AS target_id, l.l_returnflag, l.l_linestatus
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  WHERE o.o_orderkey % 5 <> 0 AND o.o_orderkey % 7 <> 0)"""

CONTACTED = """
found AS (
  SELECT s_suppkey AS person_id FROM supplier
  WHERE s_suppkey % 10 > 2 AND (s_acctbal >= 3000 OR s_suppkey % 2 = 0)),
contacts AS (
  SELECT lobby_id, term_id, f.person_id, topic_id, unnest([l_returnflag, l_linestatus]) AS contact_method
  FROM lines l JOIN found f ON f.person_id = l.target_id WHERE seq % 11 <> 0)"""


def _actions(s, d):
    return p.build_lobby_actions(
        b.actions(s, d), b.lobby_targets(s, d), b.supplier_memberships(s, d), b.supplier_persons(s, d)
    )


def _budget_rows(s, d):
    """Every amount of a person as a budget whose total the amount is."""
    raw = b.budgets(s, d)
    nothing = [F.lit("''").alias(x) for x in p.BUDGET_AMOUNTS if x != "expenses_total"]
    return raw.select(
        "first_name", "last_name", F.lit("''").alias("support_group"), F.col("amount").alias("expenses_total"), *nothing
    )


def _funding_rows(s, d):
    none = [
        "funder_organization", "funder_company_id", "funder_first_name", "funder_last_name", "loan_title",
        "loan_schedule",
    ]
    return b.budgets(s, d).select(
        "first_name", "last_name", "ftype", "amount", *[F.lit("'x'").alias(x) for x in none]
    )


AMOUNTS = """
amounts AS (
  SELECT l_suppkey AS person_id, l_linenumber, l_orderkey,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_extendedprice * 100)::BIGINT END AS cents
  FROM lineitem)"""

QUERIES = {
    "lobbies": (
        lambda s, d: p.build_lobbies(
            b.actions(s, d).select(
                F.col("company_id").alias("companyId"), F.col("other_company_id").alias("otherCompanyId"),
                F.col("name").alias("companyName"), F.col("industry").alias("mainIndustry"),
            )
        ),
        """SELECT 'C' || o_custkey AS id, 'Company ' || o_custkey || ' ' || o_orderstatus AS name,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS industry FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey
          ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END NULLS LAST, o_orderstatus) = 1""",
    ),
    "first_non_null_per_key": (
        lambda s, d: first_per_key(
            b.actions(s, d).select("term_id", "industry", "name", "seq"), ["term_id"], "industry", ["name", "seq"]
        ),
        """SELECT year(o_orderdate) AS term_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS industry,
        'Company ' || o_custkey || ' ' || o_orderstatus AS name, o_orderkey AS seq FROM orders
        QUALIFY row_number() OVER (PARTITION BY year(o_orderdate)
          ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END NULLS LAST,
                   'Company ' || o_custkey || ' ' || o_orderstatus, o_orderkey) = 1""",
    ),
    "lobby_topics": (
        lambda s, d: p.build_lobby_topics(b.actions(s, d)),
        with_(NOTIFIED)
        + """SELECT topic_id AS id, topic, project FROM lines
        QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY topic, project) = 1""",
    ),
    "lobby_topics_all_texts": (
        lambda s, d: p.build_lobby_topics(b.actions(s, d), parity=True),
        with_(NOTIFIED) + "SELECT DISTINCT topic_id AS id, topic, project FROM lines",
    ),
    "lobby_actions": (
        lambda s, d: _actions(s, d),
        with_(NOTIFIED, CONTACTED) + "SELECT * FROM contacts",
    ),
    "lobby_actions_per_person": (
        lambda s, d: _actions(s, d)
        .groupBy("person_id", "contact_method")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lobby_id").alias("lobbies")),
        with_(NOTIFIED, CONTACTED)
        + """SELECT person_id, contact_method, count(*) AS n, count(DISTINCT lobby_id) AS lobbies
        FROM contacts GROUP BY ALL""",
    ),
    "lobby_terms": (
        lambda s, d: p.build_lobby_terms(
            b.iso_times(s, d).select(
                "id", F.col("raw").alias("reportingStartDate"), F.col("raw").alias("reportingEndDate")
            )
        ).select(
            "id", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
            F.date_format("end_date", "yyyy-MM-dd").alias("end_date"),
        ),
        """SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS start_date, strftime(ts, '%Y-%m-%d') AS end_date
        FROM events""",
    ),
    "topics": (
        lambda s, d: p.build_topics(
            b.table(s, d, "part").select(
                F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("topic_id"),
                F.col("p_name").alias("term"),
            )
        ),
        "SELECT 'p' || lpad(p_partkey::VARCHAR, 6, '0') AS topic_id, p_name AS term FROM part",
    ),
    "money_parse": (
        lambda s, d: b.budgets(s, d).select(
            "seq", "line", (c.parse_money("amount") * 100).cast("long").alias("cents")
        ),
        with_(AMOUNTS) + "SELECT l_orderkey AS seq, l_linenumber AS line, coalesce(cents, 0) AS cents FROM amounts",
    ),
    "campaign_totals": (
        lambda s, d: p.build_election_budgets(
            _budget_rows(s, d), b.supplier_memberships(s, d), b.supplier_persons(s, d)
        )
        .groupBy("person_id", "election_year")
        .agg((F.sum("expenses_total") * 100).cast("long").alias("cents"), F.count(F.lit(1)).alias("n")),
        with_(AMOUNTS)
        + """SELECT person_id, 2023 AS election_year, CAST(sum(coalesce(cents, 0)) AS BIGINT) AS cents, count(*) AS n
        FROM amounts JOIN supplier ON s_suppkey = person_id WHERE s_acctbal >= 3000 GROUP BY 1""",
    ),
    "funding_types": (
        lambda s, d: p.build_election_fundings(
            _funding_rows(s, d), b.supplier_memberships(s, d), b.supplier_persons(s, d)
        )
        .groupBy("ftype")
        .agg((F.sum("amount") * 100).cast("long").alias("cents"), F.count(F.lit(1)).alias("n"),
             F.count("amount").alias("amounts")),
        with_(AMOUNTS)
        + """SELECT (['loan', 'person', 'company', 'party', 'party_union', 'other', 'forwarded'])[l_linenumber] AS ftype,
        CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n, count(cents) AS amounts
        FROM amounts JOIN supplier ON s_suppkey = person_id WHERE s_acctbal >= 3000 GROUP BY 1""",
    ),
    "promises": (
        lambda s, d: p.build_promises(
            b.table(s, d, "lineitem").join(
                b.supplier_persons(s, d).withColumnRenamed("id", "l_suppkey"), "l_suppkey"
            ).select(
                F.col("first_name").alias("firstName"), F.col("last_name").alias("lastName"),
                F.concat(F.lit("promise "), F.col("l_partkey").cast("string")).alias("promise"),
            ),
            b.supplier_memberships(s, d), b.supplier_persons(s, d),
        ).select("person_id", "promise", "election_year"),
        """SELECT l_suppkey AS person_id, 'promise ' || l_partkey AS promise, 2023 AS election_year
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 3000""",
    ),
    "code_labels": (
        lambda s, d: b.budgets(s, d)
        .groupBy(c.mapped(c.strip_quotes("ftype"), {**schemas.FUNDING_CODES, "2.8": "muu"}, "keep").alias("label"))
        .agg(F.count(F.lit(1)).alias("n")),
        """SELECT (['loan', 'person', 'company', 'party', 'party_union', 'other', 'muu'])[l_linenumber] AS label,
        count(*) AS n FROM lineitem GROUP BY 1""",
    ),
}
