"""Queries on persons, memberships and their latest state."""

from pyspark.sql import functions as F

from plenum import bindings as b
from plenum import schemas
from plenum.catalog.bits import (
    MEMBERSHIPS, MINISTERS, PERSONS, SUPPLIER_MEMBERSHIPS, SUPPLIER_PERSONS, with_,
)
from plenum.functions import clean as c
from plenum.operators import aggregate as a
from plenum.operators import resolve as r
from plenum.operators.temporal import distinct_values, latest_interval
from plenum.plans import readmodels as rm


def _iso(col):
    return F.date_format(col, "yyyy-MM-dd")


def _latest(policy):
    def run(s, d):
        out = latest_interval(b.memberships(s, d), ["person_id"], policy, ties=["pg_id", "seq"])
        return out.select("person_id", "pg_id", _iso("start_date").alias("start_date"))

    return run


def _latest_sql(order):
    return (
        with_(MEMBERSHIPS)
        + f"""SELECT person_id, pg_id, strftime(start_date, '%Y-%m-%d') AS start_date FROM memberships
        QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY {order}, pg_id DESC, seq DESC) = 1"""
    )


def _groups(s, d):
    m = b.memberships(s, d)
    return m.select(F.col("pg_id").alias("id"), F.upper("pg_id").alias("name")).distinct()


PERIODS = (
    "array_join(transform({col}, x -> concat_ws(':', {fields}, cast(x.start_date as string), "
    "coalesce(cast(x.end_date as string), '-'))), '|')"
)


def _person_groups(s, d):
    out = rm.person_list(b.persons(s, d), b.memberships(s, d), _groups(s, d), b.minister_posts(s, d))
    return out.select(
        "id", "first_name", "last_name", "part",
        F.expr(PERIODS.format(col="parliamentary_groups", fields="x.pg_id, x.name")).alias("parliamentary_groups"),
        F.expr(PERIODS.format(col="minister_positions", fields="x.name")).alias("minister_positions"),
    )


LAST = """
last AS (
  SELECT person_id, pg_id, end_date FROM memberships
  QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY start_date DESC NULLS FIRST, pg_id DESC) = 1),
active AS (
  SELECT p.id, p.first_name, p.last_name, l.pg_id FROM persons p LEFT JOIN last l ON l.person_id = p.id
  WHERE l.end_date IS NULL)"""


def _unambiguous(s, d):
    """Memberships with one row per (person, start, group), so that every order is total."""
    return b.memberships(s, d).groupBy("person_id", "start_date", "pg_id").agg(
        F.max("end_date").alias("end_date")
    )


UNAMBIGUOUS = MEMBERSHIPS.replace("memberships AS", "every_membership AS") + """,
memberships AS (
  SELECT person_id, start_date, pg_id, max(end_date) AS end_date FROM every_membership GROUP BY ALL)"""


def _roles(s, d):
    m = b.memberships(s, d)
    code = F.element_at(
        F.array(*[F.lit(x) for x in ("Jäsen", "varajäsen", "Puheenjohtaja", "varapuheenjohtaja", "lisäjäsen")]),
        (F.col("seq") % 5 + 1).cast("int"),
    )
    return m.select("person_id", "seq", "start_date", "end_date", F.col("pg_id").alias("committee_name"), code.alias("raw"))


ROLES = """
roles AS (
  SELECT person_id, seq, start_date, end_date, pg_id AS committee_name,
         (['member', 'associate', 'chair', 'first vice', 'additional'])[seq % 5 + 1] AS role,
         (['jäsen', 'varajäsen', 'puheenjohtaja', 'ensimmäinen varapuheenjohtaja', 'lisäjäsen'])[seq % 5 + 1] AS role_label
  FROM memberships)"""


def _interests(s, d):
    """Order lines as disclosed interests in five categories, one of them missing."""
    k = F.col("l_orderkey") % 5
    cat = (
        F.when(k == 0, schemas.POST_CATEGORIES[0])
        .when(k == 1, schemas.POST_CATEGORIES[1])
        .when(k == 2, "Lahjat")
        .when(k == 3, "Tulot")
    )
    text = F.when(F.col("l_linenumber") == 7, schemas.NOTHING_TO_DECLARE[0]).when(
        F.col("l_linenumber") != 6, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    )
    rows = b.table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("person_id"), cat.alias("category"), text.alias("interest"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
    )
    return c.drop_sentinels(rows, "interest", schemas.NOTHING_TO_DECLARE)


INTERESTS = f"""
interests AS (
  SELECT l_suppkey AS person_id, l_orderkey * 100 + l_linenumber AS id,
         CASE l_orderkey % 5 WHEN 0 THEN '{schemas.POST_CATEGORIES[0]}' WHEN 1 THEN '{schemas.POST_CATEGORIES[1]}'
                             WHEN 2 THEN 'Lahjat' WHEN 3 THEN 'Tulot' END AS category,
         'part ' || l_partkey AS interest
  FROM lineitem WHERE l_linenumber < 6)"""


def _interest_text(df):
    return df.select(
        "person_id", "category", "part",
        F.expr("array_join(transform(interests, x -> x.interest), '|')").alias("interests"),
    )


def _signers(s, d):
    """Signers with an id, with only a name, with a starred id or without either."""
    li = b.table(s, d, "lineitem")
    p = b.supplier_persons(s, d).withColumnRenamed("id", "l_suppkey")
    n = F.col("l_linenumber")
    return li.join(p, "l_suppkey").select(
        F.col("l_orderkey").alias("proposal_id"),
        n.alias("line"),
        F.when(n == 1, F.col("l_suppkey").cast("string")).when(n == 2, "*").alias("person_id"),
        F.when(n == 3, "").when(n == 6, "Nobody").otherwise(F.upper("first_name")).alias("first_name"),
        F.when(n == 4, F.concat(F.col("last_name"), F.lit(" kok"))).otherwise(F.col("last_name")).alias("last_name"),
        (n == 1).alias("first"),
    )


QUERIES = {
    "latest_group_ended_first": (
        _latest("ended_first"), _latest_sql("end_date DESC NULLS LAST, start_date DESC NULLS FIRST")),
    "latest_group_current_first": (
        _latest("current_first"), _latest_sql("end_date DESC NULLS FIRST, start_date DESC NULLS FIRST")),
    "latest_group_by_start": (_latest("by_start"), _latest_sql("start_date DESC NULLS LAST")),
    "latest_group_last_by_start": (_latest("last_by_start"), _latest_sql("start_date DESC NULLS FIRST")),
    "person_groups_nested": (
        _person_groups,
        with_(PERSONS, MEMBERSHIPS, MINISTERS)
        + """, g AS (SELECT person_id, string_agg(pg_id || ':' || upper(pg_id) || ':' || start_date || ':' ||
               coalesce(end_date::VARCHAR, '-'), '|' ORDER BY start_date, pg_id, end_date IS NULL, end_date) AS t
             FROM memberships GROUP BY 1),
        mi AS (SELECT person_id, string_agg(minister_position || ':' || start_date || ':' ||
               coalesce(end_date::VARCHAR, '-'), '|' ORDER BY start_date, minister_position, end_date IS NULL, end_date) AS t
             FROM ministers GROUP BY 1)
        SELECT p.id, p.first_name, p.last_name, 0 AS part, coalesce(g.t, '') AS parliamentary_groups,
               coalesce(mi.t, '') AS minister_positions
        FROM persons p LEFT JOIN g ON g.person_id = p.id LEFT JOIN mi ON mi.person_id = p.id""",
    ),
    "active_person_list": (
        lambda s, d: rm.active_list(b.persons(s, d), _unambiguous(s, d)).drop("photo"),
        with_(PERSONS, UNAMBIGUOUS, LAST) + "SELECT * FROM active",
    ),
    "active_row_count": (
        lambda s, d: a.active_row_count(b.persons(s, d), b.memberships(s, d)),
        with_(PERSONS, MEMBERSHIPS)
        + """SELECT count(*) AS "count" FROM persons p LEFT JOIN memberships m ON m.person_id = p.id
        WHERE m.end_date IS NULL""",
    ),
    "person_page": (
        lambda s, d: rm.person_page(b.persons(s, d), _unambiguous(s, d), 20, 2).drop("photo"),
        with_(PERSONS, UNAMBIGUOUS, LAST)
        + "SELECT * FROM active ORDER BY last_name NULLS LAST, id LIMIT 20 OFFSET 40",
    ),
    "person_page_info": (
        lambda s, d: rm.active_list(b.persons(s, d), _unambiguous(s, d))
        .agg(F.count(F.lit(1)).alias("total"))
        .select("total", *a.page_info("total", 2, 20)),
        with_(PERSONS, UNAMBIGUOUS, LAST)
        + """SELECT count(*) AS total, least(41, count(*)) AS page_min, least(60, count(*)) AS page_max,
        CAST(ceil(count(*) / 20.0) AS BIGINT) AS last_page FROM active""",
    ),
    "person_cards": (
        lambda s, d: rm.person_cards(b.persons(s, d), _unambiguous(s, d), b.minister_posts(s, d)).select(
            "id", "last_name", "pg_id", "minister_position"
        ),
        with_(PERSONS, UNAMBIGUOUS, MINISTERS, LAST)
        + """, post AS (SELECT person_id, minister_position, end_date FROM ministers
          QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY start_date DESC NULLS FIRST,
                                     minister_position DESC) = 1)
        SELECT a.id, a.last_name, a.pg_id, CASE WHEN p.end_date IS NULL THEN p.minister_position END AS minister_position
        FROM active a LEFT JOIN post p ON p.person_id = a.id""",
    ),
    "person_header": (
        lambda s, d: rm.person_header(b.persons(s, d), _unambiguous(s, d)).select(
            "id", "first_name", "last_name", "current", "years", "part", F.array_join("former", "|").alias("former")
        ),
        with_(PERSONS, UNAMBIGUOUS, LAST)
        + """, per_group AS (SELECT person_id, pg_id, min(start_date) AS first_start FROM memberships GROUP BY ALL),
        former AS (SELECT g.person_id, string_agg(g.pg_id, '|' ORDER BY first_start, g.pg_id) AS t
          FROM per_group g JOIN last l USING (person_id) WHERE g.pg_id <> l.pg_id AND g.pg_id <> '-' GROUP BY 1)
        SELECT p.id, p.first_name, p.last_name, l.pg_id AS "current", 0 AS part,
               (SELECT year(min(start_date)) FROM memberships m WHERE m.person_id = p.id) || ' - ' ||
               coalesce(l.end_date::VARCHAR, '...') AS years, coalesce(f.t, '') AS former
        FROM persons p JOIN last l ON l.person_id = p.id LEFT JOIN former f ON f.person_id = p.id""",
    ),
    "committee_roles": (
        lambda s, d: rm.committee_roles(_roles(s, d).withColumn("role", c.map_role("raw"))).select(
            "person_id", "committee_name", "part",
            F.expr(PERIODS.format(col="roles", fields="x.role_label")).alias("roles"),
        ),
        with_(MEMBERSHIPS, ROLES)
        + """SELECT person_id, committee_name, 0 AS part, string_agg(role_label || ':' || start_date || ':' ||
        coalesce(end_date::VARCHAR, '-'), '|' ORDER BY start_date, role, end_date IS NULL, end_date) AS roles
        FROM roles GROUP BY ALL""",
    ),
    "map_roles": (
        lambda s, d: _roles(s, d).select("seq", c.map_role("raw").alias("role")),
        with_(MEMBERSHIPS, ROLES) + "SELECT seq, role FROM roles",
    ),
    "post_interests": (
        lambda s, d: _interest_text(rm.interests_by_category(_interests(s, d), posts=True)),
        with_(INTERESTS)
        + f"""SELECT person_id, category, 0 AS part, string_agg(interest, '|' ORDER BY interest, id) AS interests
        FROM interests WHERE category IN ('{schemas.POST_CATEGORIES[0]}', '{schemas.POST_CATEGORIES[1]}') GROUP BY ALL""",
    ),
    "other_interests": (
        lambda s, d: _interest_text(rm.interests_by_category(_interests(s, d), posts=False)),
        with_(INTERESTS)
        + f"""SELECT person_id, category, 0 AS part, string_agg(interest, '|' ORDER BY interest, id) AS interests
        FROM interests WHERE category NOT IN ('{schemas.POST_CATEGORIES[0]}', '{schemas.POST_CATEGORIES[1]}') GROUP BY ALL""",
    ),
    "harmonize_groups": (
        lambda s, d: b.memberships(s, d).select(
            "seq",
            c.harmonize(
                F.when(F.col("seq") % 4 == 0, F.lit("Vihreä eduskuntaryhmä"))
                .when(F.col("seq") % 4 == 1, F.lit("Eduskuntaryhmään kuulumaton"))
                .when(F.col("seq") % 4 == 2, F.lit("Liike Nyt-Movement's Parliamentary Group"))
                .otherwise(F.col("pg_id"))
            ).alias("pg_id"),
        ),
        with_(MEMBERSHIPS)
        + """SELECT seq, CASE seq % 4 WHEN 0 THEN 'vihr' WHEN 1 THEN '-' WHEN 2 THEN 'liik' ELSE lower(pg_id) END AS pg_id
        FROM memberships""",
    ),
    "distinct_groups": (
        lambda s, d: distinct_values(b.memberships(s, d), "pg_id"),
        "SELECT DISTINCT o_orderpriority AS pg_id FROM orders WHERE o_orderpriority IS NOT NULL",
    ),
    "static_plus_discovered": (
        lambda s, d: a.union_fill(
            s.createDataFrame([("URG", "1-URGENT"), ("X", "9-UNSEEN")], "code string, name string"),
            r.not_in(
                b.memberships(s, d).select(F.col("pg_id").alias("name")).distinct(),
                s.createDataFrame([("1-URGENT",), ("9-UNSEEN",)], "name string"), ["name"],
            ),
        ),
        """SELECT * FROM (VALUES ('URG', '1-URGENT'), ('X', '9-UNSEEN')) t(code, name)
        UNION ALL SELECT DISTINCT NULL, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '9-UNSEEN')""",
    ),
    "active_persons": (
        lambda s, d: r.active_persons(
            b.supplier_memberships(s, d), b.supplier_persons(s, d), schemas.LOBBY_TARGET_CUTOFF
        ),
        with_(SUPPLIER_PERSONS, SUPPLIER_MEMBERSHIPS)
        + """SELECT DISTINCT p.id AS person_id, p.first_name, p.last_name FROM memberships m
        JOIN persons p ON p.id = m.person_id WHERE m.end_date IS NULL OR m.end_date > DATE '2024-01-01'""",
    ),
    "name_resolution": (
        lambda s, d: r.resolve_by_name(
            b.lobby_targets(s, d).select(
                F.col("id").alias("target_id"),
                c.name_tokens("name", 0).alias("first_name"), c.name_tokens("name", 1).alias("last_name"),
            ),
            r.active_persons(b.supplier_memberships(s, d), b.supplier_persons(s, d)),
        ).select("target_id", "person_id"),
        with_(SUPPLIER_PERSONS, SUPPLIER_MEMBERSHIPS)
        + """, targets AS (SELECT s_suppkey AS target_id, 'Given' || (s_suppkey % 7) AS first_name, s_name AS last_name
          FROM supplier WHERE s_suppkey % 10 > 2)
        SELECT DISTINCT t.target_id, p.id AS person_id FROM targets t JOIN persons p USING (first_name, last_name)
        JOIN memberships m ON m.person_id = p.id WHERE m.end_date IS NULL""",
    ),
    "signer_resolution": (
        lambda s, d: r.resolve_signers(_signers(s, d), b.supplier_persons(s, d))[0].select(
            "proposal_id", "line", "person_id"
        ),
        """SELECT l_orderkey AS proposal_id, l_linenumber AS line, l_suppkey AS person_id FROM lineitem
        WHERE l_linenumber NOT IN (2, 3, 6)""",
    ),
    "audit_unmatched": (
        lambda s, d: a.union_fill(
            _unmatched_signers(s, d),
        ),
        """SELECT 'signer' AS kind, count(*) AS "rows", count(DISTINCT l_orderkey) AS "keys"
        FROM lineitem WHERE l_linenumber = 6""",
    ),
    "export_keys": (
        lambda s, d: rm.export_keys(
            b.persons(s, d), b.proposals(s, d).select(F.concat(F.lit("he "), F.col("id").cast("string"), F.lit("/99")).alias("id")),
            b.documents(s, d).select("title"),
        ),
        """SELECT 'person' AS kind, c_mktsegment || '+' || c_name AS "key" FROM customer
        UNION SELECT 'proposal', 'he+' || o_orderkey || '-99' FROM orders
        UNION SELECT 'item', split_part(text, chr(10), 1) FROM documents""",
    ),
}


def _unmatched_signers(s, d):
    from plenum.operators.audits import audit_unmatched

    missing = r.resolve_signers(_signers(s, d), b.supplier_persons(s, d))[1]
    return audit_unmatched({"signer": missing}, "proposal_id")
