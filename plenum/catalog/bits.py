"""The bindings once more, in the oracle's SQL, written apart from the Spark side."""

VOTES = """
raw_votes AS (
  SELECT day(ts)::INT AS ballot_id, user_id AS person_id, ts, event_id,
         CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'no'
                         WHEN 'purchase' THEN 'abstain' WHEN 'error' THEN 'absent' END AS vote
  FROM events),
votes AS (
  SELECT ballot_id, person_id, vote FROM raw_votes WHERE vote IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ballot_id, person_id ORDER BY ts DESC, event_id DESC) = 1)"""

BALLOTS = """
ballots AS (
  SELECT day(ts)::INT AS id, min(ts) AS start_time, 'Ballot ' || day(ts) AS title,
         'Item ' || (day(ts) // 3) AS session_item_title,
         'he ' || (day(ts) // 3) || '/2024 vp' AS parliament_id,
         '/ptk/' || day(ts) AS minutes_url, '/tulos/' || day(ts) AS results_url
  FROM events GROUP BY day(ts))"""

MEMBERSHIPS = """
memberships AS (
  SELECT o_custkey AS person_id, o_orderpriority AS pg_id, o_orderdate::DATE AS start_date,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + (o_orderkey % 700 + 30)::INT END AS end_date,
         o_orderkey AS seq
  FROM orders)"""

PERSONS = """
persons AS (
  SELECT c_custkey AS id, c_mktsegment AS first_name, c_name AS last_name,
         CASE WHEN c_custkey % 3 <> 0 THEN 'photo-' || c_custkey END AS photo
  FROM customer)"""

MINISTERS = """
ministers AS (
  SELECT o_custkey AS person_id, 'Minister ' || substr(o_orderpriority, 1, 1) AS minister_position,
         o_orderdate::DATE AS start_date,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + 365 END AS end_date, o_orderkey AS seq
  FROM orders)"""

PROPOSALS = """
proposals AS (
  SELECT o_orderkey AS id,
         CASE o_orderkey % 3 WHEN 0 THEN 'government' WHEN 1 THEN 'mp_law' ELSE 'mp_petition' END AS ptype,
         o_orderdate::DATE AS date,
         CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'P' THEN 'passed_changed' ELSE 'open' END AS status,
         'Proposal ' || o_orderkey || ' of ' || o_orderpriority AS title
  FROM orders)"""

SIGNATURES = """
signatures AS (
  SELECT l_orderkey AS proposal_id, l_suppkey AS person_id, l_linenumber = 1 AS first FROM lineitem)"""

SPEECHES = """
speeches AS (
  SELECT conv_id || '/' || turn AS id, conv_id AS item_id, turn AS pos, (conv_id * 7 + turn * 3) % 100 AS person_id,
         TIMESTAMP '2024-01-01' + to_minutes(turn) AS start_time, role, text AS body, role = 'user' AS is_root
  FROM conversations)"""

SUPPLIER_PERSONS = """
persons AS (
  SELECT s_suppkey AS id, 'Given' || (s_suppkey % 7) AS first_name, s_name AS last_name FROM supplier)"""

SUPPLIER_MEMBERSHIPS = """
memberships AS (
  SELECT s_suppkey AS person_id,
         CASE WHEN s_acctbal < 3000
              THEN CASE WHEN s_suppkey % 2 = 0 THEN DATE '2024-06-30' ELSE DATE '2023-04-04' END END AS end_date
  FROM supplier)"""

ROLLCALLS = """
numbered AS (
  SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'PTK ' || o_orderkey || '/' || year(o_orderdate) || ' vp'
                 ELSE 'EDK-' || year(o_orderdate) || '-AK-' || o_orderkey END AS rollcall_id
  FROM orders),
rollcalls AS (
  SELECT rollcall_id AS id, o_custkey AS person_id FROM numbered
  WHERE rollcall_id NOT IN ('EDK-1997-AK-1', 'EDK-1998-AK-3')),
records AS (
  SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'HaV' ELSE 'EK' END AS assembly_code, o_orderkey::INT AS number,
         year(o_orderdate)::INT AS year, rollcall_id
  FROM numbered WHERE o_orderstatus = 'F')"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
