"""The given tables, shaped like the domain tables.

Every function takes (spark, folder) and derives a domain-shaped frame from the
Parquet tables of that folder, over all of their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum import schemas
from plenum.functions.clean import map_codes
from plenum.operators.temporal import latest_per_key
from plenum.sources.readers import widen


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- votes, ballots, memberships, persons ---------------------------------------

RAW_VOTE = {"click": "Jaa", "view": "Ei", "purchase": " Tyhjää ", "error": "Poissa"}


def raw_votes(spark: SparkSession, folder: str) -> DataFrame:
    code = F.lit("?")
    for kind, raw in RAW_VOTE.items():
        code = F.when(F.col("event_type") == kind, F.lit(raw)).otherwise(code)
    return table(spark, folder, "events").select(
        F.dayofmonth("ts").alias("ballot_id"),
        F.col("user_id").alias("person_id"),
        code.alias("vote"),
        "ts",
        "event_id",
    )


def votes(spark: SparkSession, folder: str) -> DataFrame:
    known = map_codes(raw_votes(spark, folder), "vote", schemas.VOTE_CODES)
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return latest_per_key(known, ["ballot_id", "person_id"], order).drop("ts", "event_id")


def ballots(spark: SparkSession, folder: str) -> DataFrame:
    """One ballot per day of the month; several ballots share an item."""
    return (
        table(spark, folder, "events")
        .groupBy(F.dayofmonth("ts").alias("id"))
        .agg(F.min("ts").alias("start_time"))
        .select(
            "id",
            "start_time",
            F.concat(F.lit("Ballot "), F.col("id").cast("string")).alias("title"),
            F.concat(F.lit("Item "), F.floor(F.col("id") / 3).cast("string")).alias("session_item_title"),
            F.concat(F.lit("he "), F.floor(F.col("id") / 3).cast("string"), F.lit("/2024 vp")).alias("parliament_id"),
            F.concat(F.lit("/ptk/"), F.col("id").cast("string")).alias("minutes_url"),
            F.concat(F.lit("/tulos/"), F.col("id").cast("string")).alias("results_url"),
        )
    )


def memberships(spark: SparkSession, folder: str) -> DataFrame:
    """One period per order; those of open orders are ongoing. Periods may overlap."""
    start, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderpriority").alias("pg_id"),
        start.alias("start_date"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(start, (k % 700 + 30).cast("int"))).alias("end_date"),
        k.alias("seq"),
    )


def ballot_dates_in_order_time(spark: SparkSession, folder: str) -> DataFrame:
    """Ballots moved 26 years back so that they fall among the membership periods."""
    return ballots(spark, folder).select("id", F.add_months("start_time", -12 * 26).alias("start_time"))


def persons(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("photo-"), F.col("c_custkey").cast("string"))).alias(
            "photo"
        ),
    )


def minister_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a post, ending after a year unless the order is open."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("person_id"),
        F.concat(F.lit("Minister "), F.substring("o_orderpriority", 1, 1)).alias("minister_position"),
        F.to_date("o_orderdate").alias("start_date"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(F.to_date("o_orderdate"), 365)).alias("end_date"),
        F.col("o_orderkey").alias("seq"),
    )


# --- proposals, signatures, reports -------------------------------------------------


def proposals(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("o_orderkey") % 3
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(kind == 0, "government").when(kind == 1, "mp_law").otherwise("mp_petition").alias("ptype"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "Passed")
        .when(F.col("o_orderstatus") == "P", "PassedChanged")
        .alias("status_code"),
        F.concat(F.lit("Proposal "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.col("o_orderpriority")).alias(
            "title"
        ),
    )


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Signers by supplier number; the same pair occurs several times on purpose."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("proposal_id"),
        F.col("l_suppkey").alias("person_id"),
        (F.col("l_linenumber") == 1).alias("first"),
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .where("l_returnflag = 'R'")
        .select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
            F.col("l_orderkey").alias("proposal_id"),
        )
    )


# --- debates ---------------------------------------------------------------------------


def speeches(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "conversations")
    return t.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").alias("item_id"),
        F.col("turn").alias("pos"),
        F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(100)).alias("person_id"),
        F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias(
            "start_time"
        ),
        "role",
        F.col("text").alias("body"),
        (F.col("role") == "user").alias("is_root"),
    )


# --- documents ----------------------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return widen(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("id"),
        F.get(F.split("text", "\n"), 0).alias("title"),
        F.col("text").alias("summary"),
        F.lit(None).cast("string").alias("reasoning"),
        F.lit(None).cast("string").alias("law_changes"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"),
        F.col("lang").alias("ptype"),
        F.col("source").alias("status"),
    )


def documents_with_twins(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th document has an empty twin; every 70th is only that."""
    docs = documents(spark, folder).select("id", "summary")
    real = docs.withColumn("summary", F.when(F.col("id") % 70 != 0, F.col("summary")))
    return real.unionByName(docs.where("id % 50 = 0").withColumn("summary", F.lit(None).cast("string")))


def raw_documents(spark: SparkSession, folder: str) -> DataFrame:
    return widen(table(spark, folder, "documents")).select(
        "doc_id",
        F.concat(
            F.lit("<Siirto><Tyyppi>VASKI_JULKVP_"), "source", F.lit("_"), "lang", F.lit("</Tyyppi><Teksti>"),
            F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
            F.lit("</Teksti></Siirto>"),
        ).alias("xml"),
    )


# --- lobbying ----------------------------------------------------------------------------------


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """One notification per order line: the customer contacts the line's supplier.

    Odd customers have the other kind of company id; every fifth order lists no
    topics, every seventh a NULL topic, every eleventh a topic without targets.
    """
    o, li = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    company = F.concat(F.lit("C"), cust.cast("string"))
    target = F.struct(
        F.col("l_suppkey").alias("target_id"), F.array("l_returnflag", "l_linestatus").alias("methods")
    )
    topic = F.struct(
        (key % 1000).alias("id"),
        F.when(key % 2 == 0, F.col("o_orderpriority")).alias("fi"),
        F.concat(F.lit("other "), F.col("o_orderstatus")).alias("other"),
        F.concat(F.lit("P"), (key % 13).cast("string")).alias("project"),
        F.when((key % 11 != 0) & F.col("l_suppkey").isNotNull(), F.array(target)).alias("targets"),
    )
    topics = F.array(F.when(key % 7 != 0, topic))
    return o.join(li, key == F.col("l_orderkey"), "left").select(
        key.alias("seq"),
        F.when(cust % 2 == 0, company).alias("company_id"),
        F.when(cust % 2 != 0, company).alias("other_company_id"),
        F.year("o_orderdate").alias("term_id"),
        F.when(key % 3 == 0, F.col("o_orderpriority")).alias("industry"),
        F.concat(F.lit("Company "), cust.cast("string"), F.lit(" "), F.col("o_orderstatus")).alias("name"),
        F.when(key % 5 == 0, F.slice(topics, 1, 0)).otherwise(topics).alias("topics"),
    )


def lobby_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets named after suppliers: some without a name, some with one word only."""
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        k.alias("id"),
        F.when(k % 10 == 0, "-")
        .when(k % 10 == 1, "")
        .when(k % 10 == 2, "Solo")
        .otherwise(F.concat(F.lit("Given"), (k % 7).cast("string"), F.lit(" "), F.col("s_name")))
        .alias("name"),
    )


def supplier_persons(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        k.alias("id"),
        F.concat(F.lit("Given"), (k % 7).cast("string")).alias("first_name"),
        F.col("s_name").alias("last_name"),
    )


def supplier_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """Open for positive balances, ended on alternating sides of the lobby cut-off for the rest."""
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        k.alias("person_id"),
        F.concat(F.lit("g"), (k % 5).cast("string")).alias("pg_id"),
        F.lit("2019-04-17").cast("date").alias("start_date"),
        F.when(
            F.col("s_acctbal") < 3000,
            F.when(k % 2 == 0, F.lit("2024-06-30").cast("date")).otherwise(F.lit("2023-04-04").cast("date")),
        ).alias("end_date"),
    )


# --- campaign money -------------------------------------------------------------------------------


def money_text() -> Column:
    """l_extendedprice the way the disclosure files write it: '44 473,56'."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole = F.floor(cents / 100)
    thousands = F.floor(whole / 1000)
    gap = F.when(F.col("l_linenumber") % 2 == 0, F.lit(" ")).otherwise(F.lit(" "))
    grouped = F.when(
        thousands > 0,
        F.concat(thousands.cast("string"), gap, F.lpad((whole % 1000).cast("string"), 3, "0")),
    ).otherwise(whole.cast("string"))
    text = F.concat(F.lit("'"), grouped, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("'"))
    return F.when(F.col("l_linenumber") == 7, F.lit("''")).otherwise(text)


def budgets(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("l_suppkey")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return (
        table(spark, folder, "lineitem")
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("'Given"), (k % 7).cast("string"), F.lit("'")).alias("first_name"),
            F.concat(F.lit("'"), F.col("s_name"), F.lit("'")).alias("last_name"),
            money_text().alias("amount"),
            F.concat(F.lit("'2."), (F.col("l_linenumber") + 1).cast("string"), F.lit("'")).alias("ftype"),
            F.col("l_orderkey").alias("seq"),
            F.col("l_linenumber").alias("line"),
        )
    )


# --- roll calls and dates -------------------------------------------------------------------------------


def _rollcall_id() -> Column:
    k = F.col("o_orderkey")
    year = F.year("o_orderdate").cast("string")
    return F.when(k % 10 == 0, F.concat(F.lit("PTK "), k.cast("string"), F.lit("/"), year, F.lit(" vp"))).otherwise(
        F.concat(F.lit("EDK-"), year, F.lit("-AK-"), k.cast("string"))
    )


def rollcalls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(_rollcall_id().alias("id"), F.col("o_custkey").alias("person_id"))


def rollcall_exclusions(spark: SparkSession, folder: str) -> list[str]:
    """Two ids that every scale of the given tables may contain."""
    return ["EDK-1997-AK-1", "EDK-1998-AK-3"]


def records(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .where("o_orderstatus = 'F'")
        .select(
            F.when(F.col("o_orderkey") % 4 == 0, "HaV").otherwise("EK").alias("assembly_code"),
            F.col("o_orderkey").cast("int").alias("number"),
            F.year("o_orderdate").alias("year"),
            _rollcall_id().alias("rollcall_id"),
        )
    )


def raw_dates(spark: SparkSession, folder: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.concat_ws(
        ".", F.dayofmonth(d).cast("string"), F.month(d).cast("string"), F.year(d).cast("string")
    )
    return table(spark, folder, "orders").select(
        k.alias("id"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.year(d).cast("string")).otherwise(text).alias("raw"),
    )


def iso_times(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("raw"),
    )
