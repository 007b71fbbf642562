"""Entity resolution, lookups and keys.

No side is broadcast by hint: person and lookup tables grow with the data, so
the choice is left to the measured size (adaptive execution), which also splits
skewed join partitions. Rows that cannot match (no key) bypass the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.clean import numeric_id, strip_party
from plenum.operators.temporal import latest_per_key


def active_persons(memberships: DataFrame, persons: DataFrame, after: str | None = None) -> DataFrame:
    """Distinct persons with an open membership, or one that ended after a day."""
    live = F.col("end_date").isNull()
    if after is not None:
        live = live | (F.col("end_date") > F.lit(after).cast("date"))
    return (
        memberships.where(live)
        .select("person_id")
        .distinct()
        .join(persons.select(F.col("id").alias("person_id"), "first_name", "last_name"), "person_id")
    )


def resolve_by_name(df: DataFrame, persons: DataFrame, on: Sequence[str] = ("first_name", "last_name")) -> DataFrame:
    """Inner join on the exact name; persons of the same name fan out."""
    named = df.dropna(subset=list(on))
    return named.join(persons.select(*on, "person_id"), list(on))


def persons_by_name(persons: DataFrame) -> DataFrame:
    """One person per case-blind name: the smallest id."""
    return persons.groupBy(
        F.lower(F.trim("first_name")).alias("_first"), F.lower(F.trim("last_name")).alias("_last")
    ).agg(F.min("id").alias("_found"))


def resolve_signers(signers: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Person id of each signer, by id or else by name; returns (resolved, unresolved).

    Input columns: person_id (text), first_name, last_name and any others. A
    star or other non-digits as id skips the row. A missing id falls back to the
    name without its party suffix.
    """
    raw = F.trim(F.col("person_id"))
    others = [c for c in signers.columns if c not in ("person_id", "first_name", "last_name")]
    nameless = F.coalesce(F.trim("first_name"), F.lit("")) == ""
    nameless = nameless | (F.coalesce(F.trim("last_name"), F.lit("")) == "")
    named = raw.isNull() & ~nameless
    first, last = F.lower(F.trim("first_name")), F.lower(strip_party("last_name"))
    names = persons_by_name(persons)

    # The signers, which are costly to cut out, are read once: those without a name to look up are dealt by their other columns and meet nothing.
    rows = signers.select(
        *others, numeric_id(raw).cast("long").alias("_id"), named.alias("_named"),
        F.when(named, first).otherwise("").alias("_first"), F.when(named, last).otherwise(F.xxhash64(*others).cast("string")).alias("_last"),
    )
    found = rows.join(names.withColumn("_named", F.lit(True)), ["_named", "_first", "_last"], "left").select(
        *others, F.coalesce("_id", F.col("_found").cast("long")).alias("person_id")
    ).where(F.col("person_id").isNotNull())

    missing = signers.where(named).select(*others, first.alias("_first"), last.alias("_last")).join(
        names, ["_first", "_last"], "left_anti"
    ).select(*others, F.col("_first").alias("first_name"), F.col("_last").alias("last_name"))
    return found, missing


def semi_by_id(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*on), list(on), "left_semi")


def not_in(df: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(known.select(*on), list(on), "left_anti")


def exists_flag(df: DataFrame, keys: DataFrame, on: str, yes: str, no: str, out: str) -> DataFrame:
    """``yes`` when the key occurs on the other side, else ``no``."""
    seen = keys.select(on).where(F.col(on).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    return (
        df.join(seen, on, "left")
        .withColumn(out, F.when(F.col("_seen"), F.lit(yes)).otherwise(F.lit(no)))
        .drop("_seen")
    )


def lookup_first(df: DataFrame, dim: DataFrame, key: str, value: str, order: Sequence[Column]) -> DataFrame:
    """Left join to the first dimension row per key."""
    first = latest_per_key(dim.where(F.col(key).isNotNull()), [key], order).select(key, value)
    return df.join(first, key, "left")


def lookup_values(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Left join to a dimension that is unique on the key (id -> file name)."""
    return df.join(dim, on, "left")


def count_per_key(df: DataFrame, counted: DataFrame, key: str, counted_key: str, out: str) -> DataFrame:
    """Rows on the other side per key, 0 when there are none."""
    n = (
        counted.where(F.col(counted_key).isNotNull())
        .groupBy(F.col(counted_key).alias(key))
        .agg(F.count(F.lit(1)).alias(out))
    )
    return df.join(n, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")))


def resolve_rollcalls(rollcalls: DataFrame, records: DataFrame, excluded: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Meeting of each roll call; returns (resolved, unmatched).

    ``PTK n/yyyy`` ids name the plenary meeting themselves. All others are looked
    up among the plenary records; those without one are reported, not loaded.
    """
    rows = rollcalls.where(~F.col("id").isin(list(excluded))) if excluded else rollcalls
    numbers = F.regexp_extract_all("id", F.lit(r"(\d+)"), 1)
    direct = rows.where(F.startswith("id", F.lit("PTK"))).select(
        "*",
        F.lit("EK").alias("record_assembly_code"),
        F.get(numbers, 0).try_cast("int").alias("record_number"),
        F.get(numbers, 1).try_cast("int").alias("record_year"),
    )
    keyed = rows.where(~F.startswith("id", F.lit("PTK")))
    meetings = latest_per_key(
        records.where("assembly_code = 'EK' AND rollcall_id IS NOT NULL"),
        ["rollcall_id"],
        [F.col("year"), F.col("number")],
    ).select(
        F.col("rollcall_id").alias("id"),
        F.col("assembly_code").alias("record_assembly_code"),
        F.col("number").alias("record_number"),
        F.col("year").alias("record_year"),
    )
    return direct.unionByName(keyed.join(meetings, "id")), keyed.join(meetings, "id", "left_anti")


def assign_key(df: DataFrame, cols: Sequence[str], out: str = "id") -> DataFrame:
    """Stable surrogate key from natural key columns; children compute it too, with no join."""
    return df.withColumn(out, F.xxhash64(*cols))
