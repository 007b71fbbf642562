"""Integrity audits: keys, references, required values, domains, lengths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.schemas import DOMAINS, LENGTHS, REFERENCES, TABLES


def audit_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def audit_fk(child: DataFrame, parent: DataFrame, cols: Sequence[str], parent_cols: Sequence[str]) -> DataFrame:
    """Child key values, all non-null, without a parent; with the number of rows each."""
    refs = child.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(cols, parent_cols)])
    return refs.join(keys, list(cols), "left_anti")


def _long(df: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """One row of per-column figures -> one row per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(value)) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def audit_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULLs per required column, in one pass."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return _long(counts, cols, "nulls")


def audit_domain(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values outside their enum, with counts; NULL is allowed."""
    bad = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.when(~F.col(c).isin(list(vals)), F.col(c).cast("string")).alias("value"),
                )
                for c, vals in domains.items()
            ]
        ),
        lambda x: x["value"].isNotNull(),
    )
    return (
        df.select(F.explode(bad).alias("b"))
        .groupBy(F.col("b.column").alias("column"), F.col("b.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def audit_length(df: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    """Greatest length per column against its limit."""
    cols = list(lengths)
    longest = df.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in cols])
    limits = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])
    return (
        _long(longest, cols, "longest")
        .withColumn("allowed", F.try_element_at(limits, F.col("column")))
        .withColumn("ok", F.col("longest") <= F.col("allowed"))
    )


def audit_unmatched(kinds: Mapping[str, DataFrame], key: str | Column) -> DataFrame:
    """Rows and distinct keys that a lookup left over, per kind."""
    out = None
    for kind, df in kinds.items():
        k = F.col(key) if isinstance(key, str) else key
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(k).alias("keys")).select(
            F.lit(kind).alias("kind"), "rows", "keys"
        )
        out = one if out is None else out.unionByName(one)
    return out


def audit_table(
    name: str, df: DataFrame, key: Sequence[str], required: Sequence[str],
    domains: Mapping[str, Sequence[str]], lengths: Mapping[str, int],
) -> DataFrame:
    """All single-table audits of a table as rows (table, audit, subject, n)."""
    parts = [
        audit_keys(df, key).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("key").alias("audit"), F.lit(",".join(key)).alias("subject"), "n"
        )
    ]
    if required:
        parts.append(audit_nulls(df, required).select(
            F.lit("null").alias("audit"), F.col("column").alias("subject"), F.col("nulls").alias("n")))
    if domains:
        parts.append(audit_domain(df, domains).groupBy("column").agg(F.sum("n").alias("n")).select(
            F.lit("domain").alias("audit"), F.col("column").alias("subject"), "n"))
    if lengths:
        parts.append(audit_length(df, lengths).where(~F.col("ok")).select(
            F.lit("length").alias("audit"), F.col("column").alias("subject"),
            F.col("longest").cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0").select(F.lit(name).alias("table"), "audit", "subject", "n")


def audit_values(
    name: str, df: DataFrame, required: Sequence[str], domains: Mapping[str, Sequence[str]], lengths: Mapping[str, int]
) -> DataFrame:
    """(table, audit, subject, n): rows with a NULL, a value outside its enum or a text too long, all counted in one scan of the table."""
    checks = (
        [("null", c, F.col(c).isNull()) for c in required]
        + [("domain", c, ~F.col(c).isin(list(values))) for c, values in domains.items()]
        + [("length", c, F.length(c) > limit) for c, limit in lengths.items()]
    )
    counts = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(audit).alias("audit"), F.lit(subject).alias("subject"), F.col(f"c{i}").alias("n"))
        for i, (audit, subject, _) in enumerate(checks)
    ])
    return counts.select(F.explode(rows).alias("r")).select(F.lit(name).alias("table"), "r.audit", "r.subject", "r.n")


def audit_references(
    tables: Mapping[str, DataFrame], references: Sequence[tuple[str, Sequence[str], str, Sequence[str]]] = REFERENCES
) -> list[DataFrame]:
    """(table, audit, subject, n) of each reference between given tables: rows whose key, all of it non-null, has no parent.

    A key with a NULL in any column refers to nothing, as in SQL. Keys are counted before they meet the parents.
    """
    out = []
    for child, cols, parent, parent_cols in references:
        if child in tables and parent in tables and all(c in tables[child].columns for c in cols):
            lost = audit_fk(tables[child], tables[parent], cols, parent_cols).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            out.append(lost.select(
                F.lit(child).alias("table"), F.lit("reference").alias("audit"), F.lit(f"{','.join(cols)} -> {parent}").alias("subject"), "n"
            ))
    return out


def audit_model(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Everything that the declared model says about the given tables, as rows (table, audit, subject, n) where n rows or keys break it.

    Keys, required key columns, domains, lengths and references come from `schemas`; of a table, what concerns columns that it does not have is
    left out. One scan counts all values of a table, one grouping its keys, and one each its references.
    """
    parts = []
    for name, df in tables.items():
        key = TABLES[name][1]
        there = set(df.columns)
        if set(key) <= there:
            parts.append(audit_keys(df, key).agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("table"), F.lit("key").alias("audit"), F.lit(",".join(key)).alias("subject"), "n"))
        required = [c for c in key if c in there]
        domains = {c: v for c, v in DOMAINS.get(name, {}).items() if c in there}
        lengths = {c: n for c, n in LENGTHS.get(name, {}).items() if c in there}
        if required or domains or lengths:
            parts.append(audit_values(name, df, required, domains, lengths))
    parts += audit_references(tables)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")
