"""Counts, grouping into lists, paging, unions and change detection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.operators.nested import NEST_LIMIT, nest_sorted


def count_rows(df: DataFrame, out: str = "count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def active_row_count(persons: DataFrame, memberships: DataFrame) -> DataFrame:
    """Rows of persons left-joined to memberships whose end is open.

    Counts membership rows, so a person with two open ones counts twice and one
    without any counts once.
    """
    mem = memberships.groupBy(F.col("person_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("end_date").isNull(), 1)).alias("_open")
    )
    rows = F.when(F.col("_all").isNull(), F.lit(1)).otherwise(F.col("_open"))
    return persons.select("id").join(mem, "id", "left").agg(F.coalesce(F.sum(rows), F.lit(0)).alias("count"))


def with_total(df: DataFrame, of: DataFrame | None = None, out: str = "total_hits") -> DataFrame:
    """Attach the row count of ``of`` (default: of the frame itself) to every row."""
    return df.withColumn(out, (df if of is None else of).agg(F.count(F.lit(1))).scalar())


def agg_names(
    df: DataFrame, keys: Sequence[str], names: str | Column, order: Sequence[Column],
    out: str = "names", limit: int = NEST_LIMIT,
) -> DataFrame:
    """Names per key joined by blanks in a fixed order, in parts of at most ``limit`` names."""
    text = F.col(names) if isinstance(names, str) else names
    nested = nest_sorted(df.where(text.isNotNull()), keys, order, [text.alias("name")], "_names", limit=limit)
    return nested.select(*keys, "part", F.array_join(F.transform("_names", lambda x: x["name"]), " ").alias(out))


def group_rows(
    df: DataFrame, keys: Sequence[str], group: str, order: Sequence[Column],
    fields: Sequence[str | Column], into: str = "items", limit: int = NEST_LIMIT,
) -> DataFrame:
    """Ordered lists per key and group; a missing group is ''."""
    filled = df.withColumn(group, F.coalesce(F.col(group), F.lit("")))
    return nest_sorted(filled, [*keys, group], order, fields, into, limit=limit)


def bundle_latest(
    df: DataFrame, keys: Sequence[str], latest: Column, header: Sequence[str],
    order: Sequence[Column], item: Sequence[str | Column], into: str = "items", limit: int = NEST_LIMIT,
) -> DataFrame:
    """Rows bundled by key, with header fields from the row that has the greatest ``latest``."""
    heads = df.groupBy(*keys).agg(F.max_by(F.struct(*header), latest).alias("_h"))
    lists = nest_sorted(df, keys, order, item, into, limit=limit)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return (
        lists.alias("l")
        .join(heads.alias("h"), on)
        .select(*[f"l.{k}" for k in keys], "l.part", "h._h.*", f"l.{into}")
    )


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """The ``number``-th page (from 0) under a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def page_info(total: str | Column, number: int, size: int) -> list[Column]:
    t = F.col(total) if isinstance(total, str) else total
    return [
        F.least(F.lit(number * size + 1).cast("long"), t).alias("page_min"),
        F.least(F.lit((number + 1) * size).cast("long"), t).alias("page_max"),
        F.ceil(t / F.lit(size)).alias("last_page"),
    ]


def true_first(flag: str) -> Column:
    """Sort key that puts TRUE before FALSE and NULL."""
    return F.when(F.col(flag).eqNullSafe(F.lit(True)), F.lit(0)).otherwise(F.lit(1))


def union_fill(*dfs: DataFrame) -> DataFrame:
    """Concatenate by name, missing columns NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


append_all = union_fill


def union_kinds(kinds: Mapping[str, DataFrame], out: str = "ptype") -> DataFrame:
    """Several kinds into one table, each row marked with its kind."""
    return union_fill(*[d.withColumn(out, F.lit(k)) for k, d in kinds.items()])


def changed_rows(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose values differ from the row of the same key in ``old``; NULL equals NULL."""
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return new.alias("n").join(old.alias("o"), key).where(differs).select("n.*")
