"""Exploding, unnesting and ordered nesting of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Items of a nested list; a key with more has several rows.
NEST_LIMIT = 100_000
# One sort key in so many, chosen by hash, may become a bound between ranges.
SAMPLE = 4096
# Ranges that a key's rows are sorted in, at most.
RANGES = 256
# Parts in which a key's rows meet its bounds.
SALTS = 16


def explode_drop(df: DataFrame, col: str) -> DataFrame:
    """One row per element; empty and NULL arrays and NULL elements go."""
    return df.withColumn(col, F.explode(col)).where(F.col(col).isNotNull())


def explode_keep(df: DataFrame, col: str) -> DataFrame:
    """One row per element; empty and NULL arrays stay as one NULL."""
    return df.withColumn(col, F.explode_outer(col))


def spread(
    df: DataFrame, keep: Sequence[str | Column], elements: Column, out: str, pos: str | None = None
) -> DataFrame:
    """One row per non-null element of an array that is costly to compute.

    An inner explode lets the optimizer test the array before it explodes it,
    which computes it three times; an outer one with a filter after does not.
    """
    rows = F.posexplode_outer(elements).alias(pos, out) if pos else F.explode_outer(elements).alias(out)
    return df.select(*keep, rows).where(F.col(out).isNotNull())


def unnest(df: DataFrame, col: str, drop: Sequence[str] = ()) -> DataFrame:
    """Lift the fields of a struct next to the other columns."""
    fields = [f for f in df.schema[col].dataType.names if f not in drop]
    return df.select(
        *[c for c in df.columns if c != col], *[F.col(f"`{col}`.`{f}`").alias(f) for f in fields]
    )


def flatten_children(df: DataFrame, key: Sequence[str], path: str, fields: Sequence[str]) -> DataFrame:
    """Repeated children of a parsed record, each with its parent key."""
    return df.select(*key, F.explode(path).alias("_child")).select(
        *key, *[F.col(f"_child.{f}").alias(f.lstrip("_")) for f in fields]
    )


def concat_lists(*cols: str | Column) -> Column:
    """Concatenate lists, a missing one counting as empty."""
    return F.concat(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.array()) for c in cols])


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    """Equality of all columns, NULL being equal to NULL; the right ones have a leading ``r_``."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"r_{c}"]) for c in cols])


def _bounds(rows: DataFrame, keys: Sequence[str], sample: int) -> DataFrame:
    """Per key the sort keys that bound its ranges, repeated for each salt; keys without a sampled row have none."""
    found = rows.where(F.pmod(F.xxhash64("_item._k"), F.lit(sample)) == 0).select(*keys, F.col("_item._k").alias("_k")).distinct()
    whole = Window.partitionBy(*keys)
    every = F.ceil(F.count(F.lit(1)).over(whole) / F.lit(RANGES))
    picked = found.select(*keys, "_k", F.row_number().over(whole.orderBy("_k")).alias("_nth"), every.alias("_every"))
    return (
        picked.where(F.col("_nth") % F.col("_every") == 0)
        .groupBy(*[F.col(k).alias(f"r_{k}") for k in keys])
        .agg(F.array_sort(F.collect_list("_k")).alias("_bounds"))
        .withColumn("r__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )


def nest_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    fields: Sequence[str | Column],
    into: str = "items",
    part: str = "part",
    limit: int = NEST_LIMIT,
    sample: int = SAMPLE,
) -> DataFrame:
    """Ordered list of structs per key, in parts of ``limit`` items, the last one taking what is left.

    ``order`` is a total order given as ascending sort keys (negate to turn one
    around). An item at place ``n`` of its key, from 0, is in part ``n div limit``,
    so parts are consecutive from 0 and the same at every size. The place is the
    count of the ranges before plus the row number inside a range; ranges are cut
    at sampled sort keys, so that no key is sorted by one task.
    """
    sort_key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    item = F.struct(
        sort_key.alias("_k"),
        F.struct(*[F.col(f) if isinstance(f, str) else f for f in fields]).alias("_v"),
    )
    rows = df.select(*keys, item.alias("_item")).withColumn("_salt", F.pmod(F.xxhash64("_item._k"), F.lit(SALTS)).cast("int"))
    bounds = _bounds(rows, keys, sample)
    number = F.size(F.filter("_bounds", lambda b: b < F.col("_item._k")))
    joined = rows.join(bounds, _same(rows, bounds, [*keys, "_salt"]), "left")
    ranged = joined.select(*keys, "_item", F.when(F.col("_bounds").isNull(), 0).otherwise(number).alias("_range"))

    # Only keys with bounds have rows in more than one range.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        joined.where(F.col("_bounds").isNotNull()).select(*keys, number.alias("_range"))
        .groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(c).alias(f"r_{c}") for c in [*keys, "_range"]], F.sum("_n").over(earlier).alias("_before"))
    )
    numbered = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_item._k")) - 1)
    place = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_nth")
    return (
        numbered.join(before, _same(numbered, before, [*keys, "_range"]), "left")
        .groupBy(*keys, F.floor(place / F.lit(limit)).alias(part))
        .agg(F.transform(F.array_sort(F.collect_list("_item")), lambda x: x["_v"]).alias(into))
    )


def with_nested(left: DataFrame, nested: DataFrame, keys: Sequence[str], into: str) -> DataFrame:
    """Attach nested lists; a key without any gets an empty one."""
    empty = F.array().cast(nested.schema[into].dataType)
    return left.join(nested, list(keys), "left").withColumn(into, F.coalesce(F.col(into), empty))


def last_element(col: str | Column) -> Column:
    """Last element, NULL for an empty list."""
    return F.try_element_at(F.col(col) if isinstance(col, str) else col, F.lit(-1))


def first_element(col: str | Column) -> Column:
    return F.try_element_at(F.col(col) if isinstance(col, str) else col, F.lit(1))


def other_values(col: str, field: str, current: Column, sentinel: str) -> Column:
    """Distinct values of a nested field, in order, except the current one and a sentinel."""
    return F.array_distinct(
        F.transform(
            F.filter(col, lambda x: (x[field] != current) & (x[field] != F.lit(sentinel))),
            lambda x: x[field],
        )
    )
