"""Latest / first row per key, duplicate removal and thread roots.

``row_number() <= 1`` plans as a WindowGroupLimit on both sides of the
exchange, so each map task ships at most one row per key: a key holding a
third of the table costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (which should be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


dedupe_by = latest_per_key


def interval_order(
    policy: str, start: str = "start_date", end: str = "end_date", ties: Sequence[str] = ()
) -> list[Column]:
    """Orderings for "the latest interval".

    ended_first    an ended interval beats an ongoing one (end DESC NULLS LAST)
    current_first  an ongoing interval beats any ended one (end DESC NULLS FIRST)
    by_start       latest start; an unknown start loses
    last_by_start  the last element when listed by ascending start
    """
    s, e = F.col(start), F.col(end)
    tail = [F.col(t).desc_nulls_last() for t in ties]
    if policy == "ended_first":
        return [e.desc_nulls_last(), s.desc_nulls_first(), *tail]
    if policy == "current_first":
        return [e.desc_nulls_first(), s.desc_nulls_first(), *tail]
    if policy == "by_start":
        return [s.desc_nulls_last(), *tail]
    if policy == "last_by_start":
        return [s.desc_nulls_first(), *tail]
    raise ValueError(f"unknown policy: {policy}")


def latest_interval(
    df: DataFrame,
    keys: Sequence[str],
    policy: str,
    start: str = "start_date",
    end: str = "end_date",
    ties: Sequence[str] = (),
) -> DataFrame:
    return latest_per_key(df, keys, interval_order(policy, start, end, ties))


def first_per_key(df: DataFrame, keys: Sequence[str], attribute: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest non-null attribute; a NULL one only when there is no other."""
    order = [F.col(attribute).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    return latest_per_key(df, keys, order)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct, fully non-null combinations."""
    return df.select(*cols).dropna().distinct()


def thread_roots(
    df: DataFrame,
    part: Sequence[str],
    pos: str | Sequence[str],
    is_root: Column,
    id_col: str,
    out: str = "response_to",
    block: int = 4096,
) -> DataFrame:
    """Carry the id of the last root in document order to the rows after it.

    ``pos`` is the place, or several columns of which the last counts within the
    others. A document is cut into blocks of ``block`` positions of the last: the last root of each
    block is found with a combinable aggregate, carried over the (far fewer)
    blocks, and only then filled in row by row inside a block. A document that
    holds a third of all rows is thus spread over many tasks. A row with no root
    before it becomes its own root.
    """
    *outer, inner = [pos] if isinstance(pos, str) else pos
    block_key = [*outer, "_blk"]
    rows = df.withColumn("_blk", F.floor(F.col(inner) / F.lit(block))).withColumn(
        "_root", F.when(is_root, F.col(id_col))
    )
    blocks = rows.groupBy(*part, *block_key).agg(
        F.max_by("_root", F.when(F.col("_root").isNotNull(), F.col(inner))).alias("_last")
    )
    before = Window.partitionBy(*part).orderBy(*block_key).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*part, *block_key, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*part, *block_key).orderBy(inner).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(carried, [*part, *block_key], "left")
        .withColumn(
            out,
            F.coalesce(F.last("_root", ignorenulls=True).over(inside), F.col("_carried"), F.col(id_col)),
        )
        .drop("_blk", "_root", "_carried")
    )
