"""Sinks: typed tables, documents routed by type. The search index has a module of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.clean import doc_type
from plenum.schemas import columns_of


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of a table in load order; columns the frame lacks are NULL."""
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
            for c, t in columns_of(table)
        ]
    )


def write_table(df: DataFrame, path: str, order: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    (df.select(*order) if order else df).write.mode(mode).parquet(path)


def with_doc_type(df: DataFrame, xml_col: str, suffix: str = "_fi", out: str = "doctype") -> DataFrame:
    kind = doc_type(xml_col)
    return df.withColumn(out, kind).where(F.endswith(F.col(out), F.lit(suffix)))


def route_by_type(df: DataFrame, xml_col: str, path: str, suffix: str = "_fi", mode: str = "overwrite") -> None:
    """One folder per document type. Files follow the size of the data: a rebalance joins small types' rows in a task and splits a dominant type over
    several."""
    with_doc_type(df, xml_col, suffix).hint("rebalance", "doctype").write.mode(mode).partitionBy("doctype").parquet(path)
