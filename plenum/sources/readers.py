"""Readers for the raw dumps. Schemas are always explicit; nothing is inferred."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_tsv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Tab-separated dump with a header and quoted cells that may span lines.

    A multi-line file cannot be split, so the rows are spread out again after
    the scan: parsing XML cells must not stay on one core per file.
    """
    df = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", True)
        .csv(path)
    )
    return df.repartition(spark.sparkContext.defaultParallelism)


def read_quoted_csv(spark: SparkSession, path: str, columns: Mapping[str, str], sep: str = ";") -> DataFrame:
    """CSV whose header names and cells are wrapped in single quotes.

    ``columns`` maps the file's header names (quotes stripped), in file order,
    to the new names; all cells come back as text without their quotes.
    """
    schema = ", ".join(f"`{new}` string" for new in columns.values())
    df = spark.read.schema(schema).option("sep", sep).option("header", True).option("quote", "").csv(path)
    return df.select(*[F.btrim(F.col(c), F.lit("'")).alias(c) for c in columns.values()])


def widen(df: DataFrame, times: int = 1) -> DataFrame:
    """Spread a scan over all cores when it has fewer splits than that.

    For costly work per row (parsing, tokenising) on a small or badly split
    file. A large input has splits enough and is left alone, unshuffled.
    Narrow rows that become long documents are many in a split: those are
    spread over several tasks (``times``) for each split and core.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if times > 1:
        return df.repartition(max(cores, splits) * times)
    return df if splits >= cores else df.repartition(cores)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One array of nested records per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_column(col: str | Column, schema: str) -> Column:
    return F.from_json(F.col(col) if isinstance(col, str) else col, schema)


def parse_xml(df: DataFrame, col: str, schema: str | StructType, out: str = "doc") -> DataFrame:
    """Parse an XML column; repeated children are arrays whether they occur once or often.

    Prefixes do not matter; attributes are fields with a leading ``_``. A document
    that is not well-formed has NULL fields.
    """
    return df.withColumn(out, F.from_xml(F.col(col), schema, {"ignoreNamespace": "true"}))


def xml_path(col: str | Column, path: str) -> Column:
    """All texts or attribute values at an XPath. Prefixed names need local-name()."""
    return F.xpath(F.col(col) if isinstance(col, str) else col, F.lit(path))


def file_id_map(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(id, photo): id is the last dash-separated piece of the name before the first dot."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.get(F.split(name, r"\."), 0)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(F.element_at(F.split(stem, "-"), -1).alias("id"), name.alias("photo"))
        .groupBy("id")
        .agg(F.max("photo").alias("photo"))
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table written by an upstream job."""
    return spark.read.parquet(path)
