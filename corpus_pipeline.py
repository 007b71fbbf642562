"""The corpus pipeline: documents to packed training sequences, one written table per stage.

Every stage takes the documents that its predecessor kept and returns documents with the same columns; only the last returns pieces.
Filters decide row by row, so null and repeated doc_ids are decided like any other. Columns that no operator reads go through a stage under
names of its own, so none clashes with a column that an operator makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import decontaminate, linededup, packing, simhash
from plenum.llm import toxicity as toxic
from plenum.llm.queries import vocabulary
from plenum.llm.shared import new_folder, passing, table, written

#: Columns that operators read; all others are only carried.
READ = ("doc_id", "text", "source")
ROW, SCORE = "pipeline_row", "pipeline_score"


def carried(docs: DataFrame) -> DataFrame:
    """`docs` with every column that is not read renamed by its place."""
    return docs.toDF(*(c if c in READ else f"pipeline_column_{i}" for i, c in enumerate(docs.columns)))


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a column `ROW`, written, so that a row keeps its number."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def decided(docs: DataFrame, rows: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """The numbered `rows` that are (left_semi) or are not (left_anti) in `marked`, as rows of `docs`. Both grow with the corpus: the same join at
    every size, with the numbers hashed and no text sorted."""
    left = rows.join(marked.hint("shuffle_hash"), ROW, how)
    return left.select([c for c in rows.columns if c != ROW]).toDF(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    rows = carried(docs)
    model = toxic.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxic.scored(rows, model, score_col=SCORE).where(F.col(SCORE) < toxic.THRESHOLD).drop(SCORE).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources stay at their first place only; n_chars follows the text."""
    rows = carried(docs)
    found = linededup.dedup_lines(rows).select(rows.columns).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by fingerprints, the one of the smallest id stays; a null id comes last."""
    rows = numbered(carried(docs))
    with passing(spark):
        groups = simhash.near_duplicates(rows.select(ROW, "text"), id_col=ROW, words=4).select(ROW, "component_id")
        place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", ROW).alias("place")
        first = groups.join(rows.select(ROW, place), ROW).groupBy("component_id").agg(F.min("place").alias("place"))
        stay = written(first.select(F.col(f"place.{ROW}").alias(ROW)), "first", keep=True)
    return decided(docs, rows, stay, "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    rows = numbered(carried(docs))
    with passing(spark):
        found = decontaminate.contamination(rows.select(ROW, "text"), table(spark, sf_dir, "benchmark"), id_col=ROW)
        gone = written(found.where("n_hit > 0").select(ROW), "contaminated", keep=True)
    return decided(docs, rows, gone, "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Model scores have no SQL; each stage is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
