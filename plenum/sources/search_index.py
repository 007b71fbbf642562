"""The stored search index: postings and a term dictionary, partitioned by term bucket.

A query works out its terms' buckets, reads those folders only, and of their files only the row groups whose term statistics hold a
wanted term. The dictionary tells how many documents a term has before any posting is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def term_bucket(term: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(term) if isinstance(term, str) else term, "UTF-8")), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    """`term_bucket` of a word that is known while the query is planned."""
    return zlib.crc32(term.encode()) % buckets


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    buckets: int

    def _read(self, name: str, terms: Sequence[str]) -> DataFrame:
        wanted = sorted({bucket_of(t, self.buckets) for t in terms})
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df.where(F.col("bucket").isin(wanted) & F.col("term").isin(list(terms))).drop("bucket")

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """(doc_id, segment, term, positions) of the given terms."""
        return self._read("postings", terms)

    def dictionary(self, terms: Sequence[str]) -> DataFrame:
        """(term, documents, hits) of those of the given terms that occur."""
        return self._read("terms", terms)

    def documents_of(self, terms: Sequence[str]) -> dict[str, int]:
        """How many documents each of the given terms has, 0 included: a row per term on the driver."""
        found = {r["term"]: r["documents"] for r in self.dictionary(terms).collect()} if terms else {}
        return {t: found.get(t, 0) for t in terms}


def write_index(postings: DataFrame, path: str, buckets: int = BUCKETS) -> SearchIndex:
    """Stores postings and their dictionary; how many files a bucket has follows its size.

    Rows of a bucket are spread over as many tasks as they need (a rebalance, which splits a bucket that holds a very common term), and
    are sorted by term inside a file.
    """
    spark = postings.sparkSession
    placed = postings.withColumn("bucket", term_bucket("term", buckets))
    (
        placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id", "segment")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    )
    stored = spark.read.parquet(f"{path}/postings")
    # A term has one posting in a segment, so postings are documents where all of these have one segment.
    several = not stored.where(F.col("segment") > 0).isEmpty()
    documents = F.countDistinct("doc_id") if several else F.count("doc_id")
    (
        stored.groupBy("bucket", "term").agg(documents.alias("documents"), F.sum(F.size("positions")).alias("hits"))
        .hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    )
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return SearchIndex(spark, path, buckets)


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(spark, path, spark.read.parquet(f"{path}/about").first()["buckets"])
