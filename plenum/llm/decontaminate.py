"""Benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of a benchmark item (an item of fewer words, but not none, is one window). Containment has to be
complete, so of a window's shingles one suffices as its necessary prefix: the rarest in the corpus. Shingles of documents are joined
with prefixes only, the positions of prefix and shingle fix where the window would begin, begin and length must fit, and the words
there are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm import wordscan
from plenum.llm.shared import mapped, written

#: Words of a window, and of a shingle (windows of fewer words are one shingle).
WINDOW, SHINGLE = 10, 5
#: Slots of the bitmap of benchmark shingles that each task holds: 2 MB, whatever the benchmark's size.
SLOTS = 1 << 24
#: Parts into which a very common shingle or passage is split in joins.
SALTS = 16


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, words, size, hashes): each window of each item, with the hashes of its shingles in order. No words: no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, end, words in wordscan.scan(batch.column(1)):
                sizes = np.diff(words.first)
                hashes = {k: dict(zip(*(x.tolist() for x in words.shingles(k)), strict=True)) for k in {min(shingle, int(n)) for n in sizes if n}}
                for i in range(end - at):
                    size, first = min(window, int(sizes[i])), int(words.first[i])
                    k = min(shingle, size)
                    for w in range(first, first + int(sizes[i]) - size + 1) if size else ():
                        own = [hashes[k][w + o] for o in range(size - k + 1)]
                        rows.append((batch.column(0)[at + i].as_py(), words.joined(w, w + size), size, np.array(own, np.uint64).view(np.int64).tolist()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item", "words", "size", "hashes"])

    source = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return mapped(source, run, "item string, words string, size int, hashes array<long>")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the slots of all benchmark shingles; Spark combines them to 64-bit words, of which there are SLOTS / 64 at most."""
    slot = F.explode("hashes").alias("h")
    bits = windows.select(slot).select(F.col("h").bitwiseAND(F.lit(SLOTS - 1).cast("long")).alias("s"))
    words = bits.groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("mask")).toPandas()
    out = np.zeros(SLOTS // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    s = hashes & np.uint64(SLOTS - 1)
    return (bitmap[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1


def _runs(docs: DataFrame, bitmap, sizes: list[int]) -> DataFrame:
    """(row, id, n_words, runs): stretches of words that shingles marked in the bitmap cover, as (place of the first word, words)."""
    kind = f"row long, id {docs.schema['id'].dataType.simpleString()}, n_words long, runs array<struct<at: long, words: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bitmap.value
        for batch in batches:
            counts, runs = [], []
            for at, end, words in wordscan.scan(batch.column(2)):
                cover = np.zeros(len(words.starts) + 1, np.int32)
                for k in sizes:
                    where, hashes = words.shingles(k)
                    hit = where[_marked(table, hashes)]
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + k, -1)
                flag = np.cumsum(cover[:-1]) > 0
                inner = words.first[(words.first > 0) & (words.first < len(flag))]
                opens, closes = flag.copy(), flag.copy()
                opens[1:] &= ~flag[:-1]
                closes[:-1] &= ~flag[1:]
                opens[inner], closes[inner - 1] = flag[inner], flag[inner - 1]
                found: list[list[dict]] = [[] for _ in range(end - at)]
                begins = np.flatnonzero(opens)
                of = np.searchsorted(words.first, begins, "right") - 1
                for a, b, i in zip(begins.tolist(), (np.flatnonzero(closes) + 1).tolist(), of.tolist(), strict=True):
                    found[i].append({"at": a - int(words.first[i]), "words": words.joined(a, b)})
                counts += np.diff(words.first).tolist()
                runs += found
            shape = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(runs, shape)], names=["row", "id", "n_words", "runs"]
            )

    return mapped(docs, run, kind)


def _shingles(runs: DataFrame, bitmap, sizes: list[int]) -> DataFrame:
    """(words, pos, size, hash) for each marked shingle of each different run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, words in wordscan.scan(batch.column(0)):
                for k in sizes:
                    where, hashes = words.shingles(k)
                    keep = _marked(bitmap.value, hashes)
                    where, hashes = where[keep], hashes[keep]
                    of = np.searchsorted(words.first, where, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, end - at).take(pa.array(of)), pa.array(where - words.first[of]), pa.array(np.full(len(of), k, np.int32)), pa.array(hashes.view(np.int64))],
                        names=["words", "pos", "size", "hash"],
                    )

    return mapped(runs.select("words"), run, "words string, pos long, size int, hash long")


def _merged(found: DataFrame) -> DataFrame:
    """(words, spans, n_hit) of (words, begins, sizes): overlapping and touching windows of a run as one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_hit = [], []
            for places in batch.column(1).to_pylist():
                own: list[list[int]] = []
                for p in sorted(places, key=lambda p: p["begin"]):
                    if own and p["begin"] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], p["begin"] + p["len"])
                    else:
                        own.append([p["begin"], p["begin"] + p["len"]])
                spans.append([{"start": a, "length": b - a} for a, b in own])
                n_hit.append(sum(b - a for a, b in own))
            shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, shape), pa.array(n_hit, pa.int64())], names=["words", "spans", "n_hit"])

    return mapped(found, run, "words string, spans array<struct<start: long, length: long>>, n_hit long")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """(`id_col`, n_words, n_hit, spans, items) for every row of `docs`.

    n_hit counts the document's words inside any occurrence of a window; spans are those stretches as (start, length) in words; items
    are the ids, as strings and in their order, of the items with a window that occurs. Null and empty texts have no words; a null or
    empty item has no window; an item with a null id marks words and is not listed; repeated rows come out as often as they came
    in; an empty table on either side gives no hits. Other columns are not read.
    """
    spark = docs.sparkSession
    windows = written(benchmark_windows(items, item_col, item_text, window, shingle), "windows")
    of_item = windows.select("words", "item").distinct()
    unique = windows.groupBy("words", "size").agg(F.first("hashes").alias("hashes"))
    sizes = sorted({min(shingle, r["size"]) for r in windows.select("size").distinct().collect()})  # `window` rows at most
    bitmap = spark.sparkContext.broadcast(_bitmap(windows))

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = written(_runs(source, bitmap, sizes), "scanned")
    runs = scanned.select("row", F.explode("runs").alias("r")).select("row", F.col("r.at").alias("at"), F.col("r.words").alias("words"))
    different = written(runs.groupBy("words").agg(F.count("*").alias("times")), "runs")
    marked = written(_shingles(different, bitmap, sizes), "shingles")

    times = marked.join(different, "words").groupBy("size", "hash").agg(F.sum("times").alias("times"))
    own = unique.select("words", F.col("size").alias("len"), F.least("size", F.lit(shingle)).alias("size"), F.posexplode("hashes").alias("offset", "hash"))
    rare = Window.partitionBy("words").orderBy(F.col("times").asc_nulls_first(), "hash", "offset")
    prefix = (
        own.join(times, ["size", "hash"], "left").withColumn("nth", F.row_number().over(rare)).where("nth = 1 AND times IS NOT NULL")
        .select(F.col("words").alias("window"), "len", "size", "offset", "hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    begin = F.col("pos") - F.col("offset")
    n = F.size(F.split("words", " "))
    candidates = (
        marked.withColumn("salt", F.pmod(F.xxhash64("words", "pos"), F.lit(SALTS)).cast("int"))
        .join(prefix, ["size", "hash", "salt"])
        .select("words", "window", "len", begin.alias("begin"))
        .where((F.col("begin") >= 0) & (F.col("begin") + F.col("len") <= n))
    )
    there = F.concat_ws(" ", F.slice(F.split("words", " "), F.col("begin").cast("int") + 1, F.col("len")))
    exact = written(candidates.where(there == F.col("window")).distinct(), "exact")
    spans = _merged(exact.groupBy("words").agg(F.collect_set(F.struct("begin", "len")).alias("places")))
    listed = (
        exact.select("words", F.col("window")).distinct().join(of_item.withColumnRenamed("words", "window"), "window")
        .groupBy("words").agg(F.collect_set("item").alias("items"))
    )
    of_run = spans.join(listed, "words", "left")
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["length"].alias("length")))
    of_row = (
        runs.join(of_run, "words").select("row", "n_hit", moved.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .groupBy("row").agg(F.sum("n_hit").alias("n_hit"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    none = F.array().cast("array<struct<start: bigint, length: bigint>>")
    return scanned.join(of_row, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )

