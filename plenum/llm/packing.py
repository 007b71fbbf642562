"""Best-fit packing of documents into training sequences.

Whole documents where they fit, else pieces. What goes where depends only on how many pieces there are of each length, and there are
`capacity` lengths at most: that histogram is planned on the driver, and Spark looks up each piece's place by its number among the
pieces of its length. No piece goes through the driver.

The plan looks for exact complements: for the gap that a piece leaves, a single length, then a pair, then a triple that fills it to
the last token, as often as the available counts allow. What is left is packed best-fit, longest first. Few pieces may be worth
more in the best-fit part than in triples or pairs, so plans with up to three, two and one lengths are made, and the shortest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.shared import mapped, written
from plenum.llm.tokenids import encoder, widened

CAPACITY = 2048
#: Parts in which the pieces of one length are numbered, so that a very common length is not one group.
PARTS = 256

Pattern = tuple[dict[int, int], int]


def _fill(gap: int, free: np.ndarray, most: int) -> tuple[int, ...] | None:
    """One, two or three available lengths, `most` at most, that add up to `gap`, the longest first."""
    if free[gap] > 0:
        return (gap,)
    if most == 1:
        return None
    there = free[: gap + 1] > 0
    twice = free[: gap + 1] > 1

    def pair(total: int, taken: int = 0) -> tuple[int, int] | None:
        low = np.arange(1, total // 2 + 1)
        ok = there[low] & there[total - low]
        if total % 2 == 0 and total:
            ok[-1] = twice[total // 2]
        if taken:  # one piece of this length is in use already
            if taken < total and not twice[taken]:
                ok[min(taken, total - taken) - 1] = False
            elif 2 * taken == total and free[taken] < 3:
                ok[taken - 1] = False
        found = np.flatnonzero(ok)
        return (total - int(low[found[0]]), int(low[found[0]])) if len(found) else None

    if (two := pair(gap)) is not None:
        return two
    if most == 2:
        return None
    for a in np.flatnonzero(there)[::-1].tolist():
        if 1 <= a <= gap - 2 and 3 * a >= gap and (two := pair(gap - a, a)) is not None:
            return (a, *two)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns ({length: copies}, sequences filled so) that use up `counts` ({length: pieces}): the best of three plans.

    Every step of a plan uses up a length or all but two of it, so there are at most a few times `capacity` patterns.
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda found: sum(times for _, times in found))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[Pattern]:
    """Gaps filled by up to `most` lengths, and the rest best-fit."""
    free = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    out: list[Pattern] = []
    if free[capacity]:
        out.append(({capacity: 1}, int(free[capacity])))
    for length in range(capacity - 1, 0, -1):
        while free[length] > 0:
            free[length] -= 1
            found = _fill(capacity - length, free, most)
            free[length] += 1
            if found is None:
                break
            copies: dict[int, int] = {}
            for x in (length, *found):
                copies[x] = copies.get(x, 0) + 1
            times = min(int(free[x]) // k for x, k in copies.items())
            for x, k in copies.items():
                free[x] -= k * times
            out.append((copies, times))
    return out + _best_fit(free, capacity)


def _best_fit(free: np.ndarray, capacity: int) -> list[Pattern]:
    """The rest, longest first, each piece where the least room is left; like sequences are handled together."""
    by_gap: dict[int, list[Pattern]] = {}
    for length in range(capacity - 1, 0, -1):
        left = int(free[length])
        gaps = np.array(sorted(g for g in by_gap if g >= length and by_gap[g]), np.int64)
        at = 0
        while left and at < len(gaps):
            gap = int(gaps[at])
            while left and by_gap[gap]:
                copies, times = by_gap[gap].pop()
                most = gap // length  # a sequence goes on being the best fit for this length
                used = min(times, left // most)
                if used == 0:
                    used, most = 1, left
                if used < times:
                    by_gap[gap].append((copies, times - used))
                by_gap.setdefault(gap - most * length, []).append((copies | {length: most}, used))
                left -= used * most
            at += 1
        most = capacity // length
        if left // most:
            by_gap.setdefault(capacity - most * length, []).append(({length: most}, left // most))
        if left % most:
            by_gap.setdefault(capacity - left % most * length, []).append(({length: left % most}, 1))
    return [p for found in by_gap.values() for p in found]


def _slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, end, copies, sequence, offset): pieces numbered `first` to `end` of a length go to sequences from `sequence`
    on, `copies` to each, the first of them at `offset`."""
    out, sequence, used = [], 0, {}
    for copies, times in patterns:
        offset = 0
        for length in sorted(copies, reverse=True):
            k, first = copies[length], used.get(length, 0)
            out.append((length, first, first + k * times, k, sequence, offset))
            used[length] = first + k * times
            offset += k * length
        sequence += times
    return out


def pieces_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids): the ids of each document and `end_id`, cut if there are more than `capacity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        end, width = end_id.to_bytes(own.width, "little"), own.width
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for i, ids in enumerate(own.encode(part.column(1).to_pylist())):
                    ids += end
                    n, a = len(ids) // width, 0
                    b = n if n <= capacity else n % capacity or capacity
                    while a < n:
                        rows.append((i, a, b, ids[a * width : b * width]))
                        a, b = b, b + capacity
                of, first, upto, data = zip(*rows, strict=True)
                first, upto = np.array(first), np.array(upto)
                number = np.arange(len(of)) - np.searchsorted(np.array(of), np.array(of))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.array(number, pa.int32()), pa.array(first, pa.int64()), pa.array(upto - first, pa.int64()), pa.array(data, pa.binary())],
                    names=["id", "piece", "start", "length", "ids"],
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return mapped(source, run, f"id {kind}, piece int, start long, length long, ids binary")


def _wide(pieces: DataFrame, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(vocabulary).width
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                ids = pa.array([widened(x, width) for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], ids, *part.columns[at + 1 :]], names=part.schema.names)

    return mapped(pieces, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema))


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, parts: int = PARTS
) -> DataFrame:
    """(`id_col`, piece, start, length, sequence_id, offset, ids) for each piece of every row of `docs`.

    A document's ids and `end_id` are one piece, or with more than `capacity` ids pieces of `capacity`, the first taking what is
    over. `ids` holds little-endian unsigned 32-bit integers. A sequence's pieces follow each other from offset 0 without gaps. A null or
    empty text is `end_id` alone; repeated rows and null ids are documents like any other; an empty table has no pieces. Other columns
    are not read.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).alias("part")
    pieces = written(pieces_of(docs, id_col, text_col, vocabulary, capacity, end_id), "pieces")
    counts = written(pieces.groupBy("length", part).agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    numbered_from = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # `capacity` rows at most
    slots = spark.createDataFrame(
        _slots(plan({r["length"]: r["n"] for r in histogram}, capacity)),
        "length long, first long, end long, copies long, sequence long, at long",
    )
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece"))
    numbered = (
        pieces.withColumn("part", part).withColumn("nth", nth).join(numbered_from, ["length", "part"])
        .withColumn("number", F.col("before") + F.col("nth") - 1)
    )
    # The slots' number is bounded by the capacity (see plan), so they are broadcast whatever the documents.
    placed = numbered.join(F.broadcast(slots), "length").where("number >= first AND number < end")
    out = placed.select(
        F.col("id").alias(id_col), "piece", "start", "length",
        F.expr("sequence + (number - first) div copies").alias("sequence_id"),
        F.expr("at + (number - first) % copies * length").alias("offset"), "ids",
    )
    return _wide(out, vocabulary)
