"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, one per bit of XXH64 over the shingles of a text. Texts link when their fingerprints differ in at most
`RADIUS` = 4 bits. A fingerprint is cut into two segments of 32 bits: of 4 differing bits, one segment holds at most 2. Two segment
values at distance 2 or less have a common neighbour at distance 1, so each fingerprint is filed under the Hamming ball of radius 1 of
each of its segments (2 x 33 table rows, whatever the data), the rows of a table key are matched, and the complete distance of the
64 bits is verified. No pair at distance 4 or less is missed, and unrelated fingerprints hardly ever share a 32-bit key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.components import components
from plenum.llm.shared import mapped, written

SEED = 42
RADIUS = 4
#: Table keys with more fingerprints than this are matched by `_dense_links`, which is as exact; the rest by comparing within the key.
BUCKET = 256

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16


def fingerprint_of(text: str | None, words: int) -> int:
    """The fingerprint of a text as an unsigned number; zero for no words."""
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return 0
    if len(found) < words:
        shingles, n = iter([b" ".join(found)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)), len(found) - words + 1
    counts = np.zeros(64, np.int64)
    left = n
    while left > 0:
        take = min(left, _CHUNK)
        digests = b"".join([xxhash.xxh64_digest(next(shingles), SEED) for _ in range(take)])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        left -= take
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(`id_col`, bits long) for every row of `docs`: repeated rows give repeated results; a null or empty text has fingerprint 0.

    Lower-cases A-Z, takes words between ASCII white space, and `words`-word shingles with repeats (fewer words: the whole sequence). A
    bit is set if it is set in over half of the hashes, so a tie is 0. Other columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint_of(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["id", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, bits long")
    return found.select(F.col("id").alias(id_col), "bits")


def table_keys(bits: DataFrame) -> DataFrame:
    """(key long, bits long): the Hamming ball of radius 1 of either 32-bit segment; the segment's number is part of the key."""
    half = F.lit(0xFFFFFFFF).cast("long")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(32)))
    upper, lower = F.shiftrightunsigned("bits", 32), F.col("bits").bitwiseAND(half)
    high = F.transform(flips, lambda f: upper.bitwiseXOR(f))
    low = F.transform(flips, lambda f: lower.bitwiseXOR(f).bitwiseOR(F.lit(1 << 32).cast("long")))
    return bits.select(F.explode(F.concat(high, low)).alias("key"), "bits")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits. As unsigned numbers: numpy counts the bits of an absolute value otherwise."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _spanning(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within `radius` of each other among a few fingerprints: one less than members at most."""
    root = list(range(len(members)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(1, len(members)):
        for j in np.flatnonzero(_apart(members[:i], members[i]) <= radius):
            a, b = top(int(j)), top(i)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(members[int(j)]), int(members[i])))
    return out


def _bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Links within each table key, for keys of bounded size; streams over rows sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, held = None, np.zeros(0, np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            bits = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            if len(held):
                keys, bits = np.concatenate([np.full(len(held), last_key, np.int64), keys]), np.concatenate([held, bits])
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            last_key, held = keys[-1], bits[starts[-1] :]
            yield from links(bits, starts[:-1], ends[:-1])
        if len(held):
            yield from links(held, np.array([0]), np.array([len(held)]))

    def links(bits: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = ends - starts
        two = starts[sizes == 2]
        near = two[_apart(bits[two], bits[two + 1]) <= radius]
        found = list(zip(bits[near].tolist(), bits[near + 1].tolist(), strict=True))
        for i in np.flatnonzero(sizes > 2):
            found += _spanning(bits[starts[i] : ends[i]], radius)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return mapped(keyed.repartition("key").sortWithinPartitions("key", "bits"), run, "a long, b long")


def _dense_links(bits: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded table keys, with neither pairs nor large groups.

    Two fingerprints at distance 4 or less have a common 64-bit neighbour at distance 2, and any two that share one are at distance 4
    or less. So each fingerprint is filed under its ball of radius 2 (2,081 rows), and neighbours in the order of a key are linked. A
    key has 2,081 fingerprints at most.
    """
    one = np.array([0, *(1 << b for b in range(64))], np.uint64)
    masks = np.array([one[i] ^ one[j] for i in range(65) for j in range(i + 1, 65)] + [0], np.uint64)

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                own = batch.column(0).slice(at, 128).to_numpy().view(np.uint64)
                keys = (own[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.repeat(own, len(masks)).view(np.int64))], names=["key", "bits"]
                )

    before = F.lag("bits").over(Window.partitionBy("key").orderBy("bits"))
    near = mapped(bits, ball, "key long, bits long").select(F.col("bits").alias("b"), before.alias("a"))
    return near.where("a is not null").select("a", "b").distinct()


def near_links(bits: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints `bits` that connect all that are within `RADIUS` of each other.

    Not every pair is a row, but whatever is within the radius is connected by rows. Keys with more than `bucket` members are found
    by a count that combines before its shuffle.
    """
    keyed = table_keys(bits)
    crowded = written(keyed.groupBy("key").count().where(F.col("count") > bucket).select("key"), "crowded")
    links = _bucket_links(keyed.join(crowded, "key", "left_anti"), RADIUS)
    if crowded.limit(1).count():
        links = links.union(_dense_links(keyed.join(crowded, "key", "left_semi").select("bits").distinct()))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(`id_col`, fingerprint, component_id) for every row of `docs`; `component_id` is the smallest id that links reach.

    Rows with equal fingerprints form one class before anything is matched, so that copies cost nothing; links are sought between
    classes. Null and empty texts have fingerprint zero and link like any other; repeated rows come out as often as they came in; a
    null id is its own row and never a component's name unless all its ids are null; an empty table gives an empty table.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = written(prints.groupBy("bits").agg(F.min(id_col).alias("first_id")), "classes")
    parts = components(near_links(classes.select("bits"), bucket))
    of_class = classes.join(parts.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "first_id", F.coalesce("component", "bits").alias("component"))
    first = of_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of_class.join(first, "component").select("bits", "component_id")
    return prints.join(named, "bits").select(id_col, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
