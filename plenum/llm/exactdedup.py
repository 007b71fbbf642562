"""Exact duplicates by a cuckoo-filter index of live contents.

A text's content key is its SHA-256, XXH64 and length in bytes. The index deals keys to shards. A shard has a cuckoo filter: buckets of four 16-bit
fingerprints, each key in one of two buckets, so that keys can be inserted and deleted; beside each fingerprint stands the number of the
entry it was stored for. A filter hit is compared with the whole stored key before it counts, and keys that only share a fingerprint are
stored side by side. When a key finds no place after `KICKS` moves, the filter is built anew with twice the buckets from the stored keys.

Equal keys are combined within each map task before they go to their shard, so copies of one text are at most a row per task there,
however many there are. The index is a table in the shared folder and can be given later rows (`insert`) or lose contents (`delete`).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.shared import mapped, written

SLOTS, KICKS = 4, 200
#: Rows a shard is made for; a shard's keys are held in the memory of one task.
SHARD_ROWS = 200_000
#: Keys a map task holds before it sends them on.
HELD = 200_000
#: A content with more than one of HOT of all rows is joined back in SALTS parts; there are HOT such contents at most.
HOT, SALTS = 1000, 64

_FILTER, _ENTRY, _DELETE, _INSERT = range(4)


class Cuckoo:
    """The live keys of one shard: `rows[key]` is what is stored for it, found through the filter only."""

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.rows: list = []
        self.resized = 0
        self._free: list[int] = []
        self._clear(buckets)

    def __len__(self) -> int:
        return len(self.keys) - len(self._free)

    def _clear(self, buckets: int) -> None:
        self._mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.entries = array("i", bytes(4 * SLOTS * buckets))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        """(fingerprint, first bucket, other bucket); the first 8 bytes of a key choose its shard and are not used again."""
        fingerprint = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[10:18], "little") & self._mask
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995 & 0x7FFFFFFF)) & self._mask

    def _slot(self, key: bytes) -> int:
        fingerprint, *buckets = self._places(key)
        for bucket in buckets:
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[slot] == fingerprint and self.keys[self.entries[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        """The entry of a live key, or -1: a filter hit counts only if the whole stored key is equal."""
        slot = self._slot(key)
        return -1 if slot < 0 else self.entries[slot]

    def insert(self, key: bytes, row) -> None:
        """Stores a key that is not live."""
        if self._free:
            entry = self._free.pop()
            self.keys[entry], self.rows[entry] = key, row
        else:
            entry = len(self.keys)
            self.keys.append(key)
            self.rows.append(row)
        if not self._place(key, entry):
            self._resize()

    def _place(self, key: bytes, entry: int) -> bool:
        fingerprint, first, other = self._places(key)
        for bucket in (first, other):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = fingerprint, entry
                    return True
        bucket = other
        for kick in range(KICKS):
            slot = SLOTS * bucket + kick % SLOTS
            fingerprint, self.prints[slot] = self.prints[slot], fingerprint
            entry, self.entries[slot] = self.entries[slot], entry
            bucket = self._other(bucket, fingerprint)
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = fingerprint, entry
                    return True
        return False

    def _resize(self) -> None:
        """Twice the buckets, or more, filled from the stored keys. Keys that agree in all the filter looks at cannot be told apart by more
        buckets, but such keys agree in 80 bits of their SHA-256."""
        while True:
            self.resized += 1
            self._clear(2 * (self._mask + 1))
            if all(self._place(key, entry) for entry, key in enumerate(self.keys) if key is not None):
                return

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        entry, self.prints[slot] = self.entries[slot], 0
        self.keys[entry] = self.rows[entry] = None
        self._free.append(entry)
        return True

    def live(self) -> Iterator[int]:
        return (i for i, key in enumerate(self.keys) if key is not None)

    def stored(self) -> bytes:
        """Filter and entry numbers as bytes."""
        return self.prints.tobytes() + self.entries.tobytes()

    @classmethod
    def loaded(cls, filter_: bytes, keys: list, rows: list) -> Cuckoo:
        """What `stored` gave, with keys and rows by entry number (None where an entry is free)."""
        own = cls(1)
        own.keys, own.rows = keys, rows
        own._free = [i for i, key in enumerate(keys) if key is None]
        own._clear(len(filter_) // (6 * SLOTS))
        n = SLOTS * (own._mask + 1)
        own.prints, own.entries = array("H", filter_[: 2 * n]), array("i", filter_[2 * n :])
        return own


@dataclass
class Index:
    """A written index: `table` has a filter row and entry rows of each shard."""

    table: DataFrame
    shards: int

    def entries(self) -> DataFrame:
        """(key, id, row, n): each live content, the largest id of its rows, the number of a row of that id, and its rows."""
        return self.table.where(f"kind = {_ENTRY}").select("key", "id", "row", "n")


def content_key(text):
    """SHA-256, XXH64 and length in bytes of a text, 48 bytes; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    numbers = F.concat(F.lpad(F.hex(F.xxhash64(whole)), 16, "0"), F.lpad(F.hex(F.octet_length(whole).cast("long")), 16, "0"))
    return F.unhex(F.concat(F.sha2(whole.cast("binary"), 256), numbers))


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (id, row, n): the larger id, then the smaller row, null ids last; n is the sum."""
    n = a[2] + b[2]
    if a[0] != b[0]:
        first = b if a[0] is None or (b[0] is not None and b[0] > a[0]) else a
    else:
        first = a if a[1] <= b[1] else b
    return first[0], first[1], n


def _combined(keyed: DataFrame) -> DataFrame:
    """(key, id, row, n): the rows (key, id, row) of each task, one for each key."""
    kind = keyed.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = {}, None
        for batch in batches:
            types = batch.schema
            for key, id_, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = (id_, row, 1)
                held[key] = _better(held[key], own) if key in held else own
            if len(held) > HELD:
                yield rows(held, types)
                held = {}
        if held:
            yield rows(held, types)

    def rows(held: dict, types: pa.Schema) -> pa.RecordBatch:
        ids, numbers, n = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(ids, types.field("id").type), pa.array(numbers, pa.int64()), pa.array(n, pa.int64())], names=["key", "id", "row", "n"]
        )

    return mapped(keyed.select("key", "id", "row"), run, f"key binary, id {kind.simpleString()}, row long, n long")


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")


def _applied(index: Index, changes: DataFrame) -> Index:
    """The index after changes (kind, key, id, row, n)."""
    columns = ["shard", "kind", "entry", "key", "id", "row", "n", "filter"]
    new = changes.select(_shard(index.shards), "kind", F.lit(-1).alias("entry"), "key", "id", "row", "n", F.lit(None).cast("binary").alias("filter"))
    kind = changes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, filter_, keys, rows, types = None, None, None, [], [], None

        def ready() -> Cuckoo:
            if filter_ is None:
                return Cuckoo()
            return Cuckoo.loaded(filter_, keys, rows)

        def out() -> Iterator[pa.RecordBatch]:
            entries = list(own.live())
            yield batch_of([(at, _FILTER, len(own.keys), None, None, None, None, own.stored())])
            for a in range(0, len(entries), 10_000):
                yield batch_of([(at, _ENTRY, i, own.keys[i], *own.rows[i], None) for i in entries[a : a + 10_000]])

        def batch_of(values: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types.field(i).type) for i, c in enumerate(zip(*values, strict=True))], names=columns)

        for batch in batches:
            types = batch.schema
            for shard, kind_, entry, key, id_, row, n, stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if at is not None:
                        own = own or ready()
                        yield from out()
                    at, own, filter_, keys, rows = shard, None, None, [], []
                if kind_ == _FILTER:
                    filter_, keys, rows = stored, [None] * entry, [None] * entry
                elif kind_ == _ENTRY:
                    keys[entry], rows[entry] = key, (id_, row, n)
                else:
                    own = own or ready()
                    if kind_ == _DELETE:
                        own.delete(key)
                    elif (found := own.find(key)) >= 0:
                        own.rows[found] = _better(own.rows[found], (id_, row, n))
                    else:
                        own.insert(key, (id_, row, n))
        if at is not None:
            own = own or ready()
            yield from out()

    rows = index.table.select(columns).unionByName(new.select(columns))
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "kind")
    return Index(written(mapped(dealt, run, f"shard int, kind int, entry int, key binary, id {kind}, row long, n long, filter binary"), "index"), index.shards)


def empty_index(spark: SparkSession, id_type: str = "long", rows: int = 0) -> Index:
    """An index without contents, for about `rows` rows."""
    table = spark.createDataFrame([], f"shard int, kind int, entry int, key binary, id {id_type}, row long, n long, filter binary")
    return Index(table, max(1, -(-rows // SHARD_ROWS)))


def insert(index: Index, keyed: DataFrame) -> Index:
    """The index after the rows (key, id, row) came in; if they make shards too large, there are more shards first, with filters built
    from the stored keys."""
    n = keyed.count() + index.table.where(f"kind = {_ENTRY}").count()
    if n > 4 * SHARD_ROWS * index.shards:
        moved = index.entries().withColumn("kind", F.lit(_INSERT))
        index = _applied(empty_index(keyed.sparkSession, keyed.schema["id"].dataType.simpleString(), n), moved)
    return _applied(index, _combined(keyed).withColumn("kind", F.lit(_INSERT)))


def delete(index: Index, keys: DataFrame) -> Index:
    """The index without the contents `keys` (key); contents that it does not hold are ignored."""
    kind = index.table.schema["id"].dataType
    gone = keys.select("key").distinct()
    return _applied(index, gone.select(F.lit(_DELETE).alias("kind"), "key", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("n")))


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, row) of every row of `docs`, written; `row` is a number of the row."""
    return written(docs.select(content_key(F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")), "contents")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, keep_id, group_size, kept, text_sha256) for every row of `docs`.

    Texts are equal when identical; a null text is empty. Of equal texts the row of the largest id stays, of several such rows one. A null id is
    smaller than any other. An empty table gives an empty table. Other columns are not read.
    """
    keyed = keyed_rows(docs, id_col, text_col)
    rows = keyed.count()
    index = insert(empty_index(docs.sparkSession, keyed.schema["id"].dataType.simpleString(), rows), keyed)
    groups = index.entries().select("key", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    hot = F.broadcast(groups.where(F.col("group_size") > rows / HOT).select("key", F.lit(SALTS).alias("salts")))  # HOT rows at most
    parts = F.coalesce("salts", F.lit(1))
    left = keyed.join(hot, "key", "left").select("key", "id", "row", F.pmod(F.col("row"), parts).cast("int").alias("salt"))
    spread = F.when(F.col("group_size") > rows / HOT, F.lit(SALTS)).otherwise(F.lit(1))
    right = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1)))
    return left.join(right, ["key", "salt"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
