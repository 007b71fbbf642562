"""Token ids as Arrow files of equal-length sequences.

A file is in Arrow's IPC file format; a record batch has up to `ROWS` rows of two fixed-size lists: `ids` and `mask` (false where the last
sequence of a file is padded). Mapped into memory, any sequence is read in place, without a copy. Documents follow each other in ascending
order of id, in files by ranges of ids; a sequence may hold the end of one document and the beginning of the next. The index says
where each document begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.shared import mapped, written
from plenum.llm.tokenids import encoder

LENGTH, ROWS = 2048, 64
#: Ids that a task reads, about.
PART = 1 << 22


def _schema(width: int, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if width == 2 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Sequences:
    """Writes ids to a file as full batches of sequences; what is left waits for more."""

    def __init__(self, path: str, width: int, length: int):
        system, place = files.FileSystem.from_uri(path)
        self._sink, self._schema = system.open_output_stream(place), _schema(width, length)
        self._out = pa.ipc.new_file(self._sink, self._schema)
        self._length, self._width, self._held = length, width, bytearray()
        self.n = 0

    def add(self, ids: bytes) -> None:
        self.n += len(ids) // self._width
        self._held += ids
        size = ROWS * self._length * self._width
        upto = len(self._held) // size * size
        for a in range(0, upto, size):
            self._write(bytes(self._held[a : a + size]), ROWS * self._length)
        del self._held[:upto]

    def _write(self, ids: bytes, real: int) -> None:
        values = pa.array(np.frombuffer(ids, f"<u{self._width}"), self._schema.field("ids").type.value_type)
        mask = pa.array(np.arange(len(values)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self._length) for x in (values, mask)]
        self._out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self._schema))

    def close(self) -> None:
        if self._held:
            real, row = len(self._held) // self._width, self._length * self._width
            self._write(bytes(self._held) + b"\0" * (-len(self._held) % row), real)
        self._out.close()
        self._sink.close()


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = LENGTH
) -> DataFrame:
    """Writes the ids of all rows to Arrow files in `folder`; the index: (`id_col`, shard, file, first, n_tokens, start).

    `first` counts ids within the file, `start` all ids before the document. Each document ends in `end_id`; a null or empty text is that id
    alone. Null ids come first; rows with equal ids follow each other in the order of their texts' hashes; an empty table gives no file. Other
    columns are not read. A task that is run again writes another file, and only files of finished tasks are in the index.
    """
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own, out, path = TaskContext.get(), encoder(vocabulary), None, None
        end = end_id.to_bytes(own.width, "little")
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                path = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
                out = _Sequences(path, own.width, length)
            first, counts = [], []
            for at in range(0, batch.num_rows, 512):
                for ids in own.encode(batch.column(1).slice(at, 512).to_pylist()):
                    first.append(out.n)
                    out.add(ids + end)
                    counts.append(out.n - first[-1])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([task.partitionId()] * n, pa.int32()), pa.array([path] * n), pa.array(first, pa.int64()), pa.array(counts, pa.int64())],
                names=["id", "shard", "file", "first", "n_tokens"],
            )
        if out is not None:
            out.close()

    files.FileSystem.from_uri(folder)[0].create_dir(files.FileSystem.from_uri(folder)[1], recursive=True)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    ordered = source.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    index = written(mapped(ordered, run, f"id {kind}, shard int, file string, first long, n_tokens long"), "token-index")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    starts = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return index.join(starts, "shard").select(
        F.col("id").alias(id_col), "shard", "file", "first", "n_tokens", (F.col("before") + F.col("first")).alias("start")
    )


class TokenFile:
    """Random access to the sequences of one file."""

    def __init__(self, path: str):
        system, place = files.FileSystem.from_uri(path)
        local = isinstance(system, files.LocalFileSystem)
        self._file = pa.ipc.open_file(pa.memory_map(place) if local else system.open_input_file(place))
        self.length = self._file.schema.field("ids").type.list_size

    def _batch(self, i: int, column: str) -> np.ndarray:
        whole = self._file.get_batch(i).column(column)
        return whole.flatten().to_numpy(zero_copy_only=column == "ids").reshape(-1, self.length)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of a sequence."""
        return self._batch(i // ROWS, "ids")[i % ROWS], self._batch(i // ROWS, "mask")[i % ROWS]

    def ids(self, first: int, n: int) -> np.ndarray:
        """`n` ids from the `first` on, as unsigned 32-bit integers."""
        size, out, at = ROWS * self.length, [], first
        while at < first + n:
            own = self._batch(at // size, "ids").ravel()
            out.append(own[at % size : at % size + first + n - at])
            at += len(out[-1])
        return np.concatenate(out).astype("<u4") if out else np.zeros(0, "<u4")


@lru_cache(maxsize=2)
def _opened(path: str) -> TokenFile:
    return TokenFile(path)


def read_tokens(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(`id_col`, start, ids) of each document of the index, from the files; `ids`: little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [_opened(f).ids(a, n).tobytes() for f, a, n in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["id", "start", "ids"])

    kind = index.schema[id_col].dataType.simpleString()
    source = index.select(F.col(id_col).alias("id"), "start", "file", "first", "n_tokens")
    n = index.agg(F.sum("n_tokens")).first()[0] or 0
    near = (F.col("first") / PART).cast("long")
    by_file = source.repartition(1 + n // PART, "file", near).sortWithinPartitions("file", "first")  # by ids in the files, not rows of the index
    return mapped(by_file, run, f"id {kind}, start long, ids binary").select(F.col("id").alias(id_col), "start", "ids")
