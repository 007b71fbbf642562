"""WARC archives, written index first and read back by coalesced byte ranges.

Tasks write records, each a gzip member of its own, to archives in a shared folder, and return one index row per record: file, offset,
length, url and digest. Whoever reads selects rows of the index; records that lie close together are fetched as one sorted byte range.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.shared import mapped, new_folder, written

#: Bytes of an archive at which a task begins another, of a range that is read at once, and of a gap that is read over.
ARCHIVE, RANGE, GAP = 1 << 28, 1 << 23, 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id: str | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> str | None:
    return name.strip().removeprefix("<urn:page:").removesuffix(">") or None


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress(b"WARC/1.1\r\n" + head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + deflate.flush()


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[str | None] | None) -> bytes:
    """One compressed record: a response, or with `refers_to` a revisit, whose block has the HTTP header only."""
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to[0]))]
    return _member(headers, http if refers_to is not None else http + payload)


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a compressed record; header names in lower case."""

    def named(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}

    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    headers = named(head)
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    return headers, named(http), payload


def revisits(keys: DataFrame, min_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the rows of `keys` (id, digest, size) that revisit another row's payload."""
    copies = written(
        keys.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to"), "copies",
    )
    return keys.join(copies, "digest").where(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "digest", "refers_to").distinct()


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive: int = ARCHIVE
) -> DataFrame:
    """Writes a record per row of `pages` to archives in `folder`; the index: (file, offset, length, url, digest), written as a table.

    The payload is the html in UTF-8, empty if null. Of equal payloads of at least `min_bytes` the row of the largest id is the response and
    others are revisits of it; null ids revisit others but are no one's response, and equal ids are alike. A null url is written as the id's name. A task that
    is run again writes another archive, and only archives of finished tasks are in the index. An empty table gives an empty index. Other columns are not read.
    """
    folder = folder.rstrip("/")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    keys = written(source.select("id", "digest", F.octet_length("html").cast("long").alias("size")), "payloads")
    again = written(revisits(keys, min_bytes), "revisits").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    decided = source.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select(
        F.col("id").cast("string").alias("id"), "url", "html", "digest", F.col("refers_to").cast("string").alias("refers_to"), F.col("_digest").isNotNull().alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sink, path, at, number = TaskContext.get(), None, None, 0, 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page, url, html, digest, refers_to, revisit = (c[i].as_py() for c in batch.columns)
                if sink is None or at >= archive:
                    if sink is not None:
                        sink.close()
                    path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    system, place = files.FileSystem.from_uri(path)
                    sink, at, number = system.open_output_stream(place, compression=None), 0, number + 1
                    first = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{number}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n")
                    sink.write(first)
                    at += len(first)
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                raw = record(page, url, html.encode(), base32, (refers_to,) if revisit else None)
                sink.write(raw)
                rows.append((path, at, len(raw), url, base32))
                at += len(raw)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "offset", "length", "url", "digest"])
        if sink is not None:
            sink.close()

    system, place = files.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)
    return written(mapped(decided, run, "file string, offset long, length long, url string, digest string"), "warc-index")


def byte_ranges(index: DataFrame, size: int = RANGE, gap: int = GAP) -> DataFrame:
    """(file, start, end, records): sorted ranges of at most about `size` bytes that cover the records of `index`, and these as (offset, length)."""
    near = Window.partitionBy("file", "chunk").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(near)
    cut = index.select("file", "offset", "length", (F.col("offset") / size).cast("long").alias("chunk"))
    runs = cut.withColumn("new", F.when(F.col("offset") - before > gap, 1).otherwise(0)).withColumn("run", F.sum("new").over(near))
    return runs.groupBy("file", "chunk", "run").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")
    ).select("file", "start", "end", "records")


def read_warc(index: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the records of `index`; payload is null for revisits.

    Size and digest are of the full payload: counted and hashed anew for responses, from the record's headers for revisits. A response
    whose payload does not have the digest of its header is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = files.FileSystem.from_uri(file)
                with system.open_input_file(place) as f:
                    raw = f.read_at(end - start, start)
                rows = []
                for r in records:
                    headers, http, payload = parse_record(raw[r["offset"] - start : r["offset"] - start + r["length"]])
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    size = int(http["content-length"])
                    if kind == "response":
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != digest or size != len(payload):
                            raise ValueError(f"{file} at {r['offset']}: payload differs from its digest")
                    refers = headers.get("warc-refers-to")
                    rows.append((_page(headers["warc-record-id"]), headers["warc-target-uri"], kind, refers and _page(refers), size, digest, payload if kind == "response" else None))
                cols = list(zip(*rows, strict=True))
                types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    shape = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    size = index.agg(F.sum("length")).first()[0] or 0
    found = mapped(byte_ranges(index).repartition(1 + size // RANGE, "file", "start"), run, shape)  # by bytes of the archives, not of the index
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_and_read(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes all pages and reads all records back."""
    index = write_warc(pages, folder or new_folder(pages.sparkSession, "warc"), **columns)
    return read_warc(index, pages.schema[columns.get("id_col", "page_id")].dataType.simpleString())
