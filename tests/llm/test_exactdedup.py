"""Exact duplicates and the cuckoo-filter index."""

import hashlib
import random
from collections import defaultdict

import pytest

pytest.importorskip("plenum.llm")
from brute import SF  # noqa: E402
from plenum.llm import exactdedup, queries  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SHAPE = "doc_id long, text string, key string, id string, row string, n string, salt string, shard string, kind string"


def plain(rows):
    """{text: (largest id, rows)}."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_whole_table_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    groups = plain(rows)
    want = {i: (*groups[t or ""], i == groups[t or ""][0], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_exact_dedup(spark, SF).collect()}
    assert got == want and any(n > 1 for _, n, *_ in want.values())


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "a "), (None, "a"), (None, "only"), (None, "only"), (7, "A"), (8, "é"), (9, "é"), (10, "x" * 500_000), (11, "x" * 500_000), (2, "b")]
    docs = spark.createDataFrame([(*r, *"abcdefg") for r in rows], SHAPE)
    out = exactdedup.exact_duplicates(docs).collect()
    groups = plain(rows)
    shas = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    assert len(out) == len(rows)
    assert sum(r["kept"] for r in out) == len(groups)
    for r in out:
        assert (r["keep_id"], r["group_size"]) == shas[r["text_sha256"]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert exactdedup.exact_duplicates(docs.limit(0)).count() == 0


def test_hot_text_in_many_tasks(spark):
    docs = spark.range(4000, numPartitions=16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = exactdedup.exact_duplicates(docs)
    assert out.where("kept").count() == 1 + 4000 - 1334
    assert [tuple(r) for r in out.where("group_size > 1").select("keep_id", "group_size").distinct().collect()] == [(3999, 1334)]


def test_filter_keeps_colliding_keys_and_deletes():
    rng = random.Random(5)
    head = b"12345678"
    keys = [head + rng.randbytes(40) for _ in range(5000)]
    twins = [head + b"\1\1" + b"\2" * 8 + bytes([k]) * 30 for k in range(6)]  # one fingerprint, one pair of buckets
    own = exactdedup.Cuckoo(4)
    for n, key in enumerate(keys + twins):
        assert own.find(key) < 0
        own.insert(key, n)
    assert own.resized > 5 and len(own) == 5006
    assert all(own.rows[own.find(key)] == n for n, key in enumerate(keys + twins))
    for key in keys[::2] + twins[::2]:
        assert own.delete(key) and not own.delete(key)
    again = exactdedup.Cuckoo.loaded(own.stored(), list(own.keys), list(own.rows))
    for n, key in enumerate(keys + twins):
        gone = n % 2 == 0
        assert (again.find(key) < 0) == gone
        if gone:
            again.insert(key, -n)
    assert len(again) == 5006 and again.rows[again.find(keys[4])] == -4


def test_index_takes_later_rows_and_loses_contents(spark, monkeypatch):
    frame = lambda rows: exactdedup.keyed_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    found = lambda index: {r["id"]: r["n"] for r in index.entries().collect()}
    index = exactdedup.insert(exactdedup.empty_index(spark), frame([(1, "a"), (2, "b"), (3, "a")]))
    assert found(index) == {3: 2, 2: 1}
    index = exactdedup.insert(index, frame([(9, "b"), (0, "a"), (5, "c")]))
    assert found(index) == {3: 3, 9: 2, 5: 1}
    index = exactdedup.delete(index, frame([(0, "a"), (0, "never there")]))
    assert found(index) == {9: 2, 5: 1}
    index = exactdedup.insert(index, frame([(4, "a")]))
    assert found(index) == {9: 2, 5: 1, 4: 1}
    monkeypatch.setattr(exactdedup, "SHARD_ROWS", 5)
    index = exactdedup.insert(index, frame([(100 + i, f"t{i}") for i in range(60)] + [(99, "a")]))
    assert index.shards > 1 and found(index) == {9: 2, 5: 1, 99: 2} | {100 + i: 1 for i in range(60)}
