"""Decontamination and SimHash near-duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("plenum.llm")
from brute import SF, component_ids, contamination, fingerprint  # noqa: E402
from plenum.llm import decontaminate, queries, simhash  # noqa: E402

SHAPE = "doc_id long, text string, row string, bits string, words string, runs string, component_id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SHAPE)


def test_contamination_of_all_documents(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {}
    for r, (n, hit, own) in zip(texts, contamination([r["text"] for r in texts], items), strict=True):
        want[r["doc_id"]] = (n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op4_decontaminate(spark, SF).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_contamination_of_hard_texts(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "b", "c", "été", "x1"])
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([0, 1, 2, 4, 5, 9, 10, 11, 25])))) for k in range(30)]
    items += [("null", None), ("empty", ""), ("marks", "?! --"), ("again", items[4][1]), (None, "one two three"), ("upper", "ONE, Two-three FOUR five")]
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "one two three four five six"), (103, " ".join(["a"] * 30_000)), (None, items[20][1]), (3, rows[3][1])]
    table = spark.createDataFrame([(*x, "s", "t") for x in items], "item_id string, text string, size string, hashes string")
    out = decontaminate.contamination(docs(spark, rows), table).collect()
    want = [(i, n, hit, own) for (i, _), (n, hit, own) in zip(rows, contamination([t for _, t in rows], items), strict=True)]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out), key=order) == sorted(want, key=order)
    for r in out:
        assert sum(s["length"] for s in r["spans"]) == r["n_hit"]


def test_contamination_without_rows(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.contamination(docs(spark, []), none).count() == 0
    assert [tuple(r)[:3] for r in decontaminate.contamination(docs(spark, [(1, "a b")]), none).collect()] == [(1, 2, 0)]


def test_near_duplicates_among_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [fingerprint(r["text"]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, component_ids(ids, prints), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == want and any(i != c for i, (_, c) in want.items())


def test_near_duplicates_of_hard_texts(spark):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "One two"), (5, "one TWO"), (4, "one two three four"), (4, "one two three four"), (None, "one two"), (3, "w " * 200_000), (2, "Ä ä b \x85")]
    prints = [fingerprint(t) for _, t in rows]
    want = sorted((i or 0, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, component_ids([i for i, _ in rows], prints), strict=True))
    assert sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [1, 3, simhash.BUCKET])
def test_links_connect_whatever_is_near(spark, bucket):
    rng = random.Random(bucket)
    values = set()
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(8):
            values.add(v)
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(v,) for v in signed], "bits long"), bucket).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in links)
    root = {v: v for v in signed}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[top(a)] = top(b)
    groups = component_ids(list(range(len(values))), values)
    assert len({top(v) for v in signed}) == len(set(groups))
    assert len({(top(v), g) for v, g in zip(signed, groups, strict=True)}) == len(set(groups))
