"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

pytest.importorskip("plenum.llm")
from brute import SF  # noqa: E402
from plenum.llm import queries, whitening  # noqa: E402

SHAPE = "vec_id long, embedding array<float>, id string, component string, n string, vector string"


def plain(rows, components=8):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of rows (id, vector) with different ids."""
    kept = {i: [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    n, x = len(kept), np.array(list(kept.values()))
    sums = [sum(c) for c in zip(*kept.values(), strict=True)]
    centred = x - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    white = centred @ axes[:, :components] / np.sqrt(values[:components])
    out = {}
    for r, i in enumerate(kept):
        deviation = sum((n * c - s) ** 2 for c, s in zip(kept[i], sums, strict=True))
        for k in range(components):
            out[i, k + 1] = (n, deviation, white[r, k], values[k] / values.sum())
    return out


def same(got, want):
    signs = {}
    assert got.keys() == want.keys()
    for (i, k), (n, deviation, white, explained) in want.items():
        r = got[i, k]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        if abs(white) > 1e-3:
            signs.setdefault(k, set()).add((r["whitened"] > 0) == (white > 0))
        assert abs(r["whitened"]) == pytest.approx(abs(white), abs=1e-7)
    assert all(len(x) == 1 for x in signs.values())


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries.op12_whitening(spark, SF).collect()
    same({(r["vec_id"], r["component"]): r for r in out}, plain(rows))
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


def test_hard_vectors(spark):
    rng = np.random.default_rng(3)
    fine = [(i, [float(c) for c in rng.normal(size=10) * range(1, 11)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0] * 9), (103, [float("nan")] * 10), (104, [1.0] * 9 + [None]), (105, [1.0] * 9 + [float("inf")]), (106, [1e30] * 10)]
    frame = lambda rows: spark.createDataFrame([(*r, *"abcd") for r in rows], SHAPE)
    out = whitening.whiten(frame(fine + odd)).collect()
    same({(r["vec_id"], r["component"]): r for r in out}, plain(fine))
    twice = whitening.whiten(frame(fine + fine + [(None, fine[0][1])])).collect()
    assert len(twice) == 121 * 8
    assert whitening.whiten(frame(odd)).count() == 8 * 0 and whitening.whiten(frame(fine).limit(0)).count() == 0
    assert whitening.whiten(frame([(i, [2.0, 3.0]) for i in range(5)])).count() == 0
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33, 64, 150])
def test_divide_and_conquer(n):
    rng = np.random.default_rng(n)
    for values in (rng.normal(size=n), np.exp(rng.normal(size=n) * 5), np.round(rng.normal(size=n)), np.ones(n), np.arange(n) * 1e-9 + 1):
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        a = q * values @ q.T
        a = (a + a.T) / 2
        got, vectors = whitening.eigen(a)
        scale = np.abs(values).max()
        assert np.abs(got - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-12 * n * scale
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-11
        assert np.abs(a @ vectors - vectors * got).max() <= 1e-11 * n * scale


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    values = np.concatenate([np.logspace(-9, 2, 20), -np.logspace(-9, 2, 20)])
    assert np.abs(whitening.polar(q * values @ q.T) - q * np.sign(values) @ q.T).max() < 1e-5
