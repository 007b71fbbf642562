"""Toxicity by held-out labels, and the pipeline against plain versions of its stages."""

import zlib

import pytest

pytest.importorskip("plenum.llm")
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from plenum.llm import queries, toxicity  # noqa: E402

SHAPE = "doc_id long, text string, id string, score string, toxic string, label string, kept string"


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = queries.op10_toxicity(spark, folder).collect()
    assert len(out) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    unseen = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic = [x for x in unseen if x[2] == 1]
    ordinary = [x for x in unseen if x[2] == 0]
    assert len(toxic) > 10 and len(ordinary) > 10
    above = sum((a[0] > b[0]) + (a[0] == b[0]) / 2 for a in toxic for b in ordinary) / (len(toxic) * len(ordinary))
    recall = sum(x[1] for x in toxic) / len(toxic)
    alarms = sum(x[1] for x in ordinary) / len(ordinary)
    print(f"held out {len(unseen)}: AUC {above:.4f}, recall {recall:.4f}, false alarms {alarms:.4f}")
    assert above > 0.95 and recall > 0.9 and alarms < 0.05


def test_scores_of_hard_tables(spark):
    bad, good = "you vile stupid zorg", "the river runs by the old mill"
    rows = [(i, f"{bad} {i}" if i % 2 else f"{good} {i}") for i in range(80)] + [(200, None), (201, ""), (202, "?!"), (None, bad), (203, "word " * 30_000), (3, f"{bad} 3")]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SHAPE)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(80)] + [(1, 0, "x"), (None, 1, "x"), (201, None, "x")], "doc_id long, toxic int, label string")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[200]["score"] == by_id[201]["score"] == by_id[202]["score"] and not by_id[None]["held_out"]
    unseen = [r for r in out if r["held_out"] and r["doc_id"] < 80]
    assert len(unseen) > 5
    assert min(r["score"] for r in unseen if r["doc_id"] % 2) > max(r["score"] for r in unseen if r["doc_id"] % 2 == 0)
    assert toxicity.toxicity(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    labels = spark.read.parquet(f"{brute.SF}/labels.parquet").collect()
    turned = [(r["doc_id"], 1 - r["toxic"] if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 else r["toxic"]) for r in labels]
    run = lambda rows: {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, spark.createDataFrame(rows, "doc_id long, toxic int")).collect()}
    assert run(turned) == run([(r["doc_id"], r["toxic"]) for r in labels])


def test_each_stage_of_the_pipeline_on_what_is_before_it(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    columns, rejected = docs.columns, {r["doc_id"] for r in queries.op10_toxicity(spark, brute.SF).where("predicted = 1").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = {r["doc_id"]: r for r in docs.collect()}
        ids, texts = list(rows), [r["text"] for r in rows.values()]
        stage(spark, docs, brute.SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            break
        assert docs.columns == columns
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(got)
        if k == 0:
            assert rejected and got == {i: r["text"] for i, r in rows.items() if i not in rejected}
        elif k == 1:
            assert got == brute.lines_left([(i, r["text"], r["source"]) for i, r in rows.items()])
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)
        elif k == 2:
            first = brute.component_ids(ids, [brute.fingerprint(t) for t in texts])
            assert got == {i: rows[i]["text"] for i, c in zip(ids, first, strict=True) if i == c}
        else:
            hit = brute.contamination(texts, items)
            assert got == {i: rows[i]["text"] for i, h in zip(ids, hit, strict=True) if not h[1]}
    from pyspark.sql import functions as F

    packed = docs.withColumn("ids_crc32", F.crc32("ids")).collect()
    brute.check_packing(packed, dict(zip(ids, brute.token_ids(texts, "byte_bpe_50k.json", 0), strict=True)))


def test_every_gram_keeps_its_own_score(spark):
    import numpy as np
    import pyarrow as pa

    texts = [f"Word{i} vile{i % 7}x{i} - common aaaaaaaaaaaa{chr(0x430 + i % 9)}é" for i in range(300)] + [None, "", "?!", "end"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    taught = spark.createDataFrame([(t or "", i % 3 % 2, i % 4 == 3) for i, t in enumerate(texts)], "text string, label int, kept boolean")
    grams = toxicity.gram_counts(docs, taught).cache()

    def plain(text):
        """Grams of a text in order, by word: the letter numbers of up to five letters, the last one first."""
        words, word = [], []
        for b in [*(text or "").encode(), 0]:
            c = int(toxicity._LETTER[b])
            if c or word:
                word.append(c)
            if not c and word:
                words.append([sum(x << 5 * j for j, x in enumerate(reversed(word[max(0, i - 4) : i + 1]))) for i in range(len(word))])
                word = []
        return words

    want = {}
    for i, t in enumerate(texts):
        for g in (g for w in plain(t) for g in w):
            want.setdefault(g, [0, 0, 0, 0])[(0 if i % 3 % 2 else 1) + 2 * (i % 4 == 3)] += 1
    assert {r["gram"]: list(r)[1:] for r in grams.collect()} == want
    scores = toxicity.gram_scores(grams, toxicity.shared_backoff(grams)).cache()
    own = {r["gram"]: r["score"] for r in scores.collect()}
    assert own.keys() == want.keys()
    sent = toxicity.Scores.sent(scores, "score").table()
    assert all(sent[g] == np.float16(x) for g, x in own.items())
    table = toxicity._dense(np.array(list(own)), np.array(list(own.values())))
    got = toxicity.text_features(pa.array(texts), table)
    for i, t in enumerate(texts):
        values = sorted((sum(float(table[g]) for g in w) for w in plain(t)), reverse=True)
        letters = sum(len(w) for w in plain(t))
        first = [*values[:3], 0, 0, 0]
        assert got[:, i] == pytest.approx([sum(values) / max(1, letters), first[0], first[1], sum(max(0, v) for v in first[:3]) / 3, np.log1p(len(values))], abs=1e-9)


def test_kneser_ney_by_hand(spark):
    """Shared backoff and both models against sums over the counts in plain Python."""
    rows = [(f"ab{c} b{c}a c" * 3, i % 2, False) for i, c in enumerate("abcabdabe")]
    grams = toxicity.gram_counts(spark.createDataFrame([r[:1] for r in rows], "text string"), spark.createDataFrame(rows, "text string, label int, kept boolean")).cache()
    counts = {r["gram"]: (r["toxic"], r["ordinary"]) for r in grams.collect()}
    levels, low = {5: dict.fromkeys(counts, 1)}, None
    for m in range(4, 0, -1):
        levels[m] = {}
        for g in levels[m + 1]:
            levels[m][g & ((1 << 5 * m) - 1)] = levels[m].get(g & ((1 << 5 * m) - 1), 0) + 1

    def smoothed(n, of, below):
        same = [x for x in of if x >> 5 == n >> 5]
        total = sum(of[x] for x in same)
        return (max(of[n] - 0.75, 0) + 0.75 * sum(of[x] > 0 for x in same) * below) / total if total else below

    for m in range(1, 5):
        low = {g: smoothed(g, levels[m], 1 / 32 if low is None else low[g & ((1 << 5 * (m - 1)) - 1)]) for g in levels[m]}
    got = {r["gram"]: r["p"] for r in toxicity.shared_backoff(grams).collect()}
    assert got == pytest.approx(low)
    import math

    want = {g: math.log(smoothed(g, {x: c[0] for x, c in counts.items()}, low[g & 0xFFFFF]) / smoothed(g, {x: c[1] for x, c in counts.items()}, low[g & 0xFFFFF])) for g in counts}
    assert {r["gram"]: r["score"] for r in toxicity.gram_scores(grams, toxicity.shared_backoff(grams)).collect()} == pytest.approx(want)


def test_bound_of_the_fit_does_not_bound_the_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"vile{i} words" if i % 2 else f"mill{i} river") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    sums, count = [], toxicity.gram_counts
    monkeypatch.setattr(toxicity, "gram_counts", lambda rows, taught: sums.append(taught.selectExpr("sum(label)", "sum(1 - label)").first()) or count(rows, taught))
    assert toxicity.toxicity(docs, labels, labelled=10).count() == 120
    learnt = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert tuple(sums[0]) == (sum(i % 2 for i in learnt), sum(1 - i % 2 for i in learnt))
