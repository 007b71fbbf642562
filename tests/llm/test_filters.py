"""Line dedup, quality rules and licence scans against brute force, on nulls, ties, empty tables and clashing columns."""

import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("plenum.llm")
from plenum.llm import licenses, linededup, quality  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, _lines string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SHAPE)


LINES = [
    (1, "Share this\nalpha one\n\nShare this", "en", "a"),
    (2, "beta two\n Share this\t", "en", "b"),
    (3, "Share this\ngamma", "de", "c"),
    (4, "alpha one", "de", "b"),
    (5, None, None, None),
    (6, "", "en", None),
    (None, "Share this", "en", "a"),
    (7, "gamma\n" * 3000 + "end", "en", "a"),
    (8, "gamma", "en", None),
    (8, "gamma", "en", None),
]


def test_lines_on_many_sites_stay_at_their_first_place(spark):
    out = linededup.dedup_lines(docs(spark, LINES))
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "_lines", "_removed"}
    got = sorted((r["doc_id"] or 0, r["text"], r["_removed"]) for r in out.collect() if r["text"] is not None)
    assert got == [
        (0, "Share this", 0), (1, "alpha one\n", 2), (2, "beta two", 1), (3, "gamma", 1), (4, "alpha one", 0), (6, "", 0),
        (7, "end", 3000), (8, "", 1), (8, "", 1),
    ]
    assert [r["_lines"] for r in out.where("doc_id = 5").collect()] == [0]


def test_lines_equal_brute_force(spark):
    rows = [(i, "\n".join(f"line {(i * k) % 17}" for k in range(1, 6)), "en", f"s{i % 5}") for i in range(60)]
    sites = defaultdict(set)
    first = {}
    for i, text, _, site in rows:
        for p, line in enumerate(text.split("\n")):
            sites[line].add(site)
            first.setdefault(line, (i, p))
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if len(sites[x]) < 3 or first[x] == (i, p)) for i, t, _, _ in rows}
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert got == want


def test_no_rows_no_lines(spark):
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def counted(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_statistics_and_outliers(spark):
    plain = [(i, " ".join(f"word{(i * 7 + k * (k + i)) % 97}" for k in range(60)), "en", "a") for i in range(40)]
    odd = [
        (100, "###*** $$$ %%% word " * 20, "en", "a"), (101, None, None, None), (102, "", "en", "a"), (103, "é\x0bü\nx\n x\nx", "en", None),
        (104, " ".join(f"w{k % 9}" for k in range(5000)), "de", "b"), (39, plain[39][1], "en", "a"), (None, "a b c d e f g h a b c d e f g h i", "en", "a"),
    ]
    out = quality.quality(docs(spark, plain + odd)).collect()
    texts = defaultdict(list)
    for i, text, _, _ in plain + odd:
        texts[i].append(text)
    assert Counter(r["doc_id"] for r in out) == Counter({i: len(t) for i, t in texts.items()})
    for r in out:
        want = counted(texts[r["doc_id"]][0])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert kept == set(range(40))
    assert quality.quality(docs(spark, [])).count() == 0


def test_licence_rules_follow_the_order_of_sentences(spark):
    mit = " ".join(licenses.SENTENCES[x] for x in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability"))
    wrapped = re.sub(r"((?:\S+ ){8})", lambda m: m[0][:-1] + "\n", mit)
    turned = " ".join(licenses.SENTENCES[x] for x in ("bsd-binary", "bsd-source", "bsd-grant"))
    rows = [
        (1, f"Some text\n{mit}", "en", "a"), (2, wrapped, "en", "a"), (3, turned, "en", "a"), (4, None, None, None), (5, "", "en", "a"),
        (6, "x\nReleased under the MIT License.\nAll rights reserved.\n" * 2, "en", "a"), (7, "licensed under cc by-nc 4.0. And more", "en", "a"),
        (8, licenses.SENTENCES["apache-licensed"] + " " + licenses.SENTENCES["apache-compliance"] + "\n" + licenses.SENTENCES["apache-copy"], "en", "a"),
        (None, "word " * 20000, "en", "a"),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {1: ["MIT"], 2: ["MIT"], 3: [], 4: [], 5: [], 6: ["All-rights-reserved", "MIT"], 7: ["CC-BY-NC-4.0"], 8: ["Apache-2.0"], None: []}
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_robust_estimates_have_the_least_determinant(spark):
    """Concentration from four starts against very many random starts in numpy, on groups with a far cluster, and against all subsets of a tiny group."""
    from itertools import combinations

    import numpy as np
    from plenum.llm import quality as q

    rng = np.random.default_rng(8)
    groups = {}
    for g in range(4):
        mixing = rng.normal(size=(4, 4)) + 2 * np.eye(4)
        core = rng.normal(size=(160, 4)) @ mixing + g
        groups[f"s{g}"] = np.vstack([core, rng.normal(size=(40, 4)) * 0.3 + 15 + g])
    groups["tiny"] = rng.normal(size=(9, 4))
    rows = [("en", s, int(i % q.SALTS), *map(float, x)) for s, points in groups.items() for i, x in enumerate(points)]
    frame = spark.createDataFrame(rows, "_lang string, _source string, _salt int, x0 double, x1 double, x2 double, x3 double")
    found = {r["_source"]: r for r in q.estimates(frame).collect()}
    assert found.keys() == groups.keys()

    # The shares of all texts that small groups lean on are the operator's own: they follow from the subsets that it chose.
    def distances(r, x):
        w = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                w[i, j] = r[f"w{i}{j}"]
        return (((x - [r[f"m{i}"] for i in range(4)]) @ w.T) ** 2).sum(axis=1)

    for s in list(groups)[:4]:
        x = groups[s]
        d = distances(found[s], x)
        assert d[160:].min() > q.CUTOFF > np.quantile(d[:160], 0.95)
        subset = x[np.argsort(d)[:150]]
        best = np.inf
        for _ in range(200):
            own = x[rng.choice(200, 5, replace=False)]
            for _ in range(15):
                m, c = own.mean(axis=0), np.cov(own.T, bias=True) + 1e-6 * np.eye(4)
                own = x[np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[:150]]
            best = min(best, np.linalg.slogdet(np.cov(own.T, bias=True))[1])
        assert np.linalg.slogdet(np.cov(subset.T, bias=True))[1] < best + 0.05

    x = groups["tiny"]
    # All texts' share dominates nine texts; with a covariance like it added, the chosen seven are among the best of all subsets.
    chosen = np.argsort(distances(found["tiny"], x))[:7]
    every = sorted(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) + 5 * np.eye(4))[1] for c in combinations(range(9), 7))
    own = np.linalg.slogdet(np.cov(x[chosen].T, bias=True) + 5 * np.eye(4))[1]
    assert own <= every[len(every) // 4]
