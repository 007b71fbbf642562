"""Packing and token files against the tokenizers library, on whole tables and on hard small ones."""

import random

import numpy as np
import pytest

pytest.importorskip("plenum.llm")
from brute import SF, check_packing, crc, token_ids  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from plenum.llm import packing, queries, tokenfiles  # noqa: E402
from plenum.llm.shared import new_folder  # noqa: E402
from plenum.llm.tokenids import Encoder  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
HARD = [
    None, "", " ", "\n\n", "  a  b\t\tc \n d ", "don't we'll I'M", "x" * 3000, "<|endoftext|> is text", "é ́a é", "你好　世界",
    "a b c​d\x85e\x1cf", "\U0001f600\U0001f468‍\U0001f469", "12345 6,7.8%", "ΣΣΣ İstanbul", "word " * 5000, "\x00\x01 ﻿",
]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_pieces_of_texts_have_the_ids_of_whole_texts(name):
    encoder = Encoder(queries.vocabulary(name))
    got = [np.frombuffer(x, f"<u{encoder.width}").tolist() for x in encoder.encode(HARD)]
    assert got == [x[:-1] for x in token_ids(HARD, name, 0)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85     　'aZ1.,́é"), st.characters(codec="utf-8")), max_size=40))
def test_any_text_has_the_ids_of_the_whole_text(text):
    for name in (BYTE, WORD):
        if name not in _ENCODERS:
            _ENCODERS[name] = Encoder(queries.vocabulary(name))
        own = _ENCODERS[name]
        assert np.frombuffer(own.encode([text])[0], f"<u{own.width}").tolist() == token_ids_of(text, name)


_ENCODERS: dict = {}
_TOKENIZERS: dict = {}


def token_ids_of(text, name):
    from tokenizers import Tokenizer

    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = Tokenizer.from_file(queries.vocabulary(name))
    return _TOKENIZERS[name].encode(text, add_special_tokens=False).ids


def test_all_documents_are_packed_tightly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([r["doc_id"] for r in docs], token_ids([r["text"] for r in docs], BYTE, 0), strict=True))
    used = check_packing(queries.op1_packing(spark, SF).collect(), ids)
    assert used <= 1 + -(-sum(map(len, ids.values())) // 2048)


def test_packing_of_nulls_repeats_and_no_rows(spark):
    shape = "doc_id long, text string, piece string, length string, ids string"
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(HARD)] + [(None, None, None, None, None), (3, HARD[3], "x", "y", "z")]
    out = packing.pack(spark.createDataFrame(rows, shape), queries.vocabulary(BYTE), parts=3).collect()
    assert sum(r["length"] for r in out) == sum(map(len, token_ids([r[1] for r in rows], BYTE, 0)))
    assert sum(r["doc_id"] is None for r in out) == 1 and sum(r["doc_id"] == 3 for r in out) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert packing.pack(spark.createDataFrame([], shape), queries.vocabulary(BYTE)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plans_use_every_piece_once_and_no_sequence_overflows(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 50, 300])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 3, 5, 1000]) for _ in range(rng.randint(0, 60))}
    found = packing.plan(counts, capacity)
    used = {}
    for copies, times in found:
        assert times > 0 and sum(n * k for n, k in copies.items()) <= capacity
        for n, k in copies.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counts
    total = sum(n * k for n, k in counts.items())
    assert sum(t for _, t in found) <= max(-(-total // capacity) * 1.5 + 1, sum(k for n, k in counts.items() if 2 * n > capacity) + total / capacity)


def test_exact_complements_fill_sequences():
    assert sum(t for _, t in packing.plan({60: 5, 40: 5}, 100)) == 5
    assert sum(t for _, t in packing.plan({60: 5, 25: 5, 15: 5}, 100)) == 5
    assert sum(t for _, t in packing.plan({55: 4, 20: 4, 15: 4, 10: 4}, 100)) == 4
    assert packing.plan({}, 100) == []


def test_all_documents_come_back_from_token_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, []
    for r, ids in zip(docs, token_ids([r["text"] for r in docs], WORD, 2), strict=True):
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    got = queries.op3_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_token_files_hold_equal_sequences_and_masks(spark):
    shape = "doc_id long, text string, shard string, start string, file string"
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(HARD)] + [(None, None, None, None, None), (3, HARD[3], "x", "y", "z")]
    index = tokenfiles.write_tokens(spark.createDataFrame(rows, shape), new_folder(spark, "t"), queries.vocabulary(WORD), length=16)
    back = tokenfiles.read_tokens(index).orderBy("start").collect()
    ids = [i for r in back for i in np.frombuffer(r["ids"], "<u4").tolist()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert ids == [i for x in token_ids([r[1] for r in ordered], WORD, 2) for i in x]
    flat = []
    for file, n in sorted((r["file"], r["n"]) for r in index.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()):
        opened = tokenfiles.TokenFile(file)
        for i in range(-(-n // 16)):
            values, mask = opened.sequence(i)
            assert len(values) == len(mask) == 16 and mask.tolist() == [i * 16 + k < n for k in range(16)]
            flat += values[mask].tolist()
    assert flat == ids
    empty = tokenfiles.write_tokens(spark.createDataFrame([], shape), new_folder(spark, "t"), queries.vocabulary(WORD))
    assert tokenfiles.read_tokens(empty).count() == 0


def test_encoder_gives_what_the_library_gives(monkeypatch):
    """Texts of letters, signs, odd spaces, contractions and the vocabularies' own special strings, against whole texts in the library."""
    import random

    import numpy as np
    import public_tokenizers
    from plenum.llm import tokenids
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenids, "_KEPT", 500)  # ids are forgotten and found again
    rng = random.Random(1)
    parts = [*"abcXYZ ÀéßŁİıǅµªº×÷12٣,.;'\"!?-_<|>\n\t\r\x85\xa0 　​́Жя中😀#$%&", "'s", "'re", "'S", "  ", "<|endoftext|>", "<|startoftext|>", " the", "tion"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    texts += ["two  <|endoftext|>  ends", "<|endoftext|>", "a<|startoftext|>b", "word " * 5000, "x" * 3000]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        own = tokenids.Encoder(path)
        want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
        for text, got, right in zip(texts, own.encode(texts), want, strict=True):
            assert np.frombuffer(got, f"<u{own.width}").tolist() == right.ids, text
    assert 50256 in tokenids.encoder(public_tokenizers.path("byte_bpe_50k.json"))._tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids
