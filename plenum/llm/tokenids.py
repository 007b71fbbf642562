"""Token ids of many texts with a given vocabulary file.

The tokenizers library gives the ids of each different piece of text, once as long as a task remembers it: a text is cut where the vocabulary's own
pre-tokenizer always cuts, and ids of the pieces are joined. A piece that is one run of Latin letters is one word of the vocabulary's model
and goes to the model itself; other pieces go through the whole library. Vocabularies whose cuts are not known here, and texts that hold one of the
vocabulary's added tokens, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: White space as the vocabulary files' patterns mean it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Latin letters that are one character in any normal form and in lower case.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
#: After a run of letters every pre-tokenizer here cuts; before ASCII signs and digits the run ends for certain.
_RUN = f"[{_LATIN}]++(?=[\t-@[-`{{-~]|$)"
#: A run without white space belongs with one space before it; the last space of a longer run belongs to what follows.
_SPACED = re.compile(f" ?{_RUN}| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORDS = re.compile(f"{_RUN}|[^{_SPACE}]+")
_LETTERS = re.compile(f" ?[{_LATIN}]+")

#: Pieces a task keeps ids of (twice that for a while), and the longest that is kept.
_KEPT, _LONGEST = 200_000, 64


def _byte_signs() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on, in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_SIGNS = _byte_signs()


class _Ids(dict):
    """Ids of pieces as bytes, found when first asked for; the older half is forgotten when there are too many."""

    def __init__(self, find):
        self._find, self._old = find, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            ids = self._find(piece)
        if len(piece) <= _LONGEST:
            if len(self) >= _KEPT:
                self._old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids by one vocabulary file, as the library gives them for a whole text with add_special_tokens=False. `width` is the bytes of an id: 2 if all
    ids fit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._model = self._tokenizer.model
        self._added = [token["content"] for token in spec.get("added_tokens") or []]
        self._lower = False
        self._cut = self._cuts(spec)
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._code = "H" if self.width == 2 else "I"
        self._ids = _Ids(self._of_piece)

    def _cuts(self, spec: dict):
        pre, normal, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
        if model.get("type") != "BPE" or model.get("dropout"):
            return None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            return _SPACED.findall
        steps = pre.get("pretokenizers") or []
        pattern = steps[0].get("pattern", {}).get("Regex", "") if steps else ""
        kinds = [x.get("type") for x in (normal or {}).get("normalizers", [])]
        split = steps and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        if split and [x.get("type") for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space") and kinds == ["NFC", "Replace", "Lowercase"]:
            self._lower = True
            return _WORDS.findall
        return None

    def _of_piece(self, piece: str) -> bytes:
        if _LETTERS.fullmatch(piece):
            own = piece.lower() if self._lower else piece
            signs = own.replace(" ", _SIGNS[32]) if own.isascii() else own.encode().decode("latin-1").translate(_SIGNS)
            return array(self._code, [token.id for token in self._model.tokenize(signs)]).tobytes()
        return self._whole(piece)

    def _whole(self, text: str) -> bytes:
        return array(self._code, self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned integers of `width` bytes; a null text is empty."""
        out, find = [], self._ids.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif self._cut is None or any(token in text for token in self._added):
                out.append(self._whole(text))
            else:
                out.append(b"".join(map(find, self._cut(text))))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker process's encoder of a vocabulary file, kept between tasks."""
    return Encoder(path)


def widened(ids: bytes, width: int) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
