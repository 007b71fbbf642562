"""Plain versions of the corpus operators for whole small tables, written from their contracts."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"
CONTRACT_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def token_ids(texts, vocabulary, end_id):
    """Ids of each whole text, by the library alone."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return [e.ids + [end_id] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def contamination(texts, items):
    """(n_words, n_hit, item ids) of each text; `items`: (id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        words = CONTRACT_WORD.findall((text or "").translate(LOWER))
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i : i + size])].add(item)
    sizes, out = {len(w) for w in windows}, []
    for text in texts:
        words = CONTRACT_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if own := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= own
        out.append((len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def fingerprint(text):
    words = PLAIN_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(ids, prints):
    """The smallest id that each row reaches by fingerprints with 4 or fewer differing bits; every pair is compared."""
    bits = np.array(prints, np.uint64)
    out, left = [None] * len(ids), set(range(len(ids)))
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = {j for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 4).tolist() if j in left}
            left -= near
            todo += near
        first = min((ids[i] for i in group if ids[i] is not None), default=None)
        for i in group:
            out[i] = first
    return out


def lines_left(rows, min_sites=3):
    """Texts of `rows` (id, text, site), ids being unique, without lines on many sites but at their first place."""
    sites, first = defaultdict(set), {}
    for i, text, site in sorted(rows, key=lambda r: r[0]):
        for p, raw in enumerate((text or "").split("\n")):
            if line := raw.strip(" \t\x0b\x0c\r"):
                sites[line].add(site or "")
                first.setdefault(line, (i, p))
    out = {}
    for i, text, _ in rows:
        keep = []
        for p, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\x0b\x0c\r")
            if not line or len(sites[line]) < min_sites or first[line] == (i, p):
                keep.append(raw)
        out[i] = None if text is None else "\n".join(keep)
    return out


def check_packing(pieces, ids_of, capacity=2048):
    """Pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset) of documents {doc_id: ids}; gives the sequences' number."""
    own, placed = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append((p["piece"], p["start"], p["length"], p["ids_crc32"]))
        placed[p["sequence_id"]].append((p["offset"], p["length"]))
    assert own.keys() == ids_of.keys()
    for doc, ids in ids_of.items():
        at = 0
        for n, (piece, start, length, check) in enumerate(sorted(own[doc])):
            assert (piece, start) == (n, at) and 0 < length <= capacity
            assert n == 0 or length == capacity
            assert check == crc(ids[at : at + length])
            at += length
        assert at == len(ids) and len(own[doc]) == -(-len(ids) // capacity)
    for found in placed.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)
