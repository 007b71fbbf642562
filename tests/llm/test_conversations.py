"""Conversation repair against a plain search over whole letter strings."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("plenum.llm")
from brute import SF  # noqa: E402
from plenum.llm import conversations, queries  # noqa: E402

SHAPE = "conv_id long, turn long, role string, text string, conv string, part string, block string, place string, audit string, way string"
SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(name.encode()) % 20
        if way == 1:
            text = ""
        elif way == 2:
            text = re.sub("[.!?]", "", text)
        elif way == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def repair(rows, insert=5, delete=2):
    """The contract's columns of one conversation's rows (turn, role, text) in order; whole written turns and letters are carried along."""
    counts, seen, marked = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for turn, role, text in rows:
        shown = SHOWN.findall(text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    ways = {"": (0, "", ())}  # by the initials written so far, all but the last two forgotten

    def state(turns):
        return "".join(t[:1] for t in turns)[-2:]

    def legal(turns):
        return re.fullmatch("(s?(ua)*u?)?", "".join(t[:1] for t in turns[-3:])) or re.fullmatch("a?(ua)*u?", "".join(t[:1] for t in turns[-3:]))

    def ok(before, turn):
        last, new = (before[-1][:1] if before else ""), turn[:1]
        return new == "u" and last in ("", "s", "a") or new == "a" and last == "u" or new == "s" and last == ""

    def best(options):
        out = {}
        for cost, letters, turns in options:
            key = turns[-1][:1] if turns else ""
            if key not in out or (cost, letters) < out[key][:2]:
                out[key] = (cost, letters, turns)
        return out

    def inserted(found):
        options = list(found.values())
        for _ in range(3):
            options += [(c + insert, le + "I", (*t, new)) for c, le, t in options for new in ("user:", "assistant:") if ok(t, new)]
        return options

    for role, text, fault in marked:
        options = []
        for cost, letters, turns in inserted(ways):
            options.append((cost + delete, letters + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + 5 * (fault == "truncated")
            if ok(turns, f"{role}:") and role[:1] in ("s", "u", "a"):
                options.append((more, letters + "K", (*turns, f"{role}:{text}")))
            options += [(more + 1, letters + "R", (*turns, f"{new}:{text}")) for new in ("user", "assistant") if ok(turns, new)]
        ways = best(options)
    cost, letters, turns = min(x for x in inserted(ways) if not x[2] or x[2][-1][:1] == "a")
    return gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def wanted(rows, damaged=True):
    out = {}
    left = damage(rows) if damaged else rows
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out[conv] = repair(own)
    return out


def got(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = wanted(rows)
    assert got(queries.op13_conversations(spark, SF)) == want
    assert {c for r in want.values() for c in r[6]} == set("DKR")  # at these costs no insert ever pays


def hard_rows():
    rng = random.Random(11)
    word = lambda: rng.choice(["Yes.", "No!", "a", "", " \n", "why? ", "so\tit goes", "é.", None])
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "u", "Sys"]), word()) for c in range(150) for _ in range(rng.randint(1, 14))]
    rows += [(None, t, "user", "x.") for t in range(5)] + [(777, t, "user" if t % 3 else "assistant", f"{t % 50}.") for t in range(900)]
    rows += [(778, 1, "user", "long " * 50_000 + "."), (778, 2, "assistant", "x."), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("block", [conversations.BLOCK, 7])
def test_hard_rows(spark, block):
    rows = hard_rows()
    frame = spark.createDataFrame([(*r, *"abcdef") for r in rows], SHAPE).repartition(5)
    assert got(conversations.repair_conversations(frame, block=block)) == wanted(rows)
    assert conversations.repair_conversations(frame.limit(0)).count() == 0


@pytest.mark.parametrize("costs", [(1, 2), (1, 1), (2, 9)])
def test_inserts_where_they_pay(monkeypatch, costs):
    monkeypatch.setattr(conversations, "INSERT", costs[0])
    monkeypatch.setattr(conversations, "DELETE", costs[1])
    caches = (conversations.step, conversations._after, conversations._before)
    for cache in caches:
        cache.cache_clear()
    letters = set()
    for conv in sorted({r[0] for r in hard_rows() if r[0] is not None and r[0] < 777}):
        own = [r[1:] for r in hard_rows() if r[0] == conv]
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want = repair(own, *costs)
        assert conversations.repaired(own) == want
        letters |= set(want[6])
    for cache in caches:
        cache.cache_clear()
    assert "I" in letters


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", "again.", "", "cut"])) for t in range(6000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(conversations.repair_conversations(frame, block=100)) == wanted(rows)
    assert got(conversations.repair_conversations(frame, block=100, block_text=50, damage=False)) == wanted(rows, damaged=False)


def test_conversation_of_dropped_rows_only(spark):
    conv = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    frame = spark.createDataFrame([(conv, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert got(conversations.repair_conversations(frame)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
