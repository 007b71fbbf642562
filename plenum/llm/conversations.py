"""Conversation structure repair by Hirschberg's divide and conquer.

A repaired conversation's role initials read `(s?(ua)+)?`. While rows are taken one by one, what is written so far is in one of four states: nothing, a
system turn, ends in a user turn, ends in an assistant turn. A row is kept, given another role, or deleted; turns may be inserted before it. Each edit
letter leads from a state to one other state, so a state and the letters fix all that is written.

The cheapest edits, of equal ones the ASCII-least letters, are found as Hirschberg aligns strings: a forward vector (for each state the least cost and the rank of
its letters among the states') and a backward vector (least cost to the end) meet at the middle row; the state with the least sum, of equals that of
the least rank, is crossed there, and both halves are solved alone. Inserts belong to the row that follows them, so letters up to a
row are never the beginning of other letters up to it, and ranks decide. Nothing but the two vectors is held.

The same is done above rows. Rows are sorted over all tasks by conversation and turn. A conversation that lies inside one task is solved there. Of others each task
cuts its rows into blocks; a block is summed up as the four vectors from each state. Blocks of a task, then the tasks of a conversation, are steps like
rows: crossings are chosen for the tasks, then for their blocks, then for their rows, each in a task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.shared import mapped, written

#: Rows and characters of text a block has at most (but for its last row).
BLOCK, BLOCK_TEXT = 4096, 1 << 22
KEEP, REROLE, DELETE, INSERT, UNREPAIRED = 0, 1, 2, 5, 5
_SPACE = " \t\n\v\f\r"
_FAR = 1 << 60
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a written turn, by the state before: of a user or assistant turn, whichever may come.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
#: The step after the last row: inserts up to an accepted end, which is named state 0.
END = "end"

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # for each state: least cost, rank of the letters


def _inserts(state: int) -> Iterator[tuple[int, int]]:
    """(inserts, state after them). More than two in a row never pay."""
    for n in range(3):
        yield n, state
        state = _NEXT[state]


@lru_cache(maxsize=None)
def step(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """{(state, state after): (least cost, least letters)} of a row: its role initial if it is s, u or a and else -, then `d` if it must be
    deleted, `t` if truncated, or nothing; or of END."""
    out: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(a: int, b: int, cost: int, letters: str) -> None:
        out[a, b] = min(out.get((a, b), (_FAR, "")), (cost, letters))

    for a in STATES:
        for n, b in _inserts(a):
            cost, letters = INSERT * n, "I" * n
            if kind == END:
                if b in (NOTHING, ASSISTANT):
                    offer(a, 0, cost, letters)
                continue
            offer(a, b, cost + DELETE, letters + "D")
            if "d" in kind[1:]:
                continue
            worse = UNREPAIRED * ("t" in kind[1:])
            offer(a, _NEXT[b], cost + REROLE + worse, letters + "R")
            own = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(kind[0])
            if own == _NEXT[b] or (own == SYSTEM and b == NOTHING):
                offer(a, own, cost + KEEP + worse, letters + "K")
    return out


def _from(state: int) -> Vector:
    return tuple(0 if s == state else _FAR for s in STATES), (0, 0, 0, 0)


def _joined(before: Vector, options: list[tuple[int, int, int, object]]) -> Vector:
    """The vector after options (state, state after, cost, order of their letters among those of the state)."""
    cost, rank = before
    best: dict[int, tuple] = {}
    for a, b, more, order in options:
        if cost[a] < _FAR and more < _FAR:
            offer = (cost[a] + more, rank[a], order)
            if b not in best or offer < best[b]:
                best[b] = offer
    ranks = {key: i for i, key in enumerate(sorted({v[1:] for v in best.values()}))}
    return tuple(best[s][0] if s in best else _FAR for s in STATES), tuple(ranks[best[s][1:]] if s in best else 0 for s in STATES)


class RowSteps:
    """Steps that are rows, by their kinds. Vectors are kept less their least cost, so that few different ones occur."""

    def __init__(self, kinds: list[str]):
        self.kinds = kinds

    def __len__(self) -> int:
        return len(self.kinds)

    def forward(self, at: Vector, a: int, b: int) -> Vector:
        base, (cost, rank) = 0, at
        for kind in self.kinds[a:b]:
            more, cost, rank = _after(cost, rank, kind)
            base += more
        return tuple(min(_FAR, c + base) for c in cost), rank

    def backward(self, cost: tuple[int, ...], a: int, b: int) -> tuple[int, ...]:
        base = 0
        for kind in reversed(self.kinds[a:b]):
            more, cost = _before(cost, kind)
            base += more
        return tuple(min(_FAR, c + base) for c in cost)


def _less(cost: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    least = min(cost)
    return least, tuple(c - least if c < _FAR else _FAR for c in cost)


@lru_cache(maxsize=1 << 16)
def _after(cost: tuple[int, ...], rank: tuple[int, ...], kind: str) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    cost, rank = _joined((cost, rank), [(a, b, more, letters) for (a, b), (more, letters) in step(kind).items()])
    return *_less(cost), rank


@lru_cache(maxsize=1 << 16)
def _before(cost: tuple[int, ...], kind: str) -> tuple[int, tuple[int, ...]]:
    found = step(kind)
    return _less(tuple(min([_FAR, *(more + cost[b] for (s, b), (more, _) in found.items() if s == a and cost[b] < _FAR)]) for a in STATES))


class NodeSteps:
    """Steps that are summed-up runs of rows: for each state the vector from it."""

    def __init__(self, nodes: list[list[Vector]]):
        self.nodes = nodes

    def __len__(self) -> int:
        return len(self.nodes)

    def forward(self, at: Vector, a: int, b: int) -> Vector:
        for node in self.nodes[a:b]:
            at = _joined(at, [(s, t, node[s][0][t], node[s][1][t]) for s in STATES for t in STATES])
        return at

    def backward(self, cost: tuple[int, ...], a: int, b: int) -> tuple[int, ...]:
        for node in reversed(self.nodes[a:b]):
            cost = tuple(min([_FAR, *(node[s][0][t] + cost[t] for t in STATES if cost[t] < _FAR and node[s][0][t] < _FAR)]) for s in STATES)
        return cost


def crossings(steps: RowSteps | NodeSteps, start: int, end: int) -> list[tuple[int, int]]:
    """The states before and after each step on the audit-least cheapest way from `start` to `end`."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(steps), start, end)]
    while todo:
        a, b, first, last = todo.pop()
        if b - a <= 1:
            out += [(first, last)] * (b - a)
            continue
        middle = (a + b) // 2
        cost, rank = steps.forward(_from(first), a, middle)
        rest = steps.backward(_from(last)[0], middle, b)
        at = min((s for s in STATES if cost[s] < _FAR and rest[s] < _FAR), key=lambda s: (cost[s] + rest[s], rank[s]))
        todo += [(middle, b, at, last), (a, middle, first, at)]
    return out


def summed(steps: RowSteps | NodeSteps) -> list[Vector]:
    """For each state the vector after all steps."""
    return [steps.forward(_from(s), 0, len(steps)) for s in STATES]


def letters_of(kinds: list[str], start: int, end: int) -> list[str]:
    """The edit letters of each row."""
    return [step(kind)[way][1] for kind, way in zip(kinds, crossings(RowSteps(kinds), start, end), strict=True)]


def written_turns(state: int, letters: str, role: str, text: str) -> Iterator[str]:
    """The turns `role:text` that a row's letters write from `state` on; ends are followed by `states_after`."""
    for letter in letters:
        if letter == "I":
            yield f"{_NAMES[_NEXT[state]]}:"
            state = _NEXT[state]
        elif letter == "R":
            yield f"{_NAMES[_NEXT[state]]}:{text}"
            state = _NEXT[state]
        elif letter == "K":
            yield f"{role}:{text}"


def initial(role: str) -> str:
    return role[:1]


def fault(text: str, again: bool) -> str:
    """The first fault of a row, or an empty string."""
    shown = text.rstrip(_SPACE)
    if not shown:
        return "blank"
    if again:
        return "duplicate"
    return "" if shown[-1] in ".!?" else "truncated"


def kind_of(role: str, found: str) -> str:
    first = initial(role)
    return (first if first and first in "sua" else "-") + {"": "", "truncated": "t"}.get(found, "d")


class _Tally:
    """Counts of a run of rows that can be joined to the next run's."""

    def __init__(self):
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, found: str) -> None:
        if found:
            self.faults[found] += 1
        own = initial(role)
        if self.last_role is None:
            self.first_role = own
        elif self.last_role + own not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_role = own
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def join(self, other: _Tally) -> None:
        for f in FAULTS:
            self.faults[f] += other.faults[f]
        if self.last_role is not None and other.first_role is not None:
            self.illegal += self.last_role + other.first_role not in ("su", "ua", "au")
        self.illegal += other.illegal
        self.first_role = other.first_role if self.first_role is None else self.first_role
        self.last_role = self.last_role if other.last_role is None else other.last_role
        self.turns += other.turns - (other.turns > 0 and other.first_turn == self.last_turn)
        if other.turns:
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn

    def values(self) -> tuple[int, ...]:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return gaps, *(self.faults[f] for f in FAULTS), self.illegal

    def packed(self) -> list[int | str | None]:
        return [*(self.faults[f] for f in FAULTS), self.illegal, self.turns, self.first_turn, self.last_turn]

    @classmethod
    def unpacked(cls, values: list, first_role: str, last_role: str) -> _Tally:
        own = cls()
        own.faults = dict(zip(FAULTS, values[:3], strict=True))
        own.illegal, own.turns, own.first_turn, own.last_turn = values[3:]
        own.first_role, own.last_role = first_role, last_role
        return own


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = [c.split()[0] for c in RESULT.split(", ")]


def _cost(kinds: list[str]) -> int:
    return RowSteps(kinds).forward(_from(NOTHING), 0, len(kinds))[0][0]


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """`RESULT` of a conversation's rows (turn, role, text) in order."""
    tally, kinds, seen = _Tally(), [], set()
    for turn, role, text in rows:
        found = fault(text, (role, text) in seen)
        seen.add((role, text))
        tally.add(turn, role, found)
        kinds.append(kind_of(role, found))
    kinds.append(END)
    ways = crossings(RowSteps(kinds), NOTHING, 0)
    audit, turns, cost = [], [], 0
    for kind, way, (_, role, text) in zip(kinds, ways, [*rows, (None, "", "")], strict=True):
        more, letters = step(kind)[way]
        cost += more
        audit.append(letters)
        turns += written_turns(way[0], letters, role, text)
    return *tally.values(), cost, "".join(audit), hashlib.sha256("\n".join(turns).encode()).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) after damage by the checksum of `conv:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    `[.!?]` out, 3 repeats it, 4 makes its role user. Nulls count as one space, but a null turn sorts as null and a null conversation stays one."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(held("conv"), F.lit(":"), held("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv", "turn", held("role").alias("role"), held("text").alias("text"), way.alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), times.alias("times")).select("conv", "turn", "role", "text", F.explode("times").alias("copy")).drop("copy")


def _solved(rows: DataFrame, block: int, block_text: int) -> DataFrame:
    """Sorted rows, one task after the other: a row of `RESULT` (done) for each conversation that lies inside a task and has `block` rows at most;
    the rows of the others with the number of their task (part), block and place."""
    kind = rows.schema["conv"].dataType.simpleString()
    turn_kind = rows.schema["turn"].dataType.simpleString()
    names = ["conv", "done", *_RESULT, "part", "block", "place", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, number = TaskContext.get().partitionId(), 0, 0
        at, held, size, open_, types = None, [], 0, True, None
        done: list[tuple] = []

        def shown() -> Iterator[pa.RecordBatch]:
            """The held rows as rows of a block."""
            nonlocal place, number, held, size
            if held:
                n = len(held)
                turns, roles, texts = zip(*held, strict=True)
                none = [None] * n
                columns = [[at[0]] * n, [False] * n, *([none] * len(_RESULT)), [part] * n, [number] * n, range(place, place + n), turns, roles, texts]
                yield batch_of(columns)
                place, number, held, size = place + n, number + 1, [], 0

        def batch_of(columns: list) -> pa.RecordBatch:
            kinds = [types.field(0).type, pa.bool_(), *([pa.int64()] * 6), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), types.field(1).type, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def results() -> Iterator[pa.RecordBatch]:
            if done:
                n = len(done)
                convs, *values = zip(*done, strict=True)
                yield batch_of([convs, [True] * n, *values, *([[None] * n] * 6)])
                done.clear()

        for batch in batches:
            types = batch.schema
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv,) != at:
                    if at is not None and not open_:
                        done.append((at[0], *repaired(held)))
                        held, size = [], 0
                    elif at is not None:
                        yield from shown()
                    open_, at = at is None, (conv,)  # the first of a task may have begun in another
                if len(held) >= block or size > block_text:
                    open_ = True
                    yield from shown()
                held.append((turn, role, text))
                size += len(text)
            if len(done) > 1000:
                yield from results()
        yield from results()
        if at is not None:  # the last may go on in another
            yield from shown()

    shape = f"conv {kind}, done boolean, {RESULT}, part int, block int, place long, turn {turn_kind}, role string, text string"
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    return mapped(rows.select("conv", "turn", "role", "text").repartitionByRange(*order).sortWithinPartitions(*order), run, shape)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[pa.DataType], tuple, list[tuple]]]:
    """(types of the columns, key, rows) of rows that come sorted by their key, the first columns."""
    at, held, types = None, [], []
    for batch in batches:
        types = batch.schema.types
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != at and held:
                yield types, at, held
                held = []
            at = row[:keys]
            held.append(row)
    if held:
        yield types, at, held


def _batch(names: str, types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names.split())


_VECTORS = "costs array<long>, ranks array<int>"
_TALLY = "tally array<long>, first_role string, last_role string"


def _flat(nodes: list[Vector]) -> tuple[list[int], list[int]]:
    return [c for cost, _ in nodes for c in cost], [r for _, rank in nodes for r in rank]


def _nodes(costs: list[int], ranks: list[int]) -> list[Vector]:
    return [(tuple(costs[4 * s : 4 * s + 4]), tuple(ranks[4 * s : 4 * s + 4])) for s in STATES]


def _block_sums(rows: DataFrame, kind: str) -> DataFrame:
    """(conv, part, block, costs, ranks, tally, first_role, last_role) of rows (conv, part, block, place, turn, role, fault)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, (conv, part, block), held in _runs(batches, 3):
            tally = _Tally()
            for row in held:
                tally.add(row[4], row[5], row[6])
            costs, ranks = _flat(summed(RowSteps([kind_of(r[5], r[6]) for r in held])))
            values = [[conv], [part], [block], [costs], [ranks], [tally.packed()], [tally.first_role], [tally.last_role]]
            kinds = [types[0], pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["conv", "part", "block", "costs", "ranks", "tally", "first_role", "last_role"])

    keys = ["conv", "part", "block"]
    small = rows.select(*keys, "place", "turn", "role", "fault").repartition(*keys).sortWithinPartitions(*keys, "place")
    return mapped(small, run, f"conv {kind}, part int, block int, {_VECTORS}, {_TALLY}")


def _part_sums(blocks: DataFrame, kind: str) -> DataFrame:
    """The same of each part (conv, part), from its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, (conv, part), held in _runs(batches, 2):
            tally = _Tally()
            for row in held:
                tally.join(_Tally.unpacked(row[5], row[6], row[7]))
            costs, ranks = _flat(summed(NodeSteps([_nodes(r[3], r[4]) for r in held])))
            values = [[conv], [part], [costs], [ranks], [tally.packed()], [tally.first_role], [tally.last_role]]
            yield pa.RecordBatch.from_arrays([pa.array(v, types[i]) for i, v in zip((0, 1, 3, 4, 5, 6, 7), values, strict=True)], names=["conv", "part", "costs", "ranks", "tally", "first_role", "last_role"])

    keys = ["conv", "part"]
    return mapped(blocks.repartition(*keys).sortWithinPartitions(*keys, "block"), run, f"conv {kind}, part int, {_VECTORS}, {_TALLY}")


def _part_ways(parts: DataFrame, kind: str) -> DataFrame:
    """(conv, part, start, end, result) from the parts of each conversation, of which there are as many as tasks at most: the states before and after each
    part, and after the last part the end of the conversation, with its tally and cost (result)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = [(tuple(step(END).get((s, t), (_FAR, ""))[0] for t in STATES), (0, 0, 0, 0)) for s in STATES]
        for types, (conv,), held in _runs(batches, 1):
            tally = _Tally()
            for row in held:
                tally.join(_Tally.unpacked(row[4], row[5], row[6]))
            steps = NodeSteps([*(_nodes(r[2], r[3]) for r in held), end])
            ways = crossings(steps, NOTHING, 0)
            cost = steps.forward(_from(NOTHING), 0, len(steps))[0][0]
            n = len(held)
            values = [[conv] * n, [r[1] for r in held], [w[0] for w in ways[:n]], [w[1] for w in ways[:n]], [None] * (n - 1) + [[*tally.values(), cost, ways[n][0]]]]
            kinds = [types[0], pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["conv", "part", "start", "end", "result"])

    return mapped(parts.repartition("conv").sortWithinPartitions("conv", "part"), run, f"conv {kind}, part int, start int, end int, result array<long>")


def _block_ways(blocks: DataFrame, ways: DataFrame, kind: str) -> DataFrame:
    """(part, block, conv, start, end, result) of each block, from the states of its part; a conversation's last block has its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, (conv, part), held in _runs(batches, 2):
            found = crossings(NodeSteps([_nodes(r[3], r[4]) for r in held]), held[0][5], held[0][6])
            n = len(held)
            values = [[conv] * n, [part] * n, [r[2] for r in held], [w[0] for w in found], [w[1] for w in found], [None] * (n - 1) + [held[0][7]]]
            kinds = [types[0], pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["conv", "part", "block", "start", "end", "result"])

    same = blocks["conv"].eqNullSafe(ways["conv"]) & (blocks["part"] == ways["part"])
    joined = blocks.join(ways, same).select(blocks["conv"], blocks["part"], "block", "costs", "ranks", "start", "end", "result")
    return mapped(joined.repartition("conv", "part").sortWithinPartitions("conv", "part", "block"), run, f"conv {kind}, part int, block int, start int, end int, result array<long>")


def _block_edits(rows: DataFrame, ways: DataFrame, kind: str) -> DataFrame:
    """(conv, part, block, audit, turns, any, result): the letters and the written turns of each block; any: are there turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for types, (conv, part, block), held in _runs(batches, 3):
            kinds = [kind_of(r[4], r[6]) for r in held]
            audit, turns = [], []
            for kind_, way, row in zip(kinds, crossings(RowSteps(kinds), held[0][7], held[0][8]), held, strict=True):
                letters = step(kind_)[way][1]
                audit.append(letters)
                turns += written_turns(way[0], letters, row[4], row[5])
            values = [[conv], [part], [block], ["".join(audit)], ["\n".join(turns)], [bool(turns)], [held[0][9]]]
            kinds_ = [types[0], pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds_, strict=True)], names=["conv", "part", "block", "audit", "turns", "any", "result"])

    keys = ["part", "block"]  # a block's number is unique within its part
    joined = rows.join(ways.drop("conv"), keys).select("conv", "part", "block", "place", "role", "text", "fault", "start", "end", "result")
    return mapped(joined.repartition(*keys).sortWithinPartitions(*keys, "place"), run, f"conv {kind}, part int, block int, audit string, turns string, any boolean, result array<long>")


def _finished(edits: DataFrame, kind: str) -> DataFrame:
    """(conv, *RESULT): blocks in order, one at a time in memory; a hash cannot be taken but in order, so one task reads a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, audit, any_, result, types = None, None, [], False, None, None

        def out() -> pa.RecordBatch:
            *counts, cost, last = result
            letters = step(END)[last, 0][1]
            state = last
            for _ in letters:
                sha.update((b"\n" if any_ or state != last else b"") + f"{_NAMES[_NEXT[state]]}:".encode())
                state = _NEXT[state]
            values = [at[0], *counts, cost, "".join(audit) + letters, sha.hexdigest()]
            kinds = [types.field(0).type, *([pa.int64()] * 6), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["conv", *_RESULT])

        for batch in batches:
            types = batch.schema
            for i in range(batch.num_rows):
                conv, _, _, letters, turns, some, found = (c[i].as_py() for c in batch.columns)
                if (conv,) != at:
                    if at is not None:
                        yield out()
                    at, sha, audit, any_, result = (conv,), hashlib.sha256(), [], False, None
                audit.append(letters)
                if some:
                    sha.update((b"\n" if any_ else b"") + turns.encode())
                    any_ = True
                result = found or result
        if at is not None:
            yield out()

    return mapped(edits.repartition("conv").sortWithinPartitions("conv", "part", "block"), run, f"conv {kind}, {RESULT}")


def _open_results(rows: DataFrame, kind: str) -> DataFrame:
    """`RESULT` of the conversations that lie in several tasks or blocks."""
    shown = F.rtrim("text", F.lit(_SPACE))
    number = (F.shiftleft(F.col("part").cast("long"), 40) + F.col("place")).alias("number")
    same = F.sha2(F.concat(F.lpad(F.octet_length("role").cast("string"), 12, "0"), "role", "text").cast("binary"), 256).alias("same")
    firsts = rows.select("conv", same, number).groupBy("conv", "same").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
    found = (
        F.when(shown == "", "blank").when(F.col("first").isNull(), "duplicate")
        .when(F.substring(shown, -1, 1).isin(".", "!", "?"), "").otherwise("truncated")
    )
    marked = written(rows.withColumn("number", number).join(firsts, "number", "left").withColumn("fault", found).drop("number", "first"), "turns")
    blocks = written(_block_sums(marked, kind), "blocks")
    ways = _part_ways(_part_sums(blocks, kind), kind)
    return _finished(_block_edits(marked, _block_ways(blocks, written(ways, "ways"), kind), kind), kind)


def repair_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True,
    block: int = BLOCK, block_text: int = BLOCK_TEXT,
) -> DataFrame:
    """(`conv_col`, *RESULT) for each conversation, of its rows by turn (nulls first; rows of one turn by role and text).

    With `damage` rows are damaged first, see `damaged`. Null roles and texts are one space; a null conversation is one of its own. Repeated rows are rows like
    any other, and so duplicates. A conversation without rows after damage has zeros, an empty audit and the hash of an empty string. An empty
    table gives an empty table. Other columns are not read. The audit and hash of one conversation are put together by one task, block by block.
    """
    source = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = damaged(source) if damage else source.select("conv", "turn", held("role"), held("text"))
    kind = source.schema["conv"].dataType.simpleString()
    first = written(_solved(rows, block, block_text), "conversations")
    done = first.where("done").select("conv", *_RESULT)
    every = done.unionByName(_open_results(first.where("NOT done").select("conv", "part", "block", "place", "turn", "role", "text"), kind))
    ids = source.select(F.col("conv").alias("id")).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    return ids.join(every, F.col("id").eqNullSafe(F.col("conv")), "left").select(
        F.col("id").alias(conv_col), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _RESULT[:6]),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
