"""Chat formatting with minimum-cost repair of roles.

Legal sequences: an optional system message, then user and assistant in turn, user first, assistant last. A turn may be
kept, merged into the message before it, given another role, and have empty messages inserted before it; each has a cost.
The cheapest repair is a shortest path over the states of the automaton (start, and the role of the last message), one
step a turn. Steps are matrices over the states and combine associatively, so a conversation that reaches over several
partitions is repaired from a matrix of each part: a part keeps its decisions for every pair of states at its ends, and the
driver links the parts' matrices, two a partition at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import table, text_batches, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs: merging turns of one role, merging into another role, a new role, a role for an unknown one, an empty message.
MERGE, MERGE_OTHER, RELABEL, NAME, INSERT = 1, 4, 3, 1, 2
FAR = 10**9
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def insertions(state: int) -> dict[int, list[int]]:
    """For every state the shortest row of empty messages that leads to it from state."""
    found, waiting = {state: []}, [state]
    for s in waiting:
        for t in NEXT[s]:
            if t not in found:
                found[t] = [*found[s], t]
                waiting.append(t)
    return found


def steps(role: int) -> dict[tuple[int, int], tuple[int, str, list[int]]]:
    """(state before, state after) -> (cost, action, inserted) of a turn with this role (0: unknown), cheapest first."""
    best: dict[tuple[int, int], tuple[int, str, list[int]]] = {}
    for s in STATES:
        options = [(MERGE if s == role else MERGE_OTHER, s, "merge", [])] if s != START else []
        for q, row in insertions(s).items():
            for t in NEXT[q]:
                own = (0, "keep") if t == role else (NAME if role == 0 else RELABEL, "relabel")
                options.append((own[0] + INSERT * len(row), t, own[1], row))
        for cost, t, action, row in options:
            if (s, t) not in best or (cost, len(row), action) < (best[s, t][0], len(best[s, t][2]), best[s, t][1]):
                best[s, t] = (cost, action, row)
    return best


STEPS = [steps(r) for r in range(4)]
COSTS = np.full((4, 4, 4), FAR, np.int64)
for _r in range(4):
    for (_s, _t), (_c, *_) in STEPS[_r].items():
        COSTS[_r, _s, _t] = _c
#: Empty messages that end a conversation legally, by its last state; an empty conversation is legal.
ENDS = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
END_COSTS = np.array([INSERT * len(ENDS[s]) for s in STATES])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def decode(codes: list[int], entry: int, exit_state: int | None) -> list[int]:
    """state before * 4 + state after of every turn on the cheapest path; without exit_state, to the cheapest end."""
    cost, back = [FAR] * 4, []
    cost[entry] = 0
    for c in codes:
        new, came = [FAR] * 4, [0] * 4
        for (s, t), (step, *_) in STEPS[c].items():
            if cost[s] + step < new[t]:
                new[t], came[t] = cost[s] + step, s
        cost = new
        back.append(came)
    at = exit_state if exit_state is not None else min(STATES, key=lambda s: (cost[s] + END_COSTS[s], s))
    out = []
    for came in reversed(back):
        out.append(came[at] * 4 + at)
        at = came[at]
    return out[::-1]


def safe(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def rendered(code: int, decision: int, text: str | None, last: bool) -> tuple[str, str, list[str], int, str]:
    """(action, role, inserted roles, cost, text) of a turn; the texts of a conversation's turns joined are its rendering."""
    s, t = divmod(decision, 4)
    cost, action, row = STEPS[code][s, t]
    if action == "merge":
        out = "\n" + safe(text)
    else:
        empty = "".join(f"{OPEN}{ROLES[r - 1]}\n{CLOSE}\n" for r in row)
        out = (f"{CLOSE}\n" if s != START else "") + empty + f"{OPEN}{ROLES[t - 1]}\n" + safe(text)
    after = []
    if last:
        after = ENDS[t]
        out += f"{CLOSE}\n" + "".join(f"{OPEN}{ROLES[r - 1]}\n{CLOSE}\n" for r in after)
    return action, ROLES[t - 1], [ROLES[r - 1] for r in row], cost + INSERT * len(after), out


FIELDS = "conv_id long, turn long, role string, text string, part int, seq long, segment int, code int, decisions array<tinyint>, matrix array<long>"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int8()), pa.list_(pa.int64())]


def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decisions for sorted turns: one a turn, or one for every pair of states where the conversation may reach further.

    The first and the last conversation of a partition, which may, also yield a row with their matrix.
    """
    part, seq, segment = TaskContext.get().partitionId(), 0, 0

    def turns() -> Iterator[tuple]:
        for batch in text_batches(batches):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def open_ended(codes: list[int]) -> tuple[list[list[int]], list[int]]:
        matrix = COSTS[codes[0]]
        for c in codes[1:]:
            matrix = combine(matrix, COSTS[c])
        paths = [decode(codes, s, t) if matrix[s, t] < FAR else [0] * len(codes) for s in STATES for t in STATES]
        return [list(d) for d in zip(*paths, strict=True)], matrix.ravel().tolist()

    def emit(rows: list[tuple], edge: bool) -> Iterator[pa.RecordBatch]:
        nonlocal seq, segment
        codes = [ROLES.index(r) + 1 if (r := (row[2] or "").strip().lower()) in ROLES else 0 for row in rows]
        out = []
        if edge:
            choices, matrix = open_ended(codes)
            out.append((rows[0][0], None, None, None, part, -1, segment, None, None, matrix))
        else:
            choices = [[d] for d in decode(codes, START, None)]
        out += [(*row, part, seq + i, segment if edge else -1 - (i == len(rows) - 1), c, d, None) for i, (row, c, d) in enumerate(zip(rows, codes, choices, strict=True))]
        seq += len(rows)
        segment += 1
        yield from held(out)

    waiting: list[tuple] = []

    def held(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        waiting.extend(rows)
        if len(waiting) >= 4000 or not rows:
            for i in range(0, len(waiting), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting[i : i + 4000], strict=True), TYPES, strict=True)], names=[f.split()[0] for f in FIELDS.split(", ")])
            waiting.clear()

    before: list[tuple] = []
    first = True
    for _, group in groupby(turns(), key=lambda row: row[0]):
        if before:
            yield from emit(before, first)
            first = False
        before = list(group)
    if before:
        yield from emit(before, True)
    yield from held([])


def link(parts: list[tuple[int, int, int | None, np.ndarray]]) -> list[tuple[int, int, int, int, bool]]:
    """(part, segment, entry, exit, whether it ends) of every part of a conversation, given in order with its matrix."""
    out = []
    for _, own in groupby(_runs(parts), key=lambda x: x[0]):
        run = [x[1] for x in own]
        costs = [np.array([0, FAR, FAR, FAR])]
        for *_, matrix in run:
            costs.append(np.minimum((costs[-1][:, None] + matrix).min(axis=0), FAR))
        at, path = int(np.argmin(costs[-1] + END_COSTS)), []
        for before, (*_, matrix) in zip(reversed(costs[:-1]), reversed(run), strict=True):
            s = int(np.argmin(before + matrix[:, at]))
            path.append((s, at))
            at = s
        out += [(p, g, s, t, i == len(run) - 1) for i, ((p, g, _, _), (s, t)) in enumerate(zip(run, reversed(path), strict=True))]
    return out


def _runs(parts: list[tuple]) -> Iterator[tuple[int, tuple]]:
    run, last = 0, object()
    for x in parts:
        run += x[2] != last
        last = x[2]
        yield run, x


def repair(turns: DataFrame) -> DataFrame:
    """A row for every row of turns (conv_id, turn, role, text): how it was repaired, and its share of the rendering.

    Columns: conv_id, turn, part, seq (ascending (part, seq) is the order of the turns), role (as given), action (keep, merge,
    relabel), new_role, inserted (roles of empty messages before it), cost, rendered. The turns of a conversation are ordered
    by turn, then role, then a hash of the text; nulls come first, and rows that repeat are turns like any other. Roles count
    without case or spaces around them; a null or other role is unknown and must be named. A null text is empty; markers inside texts are
    broken by a space. Rows with a null conv_id make up one conversation. An empty table gives an empty result; further
    columns are not read. A conversation of any length is spread over partitions by ranges of its turns.
    """
    keys = ["conv_id", "turn", "role", "mark"]
    dealt = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").withColumn("mark", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("mark")
    decided = written(dealt.mapInArrow(decide, FIELDS))
    parts = decided.where("seq = -1").select("part", "segment", "conv_id", "matrix").collect()  # two a partition at most
    links = link([(r["part"], r["segment"], r["conv_id"], np.array(r["matrix"]).reshape(4, 4)) for r in sorted(parts, key=lambda r: (r["part"], r["segment"]))])
    ends = {(p, g): (s * 4 + t, last) for p, g, s, t, last in links}
    shared = turns.sparkSession.sparkContext.broadcast(ends)
    lasts = decided.where("segment >= 0 and seq >= 0").groupBy("part", "segment").agg(F.max("seq").alias("last")).collect()  # two a partition at most
    final = turns.sparkSession.sparkContext.broadcast({(r["part"], r["segment"]): r["last"] for r in lasts})

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 4 << 20):
            out = []
            for conv, turn, role, text, part, seq, segment, code, decisions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment >= 0:
                    choice, ends_here = shared.value[part, segment]
                    decision, last = decisions[choice], ends_here and seq == final.value[part, segment]
                else:
                    decision, last = decisions[0], segment == -2
                out.append((conv, turn, part, seq, role, *rendered(code, decision, text, last)))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = ["conv_id", "turn", "part", "seq", "role", "action", "new_role", "inserted", "cost", "rendered"]
    schema = "conv_id long, turn long, part int, seq long, role string, action string, new_role string, inserted array<string>, cost long, rendered string"
    return decided.where("seq >= 0").drop("matrix").mapInArrow(render, schema)


def op6_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
