"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn followed by user and assistant turns in alternation, ending with the
assistant. A dynamic programme over the states of this automaton decides for each turn whether it is kept, given another
role, merged into the turn before, or preceded by empty turns, at least total cost. Turns are range-partitioned by
conversation and order. The programme's steps are matrices over (min, +), so a conversation that spans partitions is
summed up by one small matrix per partition; these are chained by conversation, and each partition is told the states at
its edges. No conversation has to fit into one task. Inside a partition all conversations advance together, a turn at a
time, in NumPy; long ones are cut into segments that advance together too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import bound_batches, shared_dir

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Which turn may follow which, and the states in which a conversation may end.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs: another role for a known or an unknown one, joining the turn before, an empty turn.
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2.0, 0.5, 0.75, 1.5
#: Turns and bytes of text of a partition, and turns that advance one after the other.
ROWS_PER_TASK, BYTES_PER_TASK, SEGMENT = 50_000, 64 << 20, 64
Step = tuple[float, str, tuple[int, ...], int]


def _runs(state: int) -> list[tuple[tuple[int, ...], int]]:
    """Legal runs of up to two inserted turns from a state, and where they lead."""
    out = [((), state)]
    for _ in range(2):
        out += [((*run, n), n) for run, end in out for n in NEXT[end] if n != SYSTEM and ((*run, n), n) not in out]
    return out


def steps(role: int | None) -> list[list[Step | None]]:
    """Best way to take a turn of this role, from each state to each state: (cost, action, inserted, to)."""
    table: list[list[Step | None]] = [[None] * 4 for _ in range(4)]

    def offer(a: int, b: int, step: Step) -> None:
        if table[a][b] is None or step[:3] < table[a][b][:3]:
            table[a][b] = step

    for a in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            other = 0.0 if role == to else RELABEL_UNKNOWN if role is None else RELABEL
            if a == to:
                offer(a, to, (MERGE + other, "merge" if role == to else "merge_relabel", (), to))
            for run, end in _runs(a):
                if to in NEXT[end]:
                    offer(a, to, (INSERT * len(run) + other, "keep" if role == to else "relabel", run, to))
    return table


#: By role (0: unknown or null), state and next state: the best step, and its cost in quarters, so that sums are exact.
STEPS = [steps(r or None) for r in range(4)]
NEVER = 1 << 40
COST = np.array([[[NEVER if x is None else round(4 * x[0]) for x in row] for row in t] for t in STEPS], np.int64)
CLOSE = [min((run for run, end in _runs(s) if end == ASSISTANT), key=len) for s in range(4)]
CLOSE_COST = np.array([round(4 * INSERT * len(run)) for run in CLOSE], np.int64)
_EYE = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)


def _empty_turns(run: tuple[int, ...]) -> str:
    return "".join(f"<|{ROLES[r]}|>\n<|end|>\n" for r in run)


def _opening(state: int, step: Step | None) -> str:
    """What is rendered before the text of a turn taken by this step."""
    if step is None or step[1].startswith("merge"):
        return "\n"
    return "<|end|>\n" * (state != START) + _empty_turns(step[2]) + f"<|{ROLES[step[3]]}|>\n"


_FLAT = [(a, step) for table in STEPS for a, row in enumerate(table) for step in row]
_ROLE_NAMES = pa.array([None, *ROLES.values()])
_ACTIONS = pa.array([step and step[1] for _, step in _FLAT])
_INSERTED = pa.array([[ROLES[r] for r in step[2]] if step else [] for _, step in _FLAT], pa.list_(pa.string()))
_OPENINGS = pa.array([_opening(a, step) for a, step in _FLAT], pa.large_string())
#: By the state at the end of a conversation; the last one stands for turns that end none.
_APPENDED = pa.array([*([ROLES[r] for r in run] for run in CLOSE), []], pa.list_(pa.string()))
_CLOSINGS = pa.array([*("<|end|>\n" + _empty_turns(run) for run in CLOSE), ""], pa.large_string())


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) products of two stacks of matrices."""
    return np.minimum((a[:, :, :, None] + b[:, None]).min(axis=2), NEVER)


def _waves(size: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Segments by falling size, and how many of them have a turn t, for each t."""
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left").tolist()


def _segments(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, number in the piece, first turn, size) of the segments of pieces of conversations."""
    count = -(-size // SEGMENT)
    piece = np.repeat(np.arange(start.size), count)
    nth = np.arange(piece.size) - np.repeat(np.cumsum(count) - count, count)
    return piece, nth, start[piece] + nth * SEGMENT, np.minimum(SEGMENT, size[piece] - nth * SEGMENT)


def _products(role: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The matrix of each segment: least cost from state to state."""
    order, waves = _waves(size)
    at, total = at[order], np.repeat(_EYE[None], at.size, axis=0)
    for t, n in enumerate(waves):
        total[:n] = _join(total[:n], COST[role[at[:n] + t]])
    out = np.empty_like(total)
    out[order] = total
    return out


def solve(role: np.ndarray, start: np.ndarray, size: np.ndarray, enter: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each turn on a path of least cost through each piece (turns from start, so many).

    enter is a piece's state at its start; end that at its end, or -1 for the legal end of least cost. Ties go to the lowest
    state, from the end backwards.
    """
    before, after = (np.zeros(role.size, np.int8) for _ in range(2))
    piece, nth, at, length = _segments(start, size)
    if not piece.size:
        return before, after
    rounds = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])
    last = np.flatnonzero(np.append(nth[1:] == 0, True))
    cost = np.full((piece.size, 4), NEVER, np.int64)
    cost[rounds[0], enter] = 0
    if len(rounds) > 1:
        inner = np.flatnonzero(np.append(nth[1:] != 0, False))
        matrix = np.empty((piece.size, 4, 4), np.int64)
        matrix[inner] = _products(role, at[inner], length[inner])
        for here in rounds[1:]:
            cost[here] = np.minimum((cost[here - 1][:, :, None] + matrix[here - 1]).min(axis=1), NEVER)
    order, waves = _waves(length)
    place, now, back = at[order], cost[order], []
    for t, n in enumerate(waves):
        m = now[:n, :, None] + COST[role[place[:n] + t]]
        back.append(m.argmin(axis=1).astype(np.int8))
        now[:n] = np.minimum(m.min(axis=1), NEVER)
    cost[order] = now
    ends = np.zeros(piece.size, np.int64)
    ends[last] = np.where(end >= 0, end, (cost[last] + CLOSE_COST).argmin(axis=1))
    # the state before each turn, for each state at the end of its segment
    state = np.tile(np.arange(4, dtype=np.int8), (piece.size, 1))
    for t in range(len(waves) - 1, -1, -1):
        n = waves[t]
        state[:n] = back[t] = np.take_along_axis(back[t], state[:n].astype(np.int64), axis=1)
    lead = np.empty_like(state)
    lead[order] = state
    for here in rounds[:0:-1]:
        ends[here - 1] = lead[here, ends[here]]
    mine = ends[order]
    for t, n in enumerate(waves):
        before[place[:n] + t] = back[t][np.arange(n), mine[:n]]
    after[:-1] = before[1:]
    after[at + length - 1] = ends
    return before, after


def _roles(column: pa.Array) -> np.ndarray:
    """States of the named roles; 0 for any other."""
    found = pc.index_in(pc.utf8_lower(pc.utf8_trim_whitespace(column)), value_set=pa.array(list(ROLES.values()), column.type))
    return pc.fill_null(pc.add(found, 1), 0).to_numpy(zero_copy_only=False).astype(np.int8)


def _pieces(convs: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """First turn and size of each conversation's part of a sorted partition. Ids stay 64-bit integers beside a mark for null."""
    ids = np.concatenate([pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in convs] or [np.zeros(0, np.int64)])
    none = np.concatenate([c.is_null().to_numpy(zero_copy_only=False) for c in convs] or [np.zeros(0, bool)])
    new = np.ones(ids.size, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, ids.size))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrices of a partition's first and last conversation."""
    convs, roles = [], []
    for batch in batches:
        convs.append(batch.column(0))
        roles.append(_roles(batch.column(1)))
    start, size = _pieces(convs)
    if not start.size:
        return
    role, ids, out = np.concatenate(roles), pa.chunked_array(convs), []
    for k in sorted({0, start.size - 1}):
        _, _, at, length = _segments(start[k : k + 1], size[k : k + 1])
        total = _EYE[None]
        for m in _products(role, at, length):
            total = _join(total, m[None])
        out.append({"conv": ids[int(start[k])].as_py(), "part": TaskContext.get().partitionId(), "k": k, "cost": total.ravel().tolist()})
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("cost", pa.list_(pa.int64()))]))


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the matrices of one conversation's pieces, if there are several, the states at their edges."""
    pdf = pdf.sort_values(["part", "k"])
    if len(pdf) < 2:
        return pd.DataFrame({"part": [], "k": [], "enter": [], "end": [], "closes": []})
    cost, back = np.where(np.arange(4) == START, 0, NEVER), []
    for c in pdf["cost"]:
        m = cost[:, None] + np.array(c).reshape(4, 4)
        back.append(m.argmin(axis=0))
        cost = np.minimum(m.min(axis=0), NEVER)
    ends = [int((cost + CLOSE_COST).argmin())]
    for b in back[::-1]:
        ends.append(int(b[ends[-1]]))
    ends = ends[::-1]
    return pd.DataFrame({"part": pdf["part"], "k": pdf["k"], "enter": ends[:-1], "end": ends[1:], "closes": [False] * (len(pdf) - 1) + [True]})


def _repair(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), list(batches)
        start, size = _pieces([b.column(0) for b in held])
        if not start.size:
            return
        enter, end, closes = np.full(start.size, START), np.full(start.size, -1), np.ones(start.size, bool)
        for k in {0, start.size - 1}:
            if (part, k) in told.value:
                enter[k], end[k], closes[k] = told.value[part, k]
        role = np.concatenate([_roles(b.column(2)) for b in held])
        before, after = solve(role, start, size, enter, end)
        closing = np.full(role.size, 4, np.int8)
        closing[(start + size - 1)[closes]] = after[(start + size - 1)[closes]]
        step = (role.astype(np.int64) * 4 + before) * 4 + after
        lo = 0
        for i, batch in enumerate(held):
            held[i] = None
            mine = slice(lo, lo + batch.num_rows)
            s, c = pa.array(step[mine]), pa.array(closing[mine])
            text = pc.fill_null(batch.column(3), "").cast(pa.large_string())
            piece = pc.binary_join_element_wise(_OPENINGS.take(s), text, _CLOSINGS.take(c), pa.scalar("", pa.large_string()))
            place = pa.array((part << 33) + np.arange(lo, lo + batch.num_rows))
            cols = [*batch.columns[:3], _ROLE_NAMES.take(pa.array(after[mine])), _ACTIONS.take(s), _INSERTED.take(s), _APPENDED.take(c), piece, place]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "role", "role_out", "action", "inserted", "appended", "rendered", "place"])
            lo += batch.num_rows

    return run


def repair(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, role_out, action (keep, relabel, merge, merge_relabel), inserted (roles of the
    empty turns put before it), appended (those put after a conversation's last one), rendered, place.

    The rendered pieces of a conversation, joined by place, are its repaired text. Roles are compared without case and outer
    blanks; an unknown or null role may become any. Null text is empty; an empty turn is still a turn. Turns are ordered by
    turn, nulls first, then role and a hash of the text, so repeated rows merge or alternate in a fixed order. Rows with a null
    conv_id are one conversation. An empty table gives no rows. Other columns, whatever their names, are ignored. Of several
    repairs of least cost, one is taken; where a conversation spans partitions, which one may depend on where it is cut.

    The driver holds and broadcasts a row of five small integers for each end of a partition at which a conversation goes on:
    about 50 MB for 100 TB of turns.
    """
    shared_dir(spark)
    bound_batches(spark)
    turns = turns.select("conv_id", "turn", "role", "text").withColumns({"h": F.xxhash64("text"), "rid": F.monotonically_increasing_id()})
    n, size = turns.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK), -(-(size or 0) // BYTES_PER_TASK))
    order = ["conv_id", "turn", "role", "h", "rid"]
    # checkpointed, so that both passes see the same partitions
    sorted_ = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text").checkpoint()
    edges = sorted_.select("conv_id", "role").mapInArrow(_edges, "conv long, part int, k long, cost array<long>")
    chained = edges.groupBy("conv").applyInPandas(_chained, "part int, k long, enter int, end int, closes boolean")
    told = spark.sparkContext.broadcast({(r.part, r.k): (r.enter, r.end, r.closes) for r in chained.collect()})
    schema = "conv_id long, turn long, role string, role_out string, action string, inserted array<string>, appended array<string>, rendered string, place long"
    return sorted_.mapInArrow(_repair(told), schema)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn of conversations, repaired at least cost; nulls, ties and repeats as in repair()."""
    return repair(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
