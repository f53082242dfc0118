"""Chat formatting by minimum-cost role repair.

The legal conversation is a small automaton: an optional system turn, then user
and assistant in turns, first a user, last an assistant. Each given turn is kept,
merged into the turn before it, or given another role, and empty turns may be
put before it; every such repair has a cost, and a dynamic programme over the
automaton's states finds the cheapest repaired sequence.

A step of the programme is a matrix of costs between states, and such matrices
multiply (with minimum and plus), so a long conversation is cut into blocks of
turns: a first pass makes each block's matrix, a second walks the few block
matrices of each conversation forth and back for the states between blocks, and a
third repairs each block between its two states. No task ever holds the texts of
more than one chunk of a block, whose size is bounded by rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meshwork.llm.common import arrow_map, materialize, slices

#: States: nothing yet, and the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Which turn may follow: the roles by state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_INF = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 6
    insert: int = 4


@dataclass(frozen=True)
class Template:
    """What goes before and after a turn's text, and between texts that merge."""

    open: str = "<|{role}|>\n"
    close: str = "<|end|>\n"
    between: str = "\n\n"


@dataclass
class Choice:
    """One way from a state to another by one turn: its cost, the roles of the empty turns before it, and the action."""

    cost: int
    inserted: tuple[int, ...] = ()
    role: int = START
    actions: tuple[str, ...] = field(default=())


@lru_cache(maxsize=256)
def step(role: str | None, costs: Costs) -> list[list[Choice | None]]:
    """choices[s][t]: the cheapest way from state s over a turn of ``role`` to state t. Unknown roles fit none."""
    given = ROLES.index(role) if role in ROLES[1:] else START
    out: list[list[Choice | None]] = [[None] * 4 for _ in range(4)]
    fills = {s: {s: ()} for s in range(4)}  # states that empty turns reach, with their roles
    for s in range(4):
        edge = [s]
        while edge:
            edge = [t for u in edge for t in NEXT[u] if t != SYSTEM and t not in fills[s] and not fills[s].update({t: (*fills[s][u], t)})]
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            again = ("relabel",) if t != given else ()
            price = costs.relabel if again else 0
            ways = [Choice(costs.insert * len(r) + price, r, t, again or ("keep",)) for u, r in fills[s].items() if t in NEXT[u]]
            if s == t:
                ways.append(Choice(costs.merge + price, (), t, ("merge", *again)))
            out[s][t] = min(ways, key=lambda c: (c.cost, len(c.inserted), c.actions), default=None)
    return out


def _matrix(role: str | None, costs: Costs) -> np.ndarray:
    return np.array([[c.cost if c else _INF for c in row] for row in step(role, costs)], dtype=np.int64)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _INF)


def product(roles: list[str | None], costs: Costs) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, _INF).astype(np.int64)
    for r in roles:
        out = times(out, _matrix(r, costs))
    return out


def ending(costs: Costs) -> np.ndarray:
    """The cost of ending in each state: an assistant's turn is legal, others need empty turns."""
    return np.array([0, 2 * costs.insert, costs.insert, 0], dtype=np.int64)


def walk(matrices: list[np.ndarray], costs: Costs) -> list[int]:
    """The states before, between and after the blocks on the cheapest way from the start to the end."""
    ahead = [ending(costs)]
    for m in reversed(matrices):
        ahead.append((m + ahead[-1][None, :]).min(axis=1))
    ahead.reverse()
    states = [START]
    for k, m in enumerate(matrices):
        states.append(int((m[states[-1]] + ahead[k + 1]).argmin()))
    return states


def repair(roles: list[str | None], start: int, stop: int, costs: Costs) -> list[Choice]:
    """The cheapest choices for a block's turns from one state to another."""
    ahead = [np.where(np.arange(4) == stop, 0, _INF)]
    for r in reversed(roles):
        ahead.append(np.minimum((_matrix(r, costs) + ahead[-1][None, :]).min(axis=1), _INF))
    ahead.reverse()
    out, s = [], start
    for k, r in enumerate(roles):
        t = int((_matrix(r, costs)[s] + ahead[k + 1]).argmin())
        out.append(step(r, costs)[s][t])
        s = t
    return out


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[tuple]]]:
    """(number in its block, rows) of chunks of at most ``most`` rows of equal (conv, block), which stand in columns 0 and 1."""
    held: list[tuple] = []
    chunk = 0
    for batch in slices(batches, 4096):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (len(held) == most or held[0][:2] != row[:2]):
                yield chunk, held
                chunk = chunk + 1 if held[0][:2] == row[:2] else 0
                held = []
            held.append(row)
    if held:
        yield chunk, held


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 512, costs: Costs | None = None, template: Template | None = None) -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, block, pos, turn, role, action, text, rendered.

    Rows of a conversation stand in the order of block and pos: empty turns that
    are inserted (their text is empty), the given turns (keep, relabel, merge or
    merge+relabel), and, after the last, what closes the conversation.
    ``rendered`` holds the row's share of the rendered conversation: put behind
    each other in that order they are the whole; a merged turn's share continues
    the turn before it.

    Roles are compared after trimming and lower-casing; unknown and null roles are
    relabelled, null texts count as empty. Turns stand in the order of turn (null
    first), then role and text; rows that repeat are turns of their own. Ties go
    to fewer insertions. Rows without a conversation id are one conversation. An
    empty table gives no rows. Conversation ids of any type that sorts pass through;
    other columns are ignored.

    A conversation is dealt into blocks of ``block`` turn numbers, and a block into
    chunks of as many rows in their order: however many rows have one turn number
    or none, a task that repairs them holds one chunk.
    """
    costs, template = costs or Costs(), template or Template()
    conv = dict(turns.dtypes)[conv_col]
    kind = to_arrow_type(turns.schema[conv_col].dataType)
    base = turns.select(F.col(conv_col).alias("conv"), F.floor(F.coalesce(F.col(turn_col), F.lit(-1)) / block).alias("block"), F.col(turn_col).cast("long").alias("turn"), F.lower(F.trim(role_col)).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _runs(batches, block):
            cost = product([r[3] for r in rows], costs).ravel().tolist()
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], kind), pa.array([rows[0][1]], pa.int64()), pa.array([chunk], pa.int64()), pa.array([cost], pa.list_(pa.int64()))], names=["conv", "block", "chunk", "cost"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states() -> pa.RecordBatch:
            found = walk(held, costs)
            at = np.array(places, dtype=np.int64)
            last = np.arange(len(at)) == len(at) - 1
            return pa.RecordBatch.from_arrays([pa.array([name] * len(at), kind), *(pa.array(x) for x in (at[:, 0], at[:, 1], np.array(found[:-1], np.int32), np.array(found[1:], np.int32), last))], names=["conv", "block", "chunk", "start", "stop", "last"])

        name, places, held = None, [], []
        for batch in slices(batches, 4096):
            for c, number, chunk, cost in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and c != name:
                    yield states()
                    places, held = [], []
                name = c
                places.append((number, chunk))
                held.append(np.array(cost, dtype=np.int64).reshape(4, 4))
        if held:
            yield states()

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: tuple | None = None
        ways: list[tuple[int, int, bool]] = []  # of the block's chunks: the states before and after, and whether it ends the conversation
        held: list[tuple] = []
        done = pos = size = 0

        def repaired() -> None:
            nonlocal pos, done, held, size
            (state, stop, last), rows = ways[done], held

            def put(turn: int | None, role: int, action: str, text: str, shown: str) -> None:
                nonlocal pos, size
                out.append((*group, pos, turn, ROLES[role], action, text, shown))
                pos, size = pos + 1, size + len(text) + 100

            def opened(role: int) -> str:
                return (template.close if state else "") + template.open.format(role=ROLES[role])

            for (turn, _, text), choice in zip(rows, repair([r[1] for r in rows], state, stop, costs), strict=True):
                for role in choice.inserted:
                    put(turn, role, "insert", "", opened(role))
                    state = role
                merge = choice.actions[0] == "merge"
                put(turn, choice.role, "+".join(choice.actions), text, (template.between if merge else opened(choice.role)) + text)
                state = choice.role
            if last:
                for role in {USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}.get(state, ()):
                    put(turn, role, "insert", "", opened(role))
                    state = role
                put(turn, START, "close", "", template.close)
            done, held = done + 1, []

        for batch in slices(batches, 4096):
            for c, number, chunk, start, stop, last, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, number) != group or len(held) == block:
                    if held:
                        repaired()
                    if (c, number) != group:
                        group, ways, done, pos = (c, number), [], 0, 0
                if chunk is not None:
                    ways.append((start, stop, last))
                else:
                    held.append((turn, role, text))
                if size > 1 << 22:
                    yield _table(out)
                    out, size = [], 0
        if held:
            repaired()
        if out:
            yield _table(out)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "block", "pos", "turn", "role", "action", "text", "rendered"])

    base = base.select("conv", "block", "turn", "role", "text")
    roles = base.drop("text").repartition("conv", "block").sortWithinPartitions("conv", "block", *order[:2])
    costed = arrow_map(roles, first, f"conv {conv}, block long, chunk long, cost array<bigint>")
    states = arrow_map(costed.repartition("conv").sortWithinPartitions("conv", "block", "chunk"), second, f"conv {conv}, block long, chunk long, start int, stop int, last boolean")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    states = materialize(states, "chat-states").withColumns({"turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    both = states.unionByName(base.select("conv", "block", none("chunk", "long"), none("start", "int"), none("stop", "int"), none("last", "boolean"), "turn", "role", "text"))
    dealt = both.repartition("conv", "block").sortWithinPartitions("conv", "block", F.asc_nulls_last("chunk"), *order)
    return arrow_map(dealt, third, f"conv {conv}, block long, pos long, turn long, role string, action string, text string, rendered string").withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)
