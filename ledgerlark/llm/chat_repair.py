"""Minimum-cost repair of the roles of conversations, and rendering of the repaired turns.

A legal conversation is an optional system turn followed by user and assistant turns that alternate,
beginning with the user and ending with the assistant. Each turn may keep its role, take another one or
be merged into the turn before; an empty turn may be put in before any turn and at the end. Shortest
paths over the automaton of legal turns choose the cheapest repair.

A conversation of any length is cut into chunks along the global order. A chunk is, for the path, a small
matrix of the least costs from each state before it to each state after it. The matrices of chunks that
share a conversation are chained (at most two per range partition), which gives the costs at each border;
going back over the borders gives the state in which each chunk ends; then every chunk repairs its own
turns. Ties are broken at each turn in the same way wherever the borders lie.

Every source turn and every inserted turn is one row with its part of the rendered text, so no
conversation has to fit into one value. Texts merged into a turn follow it after a line break.

Defined cases: unknown, null and oddly cased roles cost a relabel unless their lower-case form is known;
null texts render as empty; turns are in order of turn (nulls last), role and text; a null conv_id is a
conversation of its own; repeated rows are turns of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.blocks import in_blocks

#: State after a turn: none yet, or the role of the last turn.
STATES = ("start", "system", "user", "assistant")
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
LEGAL_END = "assistant"
#: Costs of a turn that keeps its role, is merged into one of its own role, of another role, is relabelled, and of an empty turn.
KEEP, MERGE_SAME, MERGE_OTHER, RELABEL, INSERT = 0, 1, 4, 3, 2
_FAR = 10**12
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"


def turn_choices(role: str) -> dict[tuple[int, int], tuple[int, str, tuple[str, ...]]]:
    """(state before, state after) to (cost, action, roles of empty turns put in before) for one source turn.

    The first listed of equal cost stands: without insertions before with, merges before relabels.
    """
    best: dict[tuple[int, int], tuple[int, str, tuple[str, ...]]] = {}

    def offer(a: str, b: str, cost: int, action: str, put_in: tuple[str, ...]) -> None:
        key = STATES.index(a), STATES.index(b)
        if key not in best or cost < best[key][0]:
            best[key] = cost, action, put_in

    # at most two empty turns: more return to a state passed before
    walks = [((), s, s) for s in STATES]
    for size in range(2):
        walks += [((*put_in, r), a, r) for put_in, a, at in walks if len(put_in) == size for r in NEXT[at] if r != "system"]
    for put_in, a, at in walks:
        extra = INSERT * len(put_in)
        for r in NEXT[at]:
            if r == role:
                offer(a, r, extra + KEEP, "keep", put_in)
        if at != "start":
            offer(a, at, extra + (MERGE_SAME if at == role else MERGE_OTHER), "merge", put_in)
        for r in NEXT[at]:
            if r != role:
                offer(a, r, extra + RELABEL, "relabel", put_in)
    return best


_CHOICES = {role: turn_choices(role) for role in (*STATES[1:], "")}
_COSTS = {role: np.array([[c.get((a, b), (_FAR,))[0] for b in range(4)] for a in range(4)], np.int64) for role, c in _CHOICES.items()}
#: Cost of making each state a legal end, and the empty turns that do.
_ENDS = {"start": (0, ()), "system": (2 * INSERT, ("user", "assistant")), "user": (INSERT, ("assistant",)), "assistant": (0, ())}


def known_role(role: str | None) -> str:
    role = (role or "").strip().lower()
    return role if role in STATES[1:] else ""


def forward(costs: np.ndarray, roles: list[str]) -> np.ndarray:
    """Least cost of each state before and after every turn."""
    out = np.empty((len(roles) + 1, 4), np.int64)
    out[0] = costs
    for i, role in enumerate(roles):
        out[i + 1] = np.minimum((out[i][:, None] + _COSTS[role]).min(0), _FAR)
    return out


def back(steps: np.ndarray, roles: list[str], end: int) -> list[int]:
    """States before each turn and after the last on a cheapest path into ``end``; ties go to the lowest state."""
    states = [end]
    for i in range(len(roles) - 1, -1, -1):
        states.append(int(np.argmin(steps[i] + _COSTS[roles[i]][:, states[-1]])))
    return states[::-1]


def last_state(costs: np.ndarray) -> int:
    return int(np.argmin(costs + np.array([_ENDS[s][0] for s in STATES])))


def matrix(roles: list[str]) -> np.ndarray:
    start = np.where(np.eye(4, dtype=bool), 0, _FAR)
    return np.stack([forward(row, roles)[-1] for row in start])


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of a sorted partition, joined and cut so that each holds one conversation's rows."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        name = frame["_conv_key"].to_numpy()
        cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)] if len(name) else []
        for a, b in zip(cuts, cuts[1:]):
            if kept and kept[-1]["_conv_key"].iat[-1] != name[a]:
                yield pd.concat(kept)
                kept = []
            kept.append(frame.iloc[a:b])
    if kept:
        yield pd.concat(kept)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, out_turn, turn, role_before, role, action, cost and segment of each source and inserted turn.

    Equal ``out_turn`` marks turns merged into one; segments in order of (out_turn, part) are the rendering.
    """
    named = conversations.select(
        F.col("conv_id").cast("string").alias("_conv"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    key = F.when(F.col("_conv").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("_conv")))
    rows = named.withColumn("_conv_key", key).withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col("_conv_key"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), F.col("_tie")]
    rows = in_blocks(rows, order)
    # at most two rows per block: conversations that cross its borders
    edges = rows.groupBy("_block").agg(F.min_by("_conv_key", "_seq").alias("first"), F.max_by("_conv_key", "_seq").alias("last")).orderBy("_block")
    crossing: dict[str, list[int]] = {}
    for edge in edges.collect():
        for conv in dict.fromkeys((edge["first"], edge["last"])):
            crossing.setdefault(conv, []).append(edge["_block"])
    crossing = {c: b for c, b in crossing.items() if len(b) > 1}
    entry, leave = _borders(rows, crossing)
    columns = "_conv string, _block bigint, _order bigint, new_turn boolean, turn bigint, role_before string, role string, action string, cost bigint, segment string"

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(frames):
            at = run["_conv_key"].iat[0], int(run["_block"].iat[0])
            roles = [known_role(r if isinstance(r, str) else None) for r in run["role"]]
            costs = np.array(entry.get(at, (0, _FAR, _FAR, _FAR)), np.int64)
            steps = forward(costs, roles)
            is_last = at not in leave or crossing[at[0]][-1] == at[1]
            states = back(steps, roles, leave.get(at, last_state(steps[-1])))
            yield _rendered(run, roles, states, is_last, at in entry and states[0] != 0)

    shape = rows.select("_conv", "_conv_key", "_block", "turn", "role", "text")
    turns = shape.mapInPandas(repair, columns)
    # numbers of repaired turns: those begun in earlier blocks, plus those begun in this one
    begun = turns.groupBy("_conv", "_block").agg(F.count_if("new_turn").alias("_n")) if crossing else None
    return _numbered(turns, begun, crossing)


def _borders(rows: DataFrame, crossing: dict[str, list[int]]) -> tuple[dict[tuple[str, int], tuple[int, ...]], dict[tuple[str, int], int]]:
    """Costs at the start of each crossing chunk and the state in which it ends."""
    if not crossing:
        return {}, {}
    wanted = {(c, b) for c, blocks in crossing.items() for b in blocks}
    schema = "conv string, block bigint, values array<bigint>"

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(frames):
            at = run["_conv_key"].iat[0], int(run["_block"].iat[0])
            if at in wanted:
                values = matrix([known_role(r if isinstance(r, str) else None) for r in run["role"]])
                yield pd.DataFrame({"conv": [at[0]], "block": [at[1]], "values": [values.ravel().tolist()]})

    narrow = rows.select("_conv_key", "_block", "role")
    found = {(r["conv"], r["block"]): np.array(r["values"], np.int64).reshape(4, 4) for r in narrow.mapInPandas(matrices, schema).collect()}
    entry: dict[tuple[str, int], tuple[int, ...]] = {}
    ends: dict[str, int] = {}
    for conv, blocks in crossing.items():
        costs = np.array([0, _FAR, _FAR, _FAR], np.int64)
        for b in blocks:
            entry[conv, b] = tuple(int(c) for c in costs)
            costs = np.minimum((costs[:, None] + found[conv, b]).min(0), _FAR)
        ends[conv] = last_state(costs)

    def ways(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in _runs(frames):
            at = run["_conv_key"].iat[0], int(run["_block"].iat[0])
            if at in wanted:
                roles = [known_role(r if isinstance(r, str) else None) for r in run["role"]]
                steps = forward(np.array(entry[at], np.int64), roles)
                yield pd.DataFrame({"conv": [at[0]], "block": [at[1]], "values": [[back(steps, roles, s)[0] for s in range(4)]]})

    first = {(r["conv"], r["block"]): r["values"] for r in narrow.mapInPandas(ways, schema).collect()}
    leave: dict[tuple[str, int], int] = {}
    for conv, blocks in crossing.items():
        state = ends[conv]
        for b in reversed(blocks):
            leave[conv, b] = state
            state = first[conv, b][state]
    return entry, leave


def _rendered(run: pd.DataFrame, roles: list[str], states: list[int], is_last: bool, goes_on: bool) -> pd.DataFrame:
    """Rows of a chunk. A turn is closed by the row that begins the next one, or by the end."""
    out: list[tuple] = []
    conv, block = run["_conv"].iat[0], int(run["_block"].iat[0])
    opened = goes_on

    def add(new: bool, turn, before, role: str, action: str, cost: int, text: str) -> None:
        nonlocal opened
        head = (_CLOSE if opened else "") + f"{_OPEN}{role}\n" if new else "\n"
        opened = True
        out.append((conv, block, len(out), new, turn, before, role, action, cost, head + text))

    for i, (turn, before, text) in enumerate(zip(run["turn"], run["role"], run["text"])):
        cost, action, put_in = _CHOICES[roles[i]][states[i], states[i + 1]]
        for r in put_in:
            add(True, None, None, r, "insert", INSERT, "")
        own = cost - INSERT * len(put_in)
        add(action != "merge", None if pd.isna(turn) else int(turn), before if isinstance(before, str) else None, STATES[states[i + 1]], action, own, text if isinstance(text, str) else "")
    if is_last:
        for r in _ENDS[STATES[states[-1]]][1]:
            add(True, None, None, r, "insert", INSERT, "")
        if out:
            out[-1] = (*out[-1][:-1], out[-1][-1] + _CLOSE)
    frame = pd.DataFrame(out, columns=["_conv", "_block", "_order", "new_turn", "turn", "role_before", "role", "action", "cost", "segment"])
    frame["turn"] = frame["turn"].astype("Int64")
    return frame


def _numbered(turns: DataFrame, begun: DataFrame | None, crossing: dict[str, list[int]]) -> DataFrame:
    inside = Window.partitionBy("_conv", "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    numbered = turns.withColumn("_inside", F.count_if("new_turn").over(inside))
    if begun is None:
        numbered = numbered.withColumn("_start", F.lit(0))
    else:
        names = [c[1:] if c[0] == "+" else None for c in crossing]
        of = begun.where(F.col("_conv").isin(*[n for n in names if n is not None]) | F.col("_conv").isNull())
        earlier = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        starts = of.select(F.col("_conv").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        # at most two rows per block
        numbered = numbered.join(F.broadcast(starts), numbered["_conv"].eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    place = F.col("_inside") + F.coalesce("_start", F.lit(0)) - 1
    order = Window.partitionBy("_conv", "_block", "_inside").orderBy("_order")
    return numbered.select(
        F.col("_conv").alias("conv_id"), place.cast("bigint").alias("out_turn"), F.col("_block").alias("chunk"), F.row_number().over(order).alias("part"), "turn", "role_before", "role", "action", "cost", "segment",
    )
