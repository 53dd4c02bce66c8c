"""Cheapest repair of damaged conversations, found row by row in bounded memory.

A legal conversation is empty, or an optional system turn and then pairs of a user and an assistant turn.
Each row is kept, given another role, or deleted, and empty turns may be put in anywhere; of the cheapest
lists of edits the one whose initials come first in ASCII order stands. A shortest-path search over the
states of the automaton (nothing yet, or the role of the last turn) keeps one survivor per state. Edits
hang in a tree of backpointers with reference counts: a branch without survivors is let go, and as soon as
all survivors share an ancestor the edits up to it are final and are given out. A survivor that another one
can imitate for less is given up. So a conversation needs
only the memory of its unresolved end, however long it is.

Ties compare complete lists of edits. What survivors do not share decides, and the order of these ends is
kept as a rank, which each step refines by its own letters: with equally many rows read, neither list is a
beginning of the other, and a list of edits leads to one state only.

A conversation of any length is cut into chunks along the global order. For those that cross a border, a
small matrix of costs between states is made per chunk; going back over them gives the cost to go at every
border, and the chunks' own searches name the state at borders where costs alone leave a choice. Then all
chunks are repaired independently, with the same edits as in one piece.

Defined cases: null roles and texts count as one space, as do null ids and turns in the hash that damages a
row; a null conv_id is a conversation of its own; an empty role has no initial and cannot be kept; rows of
one turn are in order of role and text; repeated rows are rows of their own. The digest of a conversation
is sequential by nature: one task streams over the rows of a conversation that crosses borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.blocks import in_blocks

STATES = ("", "s", "u", "a")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL_PAIRS = ("su", "ua", "au")
NO_FAULT, BLANK, DUPLICATE, CUT_SHORT = range(4)
#: Empty turns that make each state a legal end.
ENDS = {"": "", "s": "ua", "u": "a", "a": ""}
_SPACES = " \t\n\x0b\x0c\r"
_FAR = 1 << 60


def _insertions(state: str) -> Iterator[tuple[str, str]]:
    """(roles put in, state after) for up to two empty turns; more would return to a state passed before."""
    put_in = ""
    for _ in range(3):
        yield put_in, state
        state = "a" if state == "u" else "u"
        put_in += state


@lru_cache(maxsize=None)
def steps(initial: str, fault: int) -> dict[str, list[tuple[str, int, str, str]]]:
    """By state after a row: (state before, cost, initials of the edits, roles put in before the row)."""
    found: dict[str, list[tuple[str, int, str, str]]] = {s: [] for s in STATES}
    extra = TRUNCATED if fault == CUT_SHORT else 0
    for before in STATES:
        for put_in, at in _insertions(before):
            cost, letters = INSERT * len(put_in), "I" * len(put_in)
            found[at].append((before, cost + DELETE, letters + "D", put_in))
            if fault in (BLANK, DUPLICATE):
                continue
            for to in NEXT[at]:
                if to == initial:
                    found[to].append((before, cost + KEEP + extra, letters + "K", put_in))
                if to in ROLES:
                    found[to].append((before, cost + REROLE + extra, letters + "R", put_in))
    return found


#: (z, y) to what it costs at most to go on from z as from y: by empty turns, by deleting a system turn
#: where there has been a turn, by ending a lone system turn. A survivor that loses by more is never needed.
IMITATES = {
    ("a", "u"): INSERT, ("u", "a"): INSERT, ("s", "u"): INSERT, ("", "u"): INSERT, ("s", "a"): 2 * INSERT, ("", "a"): 2 * INSERT,
    ("a", ""): DELETE, ("u", ""): INSERT + DELETE, ("s", ""): 2 * INSERT, ("a", "s"): 0, ("", "s"): 0, ("u", "s"): INSERT,
}


class _Node:
    """Edits of one row on one path; ``refs`` counts the branches that go on from it and the survivor on it."""

    __slots__ = ("edits", "kids", "parent", "refs")

    def __init__(self, parent: _Node | None, edits) -> None:
        self.parent, self.edits, self.refs, self.kids = parent, edits, 0, []


class Survivors:
    """The cheapest way into each state, and the edits that are not yet final."""

    def __init__(self, state: str) -> None:
        self._root = _Node(None, None)
        self._root.refs = 1
        self._ends = {state: (0, 0, self._root)}  # cost, rank, node
        self.unresolved = 0

    def read(self, row, initial: str, fault: int) -> list:
        """Take one row; returns the edits that have become final: (row, letters, roles put in, role of the row)."""
        chosen = {}
        for state, ways in steps(initial, fault).items():
            offers = [(self._ends[b][0] + cost, self._ends[b][1], letters, b, put_in) for b, cost, letters, put_in in ways if b in self._ends]
            if offers:
                chosen[state] = min(offers)
        lost = [y for (z, y), extra in IMITATES.items() if z in chosen and y in chosen and chosen[z][0] + extra < chosen[y][0]]
        ordered = sorted(chosen.keys() - lost, key=lambda s: chosen[s][1:3])
        ends = {}
        for rank, state in enumerate(ordered):
            cost, _, letters, before, put_in = chosen[state]
            parent = self._ends[before][2]
            node = _Node(parent, (row, letters, put_in, state))
            node.refs = 1
            parent.refs += 1
            parent.kids.append(node)
            ends[state] = cost, rank, node
        old, self._ends = self._ends, ends
        self.unresolved += len(ends)
        for _, _, node in old.values():
            self._release(node)
        return self._final()

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while not node.refs and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            parent.refs -= 1
            self.unresolved -= 1
            node = parent

    def _final(self) -> list:
        """Edits up to the last ancestor that all survivors share."""
        out = []
        while self._root.refs == 1 and self._root.kids:
            self._root = self._root.kids[0]
            self._root.parent = None
            out.append(self._root.edits)
            self.unresolved -= 1
        return out

    def close(self, to_go: dict[str, int]) -> tuple[str, int, list]:
        """(last state, cost up to it, edits left) of the best way on, given the cost to go from each state."""
        best = min((cost + to_go[s], rank, s) for s, (cost, rank, _) in self._ends.items() if to_go[s] < _FAR)[2]
        cost, _, node = self._ends[best]
        out = []
        while node is not self._root:
            out.append(node.edits)
            node = node.parent
        return best, cost, out[::-1]

    def costs(self) -> list[int]:
        return [self._ends[s][0] if s in self._ends else _FAR for s in STATES]


END_COSTS = {s: INSERT * len(put_in) for s, put_in in ENDS.items()}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage that depends on the id and the turn alone."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_how"),
    ).where("_how <> 0")
    how = F.col("_how")
    text = F.when(how == 1, "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_how")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with a key of the conversation, ``_same`` (a digest of role and text) and the first fault of each.

    A row that repeats one of its own turn is found later, from the row before it.
    """
    trimmed = F.rtrim("text", F.lit(_SPACES))
    key = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.col("conv_id").cast("string"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("conv_id", "turn", "role", "text", key.alias("_key"), same.alias("_same"), (trimmed == "").alias("_blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = rows.groupBy("_key", "_same").agg(F.min(turn).alias("_first"), F.max(turn).alias("_last")).where("_first < _last").drop("_last")
    rows = rows.join(firsts, ["_key", "_same"], "left")
    fault = F.when(F.col("_blank"), BLANK).when(turn > F.col("_first"), DUPLICATE).when(F.col("_cut"), CUT_SHORT).otherwise(NO_FAULT)
    return rows.select("conv_id", "turn", "role", "text", "_key", "_same", fault.alias("fault"))


def _chunks(frames: Iterator[pd.DataFrame], before: dict) -> Iterator[tuple[tuple[str, int], tuple]]:
    """((conversation, block), (conv_id, turn, role, text, fault, whether it begins an illegal pair)) of each row, in order."""
    last_key, turn_before, same_before, initial_before = None, None, None, None
    for frame in frames:
        texts = frame["text"] if "text" in frame else [None] * len(frame)
        for conv, turn, role, text, key, same, fault, block in zip(frame["conv_id"], frame["turn"], frame["role"], texts, frame["_key"], frame["_same"], frame["fault"], frame["_block"]):
            at = (key, int(block))
            turn = None if pd.isna(turn) else int(turn)
            if at != last_key:
                last_key = at
                turn_before, same_before, initial_before = before.get(at, (None, None, None))
            initial = role[:1]
            if fault not in (BLANK, DUPLICATE) and same == same_before and turn == turn_before:
                fault = DUPLICATE
            illegal = initial_before is not None and initial_before + initial not in LEGAL_PAIRS
            yield at, (None if pd.isna(conv) else int(conv), turn, role, text, int(fault), illegal)
            turn_before, same_before, initial_before = turn, same, initial


def _matrices(rows: DataFrame, wanted: set, before: dict) -> dict[tuple[str, int], list[list[int]]]:
    """Costs from each state before a crossing chunk to each state after it."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ways = None, []
        for at, (_, _, role, _, fault, _) in _chunks(frames, before):
            if at not in wanted:
                continue
            if at != last:
                if last:
                    yield _matrix_row(last, ways)
                last, ways = at, [Survivors(s) for s in STATES]
            for way in ways:
                way.read(None, role[:1], fault)
        if last:
            yield _matrix_row(last, ways)

    found = rows.drop("text").mapInPandas(measure, "conv string, block bigint, costs array<bigint>").collect()
    return {(r["conv"], r["block"]): [r["costs"][4 * i : 4 * i + 4] for i in range(4)] for r in found}


def _matrix_row(at: tuple[str, int], ways: list[Survivors]) -> pd.DataFrame:
    return pd.DataFrame({"conv": [at[0]], "block": [at[1]], "costs": [[c for way in ways for c in way.costs()]]})


def _choices(rows: DataFrame, wanted: dict, before: dict, to_go: dict) -> dict[tuple[str, int, str], str]:
    """Last state of the best way through a chunk from a state, where costs leave a choice."""

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ways = None, {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([(*last, s, way.close(to_go[last])[0]) for s, way in ways.items()], columns=["conv", "block", "entry", "leave"])

        for at, (_, _, role, _, fault, _) in _chunks(frames, before):
            if at not in wanted:
                continue
            if at != last:
                if last:
                    yield told()
                last, ways = at, {s: Survivors(s) for s in wanted[at]}
            for way in ways.values():
                way.read(None, role[:1], fault)
        if last:
            yield told()

    found = rows.drop("text").mapInPandas(choose, "conv string, block bigint, entry string, leave string").collect() if wanted else []
    return {(r["conv"], r["block"], r["entry"]): r["leave"] for r in found}


def _borders(rows: DataFrame, crossing: dict[str, list[int]], before: dict) -> tuple[dict, dict]:
    """State at the beginning of each crossing chunk, and the cost to go from each state at its end."""
    if not crossing:
        return {}, {}
    parts = {(c, b) for c, blocks in crossing.items() for b in blocks}
    own = rows.where(F.col("_key").isin(list(crossing)))
    costs = _matrices(own, parts, before)
    to_go: dict[tuple[str, int], dict[str, int]] = {}
    for conv, blocks in crossing.items():
        ahead = dict(END_COSTS)
        for b in reversed(blocks):
            to_go[conv, b] = ahead
            ahead = {s: min(_FAR, min(costs[conv, b][i][j] + ahead[t] for j, t in enumerate(STATES))) for i, s in enumerate(STATES)}
    exits: dict[tuple[str, int, str], list[str]] = {}
    for at in parts:
        for i, s in enumerate(STATES):
            total = [min(_FAR, costs[at][i][j] + to_go[at][t]) for j, t in enumerate(STATES)]
            exits[(*at, s)] = [t for t, c in zip(STATES, total) if c == min(total)]
    unsure: dict[tuple[str, int], list[str]] = {}
    for (conv, b, s), ways in exits.items():
        if len(ways) > 1 and b != crossing[conv][-1]:
            unsure.setdefault((conv, b), []).append(s)
    told = _choices(own, unsure, before, to_go)
    entry = {}
    for conv, blocks in crossing.items():
        state = ""
        for b in blocks:
            entry[conv, b] = state
            state = told.get((conv, b, state), exits[conv, b, state][0])
    return entry, to_go


_EDITS = "conv_id bigint, chunk bigint, part bigint, turn bigint, role_before string, action string, role string, text string, fault int, illegal boolean, cost bigint"
_NAMES = [c.split()[0] for c in _EDITS.split(", ")]


class _Edits:
    """Rows of edits, given out some thousands at a time."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def begin(self, conv: int | None, chunk: int) -> None:
        self._conv, self._chunk, self._part = conv, chunk, 0

    def _add(self, *values) -> None:
        self.rows.append((self._conv, self._chunk, self._part, *values))
        self._part += 1

    def inserted(self, roles: str) -> None:
        for r in roles:
            self._add(None, None, "I", ROLES[r], "", NO_FAULT, False, INSERT)

    def add(self, edits) -> None:
        (_, turn, before, text, fault, illegal), letters, put_in, state = edits
        self.inserted(put_in)
        action = letters[-1]
        cost = {"K": KEEP, "R": REROLE, "D": DELETE}[action] + (TRUNCATED if fault == CUT_SHORT and action != "D" else 0)
        role = {"K": before, "R": ROLES.get(state), "D": None}[action]
        self._add(turn, before, action, role, None if action == "D" else text, fault, illegal, cost)

    def taken(self) -> pd.DataFrame:
        frame = pd.DataFrame(self.rows, columns=_NAMES)
        self.rows = []
        for c in ("conv_id", "turn"):
            frame[c] = frame[c].astype("Int64")
        return frame


def _edits(rows: DataFrame, crossing: dict[str, list[int]], before: dict, entry: dict, to_go: dict) -> DataFrame:
    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, last, way = _Edits(), None, None

        def close() -> None:
            state, _, left = way.close(to_go.get(last, END_COSTS))
            for e in left:
                out.add(e)
            if last not in to_go or crossing[last[0]][-1] == last[1]:
                out.inserted(ENDS[state])

        for at, row in _chunks(frames, before):
            if at != last:
                if last:
                    close()
                if len(out.rows) > 5_000:
                    yield out.taken()
                last, way = at, Survivors(entry.get(at, ""))
                out.begin(row[0], at[1])
            for e in way.read(row, row[2][:1], row[4]):
                out.add(e)
            if len(out.rows) > 20_000:
                yield out.taken()
        if last:
            close()
        if out.rows:
            yield out.taken()

    return rows.select("conv_id", "turn", "role", "text", "_key", "_same", "fault", "_block").mapInPandas(repair, _EDITS)


def _prepared(conversations: DataFrame) -> tuple[DataFrame, dict, dict, dict, dict]:
    rows = with_faults(damaged(conversations)).withColumn("_tie", F.monotonically_increasing_id())
    order: list[Column] = [F.col("_key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")]
    rows = in_blocks(rows, order)
    # at most two conversations of a block cross its borders
    last = F.max_by(F.struct("_key", "turn", "_same", F.substring("role", 1, 1).alias("initial")), "_seq")
    edges = rows.groupBy("_block").agg(F.min_by("_key", "_seq").alias("first"), last.alias("last")).orderBy("_block").collect()
    where: dict[str, list[int]] = {}
    for edge in edges:
        for conv in dict.fromkeys((edge["first"], edge["last"]["_key"])):
            where.setdefault(conv, []).append(edge["_block"])
    crossing = {c: b for c, b in where.items() if len(b) > 1}
    before = {}
    for one, other in zip(edges, edges[1:]):
        end = one["last"]
        if end["_key"] == other["first"]:
            before[end["_key"], other["_block"]] = end["turn"], end["_same"], end["initial"]
    return rows, crossing, before, *_borders(rows, crossing, before)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """One row per edit: conv_id, chunk and part (the order), turn, role_before, action, role, text, fault, illegal, cost."""
    return _edits(*_prepared(conversations))


_DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation, from edits that lie in order."""
    out: list[tuple] = []
    name, own = None, None

    def told() -> tuple:
        gaps = own["last"] - own["first"] + 1 - own["turns"] if own["turns"] else 0
        return (name[0], gaps, *own["faults"][1:], own["illegal"], own["cost"], "".join(own["audit"]), own["sha"].hexdigest())

    for frame in frames:
        columns = (frame[c] for c in ("conv_id", "turn", "action", "role", "text", "fault", "illegal", "cost"))
        for conv, turn, action, role, text, fault, illegal, cost in zip(*columns):
            at = (None if pd.isna(conv) else int(conv),)
            if at != name:
                if name:
                    out.append(told())
                name = at
                own = {"first": 0, "last": None, "turns": 0, "faults": [0] * 4, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False}
            if not pd.isna(turn) and int(turn) != own["last"]:
                own["first"] = own["first"] if own["turns"] else int(turn)
                own["last"], own["turns"] = int(turn), own["turns"] + 1
            own["faults"][fault] += 1
            own["illegal"] += bool(illegal)
            own["cost"] += int(cost)
            own["audit"].append(action)
            if action != "D":
                own["sha"].update((("\n" if own["any"] else "") + f"{role}:{text}").encode())
                own["any"] = True
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DIGEST.split(", ")]).astype({"conv_id": "Int64"})
            out = []
    if name:
        yield pd.DataFrame([told()], columns=[c.split()[0] for c in _DIGEST.split(", ")]).astype({"conv_id": "Int64"})


def repair_digests(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, faults, illegal pairs, cost, audit and repaired_sha256."""
    rows, crossing, before, entry, to_go = _prepared(conversations)
    across = F.col("_key").isin(list(crossing))
    found = _edits(rows.where(~across), {}, before, {}, {}).mapInPandas(_digested, _DIGEST)
    if crossing:
        own = _edits(rows.where(across), crossing, before, entry, to_go)
        found = found.unionByName(own.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part").mapInPandas(_digested, _DIGEST))
    found = found.withColumnRenamed("conv_id", "_found")
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, ids["conv_id"].eqNullSafe(found["_found"]), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
