import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerlark.llm import catalog, structure_repair
from ledgerlark.llm.structure_repair import Survivors
from tests.llm.helpers import SMALL

LEGAL = re.compile("(s?(ua)+)?")
LETTER = re.compile("[^\x20\x09-\x0d]")


def conversations(spark, rows):
    data = [(c, t, r, x, 1, "k", 3) for c, t, r, x in rows]
    return spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, cost int, action string, _block int")


def damage(rows):
    """(conv_id, turn, role, text) after damage, in order within each conversation."""
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how == 0:
            continue
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        r = "user" if how == 4 else r
        out[c] += [(t, r, x)] * (2 if how == 3 else 1)
    for own in out.values():
        own.sort(key=lambda s: (s[0] is not None, s[0] or 0, s[1].encode(), s[2].encode()))
    return out


def faults(own):
    found, seen = [], set()
    for _, r, x in own:
        letters = LETTER.findall(x)
        found.append("blank" if not letters else "duplicate" if (r, x) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((r, x))
    return found


def all_repairs(own, fault):
    """(cost, audit, repaired) of every list of edits with at most two empty turns in a place."""
    put_in = [p for n in range(3) for p in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (_, r, x), f in zip(own, fault):
        extra = 3 if f == "truncated" else 0
        ways = [("D", 4, None)]
        if f not in ("blank", "duplicate"):
            ways += [("K", extra, (r, x)), *(("R", 3 + extra, (to, x)) for to in ("user", "assistant"))]
        choices.append([(p, w) for p in put_in for w in ways])
    for picked in itertools.product(*choices, put_in):
        cost, audit, turns = 0, "", []
        for p, (letter, extra, turn) in picked[:-1]:
            cost, audit = cost + 3 * len(p) + extra, audit + "I" * len(p) + letter
            turns += [(r, "") for r in p] + ([turn] if turn else [])
        cost, audit = cost + 3 * len(picked[-1]), audit + "I" * len(picked[-1])
        turns += [(r, "") for r in picked[-1]]
        if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in turns)):
            yield cost, audit, turns


def cheapest(own, fault):
    """(cost, audit, repaired) by carrying whole lists of edits for each last initial."""
    def put_in(ways):
        for _ in range(3):
            for end, (cost, audit, turns) in list(ways.items()):
                to = "u" if end in ("", "s", "a") else "a"
                offer = cost + 3, audit + "I", [*turns, ({"u": "user", "a": "assistant"}[to], "")]
                ways[to] = min(ways.get(to, offer), offer)
        return ways

    ways = {"": (0, "", [])}
    for (_, r, x), f in zip(own, fault):
        new, extra = {}, 3 if f == "truncated" else 0
        for end, (cost, audit, turns) in put_in(ways).items():
            offers = [(end, (cost + 4, audit + "D", turns))]
            if f not in ("blank", "duplicate"):
                for to in {"": "su", "s": "u", "u": "a", "a": "u"}[end]:
                    if to == r[:1]:
                        offers.append((to, (cost + extra, audit + "K", [*turns, (r, x)])))
                    if to != "s":
                        offers.append((to, (cost + 3 + extra, audit + "R", [*turns, ({"u": "user", "a": "assistant"}[to], x)])))
            for to, offer in offers:
                new[to] = min(new.get(to, offer), offer)
        ways = new
    ways = put_in(ways)
    return min(ways[e] for e in ("", "a") if e in ways)


def plain(rows, best=cheapest):
    out = []
    for c, own in damage(rows).items():
        fault = faults(own)
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, turns = best(own, fault)
        out.append((
            c, gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest(),
        ))
    return out


def same(found, rows):
    got, want = {f["conv_id"]: tuple(f) for f in found}, {w[0]: w for w in plain(rows)}
    assert len(found) == len(want) and got == want


def drawn(seed, n, length, roles=("user", "user", "assistant", "assistant", "system", "User", "ufo", "tool", "", None)):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(1, length)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(["Hi.", "well", "Yes! \n", "", None, " \t", "a.b", f"n{t}?", "é"])))
    return rows


def test_short_ones_equal_all_repairs(spark):
    rng, rows = random.Random(1), []
    for c in range(120):
        for t in range(rng.randrange(0, 4)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Hi.", "well", "", f"n{t}?"])))
    for own in damage(rows).values():
        if len(own) <= 3:
            fault = faults(own)
            assert cheapest(own, fault)[:2] == min(all_repairs(own, fault))[:2]
    same(structure_repair.repair_digests(conversations(spark, rows)).collect(), rows)


@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_results_are_the_same_wherever_chunks_end(spark, partitions):
    rows = drawn(4, 60, 12) + [(1000, *r[1:]) for r in drawn(5, 60, 9)] + [(1001, t, "user", f"x{t}.") for t in range(150)]
    was, adaptive = (spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        same(structure_repair.repair_digests(conversations(spark, rows)).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


@pytest.mark.parametrize("roles", [("user",), ("assistant",), ("user", "assistant"), ("system", "user", "assistant"), ("tool", "user")])
def test_ties_and_memory(roles):
    """Edits come early and equal those of whole lists; what is kept stays small where survivors meet."""
    rng = random.Random(len(roles))
    for n in (1, 2, 5, 40, 300):
        own = [(t, rng.choice(roles), rng.choice(["Hi.", "well", f"n{t}?", f"m{t}"])) for t in range(n)]
        fault = faults(own)
        code = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        way, letters, most, early = Survivors(""), "", 0, 0
        for (_, r, _), f in zip(own, fault):
            letters += "".join(e[1] for e in way.read(None, r[:1], code[f]))
            most = max(most, way.unresolved)
        early = len(letters)
        state, cost, left = way.close(structure_repair.END_COSTS)
        letters += "".join(e[1] for e in left) + "I" * len(structure_repair.ENDS[state])
        want = cheapest(own, fault)
        assert (cost + structure_repair.END_COSTS[state], letters) == want[:2]
        if n == 300 and roles != ("user",) and roles != ("assistant",):
            assert most < 100 and early > 250


def test_turns_tell_the_repair(spark):
    rows = drawn(8, 40, 9)
    by_conv = {}
    for e in structure_repair.repaired_turns(conversations(spark, rows)).collect():
        by_conv.setdefault(e["conv_id"], []).append(e)
    for c, own in damage(rows).items():
        cost, audit, turns = cheapest(own, faults(own))
        edits = sorted(by_conv.get(c, []), key=lambda e: (e["chunk"], e["part"]))
        assert "".join(e["action"] for e in edits) == audit and sum(e["cost"] for e in edits) == cost
        assert [(e["role"], e["text"]) for e in edits if e["action"] != "D"] == turns


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "a."), (None, None, "assistant", "b."), (1, None, None, None), (1, None, None, None), (2, 0, "user", "x" * 200_000 + "."), (2, 0, "user", "x" * 200_000 + "."),
        (3, 5, "assistant", "late"), (3, 5, "assistant", "late"), (3, 9, "user", "late"), (-4, 2**40, "system", "s."), (-4, -7, "system", "s."), *((c, 0, "user", "same.") for c in range(100, 140)),
    ]
    same(structure_repair.repair_digests(conversations(spark, rows)).collect(), rows)
    assert structure_repair.repair_digests(conversations(spark, [])).count() == 0


def test_query_reads_the_whole_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    same(catalog.QUERIES["op13_coalescent_repair"](spark, SMALL).collect(), rows)
