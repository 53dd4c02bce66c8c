import itertools
import random

import pytest

from ledgerlark.llm.chat_repair import INSERT, KEEP, LEGAL_END, MERGE_OTHER, MERGE_SAME, NEXT, RELABEL, known_role, repaired_turns


def turns(spark, rows):
    data = [(c, t, r, x, 1, "k", 3) for c, t, r, x in rows]
    return spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, cost int, segment string, _block int")


def cheapest(roles):
    """Least cost by relaxing over (turns read, last role) with single steps."""
    best = {(0, "start"): 0}
    todo = [(0, "start")]
    while todo:
        i, at = todo.pop()
        cost, steps = best[i, at], []
        steps += [((i, r), INSERT) for r in NEXT[at] if r != "system"]
        if i < len(roles):
            steps += [((i + 1, r), KEEP if r == roles[i] else RELABEL) for r in NEXT[at]]
            if at != "start":
                steps.append(((i + 1, at), MERGE_SAME if at == roles[i] else MERGE_OTHER))
        for to, extra in steps:
            if cost + extra < best.get(to, 10**9):
                best[to] = cost + extra
                todo.append(to)
    return best[len(roles), LEGAL_END]


def conversations(seed, n, length):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randrange(1, length)):
            rows.append((c, t, rng.choice(["user", "user", "assistant", "assistant", "system", "User ", "tool", None]), rng.choice(["hi", "a\nb", "", None])))
    return rows


def check(rows, found):
    """Every repaired conversation is legal, complete and as cheap as can be."""
    by_conv, sources = {}, {}
    for c, t, r, x in rows:
        sources.setdefault(str(c), []).append((t, r, x))
    for f in found:
        by_conv.setdefault(str(f["conv_id"]), []).append(f)
    assert set(by_conv) == set(sources)
    for conv, own in by_conv.items():
        own.sort(key=lambda f: (f["out_turn"], f["chunk"], f["part"]))
        assert sorted({f["out_turn"] for f in own}) == list(range(own[-1]["out_turn"] + 1))
        at = "start"
        for _, group in itertools.groupby(own, key=lambda f: f["out_turn"]):
            group = list(group)
            assert len({f["role"] for f in group}) == 1 and group[0]["role"] in NEXT[at]
            assert [f["action"] == "merge" for f in group] == [False] + [True] * (len(group) - 1)
            at = group[0]["role"]
        assert at == LEGAL_END
        kept = [f for f in own if f["action"] != "insert"]
        order = sorted(sources[conv], key=lambda s: (s[0] is None, s[0] or 0, s[1] is not None, s[1] or "", s[2] is not None, s[2] or ""))
        assert [(f["turn"], f["role_before"]) for f in kept] == [s[:2] for s in order]
        assert sum(f["cost"] for f in own) == cheapest([known_role(s[1]) for s in order])
        text = ""
        for _, group in itertools.groupby(own, key=lambda f: f["out_turn"]):
            group = list(group)
            texts = iter([s[2] or "" for s, f in zip(order, kept) if f in group])
            text += f"<|im_start|>{group[0]['role']}\n" + "\n".join("" if f["action"] == "insert" else next(texts) for f in group) + "<|im_end|>\n"
        if len({(s[0], s[1]) for s in order}) == len(order):
            assert "".join(f["segment"] for f in own) == text


@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_repairs_are_legal_and_cheapest_wherever_chunks_end(spark, partitions):
    rows = conversations(4, 40, 9) + [(1000, t, r, f"t{t}") for t, (_, _, r, _) in enumerate(conversations(5, 60, 9))]
    was, adaptive = (spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = repaired_turns(turns(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    check(rows, found)
    plain = sorted((str(f["conv_id"]), f["out_turn"], f["chunk"], f["part"], f["role"], f["action"], f["segment"]) for f in found)
    key = [(c, o, r, a, s) for c, o, _, _, r, a, s in plain]
    if not hasattr(check, "first"):
        check.first = key
    assert sorted(key) == sorted(check.first)  # the same repair for any chunks


def test_all_short_conversations_are_cheapest(spark):
    roles = ["system", "user", "assistant", ""]
    rows, n = [], 0
    for size in (1, 2, 3, 4):
        for combo in itertools.product(roles, repeat=size):
            rows += [(n, t, r, f"x{t}") for t, r in enumerate(combo)]
            n += 1
    check(rows, repaired_turns(turns(spark, rows)).collect())


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, None, None), (1, None, None, None), (2, 0, "USER", "x" * 100_000), (2, 0, "USER", "x" * 100_000), (3, 5, "assistant", "late")]
    found = repaired_turns(turns(spark, rows)).collect()
    check(rows, found)
    assert [f["action"] for f in sorted((f for f in found if f["conv_id"] == "2"), key=lambda f: (f["out_turn"], f["part"]))] == ["keep", "merge", "insert"]
    assert repaired_turns(turns(spark, [])).count() == 0
