import hashlib
import random

import numpy as np
import pytest

from ledgerlark.llm import catalog, substrings
from ledgerlark.llm.fm_index import FMIndex
from tests.llm.helpers import ODD, documents, words


def brute(rows, size):
    """(id, words, removed, kept text) of each row, straight from the definition."""
    least = {}
    split = [(i, words(t, fold=False)) for i, t in rows]
    rank = lambda i: (i is None, i or 0)
    for i, ws in split:
        for k in range(len(ws) - size + 1):
            w = tuple(ws[k : k + size])
            least[w] = min(least.get(w, rank(i)), rank(i))
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - size + 1):
            if least[tuple(ws[k : k + size])] < rank(i):
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), kept))
    return out


def digests(found):
    return sorted(map(repr, ((i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in found)))


def planted(seed, n=120):
    """Documents of few different words that quote each other, some with one word changed."""
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(30)] + ["Ä", "a b", "x\u0085"]
    common = [rng.choice(names) for _ in range(40)]
    rows = []
    for i in range(n):
        ws = [rng.choice(names) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            a = rng.randrange(0, 20)
            ws[len(ws) // 2 : len(ws) // 2] = common[a : a + rng.randrange(5, 20)]
        if i % 7 == 0 and rows:
            ws += words(rng.choice(rows)[1], fold=False)[: rng.randrange(1, 40)]
        rows.append((i * 3 % n, rng.choice([" ", "\n", "  "]).join(ws)))
    return rows


@pytest.mark.parametrize("depth", [2, 3, 5, 8, 13])
def test_matching_statistics_equal_plain_search(depth):
    rng = np.random.default_rng(depth)
    for _ in range(40):
        held = [rng.integers(1, 4, rng.integers(0, 30)) for _ in range(rng.integers(1, 6))]
        text = np.concatenate([np.append(s, 0) for s in held]).astype(np.int64)
        asked = [rng.choice([1, 2, 3, -1, 9], rng.integers(0, 30), p=[0.3, 0.3, 0.3, 0.05, 0.05]) for _ in range(5)]
        flat, starts = np.concatenate(asked).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in asked])])
        index = FMIndex(text, depth)
        length, group = index.matching_statistics(flat, starts)
        have = {tuple(s[i : i + k]) for s in held for i in range(len(s)) for k in range(1, min(depth, len(s) - i) + 1)}
        want = []
        for x in asked:
            for i in range(len(x)):
                k = 0
                while k < depth and i + k < len(x) and tuple(x[i : i + k + 1]) in have:
                    k += 1
                want.append(k)
        assert length.tolist() == want
        assert ((group >= 0) == (length == depth)).all()
        for i in np.flatnonzero(group >= 0):
            at = index.order[index.starts[group[i]]]
            assert (text[at : at + depth] == flat[i : i + depth]).all()


@pytest.mark.parametrize("size, block_bytes, busy", [(13, 1 << 23, 2048), (13, 300, 1), (13, 300, 0), (4, 1000, 5), (3, 200, 10**9)])
def test_removed_words_equal_the_definition(spark, size, block_bytes, busy):
    rows = planted(size + busy % 7)
    found = substrings.repeat_digests(documents(spark, rows), size, block_bytes, busy).collect()
    assert sorted(map(repr, map(tuple, found))) == digests(brute(rows, size))


def test_texts_and_spans_say_the_same(spark):
    rows = [(k, t) for k, (_, t) in enumerate(planted(9))]
    want = brute(rows, 5)
    texts = substrings.without_repeats(documents(spark, rows), 5, 2000).collect()
    assert sorted((t["doc_id"], t["text"]) for t in texts) == sorted((i, t) for i, _, _, t in want)
    spans = substrings.repeated_spans(documents(spark, rows), 5, 2000).collect()
    split = {i: words(t, fold=False) for i, t in rows}
    gone = {i: set() for i in split}
    for s in spans:
        assert s["begin"] < s["end"] and not gone[s["doc_id"]] & set(range(s["begin"], s["end"]))
        gone[s["doc_id"]].update(range(s["begin"], s["end"]))
    for i, _, _, kept in want:
        assert " ".join(w for k, w in enumerate(split[i]) if k not in gone[i]) == kept


def test_odd_rows(spark):
    long = " ".join(f"t{k}" for k in range(40))
    rows = [*ODD, (20, long), (20, long), (None, long), (None, long), (21, "z " + long + " z"), (-5, " ".join(long.split()[5:30])), (22, long.upper()), (23, "ab " * 30_000 + long)]
    for busy in (0, 2048):
        found = substrings.repeat_digests(documents(spark, rows), block_bytes=50_000, busy=busy).collect()
        assert sorted(map(repr, map(tuple, found))) == digests(brute(rows, 13))
    assert substrings.repeat_digests(documents(spark, [])).count() == 0


def test_a_passage_in_a_third_of_all_rows_is_spread(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, f"{rng.random()} {rng.random()} " * 6 + (passage if i % 3 == 0 else "") + f" {rng.random()}" * 12) for i in range(900)]
    docs = documents(spark, rows)
    dealt, blocks = substrings._blocks(docs, 4000)
    marks = substrings._marks(dealt, 13).toPandas()
    marks = marks.merge(marks.groupby("mark").n.sum().rename("all").reset_index(), on="mark")
    assert marks["all"].max() > 200
    shared = spark.createDataFrame(marks.assign(busy=marks["all"] > 50)[["block", "mark", "busy"]])
    sent = substrings._sent(dealt, shared.where("busy"), 13, 64).toPandas()
    assert sent.groupby(["words", "block"]).size().max() == 1
    assert sent.groupby("shard").size().max() < 0.1 * len(sent)
    found = substrings.repeat_digests(docs, block_bytes=4000, busy=50).collect()
    assert sorted(map(repr, map(tuple, found))) == digests(brute(rows, 13))


def test_shares_one_shuffle_of_the_documents(spark):
    plan = substrings.repeat_digests(documents(spark, planted(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") + plan.count("Exchange hashpartitioning(block") >= 3
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_query_reads_the_whole_table(spark):
    from tests.llm.helpers import SMALL

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = catalog.QUERIES["op11_fm_index"](spark, SMALL).collect()
    assert sorted(map(repr, map(tuple, found))) == digests(brute(rows, 13))
    assert any(f["n_removed"] for f in found)
