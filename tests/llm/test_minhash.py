import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm.components import components
from ledgerlark.llm.minhash import BITS, LONGS, MINIMA, equal_minima, near_duplicates
from tests.llm.helpers import ODD, SMALL, documents, words


def shingle_set(text):
    own = words(text)
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def expected(rows):
    """Component of each id by comparing all pairs of sets that share a shingle."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingle_set(t)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in seen:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


def chain_of_edits(seed=1):
    """A group whose ends are unlike each other but connected step by step, and a group of many near copies."""
    rng = random.Random(seed)
    pick = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, own = [], [pick() for _ in range(100)]
    for k in range(8):
        rows.append((100 + k, " ".join(own)))
        own = own[6:] + [pick() for _ in range(6)]
    base = [pick() for _ in range(120)]
    for k in range(60):
        mine = list(base)
        for _ in range(rng.randrange(3)):
            mine[rng.randrange(120)] = pick()
        rows.append((300 - k, " ".join(mine)))
    shared = [pick() for _ in range(60)]  # a passage in many texts that are otherwise different
    rows += [(400 + k, " ".join(shared + [pick() for _ in range(40)])) for k in range(40)]
    return rows


@pytest.mark.parametrize("rows", [chain_of_edits(), ODD, chain_of_edits(2)[:80] + ODD + [(5000, None)]], ids=["groups", "odd", "both"])
def test_components_equal_all_pairs(spark, rows):
    sets, component = expected(rows)
    found = near_duplicates(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is not None:
            assert r["n_shingles"] == len(sets[r["doc_id"]])
            assert r["component_id"] == component[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_components_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    _, component = expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert found == component and len(set(component.values())) < len(component)


def test_null_ids_and_empty_table(spark):
    found = near_duplicates(documents(spark, [(None, "a b c d e f"), (None, None), (4, "A b c d e f"), (None, "q r s t u")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in found) == [
        ("4", "4", True), ("None", "4", False), ("None", "None", True), ("None", "None", True),
    ]
    assert near_duplicates(documents(spark, [])).count() == 0


def test_equal_nibbles_are_counted(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 16, (2, MINIMA))
    b[:90] = a[:90]

    def pack(values):
        out = [0] * LONGS
        for j, v in enumerate(values):
            out[j * BITS // 64] |= int(v) << (j * BITS % 64)
        return [x - (1 << 64) if x >> 63 else x for x in out]

    row = spark.createDataFrame([(pack(a), pack(b))], "a array<bigint>, b array<bigint>")
    assert row.select(equal_minima(F.col("a"), F.col("b"))).first()[0] == int((a == b).sum())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (101, 102), (200, 200)], "a bigint, b bigint")
    found = {r["id"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}
