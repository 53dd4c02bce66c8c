import zlib

import pytest

from ledgerlark.llm.sharding import PLACES, Ring, fill, quotas, sharded
from tests.llm.helpers import ODD, documents


def one_by_one(ring, arcs, shares):
    """Each row in order goes to the first shard with room, clockwise."""
    left, out = list(shares), []
    for arc in arcs:
        s = next(s for s in ring.walks[arc] if left[s])
        left[s] -= 1
        out.append(s)
    return out


@pytest.mark.parametrize("rows, shards", [(0, 3), (1, 8), (5000, 8), (4999, 5), (7, 8), (3000, 1)])
def test_phases_equal_rows_placed_one_by_one(rows, shards):
    import random

    rng, ring = random.Random(rows), Ring.of(shards)
    hot = rng.randrange(len(ring.ends))
    arcs = [hot if rng.random() < 0.3 else rng.randrange(len(ring.ends)) for _ in range(rows)]

    def counts(low, high, width):
        found = {}
        for i in range(low, min(high, rows)):
            step = found.setdefault((i - low) // width, {})
            step[arcs[i]] = step.get(arcs[i], 0) + 1
        return found

    phases = fill(ring, rows, quotas(rows, shards), counts)
    got = [next(aim for start, aim in reversed(phases) if i >= start)[a] for i, a in enumerate(arcs)]
    assert got == one_by_one(ring, arcs, quotas(rows, shards))


def test_ring_walks_meet_every_shard_once():
    ring = Ring.of(8)
    assert all(sorted(w) == list(range(8)) for w in ring.walks) and ring.ends == sorted(set(ring.ends)) and max(ring.ends) < PLACES


def test_arcs_are_found_by_place(spark):
    from pyspark.sql import functions as F

    ring = Ring.of(5)
    got = spark.range(PLACES).select("id", ring.arc(F.col("id")).alias("arc")).collect()
    import bisect

    for r in got[:: 61]:
        assert r["arc"] == bisect.bisect_left(ring.ends, r["id"]) % len(ring.ends)


def holds(rows, texts, shards=8):
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    for slots in counts.values():
        assert sorted(slots) == list(range(len(slots)))
    sizes = [len(counts.get(s, ())) for s in range(shards)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} <= {("rows", None)}


def test_odd_rows_and_a_hot_id_are_spread_evenly(spark):
    texts = ODD + [(77, f"copy {i % 3}") for i in range(300)] + [(i, "t") for i in range(1000, 1200)]
    holds(sharded(documents(spark, texts)).collect(), texts)
    assert sharded(documents(spark, [])).count() == 0


def test_few_rows_move_when_a_shard_is_added(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(4000)])
    was, now = ({r["doc_id"]: r["shard"] for r in sharded(docs, n).collect()} for n in (8, 9))
    assert sum(was[i] != now[i] for i in was) < 0.45 * len(was)  # dealing anew would move 8 of 9
    assert was == {r["doc_id"]: r["shard"] for r in sharded(docs.repartition(5), 8).collect()}


def test_no_python_runs_in_the_plan(spark):
    plan = sharded(documents(spark, [(i, "x") for i in range(50)]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
