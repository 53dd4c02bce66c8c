import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlark.llm.language_model import CONTEXT_LEVELS, Block, _cell, _from_small, _packed_keys, _small, _unpacked_keys, context_level, fit_weights, language_scores
from tests.llm.helpers import ODD, SMALL, documents, words

END = None


def tokens(text):
    return [*words(text), END]


def fold(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 10


def model(rows):
    """Scores of the model with weights learned from dictionaries."""
    def count(keep):
        uni, pairs, contexts = collections.Counter(), collections.Counter(), collections.Counter()
        for d, t in rows:
            if keep(fold(d)):
                own = tokens(t)
                before = ["<begin>", *own[:-1]]
                uni.update(own)
                pairs.update(zip(before, own))
                contexts.update(before)
        return uni, pairs, contexts

    uni, pairs, contexts = count(lambda f: f > 1)
    total, events = max(1, sum(uni.values())), collections.Counter()
    for d, t in rows:
        if fold(d) == 1:
            own = tokens(t)
            for v, w in zip(["<begin>", *own[:-1]], own):
                c = contexts[v]
                events[tuple(int(x[0]) for x in (context_level(np.array([c])), _cell(np.array([pairs[v, w] / max(c, 1)])), _cell(np.array([uni[w] / total]))))] += 1
    weights = fit_weights(np.array([(*k, n) for k, n in sorted(events.items())], np.int64).reshape(-1, 4), len(uni))
    uni, pairs, contexts = count(lambda f: f > 0)
    total, types = sum(uni.values()), len(uni)
    out = []
    for d, t in rows:
        own, score = tokens(t), 0.0
        for v, w in zip(["<begin>", *own[:-1]], own):
            a, b, c = weights[int(context_level(np.array([contexts[v]]))[0])]
            score += math.log10(a * pairs[v, w] / max(contexts[v], 1) + b * uni[w] / max(total, 1) + c / (types + 1))
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (types + 1))) for w in own)
        out.append((str(d), fold(d) == 0, len(own), sum(uni[w] > 0 for w in own), total, round(base, 5), round(score, 5)))
    return sorted(out)


def scored(df):
    return sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 5), round(r[6], 5)) for r in df.collect())


@pytest.mark.parametrize("block", [1 << 20, 20_000])
def test_scores_equal_dictionaries(spark, block):
    rows = ODD + [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(120).collect()]
    got, wanted = scored(language_scores(documents(spark, rows), block)), model(rows)
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-4) and g[6] == pytest.approx(w[6], abs=1e-4)


def test_odd_tables(spark):
    assert language_scores(documents(spark, [])).count() == 0
    held = next(i for i in range(100) if fold(i) == 0)
    assert scored(language_scores(documents(spark, [(held, "a b")])))[0][2:5] == (3, 0, 0)
    assert scored(language_scores(documents(spark, ODD))) == model(ODD)


def test_unseen_documents_are_better_than_the_base(spark):
    found = language_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").groupBy().sum("base_score", "score").first()
    assert found[1] > 0.8 * found[0]  # both are negative


def test_probabilities_sum_to_one():
    events = np.array([(3, 5, 20, 10), (3, 0, 30, 5), (0, 0, 12, 7), (5, 9, 9, 9)], np.int64)
    weights = fit_weights(events, 50)
    assert weights.shape == (CONTEXT_LEVELS, 3) and np.allclose(weights.sum(1), 1) and (weights >= 0).all() and weights[0, 0] == 0


def test_packed_columns_come_back():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) << np.uint64(8)
        keys = np.unique(keys)
        for kind in (0, 1):
            assert np.array_equal(_unpacked_keys(_packed_keys(kind, keys), len(keys)), keys)
        dense = np.arange(n, dtype=np.uint64) << np.uint64(8)
        assert np.array_equal(_unpacked_keys(_packed_keys(1, dense), n), dense)
        counts = rng.integers(0, 600, n)
        assert np.array_equal(_from_small(_small(counts), n), counts)


def test_blocks_keep_documents_apart():
    block = Block.of(pa.array(["a b", None, "a"]))
    assert block.doc.tolist() == [0, 0, 0, 1, 2, 2] and len(block.pairs) == 5  # begin a, a b, b end, begin end, a end


def test_weights_from_cells_lose_next_to_nothing_against_plain_em():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    by_fold = collections.defaultdict(list)
    for row in table:
        own = tokens(row["text"])
        by_fold[min(fold(row["doc_id"]), 2)] += list(zip(["<begin>", *own[:-1]], own))

    def counted(pairs):
        return collections.Counter(w for _, w in pairs), collections.Counter(pairs), collections.Counter(v for v, _ in pairs)

    def level(c):  # 0 unseen, 1 for one, 2 for two or three, 3 for four to seven, ...
        return min(int(c).bit_length(), CONTEXT_LEVELS - 1)

    uni, pairs, contexts = counted(by_fold[2])
    total, flat = sum(uni.values()), 1 / (len(uni) + 1)
    events = [(level(contexts[v]), pairs[v, w] / max(contexts[v], 1), uni[w] / total) for v, w in by_fold[1]]

    def climb(rows, start, prior):
        weights, parts = np.array(start), np.array([(a, b, flat) for _, a, b in rows])
        for _ in range(100):
            shares = parts * weights
            weights = (shares / shares.sum(1, keepdims=True)).sum(0) + prior
            weights /= weights.sum()
        return weights

    everything = climb(events, [1 / 3] * 3, np.ones(3))
    plain = {k: climb([e for e in events if e[0] == k], everything, everything * 10) for k in {e[0] for e in events}}
    cells = collections.Counter((k, int(_cell(np.array([a]))[0]), int(_cell(np.array([b]))[0])) for k, a, b in events)
    fitted = fit_weights(np.array([(*k, n) for k, n in sorted(cells.items())], np.int64), len(uni))
    for k, own in plain.items():
        if k:
            assert fitted[k] == pytest.approx(own, abs=0.01)
    uni, pairs, contexts = counted(by_fold[2] + by_fold[1])
    total, flat = sum(uni.values()), 1 / (len(uni) + 1)

    def held_out(weights):
        out = 0.0
        for v, w in by_fold[0]:
            a, b, c = weights(level(contexts[v]))
            out += math.log10(a * pairs[v, w] / max(contexts[v], 1) + b * uni[w] / total + c * flat)
        return out / len(by_fold[0])

    unseen = np.array([0, *(everything[1:] / everything[1:].sum())])
    exact, rounded = held_out(lambda k: plain.get(k, everything) if k else unseen), held_out(lambda k: fitted[k] if k else unseen)
    assert abs(exact - rounded) < 1e-3
