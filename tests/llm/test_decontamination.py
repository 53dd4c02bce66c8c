import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerlark.llm.decontamination import MIN_WORDS, Items, bucket_keys, edit_distances, edits_allowed, embed, find_passages, without_passages
from tests.llm.helpers import ODD, documents, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def best_windows(texts, items, least=MIN_WORDS):
    """(text, item) to (edits, start) by trying every window."""
    found = {}
    for t, text in enumerate(texts):
        own = words(text)
        for i, item in enumerate(items):
            wanted = words(item)
            limit = int(edits_allowed(len(wanted)))
            if len(wanted) < least:
                continue
            tried = [(distance(own[p : p + len(wanted)], wanted), p) for p in range(len(own)) if len(own[p : p + len(wanted)]) >= len(wanted) - limit]
            if tried and min(tried)[0] <= limit:
                found[t, i] = min(tried)
    return found


def planted(seed=2):
    rng = random.Random(seed)
    pick = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 5)))
    items = [" ".join(pick() for _ in range(rng.randrange(1, 40))) for _ in range(30)] + [None, "", "a b", "one two three four five six seven eight nine ten"]
    items.append(items[0].upper())
    texts = []
    for i in range(80):
        own = items[i % 30].split()
        for _ in range(rng.randrange(int(len(own) * 0.25) + 1)):
            k = rng.randrange(len(own))
            kind = rng.choice("rid")
            if kind == "d" and len(own) > 1:
                del own[k]
            elif kind == "i":
                own.insert(k, pick())
            else:
                own[k] = pick()
        head, tail = [pick() for _ in range(rng.randrange(20))], [pick() for _ in range(rng.choice((0, 0, 15)))]
        texts.append(" ".join(head + own + tail))
    texts += ["one TWO three four five six seven eight nine", "a b", None, ""]
    return texts, items


def test_windows_equal_brute_force_with_wanted_recall():
    texts, items = planted()
    block = Items.of(list(range(len(items))), items, MIN_WORDS)
    wanted = best_windows(texts, items)
    got = {(int(r.text), block.ids[r.item]): (int(r.distance), int(r.start)) for r in block.find(pa.array(texts)).itertuples()}
    assert set(got) <= set(wanted) and len(got) >= 0.9 * len(wanted) > 30
    assert all(got[k][0] >= wanted[k][0] for k in got)
    exact = {k for k, v in wanted.items() if v[0] == 0}
    assert exact and all(got.get(k) == wanted[k] for k in exact)  # equal windows share every key


def test_edit_distances_equal_their_definition():
    rng = np.random.default_rng(6)
    a, b = rng.integers(1, 4, (60, 12)).astype(np.uint64), rng.integers(1, 4, (60, 14)).astype(np.uint64)
    la, lb = rng.integers(0, 13, 60), rng.integers(0, 15, 60)
    limit = np.full(60, 5)
    got = edit_distances(a, la, b, lb, limit)
    for i in range(60):
        true = distance(a[i, : la[i]].tolist(), b[i, : lb[i]].tolist())
        assert got[i] == true or (true > 5 and got[i] > 5)


def test_embedding_turns_few_edits_into_few_differences():
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 1 << 60, (50, 40), dtype=np.uint64)
    near = np.hstack([rows[:, 1:], rng.integers(1, 1 << 60, (50, 1), dtype=np.uint64)])  # one removed, one appended
    far = rng.integers(1, 1 << 60, (50, 40), dtype=np.uint64)
    lengths = np.full(50, 40)
    base = embed(rows, lengths)
    assert (base != embed(near, lengths)).mean() < 0.6 * (base != embed(far, lengths)).mean()
    assert (base == embed(rows, lengths)).all()


@pytest.mark.parametrize("size", [1, 100])
def test_documents_lose_rows_with_passages_only(spark, monkeypatch, size):
    from ledgerlark.llm import decontamination

    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (MIN_WORDS, size))
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(7, item, "z"), (7, item, "z"), (8, None, "z"), (None, "p q r s t u v w", "z"), (9, "word", "z")], "item_id bigint, text string, doc_id string")
    docs = documents(spark, ODD + [(50, "x y " + item.upper() + " z"), (51, item.replace("four", "4")), (51, "clean"), (52, "p q r s t u v w"), (None, item)])
    every = find_passages(docs, bench).collect()
    assert [(r["doc_id"], r["start_word"], r["n_words"], r["edits"]) for r in every if r["item_id"] == 9] == [(6, 0, 1, 0)]
    found = sorted((str(r["doc_id"]), str(r["item_id"]), r["start_word"], r["edits"]) for r in every if r["item_id"] != 9)
    assert found == sorted([("50", "7", 2, 0)] * 2 + [("51", "7", 0, 1)] * 2 + [("52", "None", 0, 0)] + [("None", "7", 0, 0)] * 2)
    left = without_passages(docs, bench)
    assert left.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(map(str, [i for i, _ in ODD] + [51]))


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents(spark, ODD)
    assert find_passages(docs, bench).count() == 0 and without_passages(docs, bench).count() == len(ODD)
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert find_passages(documents(spark, []), one).count() == 0


def zipf_words(n, seed=0):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, n + 1)
    hashes = rng.integers(1, 1 << 62, n, dtype=np.uint64)
    return rng, lambda m, size: hashes[rng.choice(n, (m, size), p=share / share.sum())]


@pytest.mark.parametrize("n", [5, 7, 10, 15, 30, 59])
def test_keys_part_unrelated_windows_and_join_edited_ones(n):
    rng, draw = zipf_words(3000)
    m, items = 400, draw(400, n)
    near = items.copy()
    for i in range(m):  # as many edits as are allowed
        own = items[i].tolist()
        for word in draw(1, int(edits_allowed(n)))[0]:
            kind, at = rng.integers(3), rng.integers(len(own))
            own = own[:at] + [[word, own[at]], [word], []][kind] + own[at + 1 :]
        near[i] = (own + draw(1, n)[0].tolist())[:n]
    lengths = np.full(m, n)
    (a, real_a), (b, real_b) = bucket_keys(items, lengths), bucket_keys(near, lengths)
    assert ((a == b) & real_a & real_b).any(0).mean() >= 0.9
    met = np.zeros((m, m), bool)
    for x, rx, y, ry in zip(a, real_a, b, real_b):
        met |= (x[:, None] == y[None, :]) & rx[:, None] & ry[None, :]
    assert met[~np.eye(m, dtype=bool)].mean() < (0.01 if n >= 10 else 0.02)


def test_short_items_are_found_as_exact_copies():
    texts, items = planted(5)
    items += ["fee", "fee fi", "fee fi fo", "fee fi fo fum", "fo fee"]
    texts += ["x fee y", "FEE fi fo fum", "fi fo", "fee fo", "fo  fee fi"]
    short = [i for i, t in enumerate(items) if 0 < len(words(t)) < MIN_WORDS]
    block = Items.of(short, [items[i] for i in short], 1)
    got = {(int(r.text), block.ids[r.item]): (int(r.distance), int(r.start)) for r in block.find(pa.array(texts)).itertuples()}
    assert got == {k: v for k, v in best_windows(texts, items, 1).items() if k[1] in short} and len(got) > 10


def test_very_long_items_stay_within_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    long = [f"w{k}" for k in rng.integers(0, 5000, 6_000)]
    changed = [w if i % 50 else "z" for i, w in enumerate(long)]
    tracemalloc.start()
    block = Items.of([1, 2], [" ".join(long), "one two three four five six"], 1)
    got = {(int(r.text), block.ids[r.item]): int(r.distance) for r in block.find(pa.array(["a b " + " ".join(changed), "x one two three four five six"])).itertuples()}
    assert got == {(0, 1): 120, (1, 2): 0} and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
