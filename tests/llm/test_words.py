import random

import numpy as np
import pyarrow as pa

from ledgerlark.llm.statistics import count_texts
from ledgerlark.llm.words import run_hashes, slices, split_words
from tests.llm.helpers import ODD, words

ALPHABET = ["a", "B", "c ", " ", "\n", "\t", "\x0b", "\x1f", "é", " ", "#", "|", "!", "foo ", "foo foo foo ", "bar\nbar\n"]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return [t for _, t in ODD] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_words_of_slices_equal_the_pattern():
    texts = random_texts(200)
    whole = pa.array(texts)
    for start, size in ((0, len(texts)), (7, 50), (len(texts) - 3, 3), (5, 0)):
        for fold in (True, False):
            found = split_words(whole.slice(start, size), fold)
            names = found.vocabulary.to_pylist()
            got = [[names[c] for c in found.codes[a:b]] for a, b in zip(found.starts, found.starts[1:])]
            assert got == [words(t, fold) for t in texts[start : start + size]]


def test_counts_equal_their_definitions():
    texts = random_texts(150)
    got = count_texts(pa.array(texts))
    for i, text in enumerate(texts):
        own, t = words(text, False), text or ""
        lines = [line for line in t.split("\n") if words(line)]
        runs = {}
        for k in range(len(own) - 2):
            runs.setdefault(tuple(own[k : k + 3]), []).append(k)
        covered = {k + j for places in runs.values() if len(places) > 1 for k in places for j in range(3)}
        assert got["n_words"][i] == len(own)
        assert got["word_chars"][i] == sum(map(len, own))
        assert got["n_symbols"][i] == sum(c in "#*$%&|<>" for c in t)
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert got["n_repeat_words"][i] == len(covered)
        assert got["n_distinct"][i] == len(set(own))
        assert got["n_top_word"][i] == max((own.count(w) for w in set(own)), default=0)
        assert got["n_text"][i] == len(t)


def test_runs_stay_inside_a_text_and_slices_hold_all_rows():
    found = split_words(pa.array(["a b c", "d", None, "e f"]))
    owner, _ = run_hashes(found, found.hashes(), 2)
    assert owner.tolist() == [0, 0, 3]
    batch = pa.record_batch({"text": pa.array(["x" * n for n in (5, 0, 9, 100, 1)]), "k": pa.array(range(5))})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), size=10))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(5)) and len(parts) > 1
    assert np.array_equal(split_words(pa.array([], pa.string())).codes, [])


class _Local:
    """Stands in for a table: runs the function of a task here and keeps its batches."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):
        return list(f(iter([self.batch])))


def test_a_worker_takes_little_text_at_once(spark):
    import pyarrow as pa

    from ledgerlark.llm.packing import token_pieces
    from ledgerlark.llm.statistics import text_statistics

    batch = pa.record_batch({"doc_id": list(range(6)), "text": ["some words " * 40_000] * 6, "text_key": [0] * 6})
    for found in (text_statistics(_Local(batch)), token_pieces(_Local(batch))):
        assert max(len(set(b.column("doc_id").to_pylist())) for b in found) <= 3
        assert sorted({i for b in found for i in b.column("doc_id").to_pylist()}) == list(range(6))
