import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlark.llm import alignment, catalog
from tests.llm.helpers import ODD, SMALL, documents

#: Texts that test cuts, byte fallback, special tokens as text, and texts that do not come back.
TEXTS = [
    "a  b", " a", "a\n b", "a \n b", "b <|endoftext|> c<|endoftext|>", "<s> hi </s> <unk>", "x　y z", "it's  we'll\r\n", "a b c", "▁x", "the▁end is",
    "é\x85 z", "\x1c a \x1d b", "中文字 混 排", "🙂🙂 x", "tab\tx y", "  ", "\n", "zzzzzzzzzzzz" * 40, "ab" * 700, "🙂é" * 200, "nul\x00l x", "Ωmega ﬁ x²",
]


def plain(rows):
    """Results straight from the definition: whole texts, all ends, all pairs."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment._byte_letters()
    found = []
    for i, text in rows:
        groups = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            data = [[bytes(letters[c] for c in a.id_to_token(x)) for x in ids[0]]]
            data.append([bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]])
            if all(b"".join(d) == (" " + text).encode() for d in data):
                ends = [np.cumsum([len(x) for x in d]).tolist() for d in data]
                common = sorted(set(ends[0]) & set(ends[1]))
                at = [0, 0]
                for c in common:
                    group = []
                    for k in range(2):
                        n = ends[k].index(c) + 1
                        group.append(ids[k][at[k] : n])
                        at[k] = n
                    groups.append(group)
        found.append((i, groups))
    held = Counter()
    for _, groups in found:
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, groups in found:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == top[p[0]] for p in links),
            sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


@pytest.mark.parametrize("lane", [1, 2, 7, 64])
def test_galloping_finds_what_both_lists_hold(lane):
    rng = np.random.default_rng(lane)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, rng.integers(1, 300), rng.integers(0, 90))) for _ in range(2))
        in_a, in_b = alignment.gallop(a, b, lane)
        want = np.intersect1d(a, b)
        assert a[in_a].tolist() == b[in_b].tolist() == want.tolist()
    far = np.arange(0, 10**6, 3)
    in_a, _ = alignment.gallop(np.array([0, 5, 299_997, 999_999]), far, lane)
    assert in_a.tolist() == [0, 2, 3]


def test_overlap_ranges_and_large_groups(monkeypatch):
    a, b = np.array([7, 8, 7, 9]), np.array([1, 1, 2])
    bounds_a, bounds_b = alignment.group_bounds(np.array([2, 3])), alignment.group_bounds(np.array([1, 2]))
    assert [x.tolist() for x in alignment.overlap_ranges(bounds_a, bounds_b)] == [[0, 0, 0, 2], [2, 2, 2, 3]]
    for limit in (1 << 20, 1):
        monkeypatch.setattr(alignment, "_PAIRS", limit)
        counted = Counter()
        for g, k, t in zip(*alignment.linked_pairs(a, b, bounds_a, bounds_b, 10)):
            counted[int(g), int(k)] += int(t)
        assert counted == {(0, 71): 4, (0, 81): 2, (1, 92): 1}


def drawn(seed, n):
    rng = random.Random(seed)
    parts = ["ab", " ", "  ", "\n", "'s", "9", "é", "!?", "\t", "中", "token", "ization", " the", "▁", "🙂", "<s>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("slice_bytes", [1 << 23, 40])
def test_results_equal_the_definition(spark, slice_bytes):
    texts = [*TEXTS, *(t for _, t in ODD), *drawn(2, 150), *drawn(2, 20)]
    rows = [(k % 190, t) for k, t in enumerate(texts)]
    found = alignment.aligned_documents(documents(spark, rows), slice_bytes=slice_bytes).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain(rows)))
    assert sum(bool(f["n_links"]) for f in found) > 100


def test_without_cuts_and_with_a_small_cache(monkeypatch):
    import public_tokenizers

    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert aligner._by_chunk
    texts = [*TEXTS, *drawn(5, 60)]
    once = alignment.aligned_slice(texts, aligner)[0]
    aligner._by_chunk = False
    aligner._clear()
    whole = alignment.aligned_slice(texts, aligner)[0]
    assert once[:5] == whole[:5]
    aligner._by_chunk = True
    monkeypatch.setattr(alignment, "_CACHED_CHUNKS", 3)
    assert [alignment.aligned_slice([t], aligner)[0][4] for t in texts] == [[d] for d in whole[4]]


def test_empty_table(spark):
    assert alignment.aligned_documents(documents(spark, [])).count() == 0


def test_query_reads_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    found = catalog.QUERIES["op12_gallop_alignment"](spark, SMALL).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain(rows)))
