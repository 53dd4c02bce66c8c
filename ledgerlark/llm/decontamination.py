"""Benchmark passages in documents under edit distance, found by CGK embedding and bit sampling.

Both sides are sequences of words. A window of a document as long as an item matches it if at most a
fifth of the item's words must be inserted, removed or replaced. The CGK random walk copies a word per
step and moves on or stays by a random bit of that word, so that sequences at a small edit distance
become strings at a small Hamming distance. Sampling a few places of the string gives a bucket key;
walks and samples are repeated until the wanted recall is reached. Places lie where a walk over the words
has most likely not ended, and a key with a place beyond the end is none: equal padding says nothing. Windows
that share a key with an item are verified by exact edit distance. At the edit limit the keys reach a recall
of 0.95 and more from 5 to 59 words, and few unrelated windows share one (measured in the tests).

Windows are taken at every word. Those that cannot match are passed over before any walk: an item of n
words within k edits leaves at least n - 1 - 2k of its word pairs in the window, so a window with fewer
pairs known from any item has no match. This loses nothing.

Items are the query set. They go to the tasks in blocks of bounded size, each of which scans the
documents once; documents never move, and no group of documents is formed.

Defined cases: A to Z count as lower case; null or empty texts match nothing; items of one to four words
allow no edit, so exact copies of them are found; they do not condemn a document (``without_passages`` takes
items from ``min_words`` words on, as a single word would drop nearly everything); a window
cut off by the end of a text counts with the words it has; repeated rows and items give repeated
results; a null doc_id or item_id is carried as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.words import LEAN_SLICE_BYTES, chain, mix, slices, split_words

EDIT_SHARE = 0.2
MIN_WORDS = 5
WALKS, SAMPLES, PLACES = 8, 8, 3
#: Words of the string, per word of the item, that places are drawn from; a walk takes two steps a word.
WALKED = 1.8
#: Items per block, and words of a block where each item is as wide as its widest: at most some 50 MB in a task.
BLOCK_ITEMS, BLOCK_WORDS = 5_000, 2_000_000
#: Windows embedded at once, and words of their strings over all walks: 128 MB.
_AT_ONCE, _STRING_WORDS = 2_000, 16_000_000
_CELLS = 4_000_000


def _at_once(width: int) -> int:
    return max(1, min(_AT_ONCE, _STRING_WORDS // (3 * WALKS * max(1, width))))


def edits_allowed(n: np.ndarray | int) -> np.ndarray | int:
    return np.floor(np.asarray(n) * EDIT_SHARE + 1e-9).astype(np.int64)


def _length_bit(n: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (n % 64).astype(np.uint64)


def embed(rows: np.ndarray, lengths: np.ndarray, walks: int = WALKS, seed: int = 11) -> np.ndarray:
    """CGK strings of padded rows: for each row and walk, three times as many steps as the row is wide."""
    steps = 3 * rows.shape[1]
    coins = mix(np.arange(steps * walks, dtype=np.uint64) + np.uint64(seed << 32)).reshape(steps, walks) | np.uint64(1)
    at = np.zeros((len(rows), walks), np.int64)
    padded = np.hstack([rows, np.zeros((len(rows), 1), np.uint64)])
    line, out = np.arange(len(rows))[:, None], np.empty((steps, len(rows), walks), np.uint64)
    for j in range(steps):
        symbol = padded[line, at]
        out[j] = symbol
        at = np.minimum(at + ((symbol * coins[j]) >> np.uint64(63)).astype(np.int64), lengths[:, None])
    return out


def bucket_keys(rows: np.ndarray, lengths: np.ndarray, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """A key for each repetition and row, the embedded words at a few random places one after the other, and
    whether all of them lie within the walk. The last key is of all words, so that a copy is never missed."""
    strings = embed(rows, lengths)
    shares = (np.arange(PLACES) + np.random.default_rng(seed).random((WALKS, SAMPLES, PLACES))) / PLACES * WALKED
    line = np.arange(len(rows))
    keys, real = np.empty((WALKS * SAMPLES + 1, len(rows)), np.uint64), np.ones((WALKS * SAMPLES + 1, len(rows)), bool)
    for w in range(WALKS):
        for s in range(SAMPLES):
            picked = [strings[(shares[w, s, p] * lengths).astype(np.int64), line, w] for p in range(PLACES)]
            keys[w * SAMPLES + s] = chain([lengths.astype(np.uint64), *picked])
            real[w * SAMPLES + s] = np.all([words != 0 for words in picked], axis=0)
    keys[-1] = chain([lengths.astype(np.uint64), *rows.T])
    return keys, real


def edit_distances(a: np.ndarray, len_a: np.ndarray, b: np.ndarray, len_b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Exact word edit distances of padded row pairs, or a value above ``limit`` where it is exceeded."""
    band = int(max(limit.max(initial=0), np.abs(len_a - len_b).max(initial=0)))
    width, m = int(len_b.max(initial=0)), len(a)
    kind = np.int16 if max(width, a.shape[1]) < 4_000 else np.int32
    big = kind(1 << (13 if kind is np.int16 else 29))
    a, b, pair = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), np.arange(m)
    places = np.arange(width + 1, dtype=kind)[:, None]
    above = np.repeat(np.where(places <= band, places, big), m, 1)
    result = np.where(len_a == 0, above[len_b, pair], big)
    for i in range(1, int(len_a.max(initial=0)) + 1):
        low, high = max(1, i - band), min(width, i + band)
        row = np.full((width + 1, m), big, kind)
        if i <= band:
            row[0] = i
        if low <= high:
            steps = np.minimum(above[low : high + 1] + kind(1), above[low - 1 : high] + (a[i - 1] != b[low - 1 : high]).astype(kind))
            # a step to the right costs one, so less its place a distance is a running minimum
            run = np.concatenate([row[low - 1 : low], steps]) - places[low - 1 : high + 1]
            row[low : high + 1] = (np.minimum.accumulate(run, axis=0) + places[low - 1 : high + 1])[1:]
        result = np.where(len_a == i, row[len_b, pair], result)
        above = np.minimum(row, big)
    return result.astype(np.int64)


@dataclass(frozen=True)
class Items:
    """A block of benchmark items as padded rows of word hashes, with what the filter needs."""

    ids: list
    rows: np.ndarray
    lengths: np.ndarray
    vocabulary: np.ndarray
    pairs: np.ndarray
    keys: np.ndarray
    real: np.ndarray
    #: how often a word pair occurs in one item at most
    most_repeats: int
    #: for each word pair the item lengths it occurs with, as bits of the length modulo 64
    masks: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str | None], min_words: int) -> Items | None:
        words = split_words(pa.array(texts, pa.string()))
        hashes, own = words.hashes(), np.flatnonzero(words.counts >= max(1, min_words))
        if not len(own):
            return None
        lengths = words.counts[own]
        rows = np.zeros((len(own), int(lengths.max())), np.uint64)
        for line, i in enumerate(own):
            rows[line, : lengths[line]] = hashes[words.codes[words.starts[i] : words.starts[i + 1]]]
        inside = np.arange(rows.shape[1])[None, :] < lengths[:, None]
        vocabulary = np.unique(rows[inside])
        codes = np.searchsorted(vocabulary, rows)
        pairs = np.unique((codes[:, :-1] * len(vocabulary) + codes[:, 1:])[inside[:, 1:]])
        coded = np.where(inside[:, 1:], codes[:, :-1] * len(vocabulary) + codes[:, 1:], -1)
        line_pairs, repeats = np.unique(np.column_stack([np.repeat(np.arange(len(rows)), coded.shape[1]), coded.ravel()]), axis=0, return_counts=True)
        most = int(repeats[line_pairs[:, 1] >= 0].max(initial=1))
        masks = np.zeros(len(pairs), np.uint64)
        lines, columns = np.nonzero(coded >= 0)
        np.bitwise_or.at(masks, np.searchsorted(pairs, coded[lines, columns]), _length_bit(lengths[lines]))
        step = _at_once(rows.shape[1])
        keys, real = (np.hstack(part) for part in zip(*(bucket_keys(rows[k : k + step], lengths[k : k + step]) for k in range(0, len(rows), step))))
        return cls([ids[i] for i in own], rows, lengths, vocabulary, pairs, keys, real, most, masks)

    def find(self, texts: pa.Array) -> pd.DataFrame:
        """text, item, start, n_words and distance of the best window of each (text, item) that match."""
        nothing = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("text", "item", "start", "n_words", "distance")})
        words = split_words(texts)
        if not len(words.codes):
            return nothing
        hashes = words.hashes()[words.codes]
        starts, ends, lengths = self._windows(words, hashes)
        if not len(starts):
            return nothing
        step = _at_once(self.rows.shape[1])
        found = [self._candidates(hashes, starts[k : k + step], ends[k : k + step], lengths[k : k + step]) for k in range(0, len(starts), step)]
        met = pd.DataFrame(np.vstack(found), columns=["start", "end", "item", "distance"])
        if not len(met):
            return nothing
        met["text"] = words.owner[met["start"]]
        met["n_words"] = met["end"] - met["start"]
        met = met.sort_values(["text", "item", "distance", "start"]).drop_duplicates(["text", "item"])
        met["start"] -= words.starts[met["text"]]
        return met[nothing.columns.tolist()]

    def _windows(self, words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item length) of all windows that hold enough word pairs known from items."""
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == hashes
        owner, n = words.owner, len(hashes)
        both = np.flatnonzero(known[:-1] & known[1:] & (owner[:-1] == owner[1:]))
        code = place[both] * len(self.vocabulary) + place[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
        hit, mask = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.uint64)
        if len(self.pairs):
            real = self.pairs[at] == code
            both, code, at = both[real], code[real], at[real]
            hit[both + 1], mask[both + 1] = 1, self.masks[at]
        before = np.cumsum(hit)  # before[i]: known pairs that begin before word i
        sizes = np.unique(self.lengths)
        need = np.maximum(sizes - 1 - 2 * edits_allowed(sizes), 0)
        text_end = words.starts[1:][owner]
        if need.min() > 0:  # no window needs less than this within the longest item
            reach = np.minimum(np.arange(n) + int(sizes.max()), text_end)
            ahead = np.flatnonzero(before[np.maximum(reach - 1, 0)] - before[:n] >= need.min())
        else:
            ahead = np.arange(n)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size, least in zip(sizes, need):
            end = np.minimum(ahead + size, text_end[ahead])
            enough = (before[np.maximum(end - 1, ahead)] - before[ahead] >= least) & (end - ahead >= size - edits_allowed(size))
            if least == 0:
                enough &= known[ahead]
            own = ahead[enough]
            out.append((own, end[enough], np.full(len(own), size)))
        starts, ends, sizes = (np.concatenate([o[k] for o in out]) for k in range(3))
        return self._fitting(both, code, mask, starts, ends, sizes)

    def _fitting(self, both, code, mask, starts, ends, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows, those with enough pairs of items of their own length, a pair counting no more
        often than in any item."""
        earlier = np.full(len(mask), -1, np.int32)
        order = np.argsort(code, kind="stable")
        place, same, k = both[order], code[order], self.most_repeats
        if len(place) > k:
            earlier[place[k:]] = np.where(same[k:] == same[:-k], place[:-k], -1)
        keep = np.zeros(len(starts), bool)
        for size in np.unique(sizes):
            offsets, bit, least = np.arange(size - 1, dtype=np.int32)[None, :], _length_bit(size), size - 1 - 2 * edits_allowed(size)
            own = np.flatnonzero(sizes == size)
            step = max(1, min(20_000, _CELLS // size))
            for c in range(0, len(own), step):
                some = own[c : c + step]
                s, e = starts[some, None].astype(np.int32), ends[some, None].astype(np.int32)
                at = np.minimum(s + offsets, np.int32(len(mask) - 2))
                counts = (mask[at + 1] & bit != 0) & (s + offsets < e - 1) & (earlier[at] < s)
                keep[some] = counts.sum(1) >= least
        return starts[keep], ends[keep], sizes[keep]

    def _candidates(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        place = starts[:, None] + np.arange(self.rows.shape[1])[None, :]
        inside = place < ends[:, None]
        rows = np.where(inside, hashes[np.minimum(place, len(hashes) - 1)], np.uint64(0))
        pairs: list[np.ndarray] = []
        for own, real, wanted, is_key in zip(*bucket_keys(rows, sizes), self.keys, self.real):
            asking, held = np.flatnonzero(real), np.flatnonzero(is_key)
            order = held[np.argsort(wanted[held], kind="stable")]
            low, high = (np.searchsorted(wanted[order], own[asking], side) for side in ("left", "right"))
            lines = np.repeat(np.arange(len(asking)), high - low)
            offset = np.arange(len(lines)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            pairs.append(asking[lines] * len(self.ids) + order[low[lines] + offset])
        met = np.unique(np.concatenate(pairs))
        line, item = met // len(self.ids), met % len(self.ids)
        width, limit = ends - starts, edits_allowed(self.lengths[item])
        distance = np.where((width[line] == self.lengths[item]) & (rows[line] == self.rows[item]).all(1), 0, limit + 1)
        open_ = np.flatnonzero(distance)
        step = max(1, _CELLS // self.rows.shape[1])
        for k in range(0, len(open_), step):
            some = open_[k : k + step]
            line_, item_ = line[some], item[some]
            distance[some] = edit_distances(rows[line_], width[line_], self.rows[item_], self.lengths[item_], limit[some])
        good = distance <= limit
        return np.column_stack([starts[line], ends[line], item, distance])[good]


def item_blocks(benchmark: DataFrame, min_words: int = MIN_WORDS, size: int = BLOCK_ITEMS) -> Iterator[Items]:
    """The query set in blocks of ``size`` items, or fewer where an item is very long."""
    ids, texts, widest = [], [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        widest = max(widest, len(row["text"] or "") // 2 + 1)
        if ids and (len(ids) == size or (len(ids) + 1) * widest > BLOCK_WORDS):
            if block := Items.of(ids, texts, min_words):
                yield block
            ids, texts, widest = [], [], len(row["text"] or "") // 2 + 1
        ids.append(row["item_id"])
        texts.append(row["text"])
    if ids and (block := Items.of(ids, texts, min_words)):
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, min_words: int = 1) -> DataFrame:
    """doc_id, item_id, start_word, n_words and edits of the best window of each item in each document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, edits bigint"
    found = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, min_words):

        def search(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, size=2 * LEAN_SLICE_BYTES):
                met = items.find(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(met["text"].to_numpy(np.int64))), pa.array([items.ids[i] for i in met["item"]], pa.int64()),
                        *(pa.array(met[c].to_numpy(np.int64)) for c in ("start", "n_words", "distance")),
                    ],
                    ["doc_id", "item_id", "start_word", "n_words", "edits"],
                )

        found = found.unionByName(texts.mapInArrow(search, schema))
    return found


def without_passages(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all columns; rows are judged where they lie."""
    for items in item_blocks(benchmark, min_words):

        def clean(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, size=2 * LEAN_SLICE_BYTES):
                keep = np.ones(part.num_rows, bool)
                keep[items.find(part.column("text"))["text"].to_numpy(np.int64)] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
