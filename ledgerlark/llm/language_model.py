"""Bigram language model by deleted interpolation, scored over all documents.

The probability of a token w after v mixes three estimates: c(v, w) / c(v), c(w) / N and 1 / (V + 1).
The weights depend on how often the context was seen (powers of two) and are learned by expectation
maximisation on a tenth of the training documents, with counts from the other nine tenths; the final
score takes counts of all training documents.

Counts of word pairs are about as many as the words of the corpus, so they are neither collected nor
broadcast. Documents are hashed into blocks of some 8 MB of text. Each block sends every distinct word
and word pair once, as sorted 64-bit keys with its own counts, to the range of keys it belongs to;
there the counts of all blocks are added, and go back to the block in the order it asked. A frequent
word is one entry per block, so no key is hot. Scores need one count per key, of all training documents;
weights need the counts for counting, of the keys in a block's documents for weights alone. Which words
make up a pair of those is sent once per distinct pair. Texts are moved twice, to count and to score.

Keys are hashes, of 64 bits for words and 56 for pairs; a pair is taken for another with a chance of one
in ten million per five billion distinct pairs. Defined cases: a null or empty text is one end token; without training documents every
count is 0, the base score divides by 0.1 and the model is uniform; repeated rows count and score each
for itself; a null doc_id belongs to the hash of the empty text and is carried as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.tables import id_crc, stored, text_bytes
from ledgerlark.llm.words import chain, split_words

FOLDS, HELD_OUT, WEIGHT_FOLD = 10, 0, 1
BLOCK_BYTES = 8 << 20
CONTEXT_LEVELS = 24
#: Cells per doubling, and doublings covered, of the probabilities that weights are learned from.
CELLS, DOUBLINGS = 4, 40
_END, _BEGIN = np.uint64(0xE17D), np.uint64(0xBE61)
_WORD, _PAIR, _REFERENCES = 0, 1, 2


@dataclass(frozen=True)
class Block:
    """Tokens of a block of documents: place of each in the distinct words and pairs."""

    doc: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    context_at: np.ndarray
    pairs: np.ndarray
    pair_at: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        split = split_words(texts)
        n, counts = len(split.counts), split.counts
        hashes = split.hashes()[split.codes] if len(split.codes) else np.zeros(0, np.uint64)
        # each document: its words, then one end; the context of the first token is the begin mark
        doc = np.repeat(np.arange(n), counts + 1)
        token = np.full(len(doc), _END)
        last = np.cumsum(counts + 1) - 1
        inner = np.ones(len(doc), bool)
        inner[last] = False
        token[inner] = hashes
        context = np.concatenate([[_BEGIN], token[:-1]]) if len(doc) else token
        context[np.concatenate([[0], last[:-1] + 1])] = _BEGIN
        at, words = pd.factorize(np.concatenate([token, context]))
        pair_at, pairs = pd.factorize(chain([context, token]) & ~np.uint64(0xFF))
        # in key order, so that answers need no keys
        order, pair_order = np.argsort(words), np.argsort(pairs)
        rank, pair_rank = np.empty_like(order), np.empty_like(pair_order)
        rank[order], pair_rank[pair_order] = np.arange(len(order)), np.arange(len(pair_order))
        at = rank[at]
        return cls(doc, words[order], at[: len(doc)], at[len(doc) :], pairs[pair_order], pair_rank[pair_at])

    def references(self, fold: np.ndarray) -> bytes:
        """Distinct pairs of the documents that weights are learned from, in key order: how often each is
        there, and the places of its context and word among the words of those documents."""
        own = fold[self.doc] == WEIGHT_FOLD
        pairs, first, n = np.unique(self.pair_at[own], return_index=True, return_counts=True)
        words = np.unique(np.concatenate([self.context_at[own], self.word_at[own]]))
        places = [np.searchsorted(words, at[own][first]) for at in (self.context_at, self.word_at)]
        width = "<u2" if len(words) <= 1 << 16 else "<u4"
        return np.array([len(pairs), int(width[2:])], "<i8").tobytes() + b"".join(p.astype(width).tobytes() for p in places) + _small(n)

    def counts(self, fold: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, keys, counts in documents for counting, counts in documents for weights)."""
        own = fold[self.doc]
        main, weight = (own != HELD_OUT) & (own != WEIGHT_FOLD), own == WEIGHT_FOLD
        begin = np.searchsorted(self.words, _BEGIN)
        out = []
        for kind, keys, at in ((_WORD, self.words, self.word_at), (_PAIR, self.pairs, self.pair_at)):
            columns = [np.bincount(at[m], minlength=len(keys)).astype(np.int64) for m in (main, weight)]
            if kind == _WORD and begin < len(keys) and keys[begin] == _BEGIN:
                for c, m in zip(columns, (main, weight)):  # as a context only
                    c[begin] = np.count_nonzero(m & (self.context_at == begin))
            out.append((kind, keys, *columns))
        return out


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _packed_keys(kind: int, keys: np.ndarray) -> bytes:
    """Rising keys as bytes: for pairs five bytes per step where all steps allow, else eight per key."""
    if kind == _PAIR:
        steps = np.diff(keys >> np.uint64(8), prepend=np.uint64(0))
        if not (steps[1:] >> np.uint64(40)).any():
            return keys[:1].tobytes() + steps[1:].astype("<u4").tobytes() + (steps[1:] >> np.uint64(32)).astype(np.uint8).tobytes()
    return keys.tobytes()


def _unpacked_keys(data: bytes, n: int) -> np.ndarray:
    if len(data) == 8 * n:
        return np.frombuffer(data, np.uint64)
    steps = np.frombuffer(data, "<u4", n - 1, 8).astype(np.uint64) + (np.frombuffer(data, np.uint8, n - 1, 8 + 4 * (n - 1)).astype(np.uint64) << np.uint64(32))
    first = np.frombuffer(data, np.uint64, 1) >> np.uint64(8)
    return np.cumsum(np.concatenate([first, steps]), dtype=np.uint64) << np.uint64(8)


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes, the few above 254 kept aside at the end."""
    large = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def _from_small(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


def _referred(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of context and word, and count, of each pair in ``Block.references``."""
    n, width = (int(x) for x in np.frombuffer(data, "<i8", 2))
    context_at, word_at = np.frombuffer(data, f"<u{width}", 2 * n, 16).reshape(2, n).astype(np.int64)
    return context_at, word_at, _from_small(data[16 + 2 * n * width :], n)


def _blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Documents by block: by id and text, so that neither a repeated id nor a repeated text fills a block
    (rows that repeat both do share one) and both passes over the documents agree."""
    block = F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(blocks)).cast("int")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (id_crc() % FOLDS).cast("int").alias("fold"),
    ).withColumn("block", block)


def _asked(docs: DataFrame, ranges: int) -> DataFrame:
    def ask(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = table.column("block")[0].as_py()
        fold, own = _folds(table), Block.of(_texts(table))
        rows = [(_REFERENCES, -1, block, 0, own.references(fold), b"", b"")]
        for kind, keys, main, weight in own.counts(fold):
            bounds = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
            for r, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if b > a:
                    rows.append((kind, r, block, int(b - a), _packed_keys(kind, keys[a:b]), _small(main[a:b]), _small(weight[a:b])))
        return _rows(rows, _ASKED)

    return docs.groupBy("block").applyInArrow(ask, _ASKED)


_ASKED = "kind int, key_range int, block int, n int, keys binary, main binary, weight binary"
_ANSWER = "block int, kind int, key_range int, n int, n_learn int, counts binary, learn binary, tokens bigint, tokens_main bigint, types bigint, types_main bigint"
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array(list(c), _ARROW[k]) for n, k, c in zip(names, kinds, columns)})


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _texts(table: pa.Table) -> pa.Array:
    column = _in_order(table).column("text").combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _folds(table: pa.Table) -> np.ndarray:
    return _in_order(table).column("fold").to_numpy()


def _answered(asked: DataFrame) -> DataFrame:
    """Counts over all blocks for each key a block asked for, and totals of each key range (block -1).

    ``counts`` are of all training documents; ``learn`` are of the documents for counting, for keys that the
    block has in its documents for weights. References ride in ``learn``.
    """

    def answer(table: pa.Table) -> pa.Table:
        kind, key_range = table.column("kind")[0].as_py(), table.column("key_range")[0].as_py()
        sizes = table.column("n").to_pylist()
        if kind == _REFERENCES:  # pass on
            rows = zip(table.column("block").to_pylist(), table.column("keys").to_pylist())
            return _rows([(block, kind, key_range, 0, 0, b"", own, None, None, None, None) for block, own in rows], _ANSWER)
        keys = np.concatenate([_unpacked_keys(k.as_py(), n) for k, n in zip(table.column("keys"), sizes)])
        at, distinct = pd.factorize(keys)
        totals = []
        for name in ("main", "weight"):
            asked_counts = np.concatenate([_from_small(c.as_py(), n) for c, n in zip(table.column(name), sizes)])
            totals.append(np.bincount(at, weights=asked_counts, minlength=len(distinct)).astype(np.int64))
        learned = asked_counts > 0
        real = distinct != _BEGIN if kind == _WORD else np.ones(len(distinct), bool)
        both = totals[0] + totals[1]
        rows = [(-1, kind, key_range, 0, 0, b"", b"", int(both[real].sum()), int(totals[0][real].sum()), int((both[real] > 0).sum()), int((totals[0][real] > 0).sum()))]
        start = 0
        for block, n in zip(table.column("block").to_pylist(), sizes):
            own = at[start : start + n]
            learn = own[learned[start : start + n]]
            rows.append((block, kind, key_range, n, len(learn), _small(both[own]), _small(totals[0][learn]), None, None, None, None))
            start += n
        return _rows(rows, _ANSWER)

    # references have no key range: each block's go their own way
    group = F.when(F.col("kind") == _REFERENCES, F.col("block")).otherwise(F.lit(-1))
    return asked.groupBy("kind", "key_range", group).applyInArrow(answer, _ANSWER)


def _counts_of(answers: pa.Table, kind: int, n: str = "n", counts: str = "counts") -> np.ndarray:
    """Counts in key order, as asked by the block."""
    own = sorted((r for r in answers.select(["kind", "key_range", n, counts]).to_pylist() if r["kind"] == kind), key=lambda r: r["key_range"])
    return np.concatenate([_from_small(r[counts], r[n]) for r in own] or [np.zeros(0, np.int64)])


def context_level(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two of its count."""
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), CONTEXT_LEVELS - 1).astype(np.int64)


def _cell(p: np.ndarray) -> np.ndarray:
    """Logarithmic cell of a probability; 0 is for probability 0."""
    return np.where(p > 0, 1 + np.clip(np.rint(-np.log2(np.maximum(p, 1e-300)) * CELLS), 0, CELLS * DOUBLINGS - 1), 0).astype(np.int64)


def _cell_value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** (-(cell - 1) / CELLS), 0.0)


def fit_weights(events: np.ndarray, types: int, rounds: int = 100) -> np.ndarray:
    """Weights (pair, word, uniform) by context level, from rows of (level, pair cell, word cell, count).

    Each level starts from the weights of all levels together, with ten events' worth of them as a
    prior, so that a level without events has sensible ones.
    """
    flat = 1.0 / (types + 1)

    def climb(rows: np.ndarray, start: np.ndarray, prior: np.ndarray) -> np.ndarray:
        weights = start
        parts = np.column_stack([_cell_value(rows[:, 1]), _cell_value(rows[:, 2]), np.full(len(rows), flat)])
        for _ in range(rounds):
            shares = parts * weights
            shares /= shares.sum(1, keepdims=True)
            weights = (shares * rows[:, 3:4]).sum(0) + prior
            weights = weights / weights.sum()
        return weights

    even, out = np.full(3, 1 / 3), np.zeros((CONTEXT_LEVELS, 3))
    everything = climb(events, even, even * 3) if len(events) else even
    for level in range(CONTEXT_LEVELS):
        own = events[events[:, 0] == level]
        out[level] = climb(own, everything, everything * 10) if len(own) else everything
    out[0, 1:] += out[0, 0] * out[0, 1:] / out[0, 1:].sum()  # no pair was seen after an unseen context
    out[0, 0] = 0
    return out


def language_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    blocks = max(1, -(-text_bytes(docs) // block_bytes))
    dealt = _blocks(docs, blocks)
    answers = stored(_answered(_asked(dealt, blocks)), "counts")
    sums = answers.where((F.col("block") == -1) & (F.col("kind") == _WORD)).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "tokens_main", "types", "types_main")]
    ).first()
    own = answers.where("block >= 0").drop("tokens", "tokens_main", "types", "types_main")
    tokens_main, types_main = sums["tokens_main"], sums["types_main"]

    def learn(table: pa.Table) -> pa.Table:
        own = [r["learn"] for r in table.select(["kind", "learn"]).to_pylist() if r["kind"] == _REFERENCES]
        context_at, word_at, times = _referred(b"".join(own))
        word, both = _counts_of(table, _WORD, "n_learn", "learn"), _counts_of(table, _PAIR, "n_learn", "learn")
        context = word[context_at]
        cells = np.column_stack([context_level(context), _cell(both / np.maximum(context, 1)), _cell(word[word_at] / max(tokens_main, 1))])
        found, at = np.unique(cells, axis=0, return_inverse=True)
        n = np.bincount(at.reshape(-1), weights=times, minlength=len(found)).astype(np.int64)
        return _rows([(*map(int, c), int(k)) for c, k in zip(found, n)], "level int, pair int, word int, n bigint")

    events = own.select("block", "kind", "key_range", "n_learn", "learn").groupBy("block").applyInArrow(learn, "level int, pair int, word int, n bigint")
    # levels x pair cells x word cells at most, whatever the corpus
    gathered = events.groupBy("level", "pair", "word").agg(F.sum("n").alias("n")).orderBy("level", "pair", "word").collect()
    weights = fit_weights(np.array([tuple(r) for r in gathered], np.int64).reshape(-1, 4), types_main)
    total, types = sums["tokens"], sums["types"]
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def score(key, table: pa.Table, answered: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = Block.of(_texts(table))
        word, pair = _counts_of(answered, _WORD), _counts_of(answered, _PAIR)
        seen, context, both = word[block.word_at], word[block.context_at], pair[block.pair_at]
        w = weights[context_level(context)]
        p = w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * seen / max(total, 1) + w[:, 2] / (types + 1)
        per = lambda values: np.bincount(block.doc, weights=values, minlength=table.num_rows)
        ordered = _in_order(table)
        return pa.table({
            "doc_id": ordered.column("doc_id"), "held_out": pa.array(ordered.column("fold").to_numpy() == HELD_OUT),
            "n_tokens": pa.array(np.bincount(block.doc, minlength=table.num_rows), pa.int64()), "n_known": pa.array(per(seen > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(table.num_rows, total), pa.int64()),
            "base_score": pa.array(per(np.log10((seen + 0.1) / (total + 0.1 * (types + 1))))), "score": pa.array(per(np.log10(p))),
        })

    counts = own.where(F.col("kind") != _REFERENCES).select("block", "kind", "key_range", "n", "counts")
    return dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(score, schema)
