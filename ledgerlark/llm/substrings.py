"""Removal of repeated passages: every run of words that an earlier document holds as well.

A window is ``SIZE`` words in a row of one document. A word goes if a window covers it whose words, in
order, also begin somewhere in a document with a smaller id. What is found does not depend on what is
removed elsewhere.

An index of all texts cannot be asked by all texts at once, so both are cut by content. Each window has a
mark, the least hash of its runs of five words; windows in a row with the same mark form a stretch. Equal
windows have equal marks, so what shares no mark shares no window. Only stretches whose mark occurs in two
documents travel, as text, each distinct one once per block of documents, to the shard of the mark. There
a compressed FM-index of the shard's stretches is built and the stretches are streamed through it:
backward search gives the matching statistics of each place, and each match of full length the least
document that holds it. Where that is smaller than some holder, the window's hash goes back to the block.

A mark with more than ``BUSY`` stretches (a passage that very many documents quote, each in its own
surroundings) sends its windows one by one to the shards of their own hashes; so no passage fills a shard.
Documents are dealt to blocks once, by a hash of id and row; the passes over the blocks share that shuffle.
Per mark, stretch or window there is at most one row per block.

Equality of windows is decided on their words; 64-bit hashes only name what is equal within one block of
some 8 MB (one mistake per billion blocks).

Defined cases: null, empty and short texts have no window; ids may repeat, and rows with one id never
remove each other's words; a null id counts as larger than all others; kept words are joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.fm_index import FMIndex
from ledgerlark.llm.tables import text_bytes
from ledgerlark.llm.words import Words, mix, slices, split_words

SIZE = 13
MARK_WORDS = 5
BUSY = 2048
BLOCK_BYTES = 8 << 20
#: Windows of a stretch at most; longer runs of one mark are cut.
STRETCH = 64
_NO_ID = np.iinfo(np.int64).max
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Runs:
    """Hashes of runs of words in a list of texts; equal runs have equal hashes in every list."""

    def __init__(self, words: Words, hashes: np.ndarray) -> None:
        self.words = words
        h = hashes[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_STEP, len(h)), dtype=np.uint64)])
        self._back = _powers(_BACK, len(h) + 1)

    def hash(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self._sums[start + length] - self._sums[start]) * self._back[start] + np.asarray(length).astype(np.uint64))

    def begins(self, size: int) -> np.ndarray:
        """Where runs of ``size`` words inside one text begin."""
        n, owner = len(self.words.codes) - size + 1, self.words.owner
        return np.flatnonzero(owner[:n] == owner[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def texts(self, start: np.ndarray, length: np.ndarray) -> pa.Array:
        """The words of runs, joined by spaces."""
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
        values = self.words.vocabulary.take(pa.array(self.words.codes[at]))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, values), " ")


def stretches(runs: Runs, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words, mark) of each stretch of windows with one mark."""
    begin = runs.begins(size)
    if not len(begin):
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    inner = min(MARK_WORDS, size)
    own = runs.hash(np.arange(len(runs.words.codes) - inner + 1), inner)
    mark = own[begin]
    for k in range(1, size - inner + 1):
        np.minimum(mark, own[begin + k], out=mark)
    owner = runs.words.owner[begin]
    new = np.ones(len(begin), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    new[(np.arange(len(begin)) - np.repeat(first, np.diff(np.append(first, len(begin))))) % STRETCH == 0] = True
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(begin)))
    return owner[first], begin[first], windows + size - 1, mark[first]


class Block:
    """The documents of a block in a fixed order, and the runs of their words."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("row").combine_chunks()
        self.row = table.column("row")
        self.doc_id = table.column("doc_id")
        self.name = pc.fill_null(self.doc_id, _NO_ID).to_numpy()
        parts = [split_words(b.column("text"), lower=False) for b in slices(iter(table.to_batches()))]
        self.words = _joined(parts)
        self.runs = Runs(self.words, self.words.hashes())


def _joined(parts: list[Words]) -> Words:
    """Word lists one after another, with one vocabulary."""
    if not parts:
        return Words(np.zeros(0, np.int64), np.zeros(1, np.int64), pa.array([], pa.string()))
    if len(parts) == 1:
        return parts[0]
    names = pa.chunked_array([p.vocabulary for p in parts]).combine_chunks().dictionary_encode()
    to = names.indices.to_numpy().astype(np.int64)
    at = np.cumsum([0, *(len(p.vocabulary) for p in parts)])
    starts, size = [np.zeros(1, np.int64)], 0
    for p in parts:
        starts.append(p.starts[1:] + size)
        size += len(p.codes)
    return Words(np.concatenate([to[at[i] + p.codes] for i, p in enumerate(parts)]), np.concatenate(starts), names.dictionary)


def _distinct(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first of each distinct key, least ``low``, greatest ``high``)."""
    code, names = pd.factorize(keys)
    first = np.zeros(len(names), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    least, most = np.full(len(names), _NO_ID), np.full(len(names), np.iinfo(np.int64).min)
    np.minimum.at(least, code, low)
    np.maximum.at(most, code, high)
    return first, least, most


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    blocks = max(1, -(-text_bytes(docs) // block_bytes))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("int")), blocks


_MARKS = "block int, mark bigint, low bigint, high bigint, n bigint"
_SENT = "shard bigint, block int, words string, low bigint, high bigint"
_FOUND = "block int, hashes binary, lows binary"


def _marks(dealt: DataFrame, size: int) -> DataFrame:
    """Each mark of each block, with the least and greatest document and the number of distinct stretches."""

    def gather(table: pa.Table) -> pa.Table:
        block = Block(table)
        owner, start, length, mark = stretches(block.runs, size)
        names = block.name[owner]
        first, low, high = _distinct(block.runs.hash(start, length), names, names)
        code, marks = pd.factorize(mark[first])
        least, most = np.full(len(marks), _NO_ID), np.full(len(marks), np.iinfo(np.int64).min)
        np.minimum.at(least, code, low)
        np.maximum.at(most, code, high)
        n = len(marks)
        return pa.table({
            "block": pa.array(np.full(n, table.column("block")[0].as_py()), pa.int32()), "mark": pa.array(marks.view(np.int64)),
            "low": pa.array(least), "high": pa.array(most), "n": pa.array(np.bincount(code, minlength=n).astype(np.int64)),
        })

    return dealt.groupBy("block").applyInArrow(gather, _MARKS)


def _sent(dealt: DataFrame, shared: DataFrame, size: int, shards: int) -> DataFrame:
    """Distinct stretches of each block whose mark two documents share, with their shard; windows of busy marks."""

    def send(key, table: pa.Table, marks: pa.Table) -> pa.Table:
        block = Block(table) if table.num_rows else None
        if block is None or not marks.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "words": pa.array([], pa.string()), "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64())})
        owner, start, length, mark = stretches(block.runs, size)
        known = marks.column("mark").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, busy = known[order], marks.column("busy").to_numpy()[order]
        at = np.minimum(np.searchsorted(known, mark), len(known) - 1)
        wanted = known[at] == mark
        owner, start, length, mark, busy = owner[wanted], start[wanted], length[wanted], mark[wanted], busy[at[wanted]]
        # windows of busy marks stand for themselves
        many = length[busy] - size + 1
        ends = np.cumsum(many)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
        single = np.repeat(start[busy], many) + inside
        owner = np.concatenate([owner[~busy], np.repeat(owner[busy], many)])
        start = np.concatenate([start[~busy], single])
        length = np.concatenate([length[~busy], np.full(len(single), size)])
        whole = block.runs.hash(start, length)
        route = np.concatenate([mark[~busy], whole[len(whole) - len(single) :]])
        names = block.name[owner]
        # a window alone and a stretch of one window may be equal words on two routes
        first, low, high = _distinct(mix(whole) ^ route, names, names)
        n = len(first)
        return pa.table({
            "shard": pa.array((mix(route[first]) % np.uint64(shards)).astype(np.int64)), "block": pa.array(np.full(n, table.column("block")[0].as_py()), pa.int32()),
            "words": block.runs.texts(start[first], length[first]), "low": pa.array(low), "high": pa.array(high),
        })

    return dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, _SENT)


def shard_matches(texts: pa.Array, low: np.ndarray, size: int) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """(runs, distinct text of each, and for each place of the distinct texts the least document with its window).

    ``low`` is the least document of each text; places without a window have ``_NO_ID``.
    """
    coded = texts.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    least = np.full(len(coded.dictionary), _NO_ID)
    np.minimum.at(least, code, low)
    words = split_words(coded.dictionary, lower=False)
    # each text, then the mark of its end
    n = len(words.codes) + len(words.counts)
    owner = np.repeat(np.arange(len(words.counts)), words.counts + 1)
    symbols = np.zeros(n, np.int64)
    symbols[np.arange(len(words.codes)) + words.owner] = words.codes + 1
    index = FMIndex(symbols, size)
    held = np.minimum.reduceat(least[owner[index.order]], index.starts) if n else least
    index.pack()
    _, group = index.matching_statistics(words.codes + 1, words.starts)
    return Runs(words, words.hashes()), code, words.starts, np.where(group >= 0, held[group], _NO_ID)


def _found(sent: DataFrame, size: int) -> DataFrame:
    """Per shard and block: hashes of windows that a smaller document holds, with that document."""

    def match(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table.column("words").combine_chunks()
        texts = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
        runs, code, starts, held = shard_matches(texts, low, size)
        # windows of each sent text
        many = np.diff(starts)[code]
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[code] - (ends - many), many)
        keep = held[at] < np.repeat(high, many)
        at, to = at[keep], np.repeat(block, many)[keep]
        keys = runs.hash(at, size) if len(at) else np.zeros(0, np.uint64)
        order = np.lexsort((keys, to))
        keys, to, lows = keys[order], to[order], held[at][order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (to[1:] != to[:-1])
        keys, to, lows = keys[new], to[new], lows[new]
        bounds = [*np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist(), len(to)] if len(to) else [0]
        parts = list(zip(bounds, bounds[1:]))
        return pa.table({
            "block": pa.array([int(to[a]) for a, _ in parts], pa.int32()), "hashes": pa.array([keys[a:b].tobytes() for a, b in parts], pa.binary()),
            "lows": pa.array([lows[a:b].tobytes() for a, b in parts], pa.binary()),
        })

    return sent.groupBy("shard").applyInArrow(match, _FOUND)


def covered_words(block: Block, found: pa.Table, size: int) -> np.ndarray:
    """Whether each word of the block's documents goes."""
    gone = np.zeros(len(block.words.codes) + 1, np.int64)
    begin = block.runs.begins(size)
    if found.num_rows and len(begin):
        keys = np.concatenate([np.frombuffer(k.as_py(), np.uint64) for k in found.column("hashes")])
        lows = np.concatenate([np.frombuffer(k.as_py(), np.int64) for k in found.column("lows")])
        order = np.argsort(keys)
        keys, lows = keys[order], lows[order]
        own = block.runs.hash(begin, size)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = begin[(keys[at] == own) & (lows[at] < block.name[block.words.owner[begin]])]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + size, -1)
    return np.cumsum(gone)[:-1] > 0


_SPANS = "doc_id bigint, row bigint, begin bigint, end bigint"


def _with_spans(docs: DataFrame, size: int, block_bytes: int, busy: int, finish, schema: str) -> DataFrame:
    """Apply ``finish(block, gone)`` to each block of documents and the verdicts on its words."""
    dealt, blocks = _blocks(docs, block_bytes)
    # one row per mark and block, so a window has no more rows than there are blocks
    of = Window.partitionBy("mark")
    marks = _marks(dealt, size).select("block", "mark", F.min("low").over(of).alias("least"), F.max("high").over(of).alias("most"), F.sum("n").over(of).alias("all"))
    shared = marks.where("least < most").select("block", "mark", (F.col("all") > busy).alias("busy"))
    found = _found(_sent(dealt, shared, size, blocks), size)

    def end(key, table: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(table)
        return finish(block, covered_words(block, found, size))

    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(end, schema)


def repeated_spans(docs: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES, busy: int = BUSY) -> DataFrame:
    """doc_id, row (a number of the row), begin and end of each longest run of words that goes, by place among the words."""

    def spans(block: Block, gone: np.ndarray) -> pa.Table:
        owner = block.words.owner
        edge = np.ones(len(gone) + 1, bool)
        edge[1:-1] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(edge)
        begin, end = at[:-1], at[1:]
        begin, end = begin[gone[begin]], end[gone[begin]]
        own, base = owner[begin], block.words.starts[owner[begin]]
        place = pa.array(own)
        return pa.table({"doc_id": block.doc_id.take(place), "row": block.row.take(place), "begin": pa.array(begin - base), "end": pa.array(end - base)})

    return _with_spans(docs, size, block_bytes, busy, spans, _SPANS)


def _kept_texts(block: Block, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[str]]:
    words = block.words
    per = np.bincount(words.owner[gone], minlength=len(words.counts)).astype(np.int64)
    left = words.counts - per
    offsets = np.concatenate([[0], np.cumsum(left)])
    codes = words.codes[~gone]

    def texts() -> Iterator[str]:
        for a in range(0, len(left), 512):  # a few texts at a time
            b = min(a + 512, len(left))
            values = words.vocabulary.take(pa.array(codes[offsets[a] : offsets[b]]))
            lists = pa.LargeListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a]), values)
            yield from pc.binary_join(lists, " ").to_pylist()

    return words.counts, per, texts()


def without_repeats(docs: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES, busy: int = BUSY) -> DataFrame:
    """doc_id and the text left of each row: kept words joined by one space."""

    def texts(block: Block, gone: np.ndarray) -> pa.Table:
        return pa.table({"doc_id": block.doc_id, "text": pa.array(list(_kept_texts(block, gone)[2]), pa.string())})

    return _with_spans(docs, size, block_bytes, busy, texts, "doc_id bigint, text string")


def repeat_digests(docs: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES, busy: int = BUSY) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""

    def digest(block: Block, gone: np.ndarray) -> pa.Table:
        n, removed, texts = _kept_texts(block, gone)
        return pa.table({
            "doc_id": block.doc_id, "n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array(removed),
            "kept_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
        })

    return _with_spans(docs, size, block_bytes, busy, digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
