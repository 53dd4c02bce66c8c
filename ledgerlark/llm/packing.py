"""Packing of token pieces into fixed-length sequences by bin completion.

Texts are tokenised where they lie; only (id, length, checksum) rows go on. Documents longer than a
sequence are cut, the first piece taking what is left over. Full pieces are sequences of their own.
The others are dealt by hash into pools of bounded size, and each pool is packed in one task: around
the largest piece left, for each largest partner the fullest filling of any number of pieces is found by
exact sums over the counts of lengths, those with least waste tried first; a branch ends where its waste
exceeds what the best solution so far could afford. The first best solution is best-fit decreasing, and
the search stops at a lower bound or its node limit (two a sequence and 2,000), with four fillings a node.

Defined cases: null and empty texts are one token, the end mark; repeated rows are packed each for
itself; a null doc_id is carried as it is.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.tables import stored
from ledgerlark.llm.words import LEAN_SLICE_BYTES, slices

CAPACITY, END_ID = 1024, 2
POOL = 16_384
_CACHED_CHUNKS = 200_000
#: White space that would meet a chunk's own space, or has none before it.
_RUNS = re.compile(r"\s\s|\A\s|\s\Z")


class Encoder:
    """Token ids as little-endian bytes, by chunk between single spaces.

    In this byte-level vocabulary a token never spans the place before " x", so the ids of a text are
    those of its chunks, each with its leading space; frequent chunks come from a bounded cache. Texts
    with runs of white space around a chunk's ends are encoded whole.
    """

    def __init__(self, file: str | None) -> None:
        import base64
        from pathlib import Path

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        file = file or public_tokenizers.path("byte_bpe_50k.json")
        self._tokenizer = Tokenizer.from_file(file)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._first: dict[str, bytes] = {}
        self._inner: dict[str, bytes] = {}
        # the same vocabulary as ranks is three times as fast for chunks without special tokens
        ranks = Path(file).with_suffix(".tiktoken")
        self._plain = None
        if ranks.exists():
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            self._plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        if self._plain is None:
            yield from zip(chunks, self._encode(chunks))
            return
        marked = [c for c in chunks if any(s in c for s in self._special)]
        yield from zip(marked, self._encode(marked))
        encode, odd = self._plain.encode_ordinary, set(marked)
        for c in chunks:
            if c not in odd:
                yield c, array("I", encode(c)).tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        first, inner = self._first, self._inner
        if len(first) + len(inner) > _CACHED_CHUNKS:
            first.clear()
            inner.clear()
        cut = [None if _RUNS.search(t) else t.split(" ") for t in texts]
        heads = {c[0] for c in cut if c is not None}.difference(first)
        tails = set(chain.from_iterable(c[1:] for c in cut if c is not None)).difference(inner)
        first.update(self._chunks(list(heads)))
        inner.update((c[1:], ids) for c, ids in self._chunks([" " + c for c in tails]))
        whole = iter(self._encode([t for t, c in zip(texts, cut) if c is None]))
        for chunks in cut:
            yield next(whole) if chunks is None else first[chunks[0]] + b"".join(map(inner.__getitem__, chunks[1:]))


def worker_encoder(file: str | None) -> Encoder:
    """One encoder for each file and Python worker, so that later tasks find its cache filled."""
    kept = sys.modules.setdefault("_token_encoders", ModuleType("_token_encoders")).__dict__
    if file not in kept:
        kept[file] = Encoder(file)
    return kept[file]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, end = worker_encoder(tokenizer_file), np.array([END_ID], "<u4").tobytes()
        for part in slices(batches, size=LEAN_SLICE_BYTES):
            rows: list[tuple[int, int, int, int, int]] = []
            texts = [t or "" for t in part.column("text").to_pylist()]
            for line, ids in enumerate(encoder(texts)):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((line, piece, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])))
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *(pa.array(c) for c in columns[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest sequence that still takes it."""
    open_bins: dict[int, list[int]] = defaultdict(list)
    free: list[int] = []
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        i = bisect_right(free, n - 1)
        if i == len(free):
            bins.append([n])
            at, room = len(bins) - 1, capacity - n
        else:
            room = free[i]
            at = open_bins[room].pop()
            if not open_bins[room]:
                free.pop(i)
            bins[at].append(n)
            room -= n
        if room:
            if not open_bins[room]:
                free.insert(bisect_right(free, room), room)
            open_bins[room].append(at)
    return bins


def fillings(counts: np.ndarray, room: int, afford: int, width: int = 4) -> list[tuple[int, ...]]:
    """The ``width`` fillings of ``room`` from ``counts`` (pieces by length) with least waste.

    One piece that fits exactly dominates all else. Of one piece only the largest counts, of two the
    largest partner of each; a pair must beat the single piece and every pair with a larger partner.
    Where these waste more than ``afford``, fillings of any number of pieces are compared, the fullest
    for each largest piece. The emptiest is the largest single piece.
    """
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [()]
    single = int(have[-1])
    if single == room:
        return [(single,)]
    found: list[tuple[int, tuple[int, ...]]] = [(room - single, (single,))]
    # two pieces
    partner = np.searchsorted(have, room - have, "right") - 1
    ok = (partner >= 0) & (have[partner] <= have)
    own = ok & (have[partner] == have) & (counts[have] < 2)
    partner = np.where(own, partner - 1, partner)
    ok &= partner >= 0
    a, b = have[ok][::-1], have[partner[ok]][::-1]
    if len(a):
        rising = b > np.concatenate([[0], np.maximum.accumulate(b)[:-1]])
        better = rising & (a + b > single)
        found += [(room - int(x) - int(y), (int(x), int(y))) for x, y in zip(a[better], b[better])]
    best = min(found)[0]
    if best > afford:  # more pieces, only where two waste too much
        found += [f for f in fullest(have.tolist(), counts[have].tolist(), room, width) if f[0] < best]
    found.sort(key=lambda f: (f[0], -f[1][0]))
    return [f for _, f in found[:width]]


def fullest(have: list[int], counts: list[int], room: int, width: int) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, pieces) of the fullest filling for each largest piece, the ``width`` of least waste.

    ``have`` are lengths in rising order. The sums that the smallest lengths reach are the bits of one
    number for each length, so that a sum is taken apart again from its largest piece down.
    """
    reach, sums, ends = 1, [1], []
    for i, (n, c) in enumerate(zip(have, counts)):
        more, step, left = reach, 1, min(c, room // n) - 1
        while left > 0:
            step = min(step, left)
            more |= more << step * n
            left -= step
            step *= 2
        more &= (2 << room - n) - 1
        ends.append((room - n - (more.bit_length() - 1), -n, i))
        reach |= more << n
        sums.append(reach)
    found = []
    for waste, _, i in sorted(ends)[:width]:
        pieces, left, own = [have[i]], room - waste - have[i], counts[i] - 1
        while left:
            n = have[i]
            k = min(own, left // n)
            while not sums[i] >> left - k * n & 1:
                k -= 1
            pieces += [n] * k
            left -= k * n
            i -= 1
            own = counts[i]
        found.append((waste, tuple(pieces)))
    return found


def least_sequences(lengths: list[int], capacity: int) -> int:
    """Lower bound: pieces above half a sequence never share one, and the room they leave for pieces of
    at least k is limited; nor do more pieces of at least k than fit share one; the best over all k."""
    counts = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)
    number, weight = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half, k = capacity // 2, np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[half]
    middle, middle_weight = number[capacity - k] - number[half], weight[capacity - k] - weight[half]
    small_weight = weight[half] - weight[k - 1]
    over = np.maximum(0, -(-(small_weight - (middle * capacity - middle_weight)) // capacity))
    sizes = np.arange(1, capacity + 1)
    crowd = -(-(number[-1] - number[sizes - 1]) // (capacity // sizes))
    return int(max(-(-weight[-1] // capacity), large + over.max(), crowd.max()))


def bin_completion(lengths: list[int], capacity: int = CAPACITY, extra_nodes: int = 2_000) -> list[list[int]]:
    """Sequences as lists of piece lengths; never more than best-fit decreasing needs."""
    total = sum(lengths)
    bound = least_sequences(lengths, capacity)
    best = best_fit(lengths, capacity)
    counts = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)
    nodes = 2 * len(best) + extra_nodes
    # one level per sequence: the filling in use, the alternatives left, the waste before it
    path: list[tuple[list[int], list[tuple[int, ...]], int]] = []
    waste = 0
    largest = capacity

    def undo() -> bool:
        """Back to the last level with an alternative."""
        nonlocal waste, largest
        while path:
            used, left, before = path.pop()
            for n in used:
                counts[n] += 1
            largest = capacity
            if left:
                place(used[0], left, before)
                return True
        return False

    def place(first: int, choices: list[tuple[int, ...]], before: int) -> None:
        nonlocal waste
        used = [first, *choices[0]]
        for n in used:
            counts[n] -= 1
        path.append((used, choices[1:], before))
        waste = before + capacity - sum(used)

    while len(best) > bound and nodes > 0:
        nodes -= 1
        afford = (len(best) - 1) * capacity - total  # waste of a solution with one sequence less
        while largest and not counts[largest]:
            largest -= 1
        if not largest:
            # the waste of the last sequence decides nothing: what counts is their number
            if len(path) < len(best):
                best = [list(used) for used, _, _ in path]
            if len(best) <= bound or not undo():
                break
            continue
        if waste > afford:
            if not undo():
                break
            continue
        counts[largest] -= 1
        choices = fillings(counts, capacity - largest, 0)
        counts[largest] += 1
        place(largest, choices, waste)
    return best


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    Sequences of full pieces have negative numbers; the others carry the pool in the upper bits.
    """
    pieces = stored(token_pieces(docs, capacity, tokenizer_file), "pieces")
    short = pieces.where(F.col("length") < capacity)
    pools = -(-short.count() // POOL) or 1
    full = pieces.where(F.col("length") == capacity).select("*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    kinds = full.schema

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        lengths = table.column("length").to_numpy()
        at = np.searchsorted(lengths, np.arange(capacity + 2))  # where the pieces of each length begin
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for i, used in enumerate(bin_completion(lengths.tolist(), capacity)):
            place = 0
            for n in used:
                sequence[at[n]], offset[at[n]] = i, place
                at[n] += 1
                place += n
        pool = table.column("pool")[0].as_py()
        return table.drop_columns(["pool"]).append_column("sequence_id", pa.array(sequence + (pool << 32))).append_column("offset", pa.array(offset))

    # a position in the stored table spreads rows that repeat an id as well
    pool = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(pools)).cast("bigint")
    rest = short.withColumn("pool", pool).groupBy("pool").applyInArrow(pack, kinds)
    return full.unionByName(rest)
