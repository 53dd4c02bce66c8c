"""Alignment of the tokens of two tokenizers over the same texts.

Both tokenizations of a text cover the same bytes. Where tokens of both end at one byte, the text is cut:
tokens between two cuts are a group, and every token of one side is linked with every token of the other
whose bytes share the group. Ends are intersected by galloping: the shorter list drives, and each of its
ends is looked for in the longer one by steps that double and then by halving, from where the last one was
found. The places of common ends slice both lists into groups, and the ranks of a token's first and last
group give the tokens it is linked with.

Both vocabularies have the property (checked when they are loaded) that no token goes on over a single
space between two characters that are not white space. So a text is cut at these spaces into chunks, each
chunk's ends include its own end, and equal chunks are encoded and aligned once per worker.

How many documents hold a pair of ids linked is counted over the whole corpus: each slice of some 8 MB of
text names each of its pairs once, with its number of documents; counts are added by pair and go back to
the slices. Texts are read once and are not moved: what is stored and shuffled are each document's
distinct chunks and each slice's chunk table.

Defined cases: null and empty texts, and texts that a tokenizer does not give back byte for byte, have no
tokens: zeros and an empty digest. Special tokens written in a text are plain text. Repeated rows and rows
that repeat an id count as documents of their own; a null doc_id is carried as it is.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.tables import stored
from ledgerlark.llm.words import slices

SLICE_BYTES = 8 << 20
#: An aligner forgets what it has learned beyond so many chunks or characters of chunks.
_CACHED_CHUNKS, _CACHED_CHARS = 200_000, 32 << 20
#: Pairs made at a time from one group.
_PAIRS = 1 << 20
#: Lanes of the shorter list that gallop side by side have so many ends each.
_LANE = 64
#: Everything that either tokenizer may take for white space counts; a chunk is only longer for it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUNS = re.compile(r"\s\s|\A\s|\s\Z")


def gallop(short: np.ndarray, long: np.ndarray, lane: int = _LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``short`` and in ``long`` of the values that both rising lists hold.

    The shorter list is dealt to lanes of ``lane`` values in a row, which advance together, one value at a time.
    """
    if not len(short) or not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.arange(0, len(short), lane)
    low = np.searchsorted(long, short[heads])  # where each lane begins
    place = np.empty(len(short), np.int64)
    end = len(long)
    for k in range(lane):
        own = heads + k
        live = own < len(short)
        if not live.all():
            heads, low, own = heads[live], low[live], own[live]
        if not len(own):
            break
        value = short[own]
        # steps of 1, 2, 4 ... until a value is not below the one looked for
        step, high = np.ones(len(own), np.int64), low.copy()
        todo = np.flatnonzero((high < end) & (long[np.minimum(high, end - 1)] < value))
        while len(todo):
            low[todo] = high[todo] + 1
            high[todo] = np.minimum(high[todo] + step[todo], end)
            step[todo] *= 2
            at = high[todo]
            todo = todo[(at < end) & (long[np.minimum(at, end - 1)] < value[todo])]
        # halving between the last two steps
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            below = long[middle] < value[todo]
            low[todo] = np.where(below, middle + 1, low[todo])
            high[todo] = np.where(below, high[todo], middle)
            todo = todo[low[todo] < high[todo]]
        place[own] = low
    hit = np.flatnonzero((place < end) & (long[np.minimum(place, end - 1)] == short))
    return hit, place[hit]


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ends in both lists."""
    if len(ends_a) <= len(ends_b):
        return gallop(ends_a, ends_b)
    in_b, in_a = gallop(ends_b, ends_a)
    return in_a, in_b


def group_bounds(common: np.ndarray) -> np.ndarray:
    """Bounds of groups in a list of tokens: a group ends with a common end."""
    return np.concatenate([[0], common + 1])


def overlap_ranges(bounds_a: np.ndarray, bounds_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A, the first token of B it is linked with and the one after the last."""
    size = np.diff(bounds_a)
    return np.repeat(bounds_b[:-1], size), np.repeat(bounds_b[1:], size)


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, ``a * base + b``, how often) of the pairs of ids of each group.

    Groups with very many pairs count equal ids first and are written a bounded number of pairs at a time.
    """
    many = np.diff(bounds_a) * np.diff(bounds_b)
    groups, keys, times = [], [], []
    small = many <= _PAIRS
    width = np.diff(bounds_b)
    owner = np.repeat(np.arange(len(many)), np.diff(bounds_a))
    tokens = np.flatnonzero(small[owner])
    if len(tokens):
        n = width[owner[tokens]]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(bounds_b[owner[tokens]] - (ends - n), n)
        groups.append(np.repeat(owner[tokens], n))
        keys.append(np.repeat(ids_a[tokens], n) * base + ids_b[at])
        times.append(np.ones(len(at), np.int64))
    for g in np.flatnonzero(~small):
        a, n_a = np.unique(ids_a[bounds_a[g] : bounds_a[g + 1]], return_counts=True)
        b, n_b = np.unique(ids_b[bounds_b[g] : bounds_b[g + 1]], return_counts=True)
        for i in range(0, len(a), max(1, _PAIRS // len(b))):
            part = slice(i, i + max(1, _PAIRS // len(b)))
            keys.append((a[part, None] * base + b).ravel())
            times.append((n_a[part, None] * n_b).ravel())
            groups.append(np.full(len(keys[-1]), g))
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(groups), np.concatenate(keys), np.concatenate(times)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: byte-level; a text is given a space in front."""

    def __init__(self, file: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(file)
        self._tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        self.size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = (self._tokenizer.id_to_token(i) for i in range(self.size))
        # special tokens never come out of a text
        self.tokens = [bytes(letters[c] for c in t) if t is not None and all(c in letters for c in t) else b"" for t in tokens]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]


class Pieces:
    """Tokenizer B: pieces with byte fallback; adds the space itself."""

    def __init__(self, file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._tokenizer = SentencePieceProcessor(model_file=file)
        self.size = self._tokenizer.get_piece_size()
        self.tokens = []
        for i in range(self.size):
            piece = self._tokenizer.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self._tokenizer.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self._tokenizer.encode(chunks, num_threads=1)


def _goes_on(token: bytes) -> bool:
    """Whether a token holds a space after a character that is no white space."""
    return re.search(r"\S ", token.decode(errors="replace")) is not None


class Aligner:
    """Chunks of texts, encoded by both tokenizers and aligned; results are kept by chunk in arrays."""

    def __init__(self, file_a: str, file_b: str) -> None:
        self.a, self.b = ByteLevel(file_a), Pieces(file_b)
        self.base = self.b.size
        if self.a.size * self.base >= 1 << 32:
            raise ValueError("pairs of ids must fit into 32 bits")
        self._by_chunk = not any(map(_goes_on, (*self.a.tokens, *self.b.tokens)))
        self._length_a, self._length_b = (np.array([len(t) for t in side.tokens], np.int64) for side in (self.a, self.b))
        # ids with each mark that may follow them
        numbers = [[str(i) for i in range(side.size)] for side in (self.a, self.b)]
        self._marked = pa.array([x + m for names, marks in zip(numbers, (",|", (",", ";", ""))) for m in marks for x in names])
        self._clear()

    def _clear(self) -> None:
        self._chars = 0
        self.place: dict[str, int] = {}
        self.text: list[str | None] = []
        #: tokens of A, tokens of B, groups, links
        self.sizes = np.zeros((0, 4), np.int64)
        self.bounds, self.keys, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        if not self._by_chunk:
            return [text]
        return _CUT.split(text) if _RUNS.search(text) else text.split(" ")

    def learn(self, texts: list[list[str]]) -> None:
        """Encode and align the chunks not met before."""
        if len(self.place) > _CACHED_CHUNKS or self._chars > _CACHED_CHARS:
            self._clear()
        new = list(dict.fromkeys(c for cut in texts for c in cut if c not in self.place))
        for i in range(0, len(new), 50_000):
            self._add(new[i : i + 50_000])

    def _add(self, chunks: list[str]) -> None:
        ids_a, ids_b = self.a.encode(chunks), self.b.encode(chunks)
        a, b = (np.array([t for own in ids for t in own], np.int64) for ids in (ids_a, ids_b))
        n_a, n_b = (np.array([len(own) for own in ids], np.int64) for ids in (ids_a, ids_b))
        whole = self._come_back(chunks, (ids_a, a, n_a), (ids_b, b, n_b))
        # a chunk that does not come back takes part in nothing
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)
        in_a, in_b = common_ends(np.cumsum(self._length_a[a]), np.cumsum(self._length_b[b]))
        bounds_a, bounds_b = group_bounds(in_a), group_bounds(in_b)
        chunk_of = np.repeat(np.arange(len(chunks)), n_a)[bounds_a[1:] - 1] if len(a) else np.zeros(0, np.int64)
        size_a, size_b = np.diff(bounds_a), np.diff(bounds_b)
        per = lambda values: np.bincount(chunk_of, weights=values, minlength=len(chunks)).astype(np.int64)
        sizes = np.column_stack([n_a, n_b, per(np.ones(len(size_a))), per(size_a * size_b)])
        # equal pairs of a chunk become one, with how often it is linked
        group, keys, times = linked_pairs(a, b, bounds_a, bounds_b, self.base)
        joined = chunk_of[group] * (self.a.size * self.base) + keys
        order = np.argsort(joined, kind="stable")
        joined, times = joined[order], times[order]
        first = np.flatnonzero(np.append(True, joined[1:] != joined[:-1])) if len(joined) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        chunk, keys = np.divmod(joined[first], self.a.size * self.base)
        texts = self._written(a, b, bounds_a, bounds_b, chunk_of, len(chunks))
        start = len(self.text)
        self._chars += sum(map(len, chunks))
        self.place.update(zip(chunks, range(start, start + len(chunks))))
        self.text.extend(t if ok else None for t, ok in zip(texts, whole.tolist()))
        self.sizes = np.concatenate([self.sizes, sizes])
        ends = self.bounds[-1] + np.cumsum(np.bincount(chunk, minlength=len(chunks)))
        self.bounds = np.concatenate([self.bounds, ends])
        self.keys, self.times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])

    def _come_back(self, chunks: list[str], *sides) -> np.ndarray:
        """Whether both sides give back the bytes of each chunk with its space."""
        true = [(" " + c).encode() for c in chunks]
        lengths = np.array([len(t) for t in true], np.int64)
        whole = np.ones(len(chunks), bool)
        for side, of, (ids, flat, n) in zip((self.a, self.b), (self._length_a, self._length_b), sides):
            sums = np.concatenate([[0], np.cumsum(of[flat])])
            ends = np.cumsum(n)
            same = sums[ends] - sums[ends - n] == lengths
            # bytes of all chunks at once; one by one only if something differs
            if not same.all() or b"".join(map(side.tokens.__getitem__, flat.tolist())) != b"".join(true):
                same &= np.array([b"".join(map(side.tokens.__getitem__, own)) == t for own, t in zip(ids, true)], bool)
            whole &= same
        return whole

    def _written(self, a: np.ndarray, b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray, chunk_of: np.ndarray, n: int) -> list[str]:
        """The groups of each chunk as text: ids and the mark after each, put in their order and joined."""
        size_a, size_b = np.diff(bounds_a), np.diff(bounds_b)
        group_a, group_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[bounds_a[1:] - 1] = last_b[bounds_b[1:] - 1] = True
        ends_chunk = np.append(chunk_of[1:] != chunk_of[:-1], True) if len(chunk_of) else np.zeros(0, bool)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + bounds_b[group_a]] = a + self.a.size * last_a
        code[np.arange(len(b)) + bounds_a[group_b + 1]] = 2 * self.a.size + b + self.b.size * (last_b.astype(np.int64) + (last_b & ends_chunk[group_b]))
        per = np.bincount(chunk_of, weights=size_a + size_b, minlength=n).astype(np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self._marked.take(pa.array(code))), "").to_pylist()


def worker_aligner(file_a: str, file_b: str) -> Aligner:
    """One aligner for each pair of files and Python worker."""
    kept = sys.modules.setdefault("_token_aligners", ModuleType("_token_aligners")).__dict__
    if (file_a, file_b) not in kept:
        kept[file_a, file_b] = Aligner(file_a, file_b)
    return kept[file_a, file_b]


def _ragged(bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``chosen`` lists, and how many each has."""
    n = bounds[chosen + 1] - bounds[chosen]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[chosen] - (ends - n), n), n


_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
#: Rows of documents have their distinct chunks and how often each occurs; the row of a slice has its pairs
#: (with documents of the slice that hold each) and, by chunk, places among the pairs and how often each is linked.
_ALIGNED = (
    "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "chunks binary, times binary, pairs binary, docs binary, chunk_sizes binary, chunk_pairs binary, chunk_times binary"
)
_BINARIES = ("chunks", "times", "pairs", "docs", "chunk_sizes", "chunk_pairs", "chunk_times")


def _small(values: np.ndarray) -> bytes:
    """Numbers as bytes where all are small, else as 32-bit; ``_numbers`` tells them apart by length."""
    return values.astype(np.uint8 if values.max(initial=0) < 256 else "<u4").tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else "<u4").astype(np.int64)


def aligned_slice(texts: list[str | None], aligner: Aligner) -> tuple[list[list], tuple[bytes, ...]]:
    """Columns of the rows of the documents of a slice, and the values of the slice's own row."""
    cuts = [aligner.chunks(t) if t else [] for t in texts]
    aligner.learn(cuts)
    codes = np.array([aligner.place[c] for cut in cuts for c in cut], np.int64)
    n = np.array([len(cut) for cut in cuts], np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    # a document with one chunk that does not come back has no tokens
    lost = np.zeros(len(texts), bool)
    bad = np.array([t is None for t in aligner.text], bool)
    lost[owner[bad[codes]]] = True
    digests = []
    for i, cut in enumerate(cuts):
        digests.append(hashlib.sha256(";".join([aligner.text[aligner.place[c]] for c in cut]).encode()).hexdigest() if cut and not lost[i] else "")
    codes, owner = codes[~lost[owner]], owner[~lost[owner]]
    totals = np.zeros((len(texts), 4), np.int64)
    for k in range(4):
        totals[:, k] = np.bincount(owner, weights=aligner.sizes[codes, k], minlength=len(texts))
    # distinct chunks of each document, numbered within the slice
    own, at = np.unique(codes, return_inverse=True)
    joined, times = np.unique(owner * max(1, len(own)) + at, return_counts=True)
    doc, chunk = np.divmod(joined, max(1, len(own)))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    chunks, often = [], []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        chunks.append(chunk[a:b].astype("<u4").tobytes())
        often.append(_small(times[a:b]))
    # pairs of the slice, and in how many of its documents each is linked
    entries, sizes = _ragged(aligner.bounds, own)
    pairs, pair_at = np.unique(aligner.keys[entries], return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    docs = np.zeros(len(pairs), np.int64)
    step = max(1, len(texts) * (1 << 22) // max(1, int(sizes[chunk].sum())))
    for i in range(0, len(texts), step):  # some documents at a time
        a, b = bounds[i], bounds[min(i + step, len(texts))]
        spread, k = _ragged(starts, chunk[a:b])
        held = np.unique(np.repeat(doc[a:b], k) * max(1, len(pairs)) + pair_at[spread])
        docs += np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
    table = (pairs.astype("<u4").tobytes(), docs.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), pair_at.astype("<u4").tobytes(), _small(aligner.times[entries]))
    return [*totals.T.tolist(), digests, chunks, often], table


def _aligned(docs: DataFrame, file_a: str | None, file_b: str | None, slice_bytes: int) -> DataFrame:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        aligner = worker_aligner(file_a or public_tokenizers.path("byte_bpe_50k.json"), file_b or public_tokenizers.path("piece_bpe_32k.model"))
        for part in slices(batches, size=slice_bytes):
            columns, table = aligned_slice(part.column("text").to_pylist(), aligner)
            n, block = part.num_rows, part.column("row")[0].as_py()
            doc_id = pa.concat_arrays([part.column("doc_id"), pa.nulls(1, pa.int64())])
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            values = [pa.array([*c, None], k) for c, k in zip(columns, kinds)]
            own = [pa.array([None] * n + [v], pa.binary()) for v in table]
            yield pa.RecordBatch.from_arrays([pa.array([block] * (n + 1), pa.int64()), doc_id, *values, *own], ["block", *_DOC, *_BINARIES])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(align, _ALIGNED)


def _pair_rows(aligned: DataFrame) -> DataFrame:
    """block, pair and n_docs of each pair of each slice."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "docs"))):
                keys = np.frombuffer(pairs, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), block)), pa.array(keys), pa.array(np.frombuffer(docs, "<u4").astype(np.int64))], ["block", "pair", "n_docs"]
                )

    return aligned.where("pairs is not null").select("block", "pairs", "docs").mapInArrow(unpack, "block bigint, pair bigint, n_docs bigint")


def _base(file_b: str | None) -> int:
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=file_b or public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()


def pair_counts(aligned: DataFrame, base: int) -> tuple[DataFrame, DataFrame]:
    """(block and pair rows with the number of documents over the corpus, highest number by id of A)."""
    rows = _pair_rows(aligned).repartition("pair")
    totals = rows.groupBy("pair").agg(F.sum("n_docs").alias("count"))
    tops = totals.groupBy(F.floor(F.col("pair") / base).alias("a")).agg(F.max("count").alias("top"))
    return rows.select("block", "pair").join(totals, "pair"), tops


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def aligned_documents(
    docs: DataFrame, file_a: str | None = None, file_b: str | None = None, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    aligned = stored(_aligned(docs, file_a, file_b, slice_bytes), "aligned")
    base = _base(file_b)
    counted, tops = pair_counts(aligned, base)
    # one row per id of A at most: the vocabulary bounds it
    answers = counted.join(F.broadcast(tops), F.floor(F.col("pair") / base) == F.col("a")).select("block", "pair", "count", (F.col("count") == F.col("top")).alias("best"))

    def sum_up(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.filter(pc.is_valid(table.column("pairs"))).to_pylist()[0]
        docs = table.filter(pc.is_null(table.column("pairs")))
        order = np.argsort(answers.column("pair").to_numpy())
        count, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy()[order]
        sizes = np.frombuffer(own["chunk_sizes"], "<u4").astype(np.int64)
        at = np.frombuffer(own["chunk_pairs"], "<u4").astype(np.int64)
        times = _numbers(own["chunk_times"], len(at))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        run = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[starts])
        chunk_sum, chunk_best = run(times * count[at]), run(times * best[at])
        sums = np.zeros((2, docs.num_rows), np.int64)
        for i, (chunks, often) in enumerate(zip(docs.column("chunks").to_pylist(), docs.column("times").to_pylist())):
            c = np.frombuffer(chunks, "<u4")
            t = _numbers(often, len(c))
            sums[:, i] = chunk_best[c] @ t, chunk_sum[c] @ t
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table({**{n: docs.column(n) for n in names}, "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": docs.column("groups_sha256")})

    return aligned.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sum_up, _RESULT)
