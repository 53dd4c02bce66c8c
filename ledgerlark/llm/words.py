"""Words of whole texts as arrays: the shared first step of the operators that read documents.

A word is a run of characters other than the space and U+0009 to U+000D. Arrow splits and encodes a
slice of texts at once; no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Text at once where arrays per word are made: a worker lives on after its task and keeps the memory of its largest slice.
LEAN_SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Words:
    """``codes[starts[i]:starts[i + 1]]`` are the words of text i, as places in ``vocabulary``."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the vocabulary."""
        names = self.vocabulary.to_numpy(zero_copy_only=False)
        return pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with about ``size`` bytes of text (one long text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
        group = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def compact(texts: pa.Array) -> pa.Array:
    """Nulls as empty texts, in a buffer of its own that starts at the first text.

    Kernels on 64-bit offsets misread slices that share the buffer of a whole batch.
    """
    texts = pc.fill_null(texts, "").cast(pa.string())
    return texts.take(pa.array(np.arange(len(texts))))


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words of each text, A to Z in lower case if ``lower``; a null text has none."""
    texts = compact(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.filter(real).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[ends].astype(np.int64), coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for the values at equal places of ``parts``; order matters."""
    h = mix(parts[0] + np.uint64(0x9E3779B97F4A7C15))
    for p in parts[1:]:
        h = mix(h * np.uint64(3) + p)
    return h


def run_hashes(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``size`` words inside a text."""
    h = hashes[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = words.owner
    inside = owner[:n] == owner[size - 1 :]
    return owner[:n][inside], chain([h[i : n + i] for i in range(size)])[inside]
