"""A compressed full-text index over sequences of symbols, for runs up to a fixed length.

The Burrows-Wheeler transform of the text is kept as a wavelet tree in matrix form: one packed bit vector
per bit of a symbol, with counts of ones per 64 bits. Neither the text nor its suffix array stays. Rows are
sorted by their first ``depth`` symbols only, which is all that runs up to that length can see, and two
more bit vectors mark where the rows' first ``depth - 1`` and ``depth`` symbols change.

``matching_statistics`` walks many sequences from their ends at once. Each step is one backward
extension; a match that has reached ``depth`` symbols gives up its last one by the first of those vectors,
and one that cannot be extended starts anew without its last symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Bits:
    """A packed bit vector that counts its ones before any place."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        before = np.zeros(len(words), np.int32)
        np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int32, out=before[1:])
        return cls(words, before)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


def _sorted_pairs(rank: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of (rank, rank ``ahead`` places later; 0 beyond the end), and whether each differs from the one before."""
    n = len(rank)
    base = int(rank.max(initial=0)) + 1
    later = np.zeros_like(rank)
    if ahead < n:
        later[: n - ahead] = rank[ahead:]
    keys = rank.astype(np.uint64) * np.uint64(base) + later.astype(np.uint64)
    bits = np.uint64(max(1, n).bit_length())
    if (base * base).bit_length() + int(bits) <= 64:  # the place rides along, which sorts faster
        keys = (keys << bits) | np.arange(n, dtype=np.uint64)
        keys.sort()
        order = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        keys >>= bits
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    return order, new


class FMIndex:
    """Index of ``text``, an array of symbols from 0 up; sequences end in symbol 0, which nothing matches."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        if depth < 2:
            raise ValueError("depth must be at least 2")
        self.depth, self.size = depth, len(text)
        rank, reach = text.astype(np.int64) + 1, 1
        while reach * 2 < depth:  # ranks by the first 2, 4, 8 ... symbols
            order, new = _sorted_pairs(rank, reach)
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(new)
            reach *= 2
        order, new = _sorted_pairs(rank, depth - reach)
        # where the first depth - 1 symbols change as well
        padded = np.append(rank, np.zeros(reach, np.int64))
        a, b = order[1:], order[:-1]
        changes = np.ones(len(order), bool)
        changes[1:] = (rank[a] != rank[b]) | (padded[a + depth - 1 - reach] != padded[b + depth - 1 - reach])
        self.order = order
        self.groups = Bits.of(new)
        self._outer_at = np.append(np.flatnonzero(changes), len(order)).astype(np.int32)
        self._outer = Bits.of(changes)
        self._tree(text[order - 1])
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 1)
        self._first = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def _tree(self, symbols: np.ndarray) -> None:
        self._levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, int(symbols.max(initial=0)).bit_length()) - 1, -1, -1):
            bit = (symbols >> level) & 1
            zeros = int(len(bit) - np.count_nonzero(bit))
            self._levels.append((level, Bits.of(bit), zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    @property
    def starts(self) -> np.ndarray:
        """Where each group of rows with the same first ``depth`` symbols begins; ``order`` is dropped by ``pack``."""
        return np.flatnonzero(np.unpackbits(self.groups.words.view(np.uint8), bitorder="little")[: self.size])

    def pack(self) -> FMIndex:
        """Forget the order of the suffixes, which was needed to say what each group stands for."""
        del self.order
        return self

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with ``symbol`` and go on as the rows from ``low`` to before ``high`` do."""
        start, at = np.zeros_like(low), np.concatenate([low, high])
        both = np.concatenate([symbol, symbol])
        for level, bits, zeros in self._levels:
            one = ((symbol >> level) & 1).astype(bool)
            ones = bits.ones(start)
            start = np.where(one, zeros + ones, start - ones)
            one = ((both >> level) & 1).astype(bool)
            ones = bits.ones(at)
            at = np.where(one, zeros + ones, at - ones)
        base = self._first[symbol] - start
        return base + at[: len(low)], base + at[len(low) :]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows with the first ``depth - 1`` symbols of the row ``low``."""
        group = self._outer.ones(low + 1)
        return self._outer_at[group - 1].astype(np.int64), self._outer_at[group].astype(np.int64)

    def matching_statistics(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the sequences ``flat[starts[i]:starts[i + 1]]``: the length of the longest run
        from there that the text holds (``depth`` at most), and the group of that run where it has full length
        (else -1). Symbols that the text lacks match nothing."""
        length, group = np.zeros(len(flat), np.int64), np.full(len(flat), -1, np.int64)
        place, stop = starts[1:] - 1, starts[:-1]
        going = np.flatnonzero(place >= stop)
        place, stop = place[going], stop[going]
        low, high, done = np.zeros_like(place), np.full_like(place, self.size), np.zeros_like(place)
        while len(place):
            full = np.flatnonzero(done == self.depth)
            if len(full):
                low[full], high[full] = self.shorten(low[full])
                done[full] -= 1
            symbol = flat[place]
            known = (symbol > 0) & (symbol < len(self._first))
            low2, high2 = self.extend(np.where(known, symbol, 0), low, high)
            fits = known & (low2 < high2)
            low, high = np.where(fits, low2, 0), np.where(fits, high2, self.size)
            # a match of one symbol or none begins again here or one place on; a longer one loses its last symbol
            again = np.where(done > 0, place + done - 1, place - 1)
            done = np.where(fits, done + 1, 0)
            hit = place[fits]
            length[hit] = np.maximum(length[hit], done[fits])
            whole = fits & (done == self.depth)
            group[place[whole]] = self.groups.ones(low[whole] + 1) - 1
            place = np.where(fits, place - 1, again)
            going = place >= stop
            if not going.all():
                place, stop, low, high, done = (x[going] for x in (place, stop, low, high, done))
        return length, group
