"""Counts over each whole text, from which the quality rules and the quality classifier derive shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.tables import text_key
from ledgerlark.llm.words import LEAN_SLICE_BYTES, chain, compact, run_hashes, slices, split_words

_CLASSES = {"n_symbols": "#*$%&|<>", "n_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_digits": "0123456789", "n_marks": "!?.,;:"}
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text", "n_upper", "n_digits", "n_marks",
    "n_lines", "n_distinct", "n_top_word", "n_same_as_last", "n_short", "n_long", "n_line_ends",
)


def _repeats(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each (owner, value) pair occurs, at the place of each."""
    code, _ = pd.factorize(chain([owner.astype(np.uint64), value.astype(np.uint64)]))
    return np.bincount(code)[code] if len(code) else np.zeros(0, np.int64)


def _later_equal(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether an equal value came earlier for the same owner."""
    return pd.Series(chain([owner.astype(np.uint64), value.astype(np.uint64)])).duplicated().to_numpy()


def _class_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Characters of each class in ``_CLASSES``, all of them one byte in UTF-8; ``texts`` are compact."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    found = {}
    for name, members in _CLASSES.items():
        among = np.zeros(256, bool)
        among[np.frombuffer(members.encode(), np.uint8)] = True
        places = np.flatnonzero(among[raw])
        found[name] = np.diff(np.searchsorted(places, ends))
    return found


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """``COUNTS`` of each text; all zero for a null text."""
    n = len(texts)
    texts = compact(texts)
    words = split_words(texts, lower=False)
    owner, counts = words.owner, words.counts
    per = lambda values: np.bincount(owner, weights=values, minlength=n).astype(np.int64)
    chars = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False)[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    # words covered by a run of three that occurs again in the text
    covered = np.zeros(len(words.codes) + 2, bool)
    place = np.arange(max(0, len(words.codes) - 2))
    whole = place[owner[: len(place)] == owner[2 : 2 + len(place)]] if len(place) else place
    run_owner, runs = run_hashes(words, np.arange(len(words.vocabulary), dtype=np.uint64), 3)
    twice = whole[_repeats(run_owner, runs) > 1]
    for k in range(3):
        covered[twice + k] = True
    # lines: those with a word count
    lines = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(n), lines.value_lengths().to_numpy(zero_copy_only=False))
    coded = lines.flatten().dictionary_encode()
    spoken = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    ended = pc.match_substring_regex(coded.dictionary, r"[.!?][\x20\x09-\x0D]*$").to_numpy(zero_copy_only=False)
    line_code = coded.indices.to_numpy(zero_copy_only=False)
    real = spoken[line_code]
    line_owner, line_code = line_owner[real], line_code[real]
    repeats = _repeats(owner, words.codes)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, repeats)
    same = np.concatenate([[False], (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])]) if len(owner) else np.zeros(0, bool)
    return {
        "n_words": counts.astype(np.int64), "word_chars": per(chars),
        "n_dup_lines": np.bincount(line_owner[_later_equal(line_owner, line_code)], minlength=n).astype(np.int64),
        "n_repeat_words": per(covered[: len(words.codes)]),
        "n_text": pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64),
        **_class_counts(texts),
        "n_lines": np.bincount(line_owner, minlength=n).astype(np.int64),
        "n_distinct": np.bincount(owner[~_later_equal(owner, words.codes)], minlength=n).astype(np.int64),
        "n_top_word": top, "n_same_as_last": per(same), "n_short": per(chars <= 3), "n_long": per(chars >= 13),
        "n_line_ends": np.bincount(line_owner[ended[line_code]], minlength=n).astype(np.int64),
    }


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and ``COUNTS`` for each row of ``docs``; reads only doc_id and text, moves no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=LEAN_SLICE_BYTES):
            found = count_texts(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["doc_id", "text_key", *COUNTS]
            )

    schema = ", ".join(["doc_id bigint", "text_key bigint", *(f"{c} bigint" for c in COUNTS)])
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    return read.mapInArrow(count, schema)


#: Names of ``shares``.
SHARES = (
    "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share",
    "top_word_share", "same_share", "short_share", "long_share", "line_end_share", "line_words", "log_words",
)


def shares() -> dict[str, Column]:
    """Size-free statistics derived from the counts; 0 where there is nothing to divide by."""

    def of(a: Column | str, b: Column | str) -> Column:
        a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
        return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    return {
        "word_length": of("word_chars", "n_words"), "symbol_share": of("n_symbols", "n_words"),
        "dup_line_share": of("n_dup_lines", "n_lines"), "repeat_share": of("n_repeat_words", "n_words"),
        "upper_share": of("n_upper", "word_chars"), "digit_share": of("n_digits", "word_chars"),
        "mark_share": of("n_marks", "n_words"), "distinct_share": of("n_distinct", "n_words"),
        "top_word_share": of("n_top_word", "n_words"), "same_share": of("n_same_as_last", "n_words"),
        "short_share": of("n_short", "n_words"), "long_share": of("n_long", "n_words"),
        "line_end_share": of("n_line_ends", "n_lines"), "line_words": of("n_words", "n_lines"),
        "log_words": F.log1p(F.col("n_words").cast("double")),
    }
