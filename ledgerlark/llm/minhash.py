"""Near-duplicate documents by b-bit MinHash.

Texts become sets of five-word shingles. Of 512 minima per set only the low four bits are kept, packed
into 32 longs; the first 200 live just long enough to make 40 band keys of five. Sets that share a
band key are candidates. Equal nibbles are counted on the packed longs, corrected for the one in 16
that agree by chance, and pairs well below the wanted similarity go; the others are confirmed on their
full sets.

No bucket is expanded into all its pairs. Equal sets are one class with one representative. First each
set meets the smallest id that it shares any bucket with; then the smallest id of each of its buckets,
if that is still in another component; last, members of a bucket meet those members that are in
another component by then, in the first bucket they share, and go on only if their packed bits allow. Every two sets with a common band key are thus either compared or already
known to be connected, so no link that matters is lost; a pair at the limit shares no band key with a
chance of about 2 in 100,000.

Defined cases: A to Z count as lower case; a text with one to four words is one shingle, one without
words has none and is linked with nothing, as is null; rows with a null id take the component of their
class (null if all its ids are null); repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.components import components
from ledgerlark.llm.tables import stored
from ledgerlark.llm.words import LEAN_SLICE_BYTES, chain, mix, run_hashes, slices, split_words
from ledgerlark.session import pin

SHINGLE = 5
BANDS, BAND_ROWS, BITS = 40, 5, 4
MINIMA = 512
LONGS = -(-MINIMA * BITS // 64)
SIMILARITY_PERCENT = 75
#: Standard deviations below the wanted similarity at which an estimate rules a pair out.
MARGIN = 4.5


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle, grouped by text."""
    words = split_words(texts)
    hashes = words.hashes()
    owner, value = run_hashes(words, hashes, SHINGLE)
    for n in range(1, SHINGLE):  # the whole sequence of a short text
        own = np.flatnonzero(words.counts == n)
        if len(own):
            at = words.starts[own]
            owner = np.concatenate([owner, own])
            value = np.concatenate([value, chain([np.full(len(own), n, np.uint64), *(hashes[words.codes[at + i]] for i in range(n))])])
    first = ~pd.Series(chain([owner.astype(np.uint64), value])).duplicated().to_numpy()
    owner, value = owner[first], value[first]
    order = np.argsort(owner, kind="stable")
    return owner[order], value[order]


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two halves of a set key, band keys and packed low bits for each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _multipliers()
        for part in slices(batches, size=LEAN_SLICE_BYTES):
            owner, value = shingles(part.column("text"))
            n = np.bincount(owner, minlength=part.num_rows)
            has = np.flatnonzero(n)
            first = np.concatenate([[0], np.cumsum(n[has])[:-1]]).astype(np.int64)
            keys, packed, band = np.zeros((2, part.num_rows), np.uint64), np.zeros((part.num_rows, LONGS), np.uint64), np.zeros((part.num_rows, BANDS), np.uint64)
            if len(has):
                minima = np.empty((MINIMA, len(has)), np.uint64)
                for j in range(MINIMA):
                    minima[j] = np.minimum.reduceat(value * times[j] + plus[j], first)
                minima >>= np.uint64(24)
                for b in range(BANDS):
                    band[has, b] = chain([np.full(len(has), b, np.uint64), *minima[b * BAND_ROWS : (b + 1) * BAND_ROWS]])
                low = minima & np.uint64((1 << BITS) - 1)
                for j in range(MINIMA):
                    packed[has, j * BITS // 64] |= low[j] << np.uint64(j * BITS % 64)
                for k in range(2):
                    keys[k, has] = np.add.reduceat(mix(value + np.uint64(k + 1)), first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(keys[k].view(np.int64)) for k in range(2)),
                    _lists(band), _lists(packed),
                ],
                ["doc_id", "n_shingles", "key_a", "key_b", "bands", "packed"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        sign, "doc_id bigint, n_shingles bigint, key_a bigint, key_b bigint, bands array<bigint>, packed array<bigint>"
    )


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.view(np.int64).ravel()))


def equal_minima(a: Column, b: Column) -> Column:
    """How many of the packed low bits agree: nibbles of a xor b that are zero."""
    ones = F.lit(0x1111111111111111).cast("bigint")

    def different(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(ones)).cast("int")

    return F.lit(MINIMA) - F.aggregate(F.zip_with(a, b, different), F.lit(0), lambda s, d: s + d)


def estimated_similarity(equal: Column) -> Column:
    """Share of equal minima without those that agree by chance."""
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def _least_estimate(similarity: float) -> float:
    chance = 2.0**-BITS
    seen = chance + (1 - chance) * similarity
    return similarity - MARGIN * (seen * (1 - seen) / MINIMA) ** 0.5 / (1 - chance)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Those ``pairs`` (a, b) whose full shingle sets reach the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), "text_a", LEAN_SLICE_BYTES // 2):
                own_a, a = shingles(part.column("text_a"))
                own_b, b = shingles(part.column("text_b"))
                size_a, size_b = np.bincount(own_a, minlength=part.num_rows), np.bincount(own_b, minlength=part.num_rows)
                both = chain([np.concatenate([own_a, own_b]).astype(np.uint64), np.concatenate([a, b])])
                common = pd.Series(both).duplicated().to_numpy()[len(own_a) :]  # shingles are distinct on each side
                shared = np.bincount(own_b[common], minlength=part.num_rows)
                keep = pa.array(100 * shared >= percent * (size_a + size_b - shared))
                yield part.select(["a", "b"]).filter(keep)

    wanted = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("_text"))
    texts = texts.join(wanted, F.col("_doc") == F.col("_id"), "left_semi")
    joined = pairs.join(texts.select(F.col("_doc").alias("b"), F.col("_text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("_doc").alias("a"), F.col("_text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept for each row of ``docs``.

    Ids are expected to be unique; rows that repeat an id must repeat its text.
    """
    signed = stored(signatures(docs), "signatures")
    rows = signed.select("doc_id", "n_shingles", "key_a", "key_b")
    classes = pin(rows.where("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("id")))
    chosen = classes.where(F.col("id").isNotNull()).select(F.col("id").alias("_chosen"))
    heads = signed.join(chosen, F.col("doc_id") == F.col("_chosen"), "left_semi").where("n_shingles > 0")
    heads = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "packed").dropDuplicates(["id"])

    buckets = heads.select("id", "n", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = pin(buckets.join(sizes, "bucket"))

    bits = heads.select("id", "n", "packed")

    def plausible(pairs: DataFrame) -> DataFrame:
        one = bits.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("packed").alias("_pa"))
        two = bits.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("packed").alias("_pb"))
        met = pairs.join(two, "b").join(one, "a")
        fits = 100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")
        return met.where(fits & (estimated_similarity(equal_minima(F.col("_pa"), F.col("_pb"))) >= _least_estimate(percent / 100))).select("a", "b")

    star = shared.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    tried = pin(plausible(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    links = pin(confirmed(tried, docs, percent))
    found = components(links)

    # second round: smallest ids of buckets, where they are in another component
    of_a = found.select(F.col("id").alias("a"), F.col("component").alias("_c"))
    of_b = found.select(F.col("id").alias("b"), F.col("component").alias("_d"))
    parted = star.join(of_b, "b", "left").join(of_a, "a", "left").where(F.coalesce("_c", "a") != F.coalesce("_d", "b"))
    again = pin(plausible(parted.select("a", "b").distinct()).join(tried, ["a", "b"], "left_anti"))
    links = pin(links.unionByName(confirmed(again, docs, percent)))
    tried, found = tried.unionByName(again), components(links)

    # third round: buckets that still hold several components
    named = shared.where("members > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("_n"))
    mixed = parts.groupBy("bucket").agg(F.max_by("component", F.struct("_n", "component")).alias("largest"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    open_rows = pin(named.join(mixed, "bucket").select("bucket", "id", "n", "component", "largest"))
    signed_rows = open_rows.join(heads.select(F.col("id").alias("_head"), "bands", "packed"), F.col("id") == F.col("_head")).drop("_head")
    left = signed_rows.where("component != largest").select(
        "bucket", F.col("id").alias("a"), F.col("n").alias("_n_a"), F.col("component").alias("_c"), F.col("bands").alias("_b_a"), F.col("packed").alias("_p_a")
    )
    right = signed_rows.select(
        "bucket", F.col("id").alias("b"), F.col("n").alias("_n_b"), F.col("component").alias("_d"), (F.col("component") == F.col("largest")).alias("_big"),
        F.col("bands").alias("_b_b"), F.col("packed").alias("_p_b"),
    )
    # all of this belongs to the join, so that a pair becomes a row once, and only if it may be a link
    apart = (F.col("_c") != F.col("_d")) & (F.col("_big") | (F.col("a") < F.col("b")))
    apart = apart & (100 * F.least("_n_a", "_n_b") >= percent * F.greatest("_n_a", "_n_b"))
    apart = apart & (estimated_similarity(equal_minima(F.col("_p_a"), F.col("_p_b"))) >= _least_estimate(percent / 100))
    apart = apart & (F.array_min(F.array_intersect("_b_a", "_b_b")) == left["bucket"])
    met = left.join(right, (left["bucket"] == right["bucket"]) & apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = confirmed(pin(met.join(tried, ["a", "b"], "left_anti")), docs, percent)
    found = components(pin(links.unionByName(more)))

    named_classes = classes.join(found, "id", "left").select("key_a", "key_b", F.coalesce("component", "id").alias("_component"))
    own = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    return rows.join(named_classes, ["key_a", "key_b"], "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.isnull(own)).alias("kept")
    )
