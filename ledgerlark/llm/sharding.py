"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Every shard has the same number of points on a ring; a document belongs to the first point clockwise of
its own place. No shard takes more than its share of rows: documents come in a fixed pseudo-random order,
and one that meets a full shard goes on clockwise to the next shard with room. Shares differ by one row
at most, so the law that holds is ``rows``; a changed document, or one more shard, moves only documents
of the arcs concerned and those that overflow.

The order is cut into equal steps, and counts by (arc, step) are all the driver sees: a table whose size
depends on the ring alone. Steps in which a shard becomes full are looked at again in finer steps until
the very row is known; there are fewer such rows than shards. After that each row finds its shard from
its place on the ring and its place in the order. DataFrame functions only.

Defined cases: a null text has size 1 and the checksum of the empty text; rows that repeat an id start
from one place and overflow like others; null ids count as one id; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.tables import stored
from ledgerlark.operators.ordered import number_rows

SHARDS, POINTS = 8, 16
PLACES = 1 << 16
STEPS = 512
BLOCK_ROWS = 100_000


def _hash(text: str) -> int:
    import zlib

    h = zlib.crc32(text.encode())
    return (h * 2654435761 ^ h >> 15) % PLACES


@dataclass(frozen=True)
class Ring:
    """Arcs in clockwise order: where each ends, and the shards met from there on."""

    ends: list[int]
    walks: list[list[int]]

    @classmethod
    def of(cls, shards: int, points: int = POINTS) -> Ring:
        owner: dict[int, int] = {}
        for shard in range(shards):
            for p in range(points):
                place = _hash(f"shard {shard} point {p}")
                while place in owner:  # the next free place
                    place = (place + 1) % PLACES
                owner[place] = shard
        ends = sorted(owner)
        around = [owner[e] for e in ends]
        return cls(ends, [list(dict.fromkeys(around[i:] + around[:i])) for i in range(len(ends))])

    def arc(self, place: Column) -> Column:
        """Number of the arc that a place lies in; places after the last point belong to the first arc."""
        bounds = F.from_json(F.lit(json.dumps(self.ends)), "array<int>")
        before = F.size(F.filter(bounds, lambda end: end < place))
        return F.pmod(before, F.lit(len(self.ends))).cast("int")


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(ring: Ring, rows: int, shares: list[int], counts: Callable[[int, int, int], dict[int, dict[int, int]]]) -> list[tuple[int, list[int]]]:
    """(first place in the order, shard of each arc from there on) for each phase between fillings.

    ``counts(low, high, width)`` gives rows by step of ``width`` and arc for places from low to high.
    """
    left = list(shares)

    def targets() -> list[int]:
        return [next((s for s in walk if left[s] > 0), -1) for walk in ring.walks]

    phases = [(0, targets())]

    def run(low: int, high: int) -> None:
        width = max(1, -(-(high - low) // STEPS))
        found = counts(low, high, width)
        for step in sorted(found):
            aim, wanted = phases[-1][1], [0] * len(left)
            for arc, n in found[step].items():
                wanted[aim[arc]] += n
            begin = low + step * width
            if any(w > room for w, room in zip(wanted, left)):
                run(begin, min(begin + width, high))
                continue
            full = False
            for s, w in enumerate(wanted):
                left[s] -= w
                full |= w > 0 and not left[s]
            if full:
                phases.append((min(begin + width, high), targets()))

    if rows:
        run(0, rows)
    return phases


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    ring = Ring.of(shards)
    place = F.pmod(F.xxhash64(F.lit("place"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(PLACES)).cast("int")
    rows = narrow.withColumn("_place", place).withColumn("_arc", ring.arc(F.col("_place")))
    # the last column parts rows that are equal in all others
    rows = rows.withColumn("_turn", F.xxhash64(F.lit("turn"), "doc_id")).withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    ordered = stored(number_rows(rows, ["_turn", "doc_id", "text_crc32", "_tie"], "_rank").drop("_turn", "_tie", "_place"), "order")
    number = F.col("_rank") - 1
    total = ordered.count()

    def counts(low: int, high: int, width: int) -> dict[int, dict[int, int]]:
        found: dict[int, dict[int, int]] = {}
        some = ordered.where((number >= low) & (number < high)).groupBy(F.floor((number - low) / width).alias("step"), "_arc").count()
        for r in some.collect():
            found.setdefault(r["step"], {})[r["_arc"]] = r["count"]
        return found

    shard: Column = F.lit(None).cast("int")
    for start, aim in fill(ring, total, quotas(total, shards), counts):
        of_arc = F.get(F.from_json(F.lit(json.dumps(aim)), "array<int>"), F.col("_arc"))
        shard = F.when(number >= start, of_arc).otherwise(shard)
    placed = ordered.withColumn("shard", shard).withColumn("_block", F.floor(number / BLOCK_ROWS))
    # slots: rows of the shard in earlier blocks, and the place inside the block
    sizes = placed.groupBy("_block", "shard").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", "shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_block", "shard").orderBy("_rank")) - 1
    return placed.join(starts, ["_block", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (inside + F.col("_start")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
