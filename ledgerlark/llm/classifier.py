"""Quality scores from random Fourier features of text statistics.

Cosine features approximate a Gaussian kernel; ridge weights come from normal equations summed over
partitions; the raw scores are then calibrated by isotonic regression on rows the weights have not
seen. The driver handles only a square matrix of the number of features and one row per score step.

Defined cases: null and empty texts have zero statistics and get a score like any other; rows with a
null label teach nothing; with no labelled rows, or none to calibrate on, every score is the share of
label 1 known so far, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.rules import one_label
from ledgerlark.llm.statistics import SHARES, shares, text_statistics
from ledgerlark.llm.tables import id_crc, stored
from ledgerlark.session import pin

STATISTICS = SHARES
HELD_OUT, FOLDS, CALIBRATION_FOLD = 0, 5, 1
CUT = 0.3
SCORE_STEPS = 500


@dataclass(frozen=True)
class Features:
    """Standardised statistics, their cosine features and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, count: int, width: float, seed: int = 7) -> Features:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(0, 1 / width, (len(mean), count)), rng.uniform(0, 2 * np.pi, count))

    def of(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([waves, x, np.ones((len(rows), 1))])


@dataclass(frozen=True)
class Calibration:
    """Rising line through (score, share of label 1) knots."""

    scores: np.ndarray
    shares: np.ndarray

    def of(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.scores, self.shares)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in STATISTICS]).astype(float)


def normal_equations(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z zᵀ and z y: each partition adds up its own rows, then rows of the matrix meet by number."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = features.of(_matrix(batch))
            own = z.T @ np.hstack([z, batch.column("label").to_numpy(zero_copy_only=False).astype(float)[:, None]])
            total = own if total is None else total + own
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                ["line", "part", "values"],
            )

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # one order of additions, so that runs agree
        total = np.sum(np.stack(table.column("values").to_numpy()), axis=0)
        return pa.table({"line": pa.array([table.column("line")[0].as_py()], pa.int32()), "values": pa.array([total], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(partial, "line int, part int, values array<double>")
    lines = sums.groupBy("line").applyInArrow(add, "line int, values array<double>").collect()
    if not lines:
        return np.zeros((0, 0)), np.zeros(0)
    full = np.array([r["values"] for r in sorted(lines, key=lambda r: r["line"])])
    return full[:, :-1], full[:, -1]


def isotonic(steps: list[tuple[float, float, float]]) -> Calibration:
    """Pool adjacent violators over (mean score, label sum, rows) in score order."""
    blocks: list[list[float]] = []
    for score, positives, rows in steps:
        blocks.append([score * rows, positives, rows])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return Calibration(
        np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) if len(blocks) == 1 else b[1] / b[2] for b in blocks]),
    )


def _raw_scores(rows: DataFrame, features: Features, weights: np.ndarray, extra: list[str]) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = features.of(_matrix(batch)) @ weights
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(raw)], [*extra, "raw"])

    types = dict(rows.dtypes)
    return rows.select(*extra, *STATISTICS).mapInArrow(score, ", ".join([*(f"{c} {types[c]}" for c in extra), "raw double"]))


def quality_scores(docs: DataFrame, labels: DataFrame, count: int = 192, width: float = 3.0, ridge: float = 1e-3) -> DataFrame:
    """doc_id, held_out, score, predicted and text_key for each document; ``labels.quality`` is what is learned.

    Rows whose id has a CRC-32 divisible by 5 teach nothing; remainder 1 calibrates, the others fit.
    """
    counted = stored(text_statistics(docs), "statistics")
    rows = counted.select("doc_id", "text_key", (id_crc() % FOLDS).alias("fold"), *[c.alias(n) for n, c in shares().items()])
    known = pin(rows.where(F.col("fold") != HELD_OUT).join(one_label(labels, "quality"), "doc_id").drop("doc_id", "text_key"))
    fit, later = known.where(F.col("fold") != CALIBRATION_FOLD), known.where(F.col("fold") == CALIBRATION_FOLD)
    spread = fit.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share"), *[f(n).alias(f"{k}_{n}") for n in STATISTICS for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    share = 0.5 if not spread["n"] else spread["share"]
    held = (F.col("fold") == HELD_OUT).alias("held_out")
    model = None
    if spread["n"]:
        features = Features.draw(np.array([spread[f"m_{n}"] for n in STATISTICS]), np.array([max(spread[f"s_{n}"], 1e-3) for n in STATISTICS]), count, width)
        gram, moment = normal_equations(fit, features)
        weights = np.linalg.solve(gram + ridge * spread["n"] * np.eye(len(gram)), moment)
        step = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) * (SCORE_STEPS // 2)).cast("int")
        steps = _raw_scores(later, features, weights, ["label"]).groupBy(step.alias("step")).agg(F.avg("raw").alias("raw"), F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n"))
        found = [(r["raw"], float(r["ones"]), float(r["n"])) for r in sorted(steps.collect(), key=lambda r: r["step"])]
        model = (features, weights, isotonic(found)) if found else None
    if model is None:
        scored = rows.select("doc_id", "text_key", "fold", F.lit(float(share)).alias("score"))
    else:
        features, weights, calibration = model
        raw = _raw_scores(rows, features, weights, ["doc_id", "text_key", "fold"])
        scored = raw.select("doc_id", "text_key", "fold", _interpolated(F.col("raw"), calibration).alias("score"))
    return scored.select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "text_key")


def _interpolated(raw, calibration: Calibration):
    """The calibration as a Spark expression; a few dozen knots at most remain after pooling."""
    xs, ys = calibration.scores.tolist(), calibration.shares.tolist()
    out = F.when(raw <= xs[0], F.lit(ys[0]))
    for x0, y0, x1, y1 in zip(xs, ys, xs[1:], ys[1:]):
        out = out.when(raw <= x1, F.lit(y0) + (raw - x0) * ((y1 - y0) / max(x1 - x0, 1e-12)))
    return out.otherwise(F.lit(ys[-1]))
