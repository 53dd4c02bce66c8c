"""Levels of text features as a table, and the pipeline stage that joins it.

Training counts the values of all text features in one shuffle and numbers them in the order of their
frequency. The numbers stay in a table however many values there are: a stage joins them to the rows, and
saving the stage writes the table beside its settings. Nothing of it becomes program text.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.encoding import level_counts, modes_of
from ledgerlark.operators.ordered import number_rows
from ledgerlark.operators.target_statistics import settled_statistics
from ledgerlark.session import pin

RARE, RARE_BELOW = "_RARE_", 20
MISSING = "NA"
#: Categories of a feature that trees split by sets; features with more values give their frequency rank as a number.
MAX_CATEGORIES = 32
#: Places of a feature that are named in the features of a linear model; beyond that they are numbered.
NAMED_PLACES = 1_000
#: Rows of a feature's part of the table up to which it is offered for broadcast.
BROADCAST_LEVELS = 200_000


@dataclass(frozen=True)
class Levels:
    """``table``: feature, level, n, rare, place, rank. A rare level has the place of all rare ones together."""

    table: DataFrame
    modes: Mapping[str, str]
    #: by feature, number of levels and of places
    levels: Mapping[str, int]
    places: Mapping[str, int]
    #: names in order of place, for features with few
    names: Mapping[str, list[str]]


def _numbered(counts: DataFrame, level: str, name: str) -> DataFrame:
    """Add the place of each level of a feature: most rows first, ties by value; no task holds a feature."""
    order = [F.col("feature"), F.col("n").desc(), F.col(level)]
    ranked = number_rows(counts, order, "_rn")
    starts = ranked.groupBy("feature").agg(F.min("_rn").alias("_from"))  # one row per feature
    return ranked.join(F.broadcast(starts), "feature").withColumn(name, F.col("_rn") - F.col("_from")).drop("_rn", "_from")


def fit_levels_table(train: DataFrame, columns: Sequence[str]) -> Levels:
    """Count and number the values of ``columns``; missing ones count for the most frequent value."""
    counts = pin(level_counts(train, columns))
    modes = {r["feature"]: r["mode"] for r in modes_of(counts).collect()}
    # one row per feature from here to the end of the paragraph
    holes = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    filled = train.sparkSession.createDataFrame(
        [(c, modes.get(c) or MISSING, int(holes[c])) for c in columns if holes[c]], "feature string, level string, _holes bigint"
    )
    known = counts.join(F.broadcast(filled), ["feature", "level"], "full").select("feature", "level", "n", (F.coalesce("n", F.lit(0)) + F.coalesce("_holes", F.lit(0))).alias("_all"))
    # a value is rare by its own rows; how often it stands in the encoded rows decides its place
    rare = F.coalesce(F.col("n"), F.col("_all")) < RARE_BELOW
    known = known.select("feature", "level", F.col("_all").alias("n"), rare.alias("rare"))
    ranked = _numbered(known, "level", "rank")
    merged = ranked.select("feature", F.when(F.col("rare"), RARE).otherwise(F.col("level")).alias("_merged"), "n")
    placed = _numbered(merged.groupBy("feature", "_merged").agg(F.sum("n").alias("n")), "_merged", "place").drop("n")
    own = F.when(F.col("rare"), RARE).otherwise(F.col("level")).alias("_merged")
    table = pin(ranked.select("*", own).join(placed, ["feature", "_merged"]).select("feature", "level", "n", "rare", "place", "rank"))
    sizes = {r["feature"]: r for r in table.groupBy("feature").agg(F.count(F.lit(1)).alias("levels"), (F.max("place") + 1).alias("places")).collect()}
    few = [c for c, r in sizes.items() if r["places"] <= NAMED_PLACES]
    names: dict[str, list[str]] = {c: [""] * sizes[c]["places"] for c in few}
    for r in table.where(F.col("feature").isin(few)).select("feature", "place", own).distinct().collect():
        names[r["feature"]][r["place"]] = r["_merged"]
    return Levels(table, modes, {c: int(sizes[c]["levels"]) if c in sizes else 0 for c in columns}, {c: int(sizes[c]["places"]) if c in sizes else 0 for c in columns}, names)


class LevelEncoder(Transformer, MLWritable):
    """Adds ``c__t``, the filled value of each text feature c, and ``c__i``, its number as a double.

    Linear: values seen as rare are merged and the number is the place; unseen values come last. Trees:
    nothing is merged and the number is the frequency rank, marked as a category where there are few.
    """

    def __init__(self, columns: Sequence[str] = (), levels: Levels | None = None, linear: bool = True) -> None:
        super().__init__()
        self.columns, self.levels, self.linear = list(columns), levels, linear

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            out = self._joined(out, c)
        return out

    def _joined(self, df: DataFrame, c: str) -> DataFrame:
        known = self.levels
        number = "place" if self.linear else "rank"
        part = known.table.where(F.col("feature") == c).select(F.col("level").alias("_level"), F.col("rare").alias("_rare"), F.col(number).alias("_number"))
        if known.levels.get(c, 0) <= BROADCAST_LEVELS:
            part = F.broadcast(part)
        value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(known.modes.get(c) or MISSING))
        joined = df.withColumn(f"{c}__t", value).join(part, F.col(f"{c}__t") == F.col("_level"), "left")
        if self.linear:
            joined = joined.withColumn(f"{c}__t", F.when(F.col("_rare"), RARE).otherwise(F.col(f"{c}__t")))
        return joined.withColumn(f"{c}__i", self._number(c)).drop("_level", "_rare", "_number")

    def _number(self, c: str) -> Column:
        n = (self.levels.places if self.linear else self.levels.levels).get(c, 0)
        value = F.coalesce(F.col("_number"), F.lit(n)).cast("double")
        if not self.linear and n + 1 > MAX_CATEGORIES:
            return value
        about: dict[str, object] = {"type": "nominal", "name": f"{c}__i", "num_vals": n + 1}
        if self.linear and c in self.levels.names:
            about = {"type": "nominal", "name": f"{c}__i", "vals": [*self.levels.names[c], "__unknown"]}
        return value.alias(f"{c}__i", metadata={"ml_attr": about})

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    @classmethod
    def load(cls, path: str) -> LevelEncoder:
        return cls.read().load(path)


class _Writer(MLWriter):
    def __init__(self, stage: LevelEncoder) -> None:
        super().__init__()
        self._stage = stage

    def saveImpl(self, path: str) -> None:
        known = self._stage.levels
        settings = {
            "columns": self._stage.columns, "linear": self._stage.linear, "modes": dict(known.modes),
            "levels": dict(known.levels), "places": dict(known.places), "names": dict(known.names),
        }
        DefaultParamsWriter.saveMetadata(self._stage, path, self.sparkSession, extraMetadata={"settings": json.dumps(settings)})
        known.table.write.parquet(f"{path}/levels")


class _Reader(MLReader):
    def load(self, path: str) -> LevelEncoder:
        spark: SparkSession = self.sparkSession
        s = json.loads(DefaultParamsReader.loadMetadata(path, spark)["settings"])
        table = spark.read.parquet(f"{path}/levels")
        return LevelEncoder(s["columns"], Levels(table, s["modes"], s["levels"], s["places"], s["names"]), s["linear"])


class CategoryRates(Transformer, MLWritable):
    """Adds the label statistics of categories that rows outside training get, from a saved table of sums."""

    def __init__(self, columns: Sequence[str] = (), sums: DataFrame | None = None, prior: float = 0.0, size: int = 0) -> None:
        super().__init__()
        self.columns, self.sums, self.prior, self.size = list(columns), sums, prior, size

    def _transform(self, df: DataFrame) -> DataFrame:
        return settled_statistics(df, self.columns, self.sums, self.prior, broadcast=self.size <= BROADCAST_LEVELS)

    def write(self) -> MLWriter:
        return _RatesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RatesReader()

    @classmethod
    def load(cls, path: str) -> CategoryRates:
        return cls.read().load(path)


class _RatesWriter(MLWriter):
    def __init__(self, stage: CategoryRates) -> None:
        super().__init__()
        self._stage = stage

    def saveImpl(self, path: str) -> None:
        s = self._stage
        DefaultParamsWriter.saveMetadata(s, path, self.sparkSession, extraMetadata={"settings": json.dumps({"columns": s.columns, "prior": s.prior, "size": s.size})})
        s.sums.write.parquet(f"{path}/sums")


class _RatesReader(MLReader):
    def load(self, path: str) -> CategoryRates:
        s = json.loads(DefaultParamsReader.loadMetadata(path, self.sparkSession)["settings"])
        return CategoryRates(s["columns"], self.sparkSession.read.parquet(f"{path}/sums"), s["prior"], s["size"])
