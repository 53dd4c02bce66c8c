"""History features kept up to date by a stream.

Each micro-batch runs the event form of the history operator on the rows that the watermark has
passed, starting from the totals of all earlier batches. The state is four kinds of tables per
entity: totals per key, events still in the future (window exits, label releases), the known
(key, target) pairs, and the rows waiting for the watermark. All work is joins, grouping and windows,
so a heavy key is cut in time exactly as in batch, and the results equal the batch results.

The rows of a batch are written once and read from there, in the session that started the stream: the one
that Spark gives to a batch has adaptive execution off, and would cut every small table into all shuffle
partitions. Only events that fall before the watermark meet the rows; later ones stay in the state. First
meetings are found once a batch and added to the known pairs, which are never rewritten.

State versions and outputs are written under the batch number, so a repeated batch overwrites itself;
the version before is kept until the next batch is complete. The folder belongs to one checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.operators import skew
from ledgerlark.operators.history import finish
from ledgerlark.operators.history_events import (
    EVENT,
    add_slices,
    carry_in,
    carry_over,
    events_of,
    first_meetings,
    merge_totals,
    slice_totals,
    statistics_over,
)
from ledgerlark.operators.history_spec import Entity, Roles

_OPEN, _CLOSED = -(1 << 62), 1 << 62


@dataclass
class HistoryStream:
    """Keeps history features of a transaction stream; ``folder`` must be shared by the cluster."""

    entities: Sequence[Entity]
    roles: Roles
    prior: float
    folder: str
    delay_us: int
    hot_rows: int | None = skew.HOT_ROWS
    slice_us: int = skew.SLICE_US

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        spark = stream.sparkSession
        writer = stream.writeStream.foreachBatch(lambda batch, i: self.update(batch, i, spark)).option("checkpointLocation", checkpoint)
        return writer.trigger(**trigger).start()

    def features(self, spark: SparkSession) -> DataFrame:
        """Everything emitted so far."""
        return spark.read.parquet(f"{self.folder}/features").drop("batch")

    def rejected_rows(self, spark: SparkSession) -> DataFrame:
        """Rows without a readable time."""
        return spark.read.parquet(f"{self.folder}/rejected").drop("batch")

    def late_rows(self, spark: SparkSession) -> int:
        """Rows that came after the watermark had passed them; they are dropped and counted."""
        return int(spark.read.json(f"{self.folder}/marks").agg(F.sum("late")).first()[0] or 0)

    def flush(self, spark: SparkSession) -> None:
        """Emit what still waits for the watermark, at the end of the stream."""
        last = int(spark.read.json(f"{self.folder}/marks").agg(F.max("batch_id")).first()[0])
        self._step(self._read(spark, last, "waiting").limit(0), last + 1, closed=True)

    # -- one micro-batch -----------------------------------------------------------------------------

    def update(self, batch: DataFrame, batch_id: int, spark: SparkSession | None = None) -> None:
        """Take in one micro-batch; its work runs in ``spark``, by default the session of the batch."""
        self._write(batch.withColumn("_us", F.unix_micros(F.col(self.roles.ts).cast("timestamp"))), batch_id, "arrived")
        timed = self._read(spark or batch.sparkSession, batch_id, "arrived")
        # rows without a time have no place before or after others; they are kept aside
        timed.where("_us is null").drop("_us").write.mode("overwrite").parquet(f"{self.folder}/rejected/batch={batch_id}")
        self._step(timed.where("_us is not null"), batch_id, closed=False)

    def _step(self, rows: DataFrame, batch_id: int, closed: bool) -> None:
        spark = rows.sparkSession
        before = batch_id - 1
        mark = self._mark(spark, before)
        waiting = rows.where(F.col("_us") > mark)
        if before >= 0:
            waiting = waiting.unionByName(self._read(spark, before, "waiting"))
        late = rows.where(F.col("_us") <= mark).count()
        newest = waiting.agg(F.max("_us")).first()[0]
        upto = _CLOSED if closed else max(mark, (newest if newest is not None else mark) - self.delay_us)
        self._write(waiting.where(F.col("_us") > upto), batch_id, "waiting")
        # ids may repeat, so rows get numbers by which they meet their features again
        self._write(waiting.where(F.col("_us") <= upto).withColumn("_n", F.monotonically_increasing_id()), batch_id, "ready")
        out = ready = self._read(spark, batch_id, "ready")
        for e in self.entities:
            found = finish(self._advance(ready, e, batch_id, upto), e, self.roles, self.prior)
            out = out.join(found.select("_n", *[c for c in found.columns if c not in ready.columns]), "_n")
        out.drop("_us", "_n").write.mode("overwrite").parquet(f"{self.folder}/features/batch={batch_id}")
        marks = spark.createDataFrame([(batch_id, upto, late)], "batch_id bigint, upto bigint, late bigint")
        marks.coalesce(1).write.mode("overwrite").json(f"{self.folder}/marks/batch={batch_id}")
        self._forget(spark, batch_id - 2)

    def _advance(self, ready: DataFrame, e: Entity, batch_id: int, upto: int) -> DataFrame:
        """Statistics of the ready rows for one entity, with the columns that ``finish`` reads; writes the entity's next state."""
        spark, before = ready.sparkSession, batch_id - 1
        keep = list(dict.fromkeys(["_n", "_us", e.key, *([self.roles.amount] if e.amounts else [])]))
        events = events_of(ready, e, self.roles, keep)
        known = ready.where(F.col(e.key).isNotNull()).select(F.col(e.key).alias("_e_key"))
        if before >= 0:
            pending = self._read(spark, before, f"{e.name}_pending")
            events = events.unionByName(pending, allowMissingColumns=True)
            known = known.unionByName(pending.select("_e_key"))
        for suffix, target in e.distinct:
            met = first_meetings(ready, e, self.roles, suffix, target)
            if before >= 0:
                old = self._read_upto(spark, before, f"{e.name}_met_{suffix}").select(F.col("_e_key").alias("_o_key"), F.col("_target").alias("_o_target"))
                same = (F.col("_e_key") == F.col("_o_key")) & F.col("_target").eqNullSafe(F.col("_o_target"))
                met = met.join(old, same, "left_anti")
            self._write(met, batch_id, f"{e.name}_met_{suffix}")
            met = self._read(spark, batch_id, f"{e.name}_met_{suffix}").drop("_target")
            events = events.unionByName(met, allowMissingColumns=True)

        self._write(events.where((F.col("_e_us") > upto) & F.col("_e_key").isNotNull()).select(*EVENT), batch_id, f"{e.name}_pending")
        # what falls after the watermark falls after every ready row
        due = events.where(F.col("_e_us") <= upto)
        hot = None if skew.no_key_can_be_hot(known, self.hot_rows) else skew.hot_keys(known, "_e_key", self.hot_rows)
        sliced = add_slices(due, hot, self.slice_us)
        done = slice_totals(sliced.where(F.col("_e_key").isNotNull()), e)
        seeds = self._read(spark, before, f"{e.name}_totals") if before >= 0 else done.where(F.lit(False))
        done = done.unionByName(seeds)
        self._write(merge_totals(done, e), batch_id, f"{e.name}_totals")
        # without heavy keys a key is one slice, and only the totals of earlier batches come before it
        carry = carry_over(seeds, e) if hot is None else carry_in(done, e)
        return statistics_over(sliced, carry, e, keep)

    # -- versioned tables ----------------------------------------------------------------------------

    def _path(self, batch_id: int, name: str) -> str:
        return f"{self.folder}/state/{name}/version={batch_id}"

    def _write(self, df: DataFrame, batch_id: int, name: str) -> None:
        df.write.mode("overwrite").parquet(self._path(batch_id, name))

    def _read(self, spark: SparkSession, batch_id: int, name: str) -> DataFrame:
        return spark.read.parquet(self._path(batch_id, name))

    def _read_upto(self, spark: SparkSession, batch_id: int, name: str) -> DataFrame:
        """What all batches up to this one have added."""
        return spark.read.parquet(*[self._path(i, name) for i in range(batch_id + 1)])

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Drop a state version that no retry can need any more."""
        names = ["arrived", "waiting", "ready"]
        for e in self.entities:
            names += [f"{e.name}_pending", f"{e.name}_totals"]
        for name in names:
            old = spark._jvm.org.apache.hadoop.fs.Path(self._path(batch_id, name))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def _mark(self, spark: SparkSession, batch_id: int) -> int:
        if batch_id < 0:
            return _OPEN
        return int(spark.read.json(f"{self.folder}/marks/batch={batch_id}").first()["upto"])
