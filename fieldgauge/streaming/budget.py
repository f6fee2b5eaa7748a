"""A budget stop over an arriving call log: calls of a phase whose cap is spent are marked as they arrive."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldgauge.functions.text import lookup
from fieldgauge.operators.running import running_total
from fieldgauge.operators.scale import broadcast_if_small
from fieldgauge.sources.log_store import LogStore
from fieldgauge.sources.workspace import materialise, new_path

CLOCK = ""   # the row of the state that keeps the latest time seen


class LiveBudget:
    """State is one small row per phase, what it has spent, and the latest time seen, kept in a log store under the batch's
    number, so a repeated batch starts from the state before it and rewrites its own results.

    Within a batch calls count in the order (time, id), whichever phase is hot: running sums come from range partitions
    with one offset each, not from a task per phase. A call older than ``late`` before the latest time of earlier
    batches is marked ``late`` and not counted. A call is ``over_budget`` if its phase had spent its cap before it."""

    def __init__(self, spark: SparkSession, caps: Mapping[str, float], late: timedelta, id_: str = "event_id", ts: str = "ts",
                 phase: str = "phase", cost: str = "cents", root: str | None = None):
        self.spark, self.caps, self.late = spark, dict(caps), late
        self.id, self.ts, self.phase, self.cost = id_, ts, phase, cost
        self.root = root or new_path(spark, "budget")
        self.state = LogStore(spark, f"{self.root}/state", key="_phase")

    def _over(self, spent: Column) -> Column:
        return spent >= F.coalesce(lookup(self.caps, F.col(self.phase)).cast("double"), F.lit(float("inf")))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Mark the calls of a batch and add them to the state."""
        state = self.state.read(below=batch_id)
        clock = None if state is None else state.where(F.col("_phase") == CLOCK).select(F.max("_clock")).first()[0]
        calls = batch.select(self.id, F.col(self.ts).alias("_ts"), self.phase, F.col(self.cost).alias("_cost"))
        late = F.lit(False) if clock is None else F.col("_ts") < F.lit(clock - self.late)
        calls = materialise(calls.withColumn("_late", F.coalesce(late, F.lit(False))))
        order = [self.phase, "_ts", self.id]
        timely = running_total(calls.where("not _late"), order, "_cost")
        # the running sum goes over all phases; a phase starts at the least sum before one of its calls
        starts = timely.groupBy(F.col(self.phase).alias("_p")).agg(F.min(F.col("running") - F.col("_cost")).alias("_start"), F.sum("_cost").alias("_sum"))
        known = (starts if state is None else starts.join(state.where(F.col("_phase") != CLOCK).select("_phase", "_spent"), F.col("_p") == F.col("_phase"), "left").drop("_phase"))
        if state is None:
            known = known.withColumn("_spent", F.lit(0).cast("bigint"))
        known = materialise(known.withColumn("_spent", F.coalesce("_spent", F.lit(0)).cast("bigint")))
        spent = F.col("_spent") + F.col("running") - F.col("_cost") - F.col("_start")
        marked = (timely.join(broadcast_if_small(known), F.col(self.phase).eqNullSafe(F.col("_p")))
                  .select(self.id, self.phase, spent.cast("bigint").alias("spent_before"), F.when(self._over(spent), "over_budget").otherwise("counted").alias("status")))
        dropped = calls.where("_late").select(self.id, self.phase, F.lit(None).cast("bigint").alias("spent_before"), F.lit("late").alias("status"))
        marked.unionByName(dropped).write.mode("overwrite").parquet(f"{self.root}/calls/_batch={batch_id:012d}")
        totals = known.select(F.col("_p").alias("_phase"), (F.col("_spent") + F.col("_sum")).cast("bigint").alias("_spent"), F.lit(None).cast("timestamp").alias("_clock"))
        latest = (calls.agg(F.max("_ts").alias("_m")).select(F.lit(CLOCK).alias("_phase"), F.lit(None).cast("bigint").alias("_spent"),
                                                             F.greatest(F.col("_m").cast("timestamp"), F.lit(clock).cast("timestamp")).alias("_clock")))
        self.state.apply(totals.where("_phase is not null").unionByName(latest), version=batch_id)

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

    def calls(self) -> DataFrame:
        """All calls so far with what their phase had spent before and their mark."""
        return self.spark.read.option("basePath", f"{self.root}/calls").parquet(f"{self.root}/calls").drop("_batch")
