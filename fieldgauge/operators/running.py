"""Running totals and budget cuts without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgauge.sources.workspace import materialise


def running_total(df: DataFrame, order: Sequence[str | Column], value: str, name: str = "running",
                  partitions: int | None = None) -> DataFrame:
    """Sum of ``value`` up to and including each row in the total order ``order``.

    Rows are range partitioned on the whole (unique) order, so equal leading
    values may still be split; the layout is pinned to shared storage, because
    partition numbers must not change between the two reads. Only one sum per
    partition is then scanned in order, and added to each partition's own sums.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    sums = placed.groupBy("_pid").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (placed.withColumn("_in", F.sum(value).over(inside))
            .join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_in") + F.col("_before"))
            .drop("_pid", "_in", "_before"))


def budget_cut(df: DataFrame, order: Sequence[str], cost: str, cap) -> DataFrame:
    """Rows are worked in order until the cost already spent reaches the cap; from
    then on they are marked budget_exhausted."""
    spent_before = F.col("running") - F.col(cost)
    return (running_total(df, order, cost)
            .withColumn("status", F.when(spent_before >= cap, "budget_exhausted").otherwise("completed")))
