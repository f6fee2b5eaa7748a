"""Comparing many rows with a partitioned side table, block against block.

Neither side is ever whole in a task or on the driver: the side table is cut into blocks of bounded size, rows into
slices of bounded size, and each pair of a slice and a block of the same group is one task's work. Callers cut groups so
that rows meet only blocks that can hold their answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fieldgauge.operators.scale import broadcast_if_small

BLOCK = 4096


def _cuts(df: DataFrame, group: str, name: str, size: int) -> DataFrame:
    return df.groupBy(F.col(group).alias("_group")).agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def in_blocks(rows: DataFrame, known: DataFrame, group: str, row_key: str, known_key: str, compare: Callable, schema: str,
              block: int = BLOCK, slice_: int = BLOCK) -> DataFrame:
    """``compare(slice, block)`` over Arrow tables for every slice of ``rows`` and block of ``known`` whose ``group`` is
    equal. Groups of one side alone yield nothing. A block holds about ``block`` rows of ``known``, dealt by its key."""
    cuts = _cuts(rows, group, "_slices", slice_).join(_cuts(known, group, "_blocks", block), "_group")
    cuts = broadcast_if_small(cuts)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (rows.join(cuts, F.col(group) == F.col("_group")).withColumn("_slice", deal(row_key, "_slices"))
            .withColumn("_block", count("_blocks")).drop("_slices", "_blocks"))
    cuts = cuts.select(*[F.col(c).alias(f"{c}_k") for c in cuts.columns])   # names of its own: both sides meet again
    right = (known.join(cuts, F.col(group) == F.col("_group_k")).withColumn("_block_k", deal(known_key, "_blocks_k"))
             .withColumn("_slice_k", count("_slices_k")).drop("_slices_k", "_blocks_k"))
    return (left.groupBy("_group", "_block", "_slice").cogroup(right.groupBy("_group_k", "_block_k", "_slice_k"))
            .applyInArrow(compare, schema))
