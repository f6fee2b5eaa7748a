"""Building blocks that keep work spread out when keys are hot and keep
side tables honest about their size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

SMALL_TABLE_ROWS = 5_000


def scalar(df: DataFrame) -> Column:
    """The single value of a one-row, one-column frame as a scalar subquery, so
    totals need neither a cross join nor an unpartitioned window."""
    return df.scalar()


def broadcast_if_small(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """A table that is usually small (a label map, a price list), marked for broadcast after a check of its rows. Of a
    larger one no more than ``limit`` + 1 rows reach the driver, and it is joined by shuffle."""
    rows = df.limit(limit + 1).collect()
    return df if len(rows) > limit else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                  k: int | Column, max_k: int, salt: Column, salts: int = 64,
                  rank: str = "_rank") -> DataFrame:
    """First ``k`` rows of each group. A group is first cut to ``max_k`` rows
    within each of ``salts`` slices, so no task ever sorts a whole hot group and
    the last window holds at most salts x max_k rows per group."""
    slice_ = F.pmod(F.xxhash64(salt), F.lit(salts))
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_slice", slice_)
            .withColumn("_local", F.row_number().over(local))
            .where(F.col("_local") <= max_k)
            .withColumn(rank, F.row_number().over(final))
            .where(F.col(rank) <= k)
            .drop("_slice", "_local"))


def left_lookup(big: DataFrame, side: DataFrame, key: str, row_key: str, weight: str,
                values: Sequence[str], hot_share: float = 0.001) -> DataFrame:
    """Left join of a big frame to a side table with one row per key that may
    itself grow with the data. ``key`` is text, '' standing for no key, and
    ``weight`` is the number of big rows per key.

    Keys holding at least ``hot_share`` of all rows number at most 1/hot_share,
    so that slice of the side table is broadcast; every other key is joined by
    shuffle, where no key can be hot. Rows already answered, and rows without a
    key, carry a throw-away key that spreads them evenly over the shuffle. It is
    part of the one join key: a salt in a column of its own, constant on the
    side's rows, would be folded into a filter and leave those rows unspread."""
    floor = scalar(side.agg(F.sum(weight))) * F.lit(hot_share)
    # both slices read every column of the side, so they share one computation
    hot = F.broadcast(side.where(F.col(weight) >= floor)
                      .select(F.col(key).alias("_hk"), F.struct(*values).alias("_hot")))
    cold = side.where(F.col(weight) < floor).select(
        F.concat(F.lit("="), F.col(key)).alias("_ck"), F.struct(*values).alias("_cold"))
    answered = F.col("_hot").isNotNull() | (F.col(key) == "")
    out = (big.join(hot, F.col(key) == F.col("_hk"), "left")
           .withColumn("_jk", F.when(answered, F.xxhash64(row_key).cast("string")).otherwise(F.concat(F.lit("="), F.col(key)))))
    out = out.join(cold, F.col("_jk") == F.col("_ck"), "left")
    # a keyless group in the side table answers nobody; it is blanked here, not
    # filtered, because a filter on the key would be pushed down and re-derive it
    found = [F.when(F.col(key) != "", F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}"))).alias(v) for v in values]
    return out.select(*big.columns, *found)


def lookup_join(big: DataFrame, side: DataFrame, on: Column, key: str, values: Sequence[str],
                limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Left join of ``big`` to a side table that is usually small, with one row per text ``key``; ``on`` is the text of a
    big row and null finds nothing. Up to ``limit`` rows the side is broadcast. A larger side gets the rows that ask for
    each key counted and goes through ``left_lookup``, so no key that many rows ask for is hot in the shuffle."""
    side = side.select(F.col(key).alias("_side"), *values)
    checked = side.limit(limit + 1).collect()
    if len(checked) <= limit:
        small = F.broadcast(side.sparkSession.createDataFrame(checked, side.schema))
        return big.withColumn("_want", on).join(small, F.col("_want") == F.col("_side"), "left").select(*big.columns, *values)
    # '' stands for no key there, so keys carry a sign before them; rows are spread by their plain columns
    plain = [f.name for f in big.schema if isinstance(f.dataType, AtomicType)]
    asked = (big.withColumn("_want", F.coalesce(F.concat(F.lit("="), on), F.lit("")))
             .withColumn("_row", F.xxhash64(*plain)))
    found = (asked.groupBy("_want").agg(F.count("*").alias("_rows"))
             .join(side, F.col("_want") == F.concat(F.lit("="), "_side"), "left").select("_want", "_rows", *values))
    return left_lookup(asked, found, "_want", "_row", "_rows", values).select(*big.columns, *values)
