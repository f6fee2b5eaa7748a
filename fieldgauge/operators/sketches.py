"""Distinct counts that add up over snapshots: one small sketch per batch and key, kept instead of the rows.

A batch is read once, folded into HyperLogLog sketches map-side, and written under its own number, so a repeated batch
replaces its own sketches. Any set of batches is then answered from the sketches alone. An estimate is within
``ERROR`` of the count in all but one of some hundreds of cases (three standard errors); counts of rows and nulls are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgauge.functions import bands

LG_K = 14
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)

Keys = Mapping[str, tuple[Sequence[Column], Sequence[str]]]


def _name(i: int, part: str) -> str:
    return f"_{part}_{i}"


def sketched(df: DataFrame, keys: Keys, lg_k: int = LG_K) -> DataFrame:
    """(candidate_key, records, nulls, sketch) of each key from one pass over ``df``. Parts of a key are compared as one
    tuple, in which a null is a value; ``nulls`` counts rows with a null in one of the source columns."""
    whole = [F.to_json(F.array(*[p.cast("string") for p in parts])) for parts, _ in keys.values()]
    missing = [F.greatest(*[F.col(s).isNull() for s in sources], F.lit(False)) for _, sources in keys.values()]
    wide = df.agg(F.count("*").alias("_n"), *[F.hll_sketch_agg(w, lg_k).alias(_name(i, "s")) for i, w in enumerate(whole)],
                  *[F.count_if(m).alias(_name(i, "m")) for i, m in enumerate(missing)])
    rows = F.array(*[F.struct(F.lit(k).alias("candidate_key"), F.col("_n").alias("records"), F.col(_name(i, "m")).alias("nulls"),
                              F.col(_name(i, "s")).alias("sketch")) for i, k in enumerate(keys)])
    return wide.select(F.inline(rows))


def store_batch(df: DataFrame, keys: Keys, path: str, batch: int) -> None:
    """Write the sketches of a batch; repeating it replaces them."""
    sketched(df, keys).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def key_estimates(spark: SparkSession, path: str, batches: Sequence[int] | None = None) -> DataFrame:
    """Uniqueness of each key over all stored batches, or some of them, from their sketches."""
    stored = spark.read.option("basePath", path).parquet(path)
    if batches is not None:
        stored = stored.where(F.col("batch").isin(*batches))
    n, d = F.col("total_records"), F.col("distinct_estimate")
    return (stored.groupBy("candidate_key")
            .agg(F.sum("records").alias("total_records"), F.sum("nulls").alias("nulls_in_key"),
                 F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))
            .withColumns({"distinct_low": F.floor(d / (1 + ERROR)), "distinct_high": F.ceil(d / (1 - ERROR)),
                          "collision_pct_estimate": bands.pct(F.greatest(n - d, F.lit(0)), n)}))
