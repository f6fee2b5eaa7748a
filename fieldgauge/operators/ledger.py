"""Cost ledger over a call log, and checks as rows (gate, passed, observed, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.config import BATCH_SIZE, STAGE4_SHARE_MAX
from fieldgauge.functions import bands
from fieldgauge.operators.scale import lookup_join
from fieldgauge.functions.text import lookup, platform_by_prefix

TOTAL = "TOTAL"


def ledger(log: DataFrame, cost: str = "cost", places: int | None = 10) -> DataFrame:
    """Cost and calls per phase and in total; an absent phase is ``unknown``."""
    rolled = (log.select(F.coalesce("phase", F.lit("unknown")).alias("phase"), F.coalesce(cost, F.lit(0)).alias("_c"))
              .rollup("phase").agg(F.grouping("phase").alias("_g"), F.count("*").alias("calls"), F.sum("_c").alias("spent")))
    spent = F.col("spent") if places is None else F.round("spent", places)
    return rolled.select(F.when(F.col("_g") == 1, TOTAL).otherwise(F.col("phase")).alias("phase"), "calls", spent.alias("spent"))


def call_cost(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per call from tokens and a price table (model, input, output per million)."""
    return (lookup_join(log, prices, F.col("model"), "model", ["input", "output"])
            .withColumn("cost", F.col("input_tokens") / 1e6 * F.col("input") + F.col("output_tokens") / 1e6 * F.col("output")))


def budget_gate(spent: DataFrame, caps: Mapping[str, float], total_cap: float, strict: bool = True) -> DataFrame:
    """Per phase and in total. At entry (strict) reaching the cap fails; in the
    health check only exceeding it does. A phase without a cap has cap 0."""
    cap = F.when(F.col("phase") == TOTAL, F.lit(float(total_cap))).otherwise(
        F.coalesce(lookup({k: float(v) for k, v in caps.items()}, F.col("phase")), F.lit(0.0)))
    over = (F.col("spent") >= F.col("cap")) if strict else (F.col("spent") > F.col("cap"))
    return (spent.withColumn("cap", cap)
            .select(F.concat(F.lit("budget:"), "phase").alias("gate"), (~over).alias("passed"),
                    F.col("spent").cast("double").alias("observed"),
                    F.concat_ws(" ", F.lit("spent of cap"), F.col("cap").cast("string")).alias("detail")))


def _checks(df: DataFrame, rows: Sequence[tuple[str, Column, Column, str]]) -> DataFrame:
    """One aggregate, one output row per check."""
    cells = [F.struct(F.lit(g).alias("gate"), ok.alias("passed"), obs.cast("double").alias("observed"),
                      F.lit(d).alias("detail")) for g, ok, obs, d in rows]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def key_gate(df: DataFrame, key: str = "handle") -> DataFrame:
    """Nulls and repeated values of the key. Counted per key first, so a hot
    value is folded before it moves."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    nulls = F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0))
    extra = F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1)), F.lit(0))
    return _checks(per, [("key_nulls", nulls == 0, nulls, "rows without a key"),
                         ("key_duplicates", extra == 0, extra, "rows repeating a key")])


def batch_gate(df: DataFrame, size: tuple[int, int] = BATCH_SIZE, sizes: Sequence[str] = fv.SIZE_BANDS,
               key: str = "handle") -> DataFrame:
    n = F.count("*")
    odd = F.count_if(~F.col("size").isin(*sizes))
    hits = F.count_if(platform_by_prefix("website", tlds=False))
    own = _checks(df, [("batch_size", n.between(*size), n, f"rows, {size[0]} to {size[1]} expected"),
                       ("size_scope", odd == 0, odd, "rows with a size outside the bands"),
                       ("rules_applied", F.lit(True), hits, "platform addresses in the batch (informational)")])
    return own.unionByName(key_gate(df, key))


def cascade_gate(df: DataFrame, stage: str = "stage_resolved", max_share: float = STAGE4_SHARE_MAX) -> DataFrame:
    share = F.coalesce(bands.ratio(F.count_if(F.col(stage) == 4), F.count(stage)), F.lit(0.0))
    silent = F.count_if(F.col("status").isNull())
    return _checks(df, [("stage_distribution", share <= max_share, share, "share of rows settled by the last stage"),
                        ("no_silent_drops", silent == 0, silent, "rows without a status")])


def min_rows_gate(df: DataFrame, at_least: int = 3, name: str = "min_gap_candidates") -> DataFrame:
    n = F.count("*")
    return _checks(df, [(name, n >= at_least, n, f"rows, at least {at_least} needed")])


def regression_gate(base: DataFrame, new: DataFrame, fields: Sequence[str], enums: Mapping[str, Sequence[str]],
                    confidences: Sequence[str] = (), points: float = 5.0, accuracy: int = 10_000) -> DataFrame:
    """A new batch against a baseline: fill lost, rows outside an enum, and the
    median confidence, each failing beyond ``points`` percentage points."""
    def measures(df: DataFrame) -> DataFrame:
        n = F.count("*")
        cells = [F.struct(F.lit(f"fill:{f}").alias("gate"), bands.pct(F.count(f), n).alias("v")) for f in fields]
        cells += [F.struct(F.lit(f"enum:{f}").alias("gate"), bands.pct(
            F.count_if(F.col(f).isNull() | F.col(f).isin(*v)), n).alias("v")) for f, v in enums.items()]
        cells += [F.struct(F.lit(f"confidence:{c}").alias("gate"),
                           (F.percentile_approx(c, 0.5, accuracy) * 100.0).alias("v")) for c in confidences]
        return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))

    both = measures(base).withColumnRenamed("v", "before").join(measures(new).withColumnRenamed("v", "after"), "gate")
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn(
        "passed", F.coalesce(F.col("delta") >= -points, F.lit(False)))


class GateFailure(Exception):
    """At least one check failed."""


def enforce(checks: DataFrame, label: str) -> None:
    """Raise when a check failed. Checks are one row per gate; only failures are fetched."""
    failed = checks.where(~F.col("passed")).select("gate", "observed").collect()
    if failed:
        raise GateFailure(f"{label}: " + ", ".join(f"{r['gate']}={r['observed']}" for r in failed))


