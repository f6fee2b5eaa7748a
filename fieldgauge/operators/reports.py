"""Tables behind the run report, and the manual review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.functions import bands
from fieldgauge.functions.text import is_missing, lookup
from fieldgauge.operators.evidence import FIELDS
from fieldgauge.operators.profile import distribution, long_form, with_share
from fieldgauge.operators.running import running_total

FLAGS = tuple(f"{f}_review_flag" for f in FIELDS) + ("operating_status_review_flag",)
PRIORITY = {"enterprise": 1, "mid_market": 2, "smb": 3, "micro": 4}
SEGMENTS = tuple(PRIORITY)


def outcomes(df: DataFrame) -> DataFrame:
    return distribution(df, "enrichment_status")


def stages(df: DataFrame) -> DataFrame:
    return with_share(df.groupBy("stage_resolved").agg(F.count("*").alias("records"))).orderBy("stage_resolved")


def _per_field(df: DataFrame, cells: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("field"), *[c.alias(n) for n, c in parts]) for f, parts in cells.items()]
    return df.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


def fill_lift(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Originally missing, newly filled, and the rate, per field."""
    out = _per_field(df, {f: [
        ("originally_null", F.count_if(is_missing(f"{f}_original"))),
        ("newly_filled", F.count_if(is_missing(f"{f}_original") & ~is_missing(f"{f}_final")))] for f in fields})
    return out.withColumn("lift_pct", bands.pct("newly_filled", "originally_null"))


def coverage_delta(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    out = _per_field(df, {f: [("records", F.count("*")), ("before", F.count_if(~is_missing(f"{f}_original"))),
                              ("after", F.count_if(~is_missing(f"{f}_final")))] for f in fields})
    return out.withColumns({"before_pct": bands.pct("before", "records"), "after_pct": bands.pct("after", "records"),
                            "delta_pct": bands.pct(F.col("after") - F.col("before"), "records")})


def source_reliability(df: DataFrame, dim: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Was the stored value right? Correct, incorrect and unknown per field and group."""
    flat = long_form(df, [dim], {f"{f}_original_correct": f for f in fields}, "field", "ok")
    return (flat.groupBy("field", dim).agg(
        F.count_if(F.col("ok")).alias("correct"), F.count_if(~F.col("ok")).alias("incorrect"),
        F.count_if(F.col("ok").isNull()).alias("unknown"))
        .withColumn("reliability", bands.ratio("correct", F.col("correct") + F.col("incorrect"))))


def operating_status(df: DataFrame) -> DataFrame:
    c = F.col("still_operating")
    label = F.when(c, "Active").when(~c, "Defunct").otherwise("Unknown")
    return with_share(df.groupBy(label.alias("operating")).agg(F.count("*").alias("records")))


def closure_signals(df: DataFrame) -> DataFrame:
    return (df.select(F.explode("closure_signals").alias("signal")).groupBy("signal")
            .agg(F.count("*").alias("records")).orderBy(F.desc("records"), "signal"))


def audience_by_segment(df: DataFrame) -> DataFrame:
    """B2B, B2C, Both and unknown per segment, with a total row."""
    c = F.col("b2b_vs_b2c")
    rolled = (df.select("poc_segment", c).rollup("poc_segment").agg(
        F.grouping("poc_segment").alias("_g"), F.count_if(c == "B2B").alias("b2b"), F.count_if(c == "B2C").alias("b2c"),
        F.count_if(c == "Both").alias("both"), F.count_if(c.isNull()).alias("unknown")))
    return rolled.select(F.when(F.col("_g") == 1, "total").otherwise(F.coalesce("poc_segment", F.lit("(none)"))).alias("segment"),
                         "b2b", "b2c", "both", "unknown")


def any_flag() -> Column:
    return F.coalesce(F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in FLAGS]), F.lit(False))


def review_by_flag(df: DataFrame) -> DataFrame:
    rows = [(f.removesuffix("_review_flag"), F.count_if(F.col(f))) for f in FLAGS] + [("any", F.count_if(any_flag()))]
    cells = [F.struct(F.lit(n).alias("field"), c.alias("flagged"), F.count("*").alias("records")) for n, c in rows]
    return df.agg(F.array(*cells).alias("_r")).select(F.inline("_r"))


def review_by_segment(df: DataFrame) -> DataFrame:
    return (df.groupBy(F.coalesce("poc_segment", F.lit("(none)")).alias("segment"))
            .agg(F.count_if(any_flag()).alias("flagged"), F.count("*").alias("records")))


def queue_order() -> list[Column]:
    return [F.col("priority"), F.asc_nulls_last("website_confidence"), F.col("handle")]


def review_queue(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Flagged rows with a priority, the fields to look at, and only the flagged
    fields' columns filled in."""
    marked = [F.when(F.col(f"{f}_review_flag"), F.lit(f)) for f in FIELDS]
    details = [F.when(F.col(f"{f}_review_flag"), F.col(f"{f}_{x}")).alias(f"{f}_{x}")
               for f in FIELDS for x in ("original", "enriched", "confidence", "pipeline_stage")]
    out = df.where(any_flag()).select(
        F.coalesce(lookup(PRIORITY, F.col("poc_segment")), F.lit(9)).alias("priority"),
        "handle", "name", "city", "state", "poc_segment",
        F.array_join(F.array_compact(F.array(*marked)), ", ").alias("fields_to_review"), *details)
    return out.orderBy(*queue_order()) if ordered else out


def review_queue_places(df: DataFrame) -> DataFrame:
    """The whole review queue with the place of each row, from 0."""
    queue = review_queue(df, ordered=False).withColumn("_one", F.lit(1))
    return running_total(queue, queue_order(), "_one", "_upto").withColumn("place", F.col("_upto") - 1).drop("_one", "_upto")
