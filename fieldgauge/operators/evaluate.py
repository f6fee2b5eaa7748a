"""Scoring final values against labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.functions.space import strip
from fieldgauge.config import CALIBRATION_AT
from fieldgauge.functions import bands
from fieldgauge.functions.text import bare_domain
from fieldgauge.operators.evidence import FIELDS


def matched(labels: DataFrame, output: DataFrame, key: str = "handle") -> DataFrame:
    return labels.join(output.select(key), key, "left_semi")


def unmatched(labels: DataFrame, output: DataFrame, key: str = "handle") -> DataFrame:
    return labels.join(output.select(key), key, "left_anti").select(key)


def match_summary(labels: DataFrame, output: DataFrame, key: str = "handle") -> DataFrame:
    seen = output.select(key, F.lit(True).alias("_seen"))
    return labels.select(key).join(seen, key, "left").agg(
        F.count("*").alias("labelled"), F.count("_seen").alias("matched"),
        F.count_if(F.col("_seen").isNull()).alias("unmatched"))


def normalise(field: Column, value: Column) -> Column:
    """Domain for website, trimmed lower case for the rest."""
    return F.when(field == "website", bare_domain(value)).otherwise(F.lower(strip(value)))


def long_labels(truth: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Label rows (handle, segment, field, gt) from one struct of fields. A field
    that a label leaves out is skipped; ``present`` lists the fields it has."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"ground_truth.{f}").alias("gt")) for f in fields])
    return (truth.select("handle", "segment", "present", F.inline(pairs))
            .where(F.array_contains("present", F.col("field"))).drop("present"))


def long_output(output: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_final").alias("pred"),
                              F.col(f"{f}_confidence").cast("double").alias("conf")) for f in fields])
    return output.select("handle", F.inline(rows))


def compare(labels: DataFrame, output: DataFrame) -> DataFrame:
    """One row per labelled (handle, field) found in the output: tp, fp, fn, the
    size distance and whether both sides have a value. A wrong value is a false
    positive and a false negative; two missing values are nothing. The output
    is cut to labelled handles before it is turned to long form."""
    out = long_output(output.join(labels.select("handle").distinct(), "handle", "left_semi"))
    both = labels.join(out, ["handle", "field"])
    gt, pred = normalise(F.col("field"), F.col("gt")), normalise(F.col("field"), F.col("pred"))
    return both.withColumns({"g": gt, "p": pred}).withColumns({
        "tp": F.coalesce(F.col("g") == F.col("p"), F.lit(False)),
        "fp": F.col("p").isNotNull() & ~F.coalesce(F.col("g") == F.col("p"), F.lit(False)),
        "fn": F.col("g").isNotNull() & ~F.coalesce(F.col("g") == F.col("p"), F.lit(False)),
        "both": F.col("g").isNotNull() & F.col("p").isNotNull(),
        "distance": F.when(F.col("field") == "size", F.abs(bands.size_ordinal("gt") - bands.size_ordinal("pred")))})


def confusion(pairs: DataFrame, by: Sequence[str] = ("field",)) -> DataFrame:
    return pairs.groupBy(*by).agg(*[F.count_if(x).alias(x) for x in ("tp", "fp", "fn")])


def prf(counts: DataFrame, places: int | None = 3) -> DataFrame:
    """Precision, recall and F1; NULL where the denominator is zero."""
    p = bands.ratio("tp", F.col("tp") + F.col("fp"))
    r = bands.ratio("tp", F.col("tp") + F.col("fn"))
    f1 = bands.ratio(2 * p * r, p + r)
    rounded = (lambda c: c) if places is None else (lambda c: F.round(c, places))
    return counts.withColumns({"precision": rounded(p), "recall": rounded(r), "f1": rounded(f1)})


def macro(per_field: DataFrame, places: int | None = 3, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Means over the fields that have a value, added in a fixed order so the
    result does not depend on the order rows arrive in; F1 comes from the two means."""
    def rounded(c: Column) -> Column:
        return c if places is None else F.round(c, places)

    def mean(metric: str) -> Column:
        cells = [F.max(F.when(F.col("field") == f, F.col(metric))) for f in fields]
        total = sum((F.coalesce(c, F.lit(0.0)) for c in cells[1:]), F.coalesce(cells[0], F.lit(0.0)))
        return bands.ratio(total, F.count(metric))

    m = per_field.agg(rounded(mean("precision")).alias("macro_precision"), rounded(mean("recall")).alias("macro_recall"))
    p, r = F.col("macro_precision"), F.col("macro_recall")
    return m.withColumn("macro_f1", rounded(bands.ratio(2 * p * r, p + r)))


def ordinal_error(pairs: DataFrame) -> DataFrame:
    wrong = pairs.where("field = 'size' and both and not tp")
    return wrong.agg(F.count("*").alias("mismatches"), F.count_if(F.col("distance") <= 1).alias("within_one"),
                     bands.ratio(F.count_if(F.col("distance") <= 1), F.count("*")).alias("within_one_rate"),
                     bands.ratio(F.sum("distance"), F.count("distance")).alias("mean_distance"))


def calibration(pairs: DataFrame, at: float = CALIBRATION_AT) -> DataFrame:
    """Of confident pairs where both sides have a value, the share that is right."""
    sure = F.coalesce(F.col("conf") >= at, F.lit(False)) & F.col("both")
    return pairs.groupBy("field").agg(F.count_if(sure).alias("confident"), F.count_if(sure & F.col("tp")).alias("correct")).withColumn(
        "rate", bands.ratio("correct", "confident"))


def mismatches(pairs: DataFrame) -> DataFrame:
    return pairs.where("fn").select("handle", "field", "gt", "pred", "segment", "distance")


def weak_fields(scored: DataFrame, precision: float = 0.70, recall: float = 0.60) -> DataFrame:
    low_p = F.coalesce(F.col("precision") < precision, F.lit(False))
    low_r = F.coalesce(F.col("recall") < recall, F.lit(False))
    return scored.where(low_p | low_r).select("field", low_p.alias("low_precision"), low_r.alias("low_recall"))


def go_no_go(scored: DataFrame, go: float = 0.78, pivot: float = 0.70) -> DataFrame:
    """From website and industry precision: both reach ``go``, else both reach ``pivot``, else stop."""
    worst = F.min(F.when(F.col("field").isin("website", "industry"), F.coalesce("precision", F.lit(0.0))))
    return scored.agg(worst.alias("lowest_precision")).withColumn(
        "decision", F.when(F.col("lowest_precision") >= go, "GO").when(F.col("lowest_precision") >= pivot, "PIVOT").otherwise("STOP"))
