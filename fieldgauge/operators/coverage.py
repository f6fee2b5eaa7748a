"""Coverage of outside benchmark counts, gap ranking and verdicts.

The entity table is always aggregated to (key, label) counts before labels are
mapped, so the joins run on grids bounded by states x sectors x labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.config import GapTiers, SourcingLimit, VolumeTiers
from fieldgauge.functions import bands
from fieldgauge.functions.text import lookup
from fieldgauge.operators.scale import broadcast_if_small, lookup_join

UNMAPPED = "99"


def frequent_labels(df: DataFrame, min_n: int = 500) -> DataFrame:
    return (df.where("state is not null and industry is not null").groupBy("industry")
            .agg(F.count("*").alias("records")).where(F.col("records") >= min_n)
            .orderBy(F.desc("records"), "industry"))


def label_codes(label_map: DataFrame) -> DataFrame:
    """(_l, _s): the sector of each lower-case label, one row each; of spellings that disagree the smallest code wins."""
    return label_map.groupBy(F.lower("label").alias("_l")).agg(F.min("sector").alias("_s"))


def label_counts_to_sector(df: DataFrame, label_map: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per sector (and key). Labels map case-insensitively; NULL, unmapped
    and unknown codes fall into sector 99."""
    by_label = (df.where(F.col("state").isNotNull())
                .groupBy(*keys, F.lower("industry").alias("_label")).agg(F.count("*").alias("_n")))
    codes = broadcast_if_small(label_codes(label_map.where(F.col("sector").isin(*fv.SECTORS))))
    return (by_label.join(codes, F.col("_label") == F.col("_l"), "left")
            .groupBy(*keys, F.coalesce("_s", F.lit(UNMAPPED)).alias("sector"))
            .agg(F.sum("_n").alias("our_records")))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("our_records"))


def coverage(benchmark: DataFrame, ours: DataFrame, key: str, size: str = "employers",
             gaps: GapTiers = GapTiers(), tiers: VolumeTiers | None = None) -> DataFrame:
    """Our count over the benchmark count per key; keys we lack count as 0."""
    out = (benchmark.select(key, size).join(ours.select(key, "our_records"), key, "left")
           .withColumn("our_records", F.coalesce("our_records", F.lit(0)))
           .withColumn("coverage", bands.ratio("our_records", size))
           .withColumn("gap_tier", bands.gap_tier("coverage", gaps)))
    if tiers is not None:
        out = out.withColumn("volume_tier", bands.volume_tier("our_records", tiers))
    return out.orderBy("coverage", key)


def universe(employers: DataFrame, nonemployers: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Both counts side by side. Without a second frame the first one either
    brings a ``nonemployers`` column or stands alone."""
    if nonemployers is not None:
        employers = employers.join(nonemployers, list(keys), "left")
    other = F.coalesce("nonemployers", F.lit(0)) if "nonemployers" in employers.columns else F.lit(0)
    return employers.withColumn("nonemployers", other)


def combined_coverage(employers: DataFrame, nonemployers: DataFrame | None, ours: DataFrame,
                      gaps: GapTiers = GapTiers()) -> DataFrame:
    """Sector coverage against employers + non-employers, with the employer-only share beside it."""
    return (universe(employers, nonemployers, ["sector"]).join(ours, "sector", "left")
            .select("sector", F.coalesce("our_records", F.lit(0)).alias("our_records"), "employers", "nonemployers")
            .withColumn("universe", F.col("employers") + F.col("nonemployers"))
            .withColumn("employer_only_pct", bands.pct("our_records", "employers"))
            .withColumn("coverage", bands.ratio("our_records", "universe"))
            .withColumn("gap_tier", bands.gap_tier("coverage", gaps))
            .orderBy("coverage", "sector"))


def over_indexed(combined: DataFrame, above_pct: float = 100.0) -> DataFrame:
    return combined.where(F.col("employer_only_pct") > above_pct).select("sector", "employer_only_pct", "coverage")


def gap_cells(employers: DataFrame, nonemployers: DataFrame | None, ours: DataFrame, state_totals: DataFrame,
              second: str = "sector", gaps: GapTiers = GapTiers(), tiers: VolumeTiers = VolumeTiers()) -> DataFrame:
    """State x ``second`` cross-tab with ratio and tiers. States outside tiers A
    and B leave the grid; a cell we have no rows for counts as 0."""
    keys = ["state", second]
    tiered = (state_totals.select("state", bands.volume_tier("our_records", tiers).alias("state_tier"))
              .where(F.col("state_tier").isin("A", "B")))
    cells = (universe(employers, nonemployers, keys).join(ours, keys, "left").join(tiered, "state")
             .select(*keys, "state_tier", F.coalesce("our_records", F.lit(0)).alias("our_records"), "employers", "nonemployers")
             .withColumn("universe", F.col("employers") + F.col("nonemployers"))
             .withColumn("coverage", bands.ratio("our_records", "universe"))
             .withColumn("gap_tier", bands.gap_tier("coverage", gaps)))
    if second == "sector":
        cells = (cells.withColumn("sector_name", lookup(fv.SECTORS, F.col("sector")))
                 .withColumn("source", F.when(F.col("sector").isin(*fv.NO_NONEMPLOYER_SECTORS), "employers")
                             .otherwise("employers+nonemployers")))
    return cells.orderBy("gap_tier", "coverage", *keys)


CAVEAT_GIG = "non-employers here are mostly sole operators: a sourcing limit, not an enrichment gap"
CAVEAT_EMPLOYER_ONLY = "no non-employer counts for this sector: measured against employers only"
CAVEAT_TIER_B = "tier B state: directional signal only"


def gap_candidates(cells: DataFrame) -> DataFrame:
    """Cells below ADEQUATE with an id, a confidence and caveats."""
    high, a = F.col("gap_tier") == "HIGH_GAP", F.col("state_tier") == "A"
    gig = F.col("sector").isin(*fv.GIG_SECTORS)
    base = F.when(high & a, 0.90).when(high | a, 0.75).otherwise(0.60)
    notes = F.array_compact(F.array(
        F.when(gig, CAVEAT_GIG),
        F.when(F.col("sector").isin(*fv.NO_NONEMPLOYER_SECTORS), CAVEAT_EMPLOYER_ONLY),
        F.when(~a, CAVEAT_TIER_B)))
    return (cells.where(F.col("gap_tier") != "ADEQUATE").select(
        F.concat_ws("_", F.replace(F.col("state"), F.lit(" "), F.lit("_")),
                    F.replace(F.col("sector"), F.lit("-"), F.lit("_"))).alias("gap_id"),
        F.lit("industry x state").alias("dimension"),
        F.concat_ws(" / ", "state", "sector_name").alias("slice"),
        "state", "sector", "sector_name", "our_records", "employers", "nonemployers", "universe", "source",
        "coverage", F.col("gap_tier").alias("tier"), "state_tier",
        F.round(F.when(gig, F.greatest(base - 0.10, F.lit(0.0))).otherwise(base), 2).alias("confidence"),
        F.lit("unverified").alias("status"), notes.alias("caveats")))


def gap_summary(cells: DataFrame) -> DataFrame:
    tier = F.col("gap_tier")
    return cells.agg(
        F.count_distinct("state").alias("states"), F.count_distinct("sector").alias("sectors"),
        F.count("*").alias("cells"),
        F.count_distinct(F.when(F.col("state_tier") == "A", F.col("state"))).alias("tier_a_states"),
        F.count_distinct(F.when(F.col("state_tier") == "B", F.col("state"))).alias("tier_b_states"),
        F.count_if(tier == "HIGH_GAP").alias("high_cells"), F.count_if(tier == "MODERATE_GAP").alias("moderate_cells"),
        F.count_if(tier == "ADEQUATE").alias("adequate_cells"),
        F.count_if(tier != "ADEQUATE").alias("candidates"))


def top_gap_sectors(cells: DataFrame, k: int = 5) -> DataFrame:
    return (cells.where("gap_tier = 'HIGH_GAP'").groupBy("sector", "sector_name").agg(F.count("*").alias("state_count"))
            .orderBy(F.desc("state_count"), "sector").limit(k))


def sector_rollup(cells: DataFrame) -> DataFrame:
    """Cells rolled up to sectors. The median is the upper one, which is the
    discrete median of the ratios in descending order."""
    tier = F.col("gap_tier")
    return (cells.groupBy("sector", "sector_name").agg(
        F.count("*").alias("states"), F.count_if(tier == "HIGH_GAP").alias("high_states"),
        F.count_if(tier == "MODERATE_GAP").alias("moderate_states"),
        F.count_if(tier == "ADEQUATE").alias("adequate_states"),
        F.expr("percentile_disc(0.5) within group (order by coverage desc)").alias("median_coverage"),
        F.sum("our_records").alias("our_records"), F.sum("universe").alias("universe"),
        F.sum("employers").alias("employers"), F.sum("nonemployers").alias("nonemployers"))
        .withColumn("overall_coverage", F.coalesce(bands.ratio("our_records", "universe"), F.lit(0.0)))
        .withColumn("nonemployer_share", F.coalesce(bands.ratio("nonemployers", "universe"), F.lit(0.0)))
        .withColumn("employer_coverage", F.coalesce(bands.ratio("our_records", "employers"), F.lit(1.0))))


def classify_sectors(rollup: DataFrame, limit: SourcingLimit = SourcingLimit()) -> DataFrame:
    """SOURCING_LIMIT where non-employers dominate and employers are covered well
    enough; everything else is ACTIONABLE, worst first."""
    heavy = F.col("nonemployer_share") >= limit.nonemployer_share
    fine = F.col("employer_coverage") >= limit.employer_coverage
    return (rollup.withColumn("class", F.when(heavy & fine, "SOURCING_LIMIT").otherwise("ACTIONABLE"))
            .withColumn("inflated_but_real", heavy & ~fine)
            .orderBy("class", "overall_coverage", "sector"))


def split_actionable(rollup: DataFrame, limit: SourcingLimit = SourcingLimit()) -> tuple[DataFrame, DataFrame]:
    both = classify_sectors(rollup, limit)
    return both.where("class = 'ACTIONABLE'"), both.where("class = 'SOURCING_LIMIT'")


def sector_detail(candidates: DataFrame, ranked: DataFrame) -> DataFrame:
    """Cells of the ranked sectors (sector, rank), in rank order."""
    mine = ranked.select(F.col("sector").alias("_s"), "rank")
    return (candidates.join(mine, F.col("sector") == F.col("_s"))
            .select("rank", "sector", "state", "state_tier", "our_records", "coverage", "tier", "caveats")
            .orderBy("rank", "coverage", "state"))


def worst_states(cells: DataFrame, n_a: int = 10, n_b: int = 5,
                 without: Sequence[str] = fv.TERRITORIES) -> DataFrame:
    """The worst covered states of every sector and tier in one pass over the grid."""
    w = Window.partitionBy("sector", "state_tier").orderBy("coverage", "state")
    allowed = F.when(F.col("state_tier") == "A", n_a).otherwise(n_b)
    return (cells.where(~F.col("state").isin(*without)).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= allowed).select("sector", "state_tier", "rank", "state", "coverage"))


def labels_by_sector(label_map: DataFrame) -> DataFrame:
    """Inverse of a label map; the map is a small table, so its lists are small."""
    return label_map.groupBy("sector").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def in_sector(df: DataFrame, label_map: DataFrame, sector: str) -> DataFrame:
    labels = label_codes(label_map.where(F.col("sector").isin(*fv.SECTORS))).where(F.col("_s") == sector)
    rows = df.where(F.col("state").isNotNull())
    return lookup_join(rows, labels, F.lower("industry"), "_l", ["_s"]).where("_s is not null").drop("_s")


def slice_counts(df: DataFrame, label_map: DataFrame) -> DataFrame:
    """Rows per mapped sector, every sector at once."""
    return label_counts_to_sector(df, label_map).where(F.col("sector") != UNMAPPED).withColumnRenamed(
        "our_records", "slice_records")


def slice_stats(sample: DataFrame, by: str = "sector") -> DataFrame:
    """Fill shares of a drawn sample per slice."""
    n = F.count("*")
    return sample.groupBy(by).agg(n.alias("n"), *[
        bands.pct(F.count(c), n).alias(f"{c}_fill_pct") for c in ("website", "industry", "size", "state", "city")])


def slice_top_states(sample: DataFrame, by: str = "sector", k: int = 5) -> DataFrame:
    counts = sample.groupBy(by, "state").agg(F.count("*").alias("records"))
    w = Window.partitionBy(by).orderBy(F.desc("records"), "state")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def verdict(df: DataFrame, limit: SourcingLimit = SourcingLimit(), few: int = 1000,
            overstated_by: float | None = None) -> DataFrame:
    """Trust verdict per sector from nonemployer_share, employer_coverage,
    slice_records, website_fill_pct and industry_fill_pct (shares in 0..1, fills
    in percent). With ``overstated_by`` an observed coverage that exceeds the
    claimed one by that share gives OVERSTATED first."""
    heavy = F.col("nonemployer_share") > limit.nonemployer_share
    fine = F.col("employer_coverage") >= limit.employer_coverage
    share = F.format_string("%.0f%%", F.col("nonemployer_share") * 100)
    covered = F.format_string("%.1f%%", F.col("employer_coverage") * 100)
    slice_n = F.col("slice_records").cast("string")
    poor = (F.coalesce("website_fill_pct", F.lit(100.0)) < 40) & (F.coalesce("industry_fill_pct", F.lit(100.0)) < 50)

    def is_(v: str, *why) -> Column:
        return F.struct(F.lit(v).alias("verdict"), F.concat(*[F.lit(w) if isinstance(w, str) else w for w in why]).alias("why"))

    out = F
    if overstated_by is not None:
        out = out.when(F.col("observed_coverage") > F.col("claimed_coverage") * (1 + overstated_by),
                       is_("OVERSTATED", "observed coverage is well above the claim"))
    out = (out.when(heavy & fine, is_("ARTIFACT", share, " non-employers while employer coverage is ", covered))
           .when(heavy, is_("CONFIRMED", "employer coverage is only ", covered, " under ", share, " non-employers"))
           .when(F.col("slice_records") < few, is_("CONFIRMED", "only ", slice_n, " rows in this slice"))
           .when(poor, is_("PLAUSIBLE", "rows exist but the sample is poorly filled"))
           .otherwise(is_("PLAUSIBLE", slice_n, " rows in this slice support the gap in direction")))
    return df.withColumn("_v", out).select(*df.columns, "_v.verdict", "_v.why")


def issue_counts(findings: DataFrame) -> DataFrame:
    """Tally of issues per gap over (gap, issues array), ``clean`` left out."""
    return (findings.select("gap", F.explode("issues").alias("issue")).where("issue <> 'clean'")
            .groupBy("gap", "issue").agg(F.count("*").alias("records")))


def rank_sectors(scores: DataFrame, k: int = 5) -> DataFrame:
    """Highest priority first, then relevance; the scores are an input table."""
    order = lookup({"HIGH": 1, "MEDIUM": 2, "LOW": 3}, F.upper("priority"))
    return (scores.withColumn("_o", F.coalesce(order, F.lit(9))).orderBy("_o", F.desc("relevance"), "sector")
            .limit(k).drop("_o"))


