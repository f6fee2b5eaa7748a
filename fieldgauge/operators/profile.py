"""Profiling aggregates: counts, fill, distributions, keys and flags.

Each report is one scan with map-side partial aggregation. Shares of a total
use a scalar subquery over the already grouped counts, so no ungrouped window
and no self join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.functions.space import strip
from fieldgauge import fixed_values as fv
from fieldgauge.config import PARITY_TARGETS, TIER_B_SLACK, VolumeTiers
from fieldgauge.functions import bands
from fieldgauge.functions.text import lookup, platform_by_host, regex_domain
from fieldgauge.operators.scale import scalar

COMPANY_FIELDS = ("handle", "name", "website", "industry", "size", "type", "founded", "city", "state")
NULL_LABEL = "(null)"
MALFORMED = r"^(https?://|www\.)?.+\..{2,}"


def in_valid_state(df: DataFrame, state: str = "state", names: Sequence[str] = bands.STATE_NAMES) -> DataFrame:
    return df.where(bands.valid_state(state, names))


def with_share(counts: DataFrame, n: str = "records", name: str = "pct") -> DataFrame:
    return counts.withColumn(name, bands.pct(n, scalar(counts.agg(F.sum(n)))))


def long_form(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str], var: str, value: str) -> DataFrame:
    """Turn the named columns into (var, value) rows with the given labels."""
    pairs = ", ".join(f"'{label}', `{c}`" for c, label in cols.items())
    return df.select(*keys, F.expr(f"stack({len(cols)}, {pairs}) as ({var}, {value})"))


# -- counts and fill ---------------------------------------------------------

def snapshot(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_distinct("state").alias("distinct_states"),
        F.count_distinct("industry").alias("distinct_industries"),
        F.count("state").alias("non_null_state"),
        F.count("name").alias("non_null_name"),
        F.count("website").alias("non_null_website"))


def state_counts(df: DataFrame, names: Sequence[str] = bands.STATE_NAMES) -> DataFrame:
    s = F.col("state")
    valid = s.isin(*names)
    return df.agg(
        F.count("*").alias("total_raw"),
        F.count_if(valid).alias("valid_state"),
        F.count_if(s.isNull()).alias("null_state"),
        F.count_if(~valid).alias("invalid_state"),
        bands.pct(F.count_if(valid), F.count("*")).alias("valid_pct"),
        bands.pct(F.count("*") - F.count_if(valid), F.count("*")).alias("excluded_pct"))


def fill_rates(df: DataFrame, cols: Sequence[str] = COMPANY_FIELDS) -> DataFrame:
    """Non-null share per column, one row per column, worst first."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols])
    return (long_form(one, ["_n"], {c: c for c in cols}, "field", "filled")
            .select("field", "filled", bands.pct("filled", "_n").alias("fill_pct"))
            .orderBy("fill_pct", "field"))


def distribution(df: DataFrame, column: str, k: int | None = None, alias: str | None = None) -> DataFrame:
    """Rows and share per value, NULL shown as its own bucket, largest first."""
    alias = alias or column
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(NULL_LABEL)).alias(alias)).agg(F.count("*").alias("records"))
    out = with_share(counts).orderBy(F.desc("records"), alias)
    return out.limit(k) if k else out


def fill_by_group(df: DataFrame, group: Sequence[str], cols: Sequence[str] = ("website", "industry", "size"),
                  tiers: VolumeTiers = VolumeTiers()) -> DataFrame:
    n = F.count("*")
    total = sum((F.count(c) for c in cols[1:]), F.count(cols[0]))
    return (df.groupBy(*group)
            .agg(n.alias("records"), *[bands.pct(F.count(c), n).alias(f"{c}_fill_pct") for c in cols],
                 (total * 100.0 / (F.lit(float(len(cols))) * n)).alias("avg_fill_pct"))
            .withColumn("tier", bands.volume_tier("records", tiers))
            .orderBy("avg_fill_pct", *group))


def volume_tiers(df: DataFrame, group: str = "state", tiers: VolumeTiers = VolumeTiers()) -> DataFrame:
    counts = df.groupBy(group).agg(F.count("*").alias("records"))
    return (with_share(counts).withColumn("tier", bands.volume_tier("records", tiers))
            .orderBy(F.desc("records"), group))


def tier_summary(df: DataFrame, group: str = "state", tiers: VolumeTiers = VolumeTiers()) -> DataFrame:
    return (df.groupBy(group).agg(F.count("*").alias("n"))
            .groupBy(bands.volume_tier("n", tiers).alias("tier"))
            .agg(F.count("*").alias("groups_in_tier"), F.sum("n").alias("total_records"),
                 F.min("n").alias("min_records"), F.max("n").alias("max_records"))
            .orderBy("tier"))


# -- flags and keys ------------------------------------------------------------

def quality_flags(df: DataFrame, year_max: int = 2026) -> DataFrame:
    name = strip("name")
    repeated = (df.where(F.col("name").isNotNull() & F.col("state").isNotNull())
                .groupBy(F.lower(name), "state").agg(F.count("*").alias("n"))
                .where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0))))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("website").rlike(MALFORMED)).alias("malformed_website"),
        F.count_if(F.col("founded") < 1800).alias("suspicious_founded"),
        F.count_if(F.col("founded") > year_max).alias("future_founded"),
        F.count_if(F.length(name) < 2).alias("short_name"),
        F.count_if(F.col("city").isNull() & F.col("state").isNotNull()).alias("missing_city"),
    ).withColumn("duplicate_records", scalar(repeated))


def candidate_key(df: DataFrame, label: str, parts: Sequence[Column], sources: Sequence[str]) -> DataFrame:
    """Uniqueness of a key. The parts are compared as one tuple, so rows with a
    NULL part still count; ``sources`` are the columns whose NULLs are reported."""
    tuples = df.select(F.struct(*parts).alias("_key"),
                       F.greatest(*[F.col(s).isNull() for s in sources], F.lit(False)).alias("_null"))
    n, d = F.count("*"), F.count_distinct("_key")
    return tuples.agg(
        F.lit(label).alias("candidate_key"), n.alias("total_records"), d.alias("distinct_values"),
        (n - d).alias("duplicates"), bands.pct(n - d, n).alias("collision_pct"),
        F.count_if("_null").alias("nulls_in_key"))


def candidate_keys(df: DataFrame, keys: Mapping[str, tuple[Sequence[Column], Sequence[str]]]) -> DataFrame:
    """``candidate_key`` for several keys of texts at once: a row gives one tagged tuple per key, and tuples are counted
    before labels are, so no label is a hot key."""
    tuples = F.array(*[F.struct(F.lit(label).alias("candidate_key"), F.array(*parts).alias("_key"),
                                F.greatest(*[F.col(s).isNull() for s in sources], F.lit(False)).alias("_null"))
                       for label, (parts, sources) in keys.items()])
    counted = (df.select(F.inline(tuples)).groupBy("candidate_key", "_key")
               .agg(F.count("*").alias("_n"), F.count_if("_null").alias("_nulls")))
    n, d = F.sum("_n"), F.count("*")
    return counted.groupBy("candidate_key").agg(
        n.alias("total_records"), d.alias("distinct_values"), (n - d).alias("duplicates"),
        bands.pct(n - d, n).alias("collision_pct"), F.sum("_nulls").alias("nulls_in_key"))


def report_keys() -> dict[str, tuple[Sequence[Column], Sequence[str]]]:
    """handle, name+state, name+domain and name+city+state: their parts and the columns whose NULLs are reported."""
    name = F.lower(strip("name"))
    return {
        "handle": ([F.col("handle")], ["handle"]),
        "name + state": ([name, F.col("state")], ["name", "state"]),
        "name + domain": ([name, regex_domain("website")], ["name", "website"]),
        "name + city + state": ([name, F.lower(strip("city")), F.col("state")], ["name", "city", "state"]),
    }


def key_report(df: DataFrame) -> DataFrame:
    """The keys of ``report_keys`` side by side, from one pass."""
    return candidate_keys(df, report_keys())


def duplicate_groups(df: DataFrame, keys: Mapping[str, Column], k: int = 20) -> DataFrame:
    named = [c.alias(n) for n, c in keys.items()]
    return (df.groupBy(*named).agg(F.count("*").alias("occurrences")).where("occurrences > 1")
            .orderBy(F.desc("occurrences"), *keys).limit(k))


# -- exclusion and sanity -----------------------------------------------------

def exclusion_by_band(df: DataFrame, sizes: Sequence[str] = fv.SIZE_BANDS[2:],
                      total_label: str = "TOTAL (51+)") -> DataFrame:
    """Rows without a valid state per size band, with a total row at the end."""
    bad = ~F.coalesce(bands.valid_state(), F.lit(False))
    is_total = F.grouping("size") == 1
    rolled = (df.where(F.col("size").isin(*sizes)).select("size", bad.alias("_bad")).rollup("size")
              .agg(F.count("*").alias("total"), F.count_if("_bad").alias("excluded"), is_total.alias("_t")))
    return (rolled.select(
        F.when(F.col("_t"), total_label).otherwise(F.col("size")).alias("size"), "total", "excluded",
        bands.pct("excluded", "total").alias("excluded_pct"),
        F.when(F.col("_t"), 99).otherwise(bands.size_ordinal()).alias("sort_key"))
        .orderBy("sort_key"))


def top_invalid(df: DataFrame, column: str, valid: Sequence[str], k: int = 15) -> DataFrame:
    return (df.where(~F.col(column).isin(*valid)).groupBy(column).agg(F.count("*").alias("records"))
            .orderBy(F.desc("records"), column).limit(k))


def top_values(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    out = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("records"))
           .orderBy(F.desc("records"), column))
    return out.limit(k) if k else out


def distinct_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(k)


# -- segment quality and scope ---------------------------------------------------

def _filled(c: str) -> Column:
    return bands.pct(F.count(c), F.count("*"))


def segment_quality(df: DataFrame) -> DataFrame:
    seg = F.coalesce(bands.segment(), F.lit("size_unknown"))
    return with_share(df.groupBy(seg.alias("segment")).agg(
        F.count("*").alias("records"), _filled("website").alias("website_fill_pct"),
        _filled("industry").alias("industry_fill_pct"))).orderBy(F.desc("records"))


def worst_cells(df: DataFrame, dims: Sequence[str] = ("size", "industry"), min_n: int = 2000, k: int = 8,
                without: Sequence[str] = fv.PUBLIC_SECTOR_LABELS) -> DataFrame:
    known = [F.col(d).isNotNull() for d in dims]
    keep = ~F.col("industry").isin(*without)
    for c in known:
        keep = keep & c
    return (df.where(keep).groupBy(*dims)
            .agg(F.count("*").alias("records"), _filled("website").alias("website_fill_pct"))
            .where(F.col("records") > min_n).orderBy("website_fill_pct", *dims).limit(k))


def scope_breakdown(df: DataFrame) -> DataFrame:
    s = F.col("size")
    return df.agg(F.count("*").alias("total"), F.count_if(s == "1-10").alias("micro"),
                  F.count_if(s != "1-10").alias("eleven_plus"), F.count_if(s.isNull()).alias("size_null"))


def eleven_plus(df: DataFrame) -> DataFrame:
    return df.where(F.col("size") != "1-10")


def _missing_and_fill() -> list[Column]:
    out = [F.count("*").alias("records")]
    for c in ("website", "industry"):
        out += [F.count_if(F.col(c).isNull()).alias(f"{c}_missing"), _filled(c).alias(f"{c}_fill_pct")]
    return out


def fill_by_band(df: DataFrame) -> DataFrame:
    """11+ bands in ordinal order."""
    return eleven_plus(df).groupBy("size").agg(*_missing_and_fill()).orderBy(bands.size_ordinal())


def fill_eleven_plus(df: DataFrame) -> DataFrame:
    return eleven_plus(df).agg(*_missing_and_fill())


def platform_by_segment(df: DataFrame) -> DataFrame:
    seg = (F.when(F.col("size") == "1-10", "micro_1-10").when(F.col("size").isNull(), "size_null").otherwise("11+"))
    return (df.where(platform_by_host("website")).groupBy(seg.alias("segment"))
            .agg(F.count("*").alias("platform_urls")).orderBy(F.desc("platform_urls"), "segment"))


def label_pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]] = fv.DUPLICATE_LABELS) -> DataFrame:
    """Rows per label of each pair, all pairs in one pass over label counts."""
    label = F.lower("industry")
    wanted = sorted({x for p in pairs for x in p})
    counts = df.where(label.isin(*wanted)).groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    sums = [F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)) for p in pairs for x in p]
    rows = F.array(*[F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"),
                              sums[2 * i].alias("count_a"), sums[2 * i + 1].alias("count_b"))
                     for i, (a, b) in enumerate(pairs)])
    return (counts.agg(rows.alias("_r")).select(F.inline("_r"))
            .withColumn("combined", F.col("count_a") + F.col("count_b")))


def true_gap(df: DataFrame, pairs: Sequence[tuple[str, str]] = fv.DUPLICATE_LABELS) -> DataFrame:
    """Website gap = missing + platform address; industry gap = missing + labels split in two."""
    split = F.lower("industry").isin(*[x for p in pairs for x in p])
    return eleven_plus(df).agg(
        F.count_if(F.col("website").isNull()).alias("website_missing"),
        F.count_if(platform_by_host("website")).alias("platform_urls"),
        F.count_if(F.col("website").isNull() | platform_by_host("website")).alias("website_true_gap"),
        F.count_if(F.col("industry").isNull() | split).alias("industry_quality_gap"))


def worst_groups(df: DataFrame, group: str = "state", min_n: int = 5000, k: int = 10) -> DataFrame:
    return (df.groupBy(group).agg(F.count("*").alias("records"), _filled("website").alias("website_fill_pct"),
                                  _filled("industry").alias("industry_fill_pct"))
            .where(F.col("records") >= min_n).orderBy("website_fill_pct", group).limit(k))


def pivot_fill(df: DataFrame, group: str = "state") -> DataFrame:
    """Website fill of mid-market and enterprise side by side per group."""
    pivoted = (df.groupBy(group).pivot("segment", ["mid_market", "enterprise"])
               .agg(F.count(F.lit(1)).alias("n"), bands.pct(F.count("website"), F.count(F.lit(1))).alias("website_pct")))
    return pivoted.withColumns({f"{s}_n": F.coalesce(f"{s}_n", F.lit(0)) for s in ("mid_market", "enterprise")})


def vintage_by_band(df: DataFrame, base_year: int = 2026) -> DataFrame:
    age = F.lit(base_year) - F.col("founded")
    return (df.where(F.col("size").isNotNull()).groupBy("size").agg(
        F.count("*").alias("records"), _filled("website").alias("website_fill_pct"),
        _filled("industry").alias("industry_fill_pct"),
        bands.pct(F.count_if(F.col("type").isNull()), F.count("*")).alias("type_null_pct"),
        bands.ratio(F.sum(age), F.count("founded")).alias("mean_age")).orderBy(bands.size_ordinal()))


def null_rate_by(df: DataFrame, dim: str, cols: Sequence[str] = ("website", "industry", "size", "type")) -> DataFrame:
    """NULL share per group and its distance from the whole table, in points. The whole-table values are summed from
    the counts of the groups and attached as one struct, so rows are counted in one pass."""
    per_group = df.groupBy(dim).agg(F.count("*").alias("records"), *[F.count(c).alias(f"_n_{c}") for c in cols])
    whole = scalar(per_group.agg(F.struct(*[
        bands.pct(F.sum("records") - F.sum(f"_n_{c}"), F.sum("records")).alias(c) for c in cols])))
    shares = {f"{c}_null_pct": bands.pct(F.col("records") - F.col(f"_n_{c}"), F.col("records")) for c in cols}
    return (per_group.withColumns(shares).withColumn("_all", whole)
            .withColumns({f"{c}_vs_all": F.col(f"{c}_null_pct") - F.col("_all")[c] for c in cols})
            .drop("_all", *[f"_n_{c}" for c in cols]))


def null_rate_by_tier(df: DataFrame, group: str = "state", tiers: VolumeTiers = VolumeTiers(),
                      cols: Sequence[str] = ("website", "industry", "size", "type")) -> DataFrame:
    """NULL share per volume tier, rolled up from per-group counts."""
    per_group = df.groupBy(group).agg(F.count("*").alias("n"), *[F.count(c).alias(f"_{c}") for c in cols])
    return (per_group.groupBy(bands.volume_tier("n", tiers).alias("tier"))
            .agg(F.sum("n").alias("records"),
                 *[bands.pct(F.sum("n") - F.sum(f"_{c}"), F.sum("n")).alias(f"{c}_null_pct") for c in cols])
            .orderBy("tier"))


def co_missing(df: DataFrame, cols: Sequence[str] = ("website", "industry", "size", "type")) -> DataFrame:
    """Share of rows missing ``b`` among rows missing ``a``, every ordered pair in one pass."""
    gone = {c: F.col(c).isNull() for c in cols}
    cells = [F.struct(F.lit(a).alias("given_null"), F.lit(b).alias("field"),
                      F.count_if(gone[a]).alias("given_n"), F.count_if(gone[a] & gone[b]).alias("both_n"))
             for a in cols for b in cols if a != b]
    return (df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
            .withColumn("rate_pct", bands.pct("both_n", "given_n")))


def missing_pattern(df: DataFrame, dim: str, cols: Sequence[str] = ("website", "industry", "type"),
                    spread_points: float = 5.0) -> DataFrame:
    """Largest minus smallest NULL share over groups, per field."""
    per_group = df.where(F.col(dim).isNotNull()).groupBy(dim).agg(
        *[bands.pct(F.count("*") - F.count(c), F.count("*")).alias(c) for c in cols])
    return (long_form(per_group, [], {c: c for c in cols}, "field", "null_pct").groupBy("field")
            .agg(F.min("null_pct").alias("min_pct"), F.max("null_pct").alias("max_pct"))
            .withColumn("spread", F.col("max_pct") - F.col("min_pct"))
            .withColumn("pattern", F.when(F.col("spread") >= spread_points, "varies").otherwise("uniform")))


def parity(df: DataFrame, targets: Mapping[str, tuple] = PARITY_TARGETS, tiers: VolumeTiers = VolumeTiers(),
           slack_b: float = TIER_B_SLACK, weights: Mapping[str, int] | None = None,
           group: str = "state") -> DataFrame:
    """Fill of website, industry and size per group and segment against targets.
    Tier B groups get slack, tier C groups are left out, and an optional weight
    per segment scales the gap."""
    fields = ("website", "industry", "size")
    seg = bands.segment()
    per = (df.where(F.col(group).isNotNull()).groupBy(group, seg.alias("segment"))
           .agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in fields]))
    tier_of = (per.groupBy(group).agg(F.sum("n").alias("_t"))
               .select(F.col(group).alias("_g"), bands.volume_tier("_t", tiers).alias("tier")).where("tier <> 'C'"))
    flat = long_form(per.where("segment is not null"), [group, "segment", "n"], {c: c for c in fields}, "field", "filled")
    want = {f"{s}|{f}": t[i] for s, t in targets.items() for i, f in enumerate(fields)}
    target = lookup(want, F.concat_ws("|", "segment", "field"))
    weight = lookup(dict(weights), F.col("segment")) if weights else F.lit(1)
    return (flat.join(tier_of, F.col(group) == F.col("_g")).drop("_g")
            .withColumn("fill", bands.ratio("filled", "n"))
            .withColumn("target", target - F.when(F.col("tier") == "B", slack_b).otherwise(0.0))
            .withColumn("met", F.col("fill") >= F.col("target"))
            .withColumn("weighted_gap", F.greatest(F.col("target") - F.col("fill"), F.lit(0.0)) * weight)
            .select(group, "tier", "segment", "field", F.col("n").alias("records"), "filled", "fill", "met", "weighted_gap"))
