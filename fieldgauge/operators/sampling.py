"""Reproducible samples. Order comes from md5(key + seed), ties from the key,
so a sample does not depend on partitioning or on the engine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.config import SAMPLE_QUOTAS, SAMPLE_SPLIT
from fieldgauge.functions import bands
from fieldgauge.functions.text import lookup, platform_by_substring
from fieldgauge.operators.coverage import worst_states, label_codes
from fieldgauge.operators.scale import broadcast_if_small, lookup_join, top_per_group

SAMPLE_PLATFORMS = tuple(d for d in fv.PLATFORM_DOMAINS if d != "hub.biz")


def hash_order(key: str = "handle", seed: str = "42") -> list[Column]:
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)]


def hash_sample(df: DataFrame, n: int, key: str = "handle", seed: str = "42") -> DataFrame:
    return df.orderBy(*hash_order(key, seed)).limit(n)


def first_rows(df: DataFrame, n: int, key: str = "handle") -> DataFrame:
    return df.orderBy(key).limit(n)


def with_keys(df: DataFrame, keys: DataFrame, key: str = "handle") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def sample_segment() -> Column:
    """Size segment, with high-churn micro firms left out. The exclusion keeps
    SQL's three-valued NOT: an undecided churn test leaves the row out as well."""
    return F.when(F.col("size") == "1-10", F.when(~bands.high_churn(), "micro")).otherwise(bands.segment())


def sample_conditions() -> dict[str, Column]:
    platform = platform_by_substring("website", SAMPLE_PLATFORMS)
    return {"missing_website": F.col("website").isNull(),
            "missing_industry": F.col("industry").isNull(),
            "platform_url": platform}


def quotas(per_segment: Mapping[str, int] = SAMPLE_QUOTAS, split: Mapping[str, float] = SAMPLE_SPLIT) -> dict[str, int]:
    return {f"{s}|{c}": round(n * share) for s, n in per_segment.items() for c, share in split.items()}


def quota_sample(df: DataFrame, per_segment: Mapping[str, int] = SAMPLE_QUOTAS,
                 split: Mapping[str, float] = SAMPLE_SPLIT, seed: str = "42", key: str = "handle") -> DataFrame:
    """Segment x condition quotas. A row may meet two conditions; it is drawn in
    each and then kept under the first one in the order of ``split``."""
    quota = quotas(per_segment, split)
    met = sample_conditions()
    tags = F.array_compact(F.array(*[F.when(met[c], F.lit(c)) for c in split]))
    tagged = (df.where("state is not null").withColumn("poc_segment", sample_segment())
              .where("poc_segment is not null").withColumn("poc_condition", F.explode(tags))
              .withColumn("_quota", lookup(quota, F.concat_ws("|", "poc_segment", "poc_condition"))))
    drawn = top_per_group(tagged, ["poc_segment", "poc_condition"], hash_order(key, seed),
                          F.col("_quota"), max(quota.values()), salt=F.col(key))
    first = Window.partitionBy(key).orderBy(lookup({c: i for i, c in enumerate(split)}, F.col("poc_condition")))
    return (drawn.withColumn("_first", F.row_number().over(first)).where("_first = 1")
            .select(*df.columns, "poc_segment", "poc_condition"))


def sample_composition(sample: DataFrame) -> DataFrame:
    return sample.groupBy("poc_segment", "poc_condition").agg(F.count("*").alias("records"))


def sector_samples(df: DataFrame, label_map: DataFrame, n: int = 15, seed: str = "part2_verify_seed",
                   key: str = "handle") -> DataFrame:
    """Spot-check sample of ``n`` rows of every mapped sector in one job."""
    codes = label_codes(label_map).withColumnRenamed("_s", "sector")
    rows = lookup_join(df.where("state is not null"), codes, F.lower("industry"), "_l", ["sector"]).where("sector is not null")
    return top_per_group(rows, ["sector"], hash_order(key, seed), n, n, salt=F.col(key)).drop("_rank")


def audit_sample(df: DataFrame, cells: DataFrame, label_map: DataFrame, gaps: DataFrame, n: int = 100,
                 forced: int = 2, worst: tuple[int, int] = (10, 5), worst_micro: tuple[int, int] = (8, 4),
                 food_sector: str = "72", seed: str = "record_audit_v1_seed", key: str = "handle") -> DataFrame:
    """Record-audit samples of all gaps in one job; ``gaps`` is a small table of
    (gap, kind, sector) with kind standard, micro or size.

    standard  rows of the sector in its worst covered states, plus ``forced``
              enterprise rows of the sector from anywhere
    micro     1-10 rows of the sector or of food service in the worst states
    size      enterprise rows of any sector

    The pool is read once: each row is tagged with the gaps and strata it may
    serve, and one ranking within (gap, stratum) draws them all.
    """
    pool = df.where("website is not null or industry is not null")
    codes = label_codes(label_map).withColumnRenamed("_s", "_sector")
    ranked = worst_states(cells, max(worst[0], worst_micro[0]), max(worst[1], worst_micro[1]))

    def within(limits: tuple[int, int]) -> Column:
        return F.collect_set(F.when(F.col("rank") <= F.when(F.col("state_tier") == "A", limits[0]).otherwise(limits[1]), F.col("state")))

    states = ranked.groupBy(F.col("sector").alias("_ws")).agg(within(worst).alias("_standard"), within(worst_micro).alias("_micro"))
    named = broadcast_if_small(gaps).join(states, F.col("sector") == F.col("_ws"), "left")
    nowhere = F.array().cast("array<string>")
    rule = F.struct("gap", "kind", F.coalesce(F.when(F.col("kind") == "micro", F.col("_micro")).otherwise(F.col("_standard")), nowhere).alias("states"))
    # per sector of a row, the gaps it may serve: those of its own sector, for micro gaps food service too, size gaps anywhere
    serves = F.array_distinct(F.when(F.col("kind") == "micro", F.array("sector", F.lit(food_sector))).otherwise(F.array("sector")))
    rules = broadcast_if_small(named.where("kind <> 'size'").withColumn("_m", F.explode(serves)).groupBy("_m").agg(F.collect_list(rule).alias("_rules")))
    size_gap = gaps.where("kind = 'size'").agg(F.min("gap")).scalar()

    big = F.coalesce(F.col("size").isin(*bands.ENTERPRISE), F.lit(False))
    tag = lambda gap, stratum, quota: F.struct(gap.alias("gap"), F.lit(stratum).alias("_stratum"), F.lit(quota).alias("_k"))

    def of_sector(r: Column) -> Column:
        placed = F.coalesce(F.array_contains(r["states"], F.col("state")), F.lit(False))
        standard = r["kind"] == "standard"
        return F.array_compact(F.array(
            F.when(standard & placed, tag(r["gap"], 0, n - forced)), F.when(standard & big, tag(r["gap"], 1, forced)),
            F.when(~standard & placed & F.coalesce(F.col("size") == "1-10", F.lit(False)), tag(r["gap"], 0, n))))

    any_sector = F.array_compact(F.array(F.when(big & F.col("state").isNotNull() & size_gap.isNotNull(), tag(size_gap, 0, n))))
    mine = F.coalesce(F.flatten(F.transform("_rules", of_sector)), F.array().cast("array<struct<gap:string,_stratum:int,_k:int>>"))
    tagged = (lookup_join(pool, codes, F.lower("industry"), "_l", ["_sector"]).join(rules, F.col("_sector") == F.col("_m"), "left")
              .select(*df.columns, F.explode(F.concat(mine, any_sector)).alias("_t")).select(*df.columns, "_t.*"))
    drawn = top_per_group(tagged, ["gap", "_stratum"], hash_order(key, seed), F.col("_k"), n, salt=F.col(key))
    once = Window.partitionBy("gap", key).orderBy("_stratum")
    return (drawn.withColumn("_once", F.row_number().over(once)).where("_once = 1")
            .select("gap", *df.columns, (F.col("_stratum") == 1).alias("forced")))


def sampled_states(sample: DataFrame) -> DataFrame:
    """States per gap: at most as many as the sample has rows."""
    return (sample.where("state is not null").groupBy("gap")
            .agg(F.array_sort(F.collect_set("state")).alias("states"), F.count("*").alias("records")))


def union_dedup(parts: Sequence[DataFrame], key: str, order: Sequence[Column]) -> DataFrame:
    """Union of frames keeping one row per key: the earliest part, then ``order``."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_part", *order)
    return out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_part")
