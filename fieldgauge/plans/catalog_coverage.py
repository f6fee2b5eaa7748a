"""Registered sources and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.functions import bands
from fieldgauge.functions.text import first_percentage, lookup
from fieldgauge.operators import coverage as cv, profile as pr, sampling as sa
from fieldgauge.plans.registry import TIER, TIERS, query
from fieldgauge.plans.testbed import (BENCHMARK_CTE, BENCHMARK_SIZE_CTE, CLEANED_CTE, COMPANIES_CTE, LABELS_CTE, benchmark,
                                      benchmark_by_size, call_log, cleaned, companies, sector_labels, table)
from fieldgauge.sources import benchmarks as bm, companies as src
from fieldgauge.sources.log_store import LogStore
from fieldgauge.sources.workspace import new_path

C, K, B, L = COMPANIES_CTE, CLEANED_CTE, BENCHMARK_CTE, LABELS_CTE


ruled = cleaned


# -- sources and sinks ----------------------------------------------------------

_COLS = "handle, name, website, industry, size, type, founded, city, state, country_code"


@query("i1_csv_ingest", f"select {_COLS} from companies where country_code = 'US'", C)
def i1(s, d):
    path = new_path(s, "companies-csv")
    src.write_csv(companies(s, d), path)
    return src.ingest_csv(s, path, "US")


@query("i2_parquet_round_trip", f"select {_COLS} from companies", C)
def i2(s, d):
    path = new_path(s, "companies")
    src.write_parquet(companies(s, d), path)
    return src.read_parquet(s, path)


@query("i4_snapshot", """select count(*) as total_records, count(distinct state) as distinct_states,
 count(distinct industry) as distinct_industries, count(state) as non_null_state, count(name) as non_null_name,
 count(website) as non_null_website from companies""", C)
def i4(s, d):
    return pr.snapshot(companies(s, d))


FIPS = {name: fips for fips, name in bm.STATE_OF_FIPS.items()}


def employer_file(s, d) -> str:
    """Benchmark counts written the way the public employer file looks."""
    b = benchmark(s, d)
    fips = lookup(FIPS, F.col("state"))
    cells = b.select(fips.alias("State"), F.col("state").alias("State Name"), F.col("sector").alias("NAICS"), "employers")
    states = b.groupBy("state").agg(F.sum("employers").alias("employers")).select(
        F.regexp_replace(lookup(FIPS, F.col("state")), "^0", "").alias("State"), F.col("state").alias("State Name"),
        F.lit("--").alias("NAICS"), "employers")
    nation = b.groupBy("sector").agg(F.sum("employers").alias("employers")).select(
        F.lit("00").alias("State"), F.lit("United States").alias("State Name"), F.col("sector").alias("NAICS"), "employers")
    rows = cells.unionByName(states).unionByName(nation)
    sizes = F.explode(F.array(F.lit("01: Total"), F.lit("02: <5")))
    out = rows.withColumn("Enterprise\nSize", sizes).withColumn("Firms", F.format_number("employers", 0)).drop("employers")
    path = new_path(s, "employers-csv")
    out.write.option("header", True).csv(path)
    return path


@query("i5_employer_states", "select state, cast(sum(employers) as bigint) as employers from benchmark_cells group by state", B)
def i5(s, d):
    return bm.employer_states(bm.employer_rows(s, employer_file(s, d)))


@query("i6_employer_sectors", "select sector, cast(sum(employers) as bigint) as employers from benchmark_cells group by sector", B)
def i6(s, d):
    return bm.employer_sectors(bm.employer_rows(s, employer_file(s, d)))


@query("i7_employer_cells", "select state, sector, employers from benchmark_cells", B)
def i7(s, d):
    return bm.employer_cells(bm.employer_rows(s, employer_file(s, d)))


def nonemployer_file(s, d) -> str:
    """Benchmark counts as a non-employer file: plain sectors as two-digit rows,
    range sectors as three-digit rows, one legal form beside the totals, and a
    suppressed count."""
    b = benchmark(s, d).select(lookup(FIPS, F.col("state")).alias("ST"), "sector", "nonemployers")
    plain = b.where(~F.contains("sector", F.lit("-"))).select("ST", F.col("sector").alias("NAICS"), F.col("nonemployers").alias("n"))
    low, high = F.substring("sector", 1, 2), F.substring("sector", 4, 2)
    half = (F.col("nonemployers") / 2).cast("bigint")
    ranges = b.where(F.contains("sector", F.lit("-"))).select("ST", F.explode(F.array(
        F.struct(F.concat(low, F.lit("1")).alias("NAICS"), half.alias("n")),
        F.struct(F.concat(high, F.lit("2")).alias("NAICS"), (F.col("nonemployers") - half).alias("n")),
        F.struct(F.concat(high, F.lit("34")).alias("NAICS"), F.col("nonemployers").alias("n")))).alias("r")).select("ST", "r.*")
    rows = plain.unionByName(ranges)
    forms = F.explode(F.array(F.struct(F.lit("-").alias("LFO"), F.col("n").cast("string").alias("ESTAB")),
                              F.struct(F.lit("C").alias("LFO"), F.lit("7").alias("ESTAB")),
                              F.struct(F.lit("-").alias("LFO"), F.lit("D").alias("ESTAB"))))
    path = new_path(s, "nonemployers-csv")
    rows.select("ST", "NAICS", forms.alias("f")).select("ST", "NAICS", "f.LFO", "f.ESTAB").write.option("header", True).csv(path)
    return path


_SECTORS = ", ".join(f"('{c}')" for c in fv.SECTORS)
_STATES = ", ".join(f"('{n}')" for _, f, n in fv.STATES if f)


@query("i8_nonemployer_sectors", f"""select s as sector, coalesce(n, 0) as nonemployers from (values {_SECTORS}) v(s)
 left join (select sector, cast(sum(nonemployers) as bigint) as n from benchmark_cells group by sector) b on b.sector = s""", B)
def i8(s, d):
    return bm.nonemployer_sectors(bm.nonemployer_rows(s, nonemployer_file(s, d)))


@query("i9_nonemployer_grid", f"""select st as state, s as sector, coalesce(nonemployers, 0) as nonemployers
 from (values {_STATES}) a(st) cross join (values {_SECTORS}) v(s)
 left join benchmark_cells b on b.state = st and b.sector = s""", B)
def i9(s, d):
    return bm.nonemployer_cells(bm.nonemployer_rows(s, nonemployer_file(s, d)))


@query("i10_label_map_inverse", """select sector, array_to_string(list_sort(list(distinct industry)), '|') as labels, cast(sum(n) as bigint) as records
 from (select industry, sector, count(*) as n from companies join label_map on label = industry group by 1, 2) group by sector""", C, L)
def i10(s, d):
    inverse = cv.labels_by_sector(sector_labels(s)).select("sector", F.array_join("labels", "|").alias("labels"))
    return inverse.join(cv.label_counts_to_sector(companies(s, d).withColumn("state", F.lit("any")), sector_labels(s))
                        .withColumnRenamed("our_records", "records"), "sector")


@query("i11_call_log_scan", """select event_type as phase, 'model-' || (user_id%2) as model, count(*) as calls,
 cast(sum(user_id*10) as bigint) as tokens, cast(sum(cast(round(value*100) as bigint)) as bigint) as cents from events group by 1, 2""")
def i11(s, d):
    path = new_path(s, "calls-json")
    call_log(s, d).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "phase", "model",
                          F.col("input_tokens").alias("tokens"), (F.col("cents") / 100).alias("cost"),
                          F.lit("v1").alias("prompt_version"), F.lit("success").alias("outcome"),
                          F.create_map(F.lit("event"), F.col("event_id").cast("string")).alias("metadata")).write.json(path)
    log = src.read_call_log(s, path)
    return log.groupBy("phase", "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"),
                                             F.sum(F.round(F.col("cost") * 100).cast("bigint")).alias("cents"))


@query("i12_upsert", """select handle, name, size from companies where founded % 3 <> 0 or founded is null
 union all select handle, upper(name), '10K+' from companies where founded % 3 = 0""", C)
def i12(s, d):
    old = companies(s, d).select("handle", "name", "size", "founded")
    batch = old.where("founded % 3 = 0").select("handle", F.upper("name").alias("name"), F.lit("10K+").alias("size"))
    stored = LogStore(s)
    stored.apply(old.drop("founded"))
    stored.apply(batch)
    return stored.read()


@query("i14_first_rows", "select handle, name from companies order by handle limit 50", C)
def i14(s, d):
    return sa.first_rows(companies(s, d).select("handle", "name"), 50)


@query("i14_by_key_list", """select handle, name, state from companies where handle in
 (select 'company/' || l_orderkey from lineitem where l_returnflag = 'R' and l_quantity > 45)""", C)
def i14b(s, d):
    keys = (table(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45")
            .select(F.concat(F.lit("company/"), F.col("l_orderkey").cast("string")).alias("handle")))
    return sa.with_keys(companies(s, d).select("handle", "name", "state"), keys)


# -- coverage ----------------------------------------------------------------------

GAP = "case when {r} < 0.10 then 'HIGH_GAP' when {r} < 0.30 then 'MODERATE_GAP' else 'ADEQUATE' end"
OURS_STATE = "ours_state as (select state, count(*) as our_records from cleaned where state is not null group by state)"
OURS_SECTOR = """ours_sector as (select coalesce(sector, '99') as sector, count(*) as our_records from cleaned
 left join label_map on lower(industry) = label where state is not null group by 1)"""
OURS_CELL = """ours_cell as (select state, coalesce(sector, '99') as sector, count(*) as our_records from cleaned
 left join label_map on lower(industry) = label where state is not null group by 1, 2)"""
CELLS = f"""cells as (select *, {GAP.format(r='coverage')} as gap_tier from (
 select b.state, b.sector, t.state_tier, coalesce(o.our_records, 0) as our_records, b.employers, b.nonemployers,
  b.employers + b.nonemployers as universe,
  coalesce(o.our_records, 0) / nullif(cast(b.employers + b.nonemployers as double), 0) as coverage
 from benchmark_cells b left join ours_cell o using (state, sector)
 join (select state, {TIER.format(c='our_records')} as state_tier from ours_state) t on t.state = b.state
 where t.state_tier in ('A','B')))"""
ALL = (C, K, B, L, OURS_STATE, OURS_SECTOR, OURS_CELL, CELLS)


def state_totals(s, d):
    return cv.key_counts(ruled(s, d), "state")


def cells(s, d):
    """State x sector grid. One aggregation of the cleaned table by (state,
    sector) feeds both the cells and the state totals."""
    ours = cv.label_counts_to_sector(ruled(s, d), sector_labels(s), ["state"])
    totals = ours.groupBy("state").agg(F.sum("our_records").alias("our_records"))
    return cv.gap_cells(benchmark(s, d), None, ours, totals, tiers=TIERS)


def employers_by(s, d, key):
    return benchmark(s, d).groupBy(key).agg(F.sum("employers").alias("employers"))


@query("j1_state_coverage", f"""select state, employers, coalesce(our_records, 0) as our_records,
 coalesce(our_records, 0)/cast(employers as double) as coverage, {GAP.format(r='coalesce(our_records, 0)/cast(employers as double)')} as gap_tier,
 {TIER.format(c='coalesce(our_records, 0)')} as volume_tier
 from (select state, cast(sum(employers) as bigint) as employers from benchmark_cells group by state) left join ours_state using (state)""", *ALL)
def j1(s, d):
    return cv.coverage(employers_by(s, d, "state"), state_totals(s, d), "state", tiers=TIERS)


@query("j2_frequent_labels", """select industry, count(*) as records from companies where state is not null and industry is not null
 group by industry having count(*) >= 500""", C)
def j2(s, d):
    return cv.frequent_labels(companies(s, d))


@query("j3_sector_counts", "select sector, our_records from ours_sector", *ALL)
def j3(s, d):
    return cv.label_counts_to_sector(ruled(s, d), sector_labels(s))


@query("j4_cell_counts", "select state, sector, our_records from ours_cell", *ALL)
def j4(s, d):
    return cv.label_counts_to_sector(ruled(s, d), sector_labels(s), ["state"])


@query("j5_sector_coverage", f"""select sector, employers, coalesce(our_records, 0) as our_records,
 coalesce(our_records, 0)/cast(employers as double) as coverage, {GAP.format(r='coalesce(our_records, 0)/cast(employers as double)')} as gap_tier
 from (select sector, cast(sum(employers) as bigint) as employers from benchmark_cells group by sector) left join ours_sector using (sector)""", *ALL)
def j5(s, d):
    return cv.coverage(employers_by(s, d, "sector"), cv.label_counts_to_sector(ruled(s, d), sector_labels(s)), "sector")


COMBINED = f"""combined as (select *, {GAP.format(r='coverage')} as gap_tier from (
 select sector, our_records, employers, nonemployers, employers+nonemployers as universe, our_records*100e0/employers as employer_only_pct,
  our_records/cast(employers+nonemployers as double) as coverage from
 (select sector, cast(sum(employers) as bigint) as employers, cast(sum(nonemployers) as bigint) as nonemployers from benchmark_cells group by sector)
 join ours_sector using (sector)))"""


def combined(s, d):
    b = benchmark(s, d).groupBy("sector").agg(F.sum("employers").alias("employers"), F.sum("nonemployers").alias("nonemployers"))
    return cv.combined_coverage(b, None, cv.label_counts_to_sector(ruled(s, d), sector_labels(s)))


@query("j6_combined_coverage", "select * from combined", *ALL, COMBINED)
def j6(s, d):
    return combined(s, d)


@query("j7_over_indexed", "select sector, employer_only_pct, coverage from combined where employer_only_pct > 80", *ALL, COMBINED)
def j7(s, d):
    return cv.over_indexed(combined(s, d), 80.0)


NAME = "case sector " + " ".join(f"when '{c}' then '{n}'" for c, n in fv.SECTORS.items()) + " end"
SOURCE = "case when sector in ('55','99') then 'employers' else 'employers+nonemployers' end"


@query("j7_best_indexed", """select sector, employer_only_pct, coverage from combined
 where employer_only_pct > (select avg(employer_only_pct) from combined)""", *ALL, COMBINED)
def j7_best(s, d):
    """Sectors over the mean of all, so that rows pass the threshold whatever the counts."""
    all_ = combined(s, d)
    mean = all_.agg(F.avg("employer_only_pct")).scalar()
    return all_.where(F.col("employer_only_pct") > mean).transform(cv.over_indexed, float("-inf"))


@query("j8_gap_cells", f"select *, {NAME} as sector_name, {SOURCE} as source from cells", *ALL)
def j8(s, d):
    return cells(s, d)


@query("j9_gap_tiers", f"""select sector, state, {GAP.format(r='coverage')} as tier from
 (select state, sector, employers/nullif(cast(employers+nonemployers*4 as double),0) as coverage from benchmark_cells)""", B)
def j9(s, d):
    b = benchmark(s, d)
    return b.select("sector", "state", bands.gap_tier(bands.ratio("employers", F.col("employers") + F.col("nonemployers") * 4)).alias("tier"))


_GIG = "sector in ('48-49','81','56','53')"
CAND = f"""cand as (select replace(state,' ','_') || '_' || replace(sector,'-','_') as gap_id, 'industry x state' as dimension,
 state || ' / ' || {NAME} as slice, state, sector, {NAME} as sector_name, our_records, employers, nonemployers, universe, {SOURCE} as source,
 coverage, gap_tier as tier, state_tier,
 round(case when gap_tier='HIGH_GAP' and state_tier='A' then 0.90e0 when gap_tier='HIGH_GAP' or state_tier='A' then 0.75e0 else 0.60e0 end
  - case when {_GIG} then 0.10e0 else 0e0 end, 2) as confidence, 'unverified' as status,
 concat_ws(' | ', case when {_GIG} then '{cv.CAVEAT_GIG}' end, case when sector in ('55','99') then '{cv.CAVEAT_EMPLOYER_ONLY}' end,
  case when state_tier='B' then '{cv.CAVEAT_TIER_B}' end) as caveats from cells where gap_tier <> 'ADEQUATE')"""


@query("j10_gap_candidates", "select * from cand", *ALL, CAND)
def j10(s, d):
    return cv.gap_candidates(cells(s, d)).withColumn("caveats", F.array_join("caveats", " | "))


@query("j11_gap_summary", """select count(distinct state) as states, count(distinct sector) as sectors, count(*) as cells,
 count(distinct case when state_tier='A' then state end) as tier_a_states, count(distinct case when state_tier='B' then state end) as tier_b_states,
 count(*) filter (gap_tier='HIGH_GAP') as high_cells, count(*) filter (gap_tier='MODERATE_GAP') as moderate_cells,
 count(*) filter (gap_tier='ADEQUATE') as adequate_cells, count(*) filter (gap_tier<>'ADEQUATE') as candidates from cells""", *ALL)
def j11(s, d):
    return cv.gap_summary(cells(s, d))


@query("j11_top_gap_sectors", f"""select sector, {NAME} as sector_name, count(*) as state_count from cells where gap_tier='HIGH_GAP'
 group by sector order by 3 desc, 1 limit 5""", *ALL)
def j11b(s, d):
    return cv.top_gap_sectors(cells(s, d))


ROLL = f"""roll as (select sector, {NAME} as sector_name, count(*) as states, count(*) filter (gap_tier='HIGH_GAP') as high_states,
 count(*) filter (gap_tier='MODERATE_GAP') as moderate_states, count(*) filter (gap_tier='ADEQUATE') as adequate_states,
 list_sort(list(coverage))[count(*)//2 + 1] as median_coverage, cast(sum(our_records) as bigint) as our_records,
 cast(sum(universe) as bigint) as universe, cast(sum(employers) as bigint) as employers, cast(sum(nonemployers) as bigint) as nonemployers
 from cells group by sector),
rollx as (select *, our_records/cast(universe as double) as overall_coverage, nonemployers/cast(universe as double) as nonemployer_share,
 our_records/cast(employers as double) as employer_coverage from roll)"""


@query("j12_sector_rollup", "select * from rollx", *ALL, ROLL)
def j12(s, d):
    return cv.sector_rollup(cells(s, d))


@query("j13_actionable_sectors", """select *, case when nonemployer_share >= 0.70 and employer_coverage >= 0.35 then 'SOURCING_LIMIT' else 'ACTIONABLE' end as class,
 nonemployer_share >= 0.70 and employer_coverage < 0.35 as inflated_but_real from rollx""", *ALL, ROLL)
def j13(s, d):
    return cv.classify_sectors(cv.sector_rollup(cells(s, d)))


_RANKED = [("48-49", 1), ("23", 2), ("31-33", 3)]


@query("j14_sector_detail", """select case sector when '48-49' then 1 when '23' then 2 else 3 end as rank, sector, state, state_tier, our_records,
 coverage, tier, caveats from cand where sector in ('48-49','23','31-33')""", *ALL, CAND)
def j14(s, d):
    ranked = s.createDataFrame(_RANKED, "sector string, rank int")
    return cv.sector_detail(cv.gap_candidates(cells(s, d)), ranked).withColumn("caveats", F.array_join("caveats", " | "))


WORST = """worst as (select sector, state_tier, cast(rn as integer) as rank, state, coverage from (select *, row_number() over (partition by sector, state_tier
 order by coverage, state) as rn from cells) where rn <= case when state_tier='A' then {a} else {b} end)"""


@query("j15_worst_states", "select * from worst", *ALL, WORST.format(a=2, b=1))
def j15(s, d):
    return cv.worst_states(cells(s, d), 2, 1)


@query("j16_slice_counts", "select sector, our_records as slice_records from ours_sector where sector <> '99'", *ALL)
def j16(s, d):
    return cv.slice_counts(ruled(s, d), sector_labels(s))


@query("j16_one_slice", "select count(*) as records from cleaned where state is not null and industry = 'construction'", C, K)
def j16b(s, d):
    return cv.in_sector(ruled(s, d), sector_labels(s), "23").agg(F.count("*").alias("records"))


SPOT = """spot as (select * from (select c.*, l.sector, row_number() over (partition by l.sector order by md5(handle || 'part2_verify_seed'), handle) as rn
 from cleaned c join label_map l on lower(industry) = label where state is not null) where rn <= 15)"""


def spot(s, d):
    return sa.sector_samples(ruled(s, d), sector_labels(s))


_FILLS = ", ".join(f"count({c})*100e0/count(*) as {c}_fill_pct" for c in ("website", "industry", "size", "state", "city"))


@query("j17_slice_stats", f"select sector, count(*) as n, {_FILLS} from spot group by sector", *ALL, SPOT)
def j17(s, d):
    return cv.slice_stats(spot(s, d))


@query("j17_slice_top_states", """select sector, state, records, cast(rn as integer) as rank from (select sector, state, count(*) as records,
 row_number() over (partition by sector order by count(*) desc, state) as rn from spot group by sector, state) where rn <= 5""", *ALL, SPOT)
def j17b(s, d):
    return cv.slice_top_states(spot(s, d))


@query("j17_slice_sizes", "select sector, coalesce(size, '(null)') as size, count(*) as records from spot group by 1, 2", *ALL, SPOT)
def j17c(s, d):
    return spot(s, d).groupBy("sector", F.coalesce("size", F.lit("(null)")).alias("size")).agg(F.count("*").alias("records"))


@query("j18_verdicts", """select sector, nonemployer_share, employer_coverage, slice_records, website_fill_pct, industry_fill_pct,
 case when nonemployer_share > 0.70 and employer_coverage >= 0.35 then 'ARTIFACT' when nonemployer_share > 0.70 then 'CONFIRMED'
  when slice_records < 1000 then 'CONFIRMED' else 'PLAUSIBLE' end as verdict,
 case when nonemployer_share > 0.70 and employer_coverage >= 0.35 then printf('%.0f%%', nonemployer_share * 100) || ' non-employers while employer coverage is ' || printf('%.1f%%', employer_coverage * 100)
  when nonemployer_share > 0.70 then 'employer coverage is only ' || printf('%.1f%%', employer_coverage * 100) || ' under ' || printf('%.0f%%', nonemployer_share * 100) || ' non-employers'
  when slice_records < 1000 then 'only ' || slice_records || ' rows in this slice'
  when coalesce(website_fill_pct, 100) < 40 and coalesce(industry_fill_pct, 100) < 50 then 'rows exist but the sample is poorly filled'
  else slice_records || ' rows in this slice support the gap in direction' end as why
 from rollx join (select sector, our_records as slice_records from ours_sector) using (sector)
 join (select sector, count(website)*100e0/count(*) as website_fill_pct, count(industry)*100e0/count(*) as industry_fill_pct from spot group by sector)
 using (sector)""", *ALL, ROLL, SPOT)
def j18(s, d):
    roll = cv.sector_rollup(cells(s, d)).select("sector", "nonemployer_share", "employer_coverage")
    joined = (roll.join(cv.slice_counts(ruled(s, d), sector_labels(s)), "sector")
              .join(cv.slice_stats(spot(s, d)).select("sector", "website_fill_pct", "industry_fill_pct"), "sector"))
    return cv.verdict(joined)


@query("j19_first_percentage", r"""select doc_id, coalesce(try_cast(nullif(regexp_extract(t, '(\d+(?:\.\d+)?)\s*%', 1), '') as double), 0e0) as pct
 from (select doc_id, text || ' about ' || (n_chars%997)/10e0 || ' % of rows' as t from documents)""")
def j19(s, d):
    t = F.concat("text", F.lit(" about "), (F.col("n_chars") % 997 / F.lit(10.0)).cast("string"), F.lit(" % of rows"))
    return table(s, d, "documents").select("doc_id", first_percentage(t).alias("pct"))


@query("j20_issue_counts", """select gap, issue, count(*) as records from (select l_shipdate is not null, l_returnflag as gap,
 unnest([case when l_discount >= 0.08 then 'website_mismatch' else 'clean' end, case when l_tax >= 0.06 then 'industry_mislabel' else 'clean' end]) as issue
 from lineitem) where issue <> 'clean' group by 1, 2""")
def j20(s, d):
    findings = table(s, d, "lineitem").select(F.col("l_returnflag").alias("gap"), F.array(
        F.when(F.col("l_discount") >= 0.08, "website_mismatch").otherwise("clean"),
        F.when(F.col("l_tax") >= 0.06, "industry_mislabel").otherwise("clean")).alias("issues"))
    return cv.issue_counts(findings)


@query("j21_ranked_sectors", """select sector, priority, relevance from (select sector, case when employer_coverage < 0.5 then 'HIGH'
 when employer_coverage < 0.7 then 'MEDIUM' else 'LOW' end as priority, universe as relevance from rollx)
 order by case priority when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, relevance desc, sector limit 5""", *ALL, ROLL)
def j21(s, d):
    e = F.col("employer_coverage")
    scores = cv.sector_rollup(cells(s, d)).select("sector", F.when(e < 0.5, "HIGH").when(e < 0.7, "MEDIUM").otherwise("LOW").alias("priority"),
                                                  F.col("universe").alias("relevance"))
    return cv.rank_sectors(scores)


@query("j22_size_cells", f"""select *, {GAP.format(r='coverage')} as gap_tier from (select b.state, b.size, t.state_tier,
 coalesce(o.our_records, 0) as our_records, employers, 0 as nonemployers, employers as universe,
 coalesce(o.our_records, 0)/nullif(cast(employers as double), 0) as coverage from benchmark_sizes b
 left join (select state, size, count(*) as our_records from cleaned where state is not null and size is not null group by 1, 2) o using (state, size)
 join (select state, {TIER.format(c='our_records')} as state_tier from ours_state) t on t.state = b.state where state_tier in ('A','B'))""",
       *ALL, BENCHMARK_SIZE_CTE)
def j22(s, d):
    df = ruled(s, d).where("state is not null")
    counts = df.groupBy("state", "size").agg(F.count("*").alias("our_records"))
    totals = counts.groupBy("state").agg(F.sum("our_records").alias("our_records"))
    return cv.gap_cells(benchmark_by_size(s, d), None, counts.where("size is not null"), totals, "size", tiers=TIERS)


