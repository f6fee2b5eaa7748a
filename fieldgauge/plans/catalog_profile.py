"""Registered profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.config import PARITY_TARGETS
from fieldgauge.functions import bands
from fieldgauge.functions.text import host
from fieldgauge.operators import anomalies as an, cleaning as cl, profile as pr, sketches as sk
from fieldgauge.plans.registry import BAND_ORD, SEGMENT, SET_CTE, TIER, TIERS, US_CTE, VALID, query, quoted
from fieldgauge.plans.testbed import CLEANED_CTE, COMPANIES_CTE, cleaned, companies, table
from fieldgauge.sources.workspace import new_path

C, K = COMPANIES_CTE, CLEANED_CTE
BLOCKED = quoted(fv.PLATFORM_DOMAINS)


def us(s, d):
    return pr.in_valid_state(companies(s, d))


def placed(s, d):
    """Cleaned rows that have a state."""
    return cleaned(s, d).where("state is not null")


@query("p1_record_counts", f"""
select count(*) as total_raw, count(*) filter (state in ({VALID})) as valid_state,
 count(*) filter (state is null) as null_state,
 count(*) filter (state is not null and state not in ({VALID})) as invalid_state,
 count(*) filter (state in ({VALID})) * 100e0 / count(*) as valid_pct,
 (count(*) - count(*) filter (state in ({VALID}))) * 100e0 / count(*) as excluded_pct from companies""", C)
def p1(s, d):
    return pr.state_counts(companies(s, d))


_FIELDS = pr.COMPANY_FIELDS


@query("p2_fill_rates", " union all ".join(
    f"select '{f}' as field, count({f}) as filled, count({f}) * 100e0 / count(*) as fill_pct from us" for f in _FIELDS), C, US_CTE)
def p2(s, d):
    return pr.fill_rates(us(s, d))


def _dist_sql(c, alias=None, k=None):
    alias = alias or c
    return f"""select coalesce({c}, '(null)') as {alias}, count(*) as records,
 count(*) * 100e0 / (select count(*) from us) as pct from us group by 1
 order by records desc, 1 {'limit ' + str(k) if k else ''}"""


@query("p3_industry_distribution", _dist_sql("industry", k=25), C, US_CTE)
def p3(s, d):
    return pr.distribution(us(s, d), "industry", 25)


@query("p4_size_distribution", _dist_sql("size"), C, US_CTE)
def p4(s, d):
    return pr.distribution(us(s, d), "size")


@query("p4_type_distribution", _dist_sql("type", "company_type"), C, US_CTE)
def p4b(s, d):
    return pr.distribution(us(s, d), "type", alias="company_type")


def _fill_by(g):
    return f"""select {g}, count(*) as records, count(website)*100e0/count(*) as website_fill_pct,
 count(industry)*100e0/count(*) as industry_fill_pct, count(size)*100e0/count(*) as size_fill_pct,
 (count(website)+count(industry)+count(size))*100e0/(3e0*count(*)) as avg_fill_pct,
 {TIER.format(c='count(*)')} as tier from us group by {g}"""


@query("p5_fill_by_state", _fill_by("state"), C, US_CTE)
def p5(s, d):
    return pr.fill_by_group(us(s, d), ["state"], tiers=TIERS)


@query("p6_volume_tiers", f"""select state, count(*) as records, count(*)*100e0/(select count(*) from us) as pct,
 {TIER.format(c='count(*)')} as tier from us group by state""", C, US_CTE)
def p6(s, d):
    return pr.volume_tiers(us(s, d), tiers=TIERS)


@query("p7_tier_summary", f"""select {TIER.format(c='n')} as tier, count(*) as groups_in_tier,
 cast(sum(n) as bigint) as total_records, min(n) as min_records, max(n) as max_records
 from (select state, count(*) as n from us group by state) group by 1""", C, US_CTE)
def p7(s, d):
    return pr.tier_summary(us(s, d), tiers=TIERS)


@query("p8_quality_flags", r"""select count(*) as total,
 count(*) filter (website is not null and not regexp_matches(website, '^(https?://|www\.)?.+\..{2,}')) as malformed_website,
 count(*) filter (founded < 1800) as suspicious_founded, count(*) filter (founded > 2026) as future_founded,
 count(*) filter (length(trim(name)) < 2) as short_name, count(*) filter (city is null) as missing_city,
 (select coalesce(cast(sum(n) as bigint), 0) from (select count(*) as n from us where name is not null
  group by lower(trim(name)), state having count(*) > 1)) as duplicate_records from us""", C, US_CTE)
def p8(s, d):
    return pr.quality_flags(us(s, d))


def _key_sql(label, parts, sources):
    nulls = " or ".join(f"{x} is null" for x in sources)
    return f"""select '{label}' as candidate_key, count(*) as total_records, count(distinct {parts}) as distinct_values,
 count(*) - count(distinct {parts}) as duplicates, (count(*) - count(distinct {parts})) * 100e0 / count(*) as collision_pct,
 count(*) filter ({nulls}) as nulls_in_key from us"""


_DOMAIN = r"nullif(regexp_extract(lower(coalesce(website,'')), '(?:https?://)?(?:www\.)?([^/?#\s]+)', 1), '')"


_KEYS_SQL = " union all ".join([
    _key_sql("handle", "(handle,)", ["handle"]).replace("(handle,)", "handle"),
    _key_sql("name + state", "(lower(trim(name)), state)", ["name", "state"]),
    _key_sql("name + domain", f"(lower(trim(name)), {_DOMAIN})", ["name", "website"]),
    _key_sql("name + city + state", "(lower(trim(name)), lower(trim(city)), state)", ["name", "city", "state"])])


@query("p9_candidate_keys", _KEYS_SQL, C, US_CTE)
def p9(s, d):
    return pr.key_report(us(s, d))


@query("p9_keys_from_sketches", f"select candidate_key, total_records, nulls_in_key, true as within_error from ({_KEYS_SQL})", C, US_CTE)
def p9_sketches(s, d):
    """Four snapshots are sketched one by one and put aside; the keys of all are read off the stored sketches, and the exact
    counts only judge them."""
    path = new_path(s, "key-sketches")
    for batch in range(4):
        sk.store_batch(us(s, d).where(F.pmod(F.hash("handle"), F.lit(4)) == batch), pr.report_keys(), path, batch)
    exact = pr.key_report(us(s, d)).select("candidate_key", "distinct_values")
    return sk.key_estimates(s, path).join(exact, "candidate_key").select(
        "candidate_key", "total_records", "nulls_in_key", F.col("distinct_values").between(F.col("distinct_low"), F.col("distinct_high")).alias("within_error"))


@query("p10_key_name_city_state", _key_sql(
    "name + city + state", "(lower(trim(name)), lower(trim(city)), state)", ["name", "city", "state"]), C, US_CTE)
def p10(s, d):
    return pr.candidate_key(us(s, d), "name + city + state",
                            [F.lower(F.trim("name")).alias("n"), F.lower(F.trim("city")).alias("c"), F.col("state")],
                            ["name", "city", "state"])


@query("p11_duplicate_groups", """select lower(trim(name)) as norm_name, state, count(*) as occurrences from us
 where name is not null group by 1, 2 having count(*) > 1 order by 3 desc, 1, 2 limit 20""", C, US_CTE)
def p11(s, d):
    return pr.duplicate_groups(us(s, d).where("name is not null"),
                               {"norm_name": F.lower(F.trim("name")), "state": F.col("state")})


@query("p12_state_coverage", f"""select count(*) as total_raw, count(*) filter (state in ({VALID})) as valid_state,
 count(*) filter (state is null) as null_state, count(*) filter (state is not null and state not in ({VALID})) as invalid_state,
 (count(*) - count(*) filter (state in ({VALID}))) * 100e0 / count(*) as excluded_pct from companies""", C)
def p12(s, d):
    return pr.state_counts(companies(s, d)).drop("valid_pct")


_BIG = quoted(fv.SIZE_BANDS[2:])
_BAD = f"(state is null or state not in ({VALID}))"


@query("p13_exclusion_by_band", f"""
select size, count(*) as total, count(*) filter ({_BAD}) as excluded, count(*) filter ({_BAD})*100e0/count(*) as excluded_pct,
 {BAND_ORD.format(c='size')} as sort_key from companies where size in ({_BIG}) group by size
union all select 'TOTAL (51+)', count(*), count(*) filter ({_BAD}), count(*) filter ({_BAD})*100e0/count(*), 99
 from companies where size in ({_BIG})""", C)
def p13(s, d):
    return pr.exclusion_by_band(companies(s, d))


@query("p14_top_invalid_states", f"""select state, count(*) as records from companies
 where state is not null and state not in ({VALID}) group by state order by records desc, state limit 15""", C)
def p14(s, d):
    return pr.top_invalid(companies(s, d), "state", bands.STATE_NAMES)


def _top_sql(c, k=None):
    return f"""select {c}, count(*) as records from companies where {c} is not null group by {c}
 order by records desc, {c} {'limit ' + str(k) if k else ''}"""


@query("p15_sanity_states", _top_sql("state", 20), C)
def p15a(s, d):
    return pr.top_values(companies(s, d), "state", 20)


@query("p15_sanity_distinct_states", "select count(distinct state) as distinct_states from companies", C)
def p15b(s, d):
    return companies(s, d).agg(F.count_distinct("state").alias("distinct_states"))


@query("p15_sanity_industries", _top_sql("industry", 15), C)
def p15c(s, d):
    return pr.top_values(companies(s, d), "industry", 15)


@query("p15_sanity_sizes", _top_sql("size"), C)
def p15d(s, d):
    return pr.top_values(companies(s, d), "size")


@query("p15_sanity_websites", "select distinct website from companies where website is not null order by 1 limit 10", C)
def p15e(s, d):
    return pr.distinct_values(companies(s, d), "website", 10)


@query("p16_segment_quality", f"""select coalesce({SEGMENT.format(c='size')}, 'size_unknown') as segment, count(*) as records,
 count(website)*100e0/count(*) as website_fill_pct, count(industry)*100e0/count(*) as industry_fill_pct,
 count(*)*100e0/(select count(*) from placed) as pct from placed group by 1""", C, K, SET_CTE)
def p16(s, d):
    return pr.segment_quality(placed(s, d))


@query("p17_worst_cells", """select size, industry, count(*) as records, count(website)*100e0/count(*) as website_fill_pct
 from placed where size is not null and industry is not null group by 1, 2 having count(*) > 100
 order by website_fill_pct, size, industry limit 8""", C, K, SET_CTE)
def p17(s, d):
    return pr.worst_cells(placed(s, d), min_n=100)


@query("p18_scope", """select count(*) as total, count(*) filter (size='1-10') as micro,
 count(*) filter (size<>'1-10') as eleven_plus, count(*) filter (size is null) as size_null from placed""", C, K, SET_CTE)
def p18(s, d):
    return pr.scope_breakdown(placed(s, d))


_MF = """count(*) as records, count(*)-count(website) as website_missing, count(website)*100e0/count(*) as website_fill_pct,
 count(*)-count(industry) as industry_missing, count(industry)*100e0/count(*) as industry_fill_pct"""


@query("p19_fill_by_band", f"select size, {_MF} from placed where size <> '1-10' group by size", C, K, SET_CTE)
def p19(s, d):
    return pr.fill_by_band(placed(s, d))


@query("p19_fill_eleven_plus", f"select {_MF} from placed where size <> '1-10'", C, K, SET_CTE)
def p19b(s, d):
    return pr.fill_eleven_plus(placed(s, d))


_PLAT = f"""(regexp_extract(lower(website), 'https?://(?:www[.])?([^/]+)', 1) in ({BLOCKED})
 or regexp_extract(lower(website), '^(?:www[.])?([^/]+)', 1) in ({BLOCKED}))"""


@query("p20_platform_by_segment", f"""select case when size='1-10' then 'micro_1-10' when size is null then 'size_null' else '11+' end
 as segment, count(*) as platform_urls from us where website is not null and {_PLAT} group by 1""", C, US_CTE)
def p20(s, d):
    return pr.platform_by_segment(us(s, d))


_PAIRS = [p for pair in fv.DUPLICATE_LABELS for p in pair]
# the duplicate-label columns of the view hold one label of a pair; add a pair that both occur
_TEST_PAIRS = (("construction", "retail"), *fv.DUPLICATE_LABELS)


@query("p21_true_gap", f"""select count(*) filter (website is null) as website_missing,
 count(*) filter (website is not null and {_PLAT}) as platform_urls,
 count(*) filter (website is null or {_PLAT}) as website_true_gap,
 count(*) filter (industry is null or lower(industry) in ({quoted(_PAIRS)})) as industry_quality_gap
 from us where size <> '1-10'""", C, US_CTE)
def p21(s, d):
    return pr.true_gap(us(s, d))


@query("p22_label_pairs", " union all ".join(f"""select '{a}' as label_a, '{b}' as label_b,
 count(*) filter (lower(industry)='{a}') as count_a, count(*) filter (lower(industry)='{b}') as count_b,
 count(*) filter (lower(industry) in ('{a}','{b}')) as combined from placed where size <> '1-10'""" for a, b in _TEST_PAIRS), C, K, SET_CTE)
def p22(s, d):
    return pr.label_pair_counts(pr.eleven_plus(placed(s, d)), _TEST_PAIRS)


@query("p23_worst_states", """select state, count(*) as records, count(website)*100e0/count(*) as website_fill_pct,
 count(industry)*100e0/count(*) as industry_fill_pct from placed where size <> '1-10' group by state
 having count(*) >= 300 order by website_fill_pct, state limit 10""", C, K, SET_CTE)
def p23(s, d):
    return pr.worst_groups(pr.eleven_plus(placed(s, d)), min_n=300)


@query("p24_pivot_fill", f"""select state,
 count(*) filter (g='mid_market') as mid_market_n, count(*) filter (g='enterprise') as enterprise_n,
 count(website) filter (g='mid_market')*100e0/nullif(count(*) filter (g='mid_market'),0) as mid_market_website_pct,
 count(website) filter (g='enterprise')*100e0/nullif(count(*) filter (g='enterprise'),0) as enterprise_website_pct
 from (select *, {SEGMENT.format(c='size')} as g from us) group by state""", C, US_CTE)
def p24(s, d):
    return pr.pivot_fill(us(s, d).withColumn("segment", bands.segment()))


@query("p25_vintage_by_band", """select size, count(*) as records, count(website)*100e0/count(*) as website_fill_pct,
 count(industry)*100e0/count(*) as industry_fill_pct, (count(*)-count(type))*100e0/count(*) as type_null_pct,
 cast(sum(2026-founded) as double)/count(founded) as mean_age from us where size is not null group by size""", C, US_CTE)
def p25(s, d):
    return pr.vintage_by_band(us(s, d))


_NC = ("website", "industry", "size", "type")


@query("p26_null_rate_by_band", "select size, count(*) as records, " + ", ".join(
    f"(count(*)-count({c}))*100e0/count(*) as {c}_null_pct, (count(*)-count({c}))*100e0/count(*) - "
    f"(select (count(*)-count({c}))*100e0/count(*) from us) as {c}_vs_all" for c in ("website", "industry", "type")) +
    " from us group by size", C, US_CTE)
def p26(s, d):
    return pr.null_rate_by(us(s, d), "size", ("website", "industry", "type"))


@query("p26_null_rate_by_state", "select state, count(*) as records, " + ", ".join(
    f"(count(*)-count({c}))*100e0/count(*) as {c}_null_pct, (count(*)-count({c}))*100e0/count(*) - "
    f"(select (count(*)-count({c}))*100e0/count(*) from us) as {c}_vs_all" for c in _NC) + " from us group by state", C, US_CTE)
def p26b(s, d):
    return pr.null_rate_by(us(s, d), "state")


@query("p26_null_rate_by_tier", f"select {TIER.format(c='n')} as tier, cast(sum(n) as bigint) as records, " + ", ".join(
    f"cast(sum(n)-sum(n_{c}) as bigint)*100e0/cast(sum(n) as bigint) as {c}_null_pct" for c in _NC) +
    " from (select state, count(*) as n, " + ", ".join(f"count({c}) as n_{c}" for c in _NC) +
    " from us group by state) group by 1", C, US_CTE)
def p26c(s, d):
    return pr.null_rate_by_tier(us(s, d), tiers=TIERS)


@query("p27_co_missing", " union all ".join(
    f"""select '{a}' as given_null, '{b}' as field, count(*) filter ({a} is null) as given_n,
 count(*) filter ({a} is null and {b} is null) as both_n,
 count(*) filter ({a} is null and {b} is null)*100e0/nullif(count(*) filter ({a} is null),0) as rate_pct from us"""
    for a in _NC for b in _NC if a != b), C, US_CTE)
def p27(s, d):
    return pr.co_missing(us(s, d))


@query("p28_missing_pattern", " union all ".join(f"""select '{c}' as field, min(r) as min_pct, max(r) as max_pct,
 max(r)-min(r) as spread, case when max(r)-min(r) >= 5 then 'varies' else 'uniform' end as pattern
 from (select (count(*)-count({c}))*100e0/count(*) as r from us group by state)""" for c in ("website", "industry", "type")), C, US_CTE)
def p28(s, d):
    return pr.missing_pattern(us(s, d), "state")


@query("p29_frequent_websites", """select website, count(*) as records, count(*)*100e0/(select count(*) from us) as pct
 from us where website is not null group by website having count(*) > (select count(*) from us)*0.001""", C, US_CTE)
def p29(s, d):
    return an.frequency_anomaly(us(s, d), "website")


@query("p29_frequent_page_urls", """select url, count(*) as records, count(*)*100e0/(select count(*) from pages) as pct
 from pages where url is not null group by url having count(*) > (select count(*) from pages)*0.001""")
def p29b(s, d):
    return an.frequency_anomaly(table(s, d, "pages"), "url")


_HOST = r"regexp_replace(regexp_extract(regexp_replace(lower(trim({c})), '^https?://', ''), '^([^/?#]*)', 1), '^www\.', '')"


@query("p30_shared_domains", f"""select domain, count(distinct handle) as keys, count(*) as records from
 (select handle, {_HOST.format(c='website')} as domain from us where website is not null)
 where domain <> '' group by domain having count(distinct handle) >= 50""", C, US_CTE)
def p30(s, d):
    return an.shared_domains(us(s, d), host("website"))


@query("p30_shared_page_hosts", f"""select domain, count(distinct page_id) as keys, count(*) as records from
 (select page_id, {_HOST.format(c='url')} as domain from pages) where domain <> '' group by domain
 having count(distinct page_id) >= 3""")
def p30b(s, d):
    return an.shared_domains(table(s, d, "pages"), host("url"), 3, "page_id")


@query("p31_enum_check", f"""select 'size' as field, count(*) filter (size is not null and size not in ({quoted(fv.SIZE_BANDS)})) as out_of_set,
 count(*) filter (size is null) as nulls from companies
union all select 'type', count(*) filter (type is not null and type not in ({quoted(fv.ENTITY_TYPES)})), count(*) filter (type is null) from companies
union all select 'state', count(*) filter (state is not null and state not in ({VALID})), count(*) filter (state is null) from companies""", C)
def p31(s, d):
    return an.enum_check(companies(s, d), {"size": fv.SIZE_BANDS, "type": fv.ENTITY_TYPES, "state": bands.STATE_NAMES})


@query("p32_label_cardinality", """select 'industry' as field, count(distinct industry) as distinct_values,
 count(distinct industry) <= 500 as within_limit from us""", C, US_CTE)
def p32(s, d):
    return an.cardinality_check(us(s, d), "industry")


_LABELS = "labels_ as (select distinct lower(trim(p_name || ' ' || p_type)) as label from part union select distinct lower(trim(p_name)) from part)"


def part_labels(s, d):
    """Label taxonomy drawn from part names: plain, and with the part type."""
    p = table(s, d, "part")
    return (p.select(F.explode(F.array("p_name", F.concat_ws(" ", "p_name", "p_type"))).alias("raw"))
            .transform(an.distinct_labels, "raw"))


@query("p33_similar_labels", """select a.label as label_a, b.label as label_b,
 1e0 - levenshtein(a.form, b.form) / cast(greatest(length(a.form), length(b.form)) as double) as score
 from forms a join forms b on a.label < b.label
 where 1e0 - levenshtein(a.form, b.form) / cast(greatest(length(a.form), length(b.form)) as double) >= 0.85 - 1e-12""",
       _LABELS, "forms as (select label, array_to_string(list_sort(string_split(label, ' ')), ' ') as form from labels_)")
def p33(s, d):
    return an.similar_labels(part_labels(s, d))


@query("p34_subset_labels", """select a.label as short_label, b.label as long_label from labels_ a join labels_ b
 on len(list_distinct(string_split(b.label,' '))) > len(list_distinct(string_split(a.label,' ')))
 and list_has_all(string_split(b.label,' '), string_split(a.label,' '))""", _LABELS)
def p34(s, d):
    return an.subset_labels(part_labels(s, d))


@query("p35_top_city_state", """select city, state, count(*) as records from us where city is not null
 group by 1, 2 order by 3 desc, 1, 2 limit 20""", C, US_CTE)
def p35(s, d):
    return an.top_pairs(us(s, d))


@query("p36_implausible_size", """select count(*) filter (size='10K+' and founded>=2021) as implausible,
 count(*) filter (size='10K+') as largest_band,
 count(*) filter (size='10K+' and founded>=2021)*100e0/count(*) filter (size='10K+') as pct_of_band from us""", C, US_CTE)
def p36(s, d):
    return an.implausible_size_report(us(s, d))


@query("p37_type_suffix", f"""select type, count(*) filter (not regexp_matches(h, '\\.(org|gov|mil|edu)$')) as other_suffix,
 count(*) as with_website, count(*) filter (not regexp_matches(h, '\\.(org|gov|mil|edu)$'))*100e0/count(*) as other_pct
 from (select type, {_HOST.format(c='website')} as h from us where website is not null and type in ('Nonprofit','Government Agency'))
 group by type""", C, US_CTE)
def p37(s, d):
    return an.type_suffix_check(us(s, d))


@query("p38_round_years", """select count(founded) as non_null, count(*) filter (founded%1000=0) as mult_1000,
 count(*) filter (founded%100=0 and founded%1000<>0) as mult_100, count(*) filter (founded between 1950 and 2024) as in_range,
 count(*) filter (founded between 1950 and 2024 and founded%10=0) as mult_10,
 count(*) filter (founded between 1950 and 2024 and founded%5=0) as mult_5,
 count(*) filter (founded%1000=0)*100e0/count(founded) as mult_1000_pct,
 count(*) filter (founded between 1950 and 2024 and founded%10=0)*100e0/count(*) filter (founded between 1950 and 2024) as mult_10_pct,
 count(*) filter (founded between 1950 and 2024 and founded%5=0)*100e0/count(*) filter (founded between 1950 and 2024) as mult_5_pct
 from us""", C, US_CTE)
def p38(s, d):
    return an.round_number_check(us(s, d))


@query("p39_text_encoding", r"""select lang, count(text) as rows, count(*) filter (contains(text, chr(65533))) as replacement_char,
 count(*) filter (length(regexp_replace(text, '[a-zA-Z0-9 ]', '', 'g')) > length(text)*0.30e0) as high_special_ratio,
 count(*) filter (regexp_matches(text, '[\x{4E00}-\x{9FFF}]')) as cjk,
 count(*) filter (regexp_matches(text, '[\x{0600}-\x{06FF}]')) as arabic,
 count(*) filter (regexp_matches(text, '[\x{4E00}-\x{9FFF}]') and regexp_matches(text, '[a-zA-Z]')) as latin_and_cjk,
 count(*) filter (regexp_matches(text, '[\x{10000}-\x{10FFFF}]')) as four_byte,
 count(*) filter (regexp_matches(text, '[^\x00-\x7F]')) as non_ascii,
 count(*) filter (regexp_matches(text, '[\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}]')) as non_latin
 from documents group by lang""")
def p39(s, d):
    docs = table(s, d, "documents")
    return an.encoding_profile(docs.select("lang", "text"), "text", by=["lang"])


@query("p40_invalid_state_categories", """select category, count(*) as records, count(distinct state) as distinct_values from (
 select state, case state when 'York' then 'city_leak' when 'Tx Texas' then 'redundant_prefix' when 'Flrida' then 'typo'
  when 'District Of Columbia' then 'case_mismatch' when 'N.Y.' then 'abbreviation' when 'Ontario' then 'foreign' end as category
 from companies) where category is not null group by category""", C)
def p40(s, d):
    raw = companies(s, d).withColumn("_s", cl.clean_state())
    return an.classify_invalid(raw, F.col("_s"))


@query("p41_null_state_residue", f"""select size, count(*) as records, (select count(*) from cleaned where state is null) as total_null_state
 from cleaned where state is null and size in ({_BIG}) group by size""", C, K)
def p41(s, d):
    return an.null_state_residue(cleaned(s, d))


def _parity_sql():
    target = "case " + " ".join(f"when g='{g}' and f='{f}' then {t[i]}e0" for g, t in PARITY_TARGETS.items()
                                for i, f in enumerate(("website", "industry", "size"))) + " end"
    flat = " union all ".join(f"select state, g as segment, '{f}' as f, g, count(*) as records, count({f}) as filled from seg "
                              f"where g is not null group by state, g" for f in ("website", "industry", "size"))
    return f"""select state, tier, segment, f as field, records, filled, filled/cast(records as double) as fill,
 filled/cast(records as double) >= t as met, greatest(t - filled/cast(records as double), 0e0) * w as weighted_gap from (
 select x.*, y.tier, ({target}) - case when y.tier='B' then 0.05e0 else 0e0 end as t,
  case g when 'enterprise' then 3 when 'mid_market' then 3 else 1 end as w
 from ({flat}) x join (select state, {TIER.format(c='count(*)')} as tier from us group by state) y using (state)
 where y.tier <> 'C')"""


@query("p42_parity", _parity_sql(), C, US_CTE, f"seg as (select *, {SEGMENT.format(c='size')} as g from us)")
def p42(s, d):
    return pr.parity(us(s, d), tiers=TIERS, weights={"enterprise": 3, "mid_market": 3, "smb": 1, "micro": 1})


@query("p43_fill_by_industry", _fill_by("industry"), C, US_CTE)
def p43(s, d):
    return pr.fill_by_group(us(s, d), ["industry"], tiers=TIERS)
