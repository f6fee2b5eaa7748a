"""Evidence tables derived from line items and orders, and the oracle's own
account of how they resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.functions import bands
from fieldgauge.operators import evidence as ev
from fieldgauge.operators.sampling import sample_conditions
from fieldgauge.plans.registry import SEGMENT, quoted
from fieldgauge.plans.testbed import COMPANIES_CTE, companies, stage, table

# Both engines read these expressions over one row per order: k, the number of
# lines n, and the largest and smallest discount and tax of its lines.
_SIZES = "case {x} % 9 when 0 then null when 8 then 'Huge' " + " ".join(
    f"when {i} then '{b}'" for i, b in enumerate(fv.SIZE_BANDS[:7], 1)) + " end"
_TYPES = "case {x} % 5 when 0 then null when 1 then 'Privately Held' when 2 then 'Nonprofit' when 3 then 'Bogus' else 'Partnership' end"
_LABEL = "case when k % 8 = 0 then null when k % 3 = 0 then 'retail' when k % 3 = 1 then 'construction' else 'manufacturing' end"

FOUND = {
    "candidate_website": "case when k % 6 = 0 then null when k % 9 = 0 then concat('https://www.other', k, '.example.org') else concat('http://c', k, '.example.com/') end",
    "website_confidence": "max_disc * 10",
    "candidate_type": _TYPES.format(x="n"),
    "type_confidence": "max_tax * 12.5e0",
    "candidate_size": _SIZES.format(x="(n + k)"),
    "size_confidence": "min_disc * 10",
    "industry_snapped": _LABEL,
    "industry_confidence": "min_tax * 12.5e0",
    "extracted_name": "case when k % 10 = 0 then null when k % 10 in (1, 2) then 'Totally Different Company' else concat('Customer#', lpad(cast(o_custkey as varchar(20)), 9, '0')) end",
    "naics_2digit": "cast(case when k % 12 = 0 then null when k % 12 < 4 then 23 when k % 12 < 8 then 44 when k % 12 < 10 then 62 else 99 end as int)",
    "still_operating": "case when k % 5 = 0 then null else k % 7 <> 0 end",
    "closure_signals": "case when k % 14 = 0 then array('permanently_closed', 'acquired') when k % 7 = 0 then array('permanently_closed') end",
    "is_single_facility": "case when k % 4 = 0 then null else k % 4 = 1 end",
    "search_used": "k % 2 = 0",
    "error": "k % 97 = 0",
}
RETRY = FOUND | {
    "candidate_website": "concat('https://retry', k, '.example.net')",
    "website_confidence": "0.8e0", "candidate_size": "'51-200'", "size_confidence": "0.5e0", "error": "k % 3 = 0",
}
GATE = {"entity_verdict": "case k % 25 when 0 then 'NO_MATCH' when 1 then 'SUBSIDIARY' when 2 then 'PARENT' else 'MATCH' end"}
VERIFY = {"website_verified": "case k % 4 when 0 then true when 1 then false end", "website_confidence": "0.75e0"}
SIZED = {"candidate_size": _SIZES.format(x="(k + 3)"), "size_confidence": "(k % 100) / 100e0", "error": "k % 29 = 0"}
CLOSED = {"still_operating": "case when k % 3 = 0 then null else k % 11 <> 0 end",
          "closure_signals": "case when k % 11 = 0 then array('closed_page') end", "error": "k % 31 = 0"}
RESOLVED = {
    "website_final": "case when k % 5 = 1 then null else concat('https://final', k, '.example.com/x') end", "website_confidence": "0.9e0",
    "type_final": "case when k % 5 = 2 then null else 'Public Company' end", "type_confidence": "case when k % 5 = 2 then null else 0.85e0 end",
    "size_final": "case when k % 5 = 3 then null else '201-500' end", "size_confidence": "(k % 10) / 10e0",
    "industry_final": "case when k % 5 = 4 then null else 'retail' end", "industry_confidence": "0.66e0", "error": "k % 41 = 0",
}
# share of keys each source has a row for
KEPT = {"found": None, "retry": None, "gate": "k % 13 <> 0", "verify": "k % 17 <> 0", "sized": None, "closed": None, "resolved": "k % 3 <> 1"}
VIEWS = {"found": FOUND, "retry": RETRY, "gate": GATE, "verify": VERIFY, "sized": SIZED, "closed": CLOSED, "resolved": RESOLVED}


def per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.max("l_discount").alias("max_disc"), F.min("l_discount").alias("min_disc"),
        F.max("l_tax").alias("max_tax"), F.min("l_tax").alias("min_tax"))
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("k", F.col("l_orderkey")))


def evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = stage(spark, sf_dir, "per_order", per_order)
    out = {}
    for name, cols in VIEWS.items():
        rows = base.where(KEPT[name]) if KEPT[name] else base
        out[name] = rows.selectExpr("concat('company/', k) as handle", *[f"{x} as {c}" for c, x in cols.items()])
    return out


RAW_LABEL = """case k % 12 when 0 then null when 1 then ' Retail ' when 2 then 'construction' when 3 then 'constructoin'
 when 4 then 'truck transportation services' when 5 then 'manufacturing plant' when 6 then 'zzqq' when 7 then 'IT Consulting'
 when 8 then '  ' when 9 then 'it services' when 10 then 'retial' else 'hospital' end"""


def raw_evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Evidence whose findings bring label texts as they were read."""
    found = stage(spark, sf_dir, "per_order", per_order).selectExpr(
        "concat('company/', k) as handle", *[f"{x} as {c}" for c, x in FOUND.items() if c != "industry_snapped"], f"{RAW_LABEL} as industry_raw")
    return evidence(spark, sf_dir) | {"found": found}


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company with the segment and condition a sample would give it."""
    met = sample_conditions()
    cond = F.when(met["missing_website"], "missing_website").when(met["platform_url"], "platform_url").when(
        met["missing_industry"], "missing_industry").otherwise("none")
    return companies(spark, sf_dir).withColumns({"poc_segment": bands.segment(), "poc_condition": cond})


TRACE = ("needs_search", "website_rules_flag", "website_corrupted", "gated", "verdict", "dropped", "t_val", "t_conf",
         "verified", "w_conf1", "s_val", "s_conf", "uncertain")


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved rows with the working columns of every step, as a stored stage."""
    def build(s: SparkSession, d: str) -> DataFrame:
        rows = ev.resolve(entities(s, d), evidence(s, d), trace=True)
        return rows.select(*ev.OUTPUT, *TRACE, F.col("ev.candidate_website").alias("found_website"))
    return stage(spark, sf_dir, "resolved", build)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traced(spark, sf_dir).select(*ev.OUTPUT)


# -- SQL side -----------------------------------------------------------------

def _duck(x: str) -> str:
    return x.replace("array(", "list_value(")


def _src(name: str) -> str:
    cols = ", ".join(f"{_duck(x)} as {name}_{c}" for c, x in VIEWS[name].items())
    return f"ev_{name} as (select 'company/' || k as handle, true as has_{name}, {cols} from po{' where ' + KEPT[name] if KEPT[name] else ''})"


_PO = """po as (select l_orderkey as k, o_custkey, count(*) as n, max(l_discount) as max_disc, min(l_discount) as min_disc, max(l_tax) as max_tax,
 min(l_tax) as min_tax from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""
_DOM = "nullif(rtrim(regexp_extract(lower(trim({x})), '^(?:https://)?(?:http://)?(?:www\\.)?([^/?]*)', 1), '.'), '')"
_PLATFORM = "coalesce(website in ('https://www.facebook.com/p','weebly.com','betterhealth.vic.gov.au'), false)"
_JOINED = ("ent as (select *, " + SEGMENT.format(c="size") + """ as poc_segment,
 case when website is null then 'missing_website' when website in ('https://www.facebook.com/p','weebly.com','http://foo.wixsite.com/p','betterhealth.vic.gov.au')
  then 'platform_url' when industry is null then 'missing_industry' else 'none' end as poc_condition
 from companies """ + " ".join(f"left join ev_{v} using (handle)" for v in VIEWS) + ")")

_STOPS = quoted(fv.NAME_DOMAIN_STOP_WORDS)
_ROUTED = f"""routed as (select *, {_DOM.format(x='website')} as site0,
 {_PLATFORM} as rules_flag, website = 'https://d1.k12.ny.us' is true as k12, coalesce(website = 'betterhealth.vic.gov.au', false) as corrupted,
 case when website = 'https://d1.k12.ny.us' then 'Educational' when name like 'City of %' then 'Government Agency' when name like '% Foundation' then 'Nonprofit'
  when name like '% LLP' then 'Partnership' when name like '% Inc' then 'Privately Held' end as hint,
 case when website = 'https://d1.k12.ny.us' then 0.95e0 when name like 'City of %' then 0.93e0 when name like '% Foundation' then 0.92e0
  when name like '% LLP' then 0.76e0 when name like '% Inc' then 0.73e0 else 0e0 end as hint_conf,
 coalesce(website = 'https://d1.k12.ny.us', false) or name like 'City of %' or name like '% Foundation' or name like '% LLP' as confirmed,
 poc_condition in ('missing_website','platform_url') or (website is not null and len(toks) > 0
  and len(list_filter(toks, lambda t: contains(plain, t))) = 0) as needs_search
 from (select *, regexp_replace(coalesce({_DOM.format(x='website')}, ''), '[^a-z0-9]', '', 'g') as plain,
  list_filter(regexp_split_to_array(lower(name), '[\\s\\-_&,./]+'), lambda t: length(t) >= 4 and t not in ({_STOPS})) as toks from ent))"""
# share of matching characters: the found name is the start of the name, or the two share too little to reach the threshold
_ALIKE = ("case when starts_with(lower(name), lower(found_extracted_name)) then 2e0 * length(found_extracted_name)"
        " / (length(name) + length(found_extracted_name)) else 0e0 end")
_GATED = f"""gated as (select *, coalesce(found_error, false) as failed,
 not coalesce(found_error, false) and needs_search and (case when found_candidate_website is null and found_candidate_type is null then false
  when confirmed then false when corrupted then false when size in ('1K-5K','5K-10K','10K+') then true
  when found_extracted_name is not null and {_ALIKE} < 0.70 then true
  when split_part(site0, '.', 1) = split_part({_DOM.format(x='found_candidate_website')}, '.', 1) and not {_PLATFORM} then false else true end) as gate_ran from routed)"""
_VERDICT = """judged as (select *, case when gate_ran then coalesce(gate_entity_verdict, 'MATCH') else 'MATCH' end as verdict from gated),
dropped as (select *, failed or verdict = 'NO_MATCH' as gone,
 verdict in ('SUBSIDIARY','PARENT') and has_retry is not null and not coalesce(retry_error, false) as use_retry from judged)"""
_EV = "evd as (select *, " + ", ".join(
    f"case when gone then null when use_retry then retry_{c} else found_{c} end as e_{c}" for c in FOUND) + " from dropped)"
_MERGED = f"""merged as (select *,
 case when gone then null when k12 then 'primary and secondary education' else coalesce(e_industry_snapped, industry) end as lab,
 case when gone then null when k12 then 'stage0_tld' when e_industry_snapped is not null and e_naics_2digit is not null then 'embeddings'
  when e_industry_snapped is not null then 'keyword' when industry is not null then 'passthrough' else 'none' end as lab_method,
 case when not gone and hint is not null and e_candidate_type is null then hint else e_candidate_type end as t_val,
 case when not gone and hint is not null and e_candidate_type is null then hint_conf else coalesce(e_type_confidence, 0) end as t_conf,
 case when gone then null when e_naics_2digit = 23 then 'B2B' when e_naics_2digit = 44 then 'B2C' when e_naics_2digit = 62 then 'Both' end as aud,
 {_DOM.format(x='e_candidate_website')} as w_val, coalesce(e_website_confidence, 0) as w0, coalesce(e_size_confidence, 0) as s0,
 coalesce(e_industry_confidence, 0) as i_conf from evd)"""
_CHECKED = """checked as (select *, not gone and w_val is not null and needs_search and w0 < 0.72 and has_verify is not null as was_checked,
 not gone and (((verdict = 'MATCH' or confirmed) and (e_candidate_size is null or s0 < 0.55)) or verdict in ('PARENT','SUBSIDIARY')) as want_size from merged),
settled as (select *, case when was_checked then verify_website_verified end as verified,
 coalesce(want_size and not coalesce(sized_error, false) and sized_candidate_size is not null and coalesce(sized_size_confidence, 0) > s0, false) as take_size,
 coalesce(not gone and e_still_operating is null and not coalesce(closed_error, false) and closed_still_operating is not null, false) as take_close from checked),
vals as (select *, case when verified then greatest(w0, verify_website_confidence) when not verified then least(w0, 0.45) else w0 end as w1,
 case when take_size then sized_candidate_size else e_candidate_size end as s_val, case when take_size then sized_size_confidence else s0 end as s_conf,
 case when take_close then closed_still_operating else e_still_operating end as operating,
 case when take_close then closed_closure_signals else e_closure_signals end as signals from settled)"""
_UNSURE = """unsure as (select *, not gone and w_val is not null and ((needs_search and w1 < 0.60) or coalesce(not verified, false)) as u_w,
 not gone and t_val is not null and t_conf < 0.60 as u_t, not gone and s_val is not null and s_conf < 0.60 and w_val is not null as u_s,
 not gone and lab is not null and i_conf < 0.60 as u_i from vals),
esc as (select *, (u_w or u_t or u_s or u_i) and has_resolved is not null as escalated,
 concat_ws(',', case when u_w then 'website' end, case when u_t then 'type' end, case when u_s then 'size' end, case when u_i then 'industry' end) as uncertain from unsure),
rz as (select *, escalated and not coalesce(resolved_error, false) as use_r from esc)"""


def _fin(f: str, base: str) -> str:
    return f"coalesce(case when use_r then resolved_{f}_final end, {base})"


def _conf(f: str, base: str) -> str:
    return f"coalesce(case when use_r then resolved_{f}_confidence end, {base})"


_CAND = f"""cand0 as (select *, {_DOM.format(x=_fin('website', 'e_candidate_website'))} as website_enriched,
 case when {_fin('type', 't_val')} in ({quoted(fv.ENTITY_TYPES)}) then {_fin('type', 't_val')} end as type_enriched,
 case when {_fin('size', 's_val')} in ({quoted(fv.SIZE_BANDS)}) then {_fin('size', 's_val')} end as size_enriched,
 {_fin('industry', 'lab')} as industry_enriched,
 {_conf('website', 'w1')} as website_confidence, {_conf('type', 't_conf')} as type_confidence,
 {_conf('size', 's_conf')} as size_confidence, {_conf('industry', 'i_conf')} as industry_confidence from rz)"""
_AT = {"website": 0.70, "type": 0.65, "industry": 0.65, "size": 0.55}


def _final_sql() -> str:
    cols = ["handle", "name", "city", "state", "poc_segment", "poc_condition"]
    for f, at in _AT.items():
        sure = f"{f}_confidence >= {at}"
        if f == "website":
            final = f"coalesce(case when {sure} then website_enriched end, case when not rules_flag then site0 end, website_enriched)"
            right = f"case when website is not null and site0 is not null and website_enriched is not null and w1 >= {at} then website_enriched = site0 end"
        else:
            final = f"coalesce(case when {sure} then {f}_enriched end, {f}, {f}_enriched)"
            right = f"case when {f} is not null and {f}_enriched is not null and {sure} then {f}_enriched = {f} end"
        cols += [f"{f} as {f}_original", f"{f}_enriched", f"{final} as {f}_final", f"{right} as {f}_original_correct", f"{f}_confidence",
                 f"{f}_enriched is not null and not ({sure}) as {f}_review_flag",
                 f"case when {final} is null then 'NO_CANDIDATE' when use_r and resolved_{f}_final is not null then 'resolved' "
                 + ("when was_checked then 'searched' " if f == "website" else "")
                 + f"when coalesce(e_search_used, false) then 'searched' else 'parametric' end as {f}_pipeline_stage"]
    cols += ["operating is null or coalesce(len(signals), 0) > 0 as operating_status_review_flag",
             "case when failed then 1 when gone then 0 when escalated then 4 when was_checked then 3 when gate_ran then 2 else 1 end as stage_resolved",
             "case when failed then 'error' else 'completed' end as status", "operating as still_operating",
             "array_to_string(coalesce(signals, []), ',') as closure_signals", "e_is_single_facility as is_single_facility", "aud as b2b_vs_b2c",
             "lab_method as industry_snap_method",
             "failed", "verified", "escalated"]
    return "fin as (select " + ", ".join(cols) + " from cand0)"


_NEW = " + ".join(f"(case when {f}_final is not null and {f}_original is null then 1 else 0 end)" for f in _AT)
_ENRICHED = f"""enriched as (select * exclude (failed, verified, escalated), case when failed then 'ERROR'
 when website_enriched is not null and coalesce(not verified, false) and not escalated then 'CONFLICT'
 when {_NEW} = 0 then 'NO_CANDIDATE' when {_NEW} >= 2 then 'FULLY_ENRICHED' else 'PARTIALLY_ENRICHED' end as enrichment_status from fin)"""

# the same evidence with label texts that go through the cascade (tax, texts and the cascade's own tables are given)
RAW_TEXTS_CTE = f"texts as (select distinct trim(lower({RAW_LABEL})) as text from po where trim({RAW_LABEL}) <> '')"
RAW_FOUND_CTE = (_src("found").replace(f"{_duck(_LABEL)} as found_industry_snapped", "x.label as found_industry_snapped")
                 .replace(" from po)", f" from po left join snapmap x on x.text = trim(lower({RAW_LABEL})))"))
# the same evidence under a cap on what the calls of the entities may cost
BUDGET_CAP = 3000
PRICED_CTE = f"""priced as (select handle, run - cost >= {BUDGET_CAP} as exhausted, run - closing < {BUDGET_CAP} as closes from (
 select handle, cost, closing, sum(cost) over (order by handle) as run from (
 select 'company/' || o_orderkey as handle, coalesce(n, 0) as cost, case when n is null then 0 else 1 end as closing from orders left join po on k = o_orderkey)))"""
BUDGET_CLOSED_CTE = _src("closed").replace(" from po)", " from po where 'company/' || k in (select handle from priced where closes))")


def resolving_ctes(**instead: str) -> tuple[str, ...]:
    """The oracle's tables of the merge with some sources replaced."""
    return (*[instead.get(v, _src(v)) for v in VIEWS], _JOINED, _ROUTED, _GATED, _VERDICT, _EV, _MERGED, _CHECKED, _UNSURE, _CAND, _final_sql(), _ENRICHED)


PO_CTES = (COMPANIES_CTE, _PO)
EVIDENCE_CTES = (COMPANIES_CTE, _PO, *[_src(v) for v in VIEWS], _JOINED, _ROUTED, _GATED, _VERDICT, _EV, _MERGED, _CHECKED, _UNSURE, _CAND)
ENRICHED_CTES = (*EVIDENCE_CTES, _final_sql(), _ENRICHED)
