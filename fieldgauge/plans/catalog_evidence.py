"""Registered evidence, ledger, gate, report and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.operators import evaluate as el, evidence as ev, ledger as lg, reports as rp, running as rn
from fieldgauge.plans import evidence_views as views
from fieldgauge.plans.catalog_samples import CASCADE, CASCADE_CTES
from fieldgauge.plans.evidence_views import ENRICHED_CTES, EVIDENCE_CTES, enriched, traced
from fieldgauge.plans.registry import query, quoted
from fieldgauge.plans.testbed import CALLS_CTE, COMPANIES_CTE, SECTOR_OF_LABEL, call_log, cleaned, companies, stage, table
from fieldgauge.plans.testbed import CLEANED_CTE
from fieldgauge.sources import companies as src
from fieldgauge.sources.workspace import new_path

C, K, E, X = COMPANIES_CTE, CLEANED_CTE, EVIDENCE_CTES, ENRICHED_CTES
F4 = ("website", "type", "industry", "size")


def flat(df):
    return df.withColumn("closure_signals", F.array_join("closure_signals", ","))


# -- evidence ------------------------------------------------------------------

@query("e1_parsed_responses", """select event_id, case event_id % 4 when 3 then null else cast(props->>'k' as bigint) end as k,
 case event_id % 4 when 3 then 'invalid_json' else 'success' end as outcome from events""")
def e1(s, d):
    log = table(s, d, "events").selectExpr("event_id", """case event_id % 4 when 0 then concat('Here it is:\\n```json\\n', props, '\\n```')
 when 1 then concat('Sure. ', props, ' Done.') when 2 then concat('```\\nnot json\\n```\\n', props) else substr(props, 1, length(props) - 1) end as raw""")
    return ev.parse_responses(log, "k bigint").select("event_id", F.col("parsed.k").alias("k"), "outcome")


@query("e2_routing", "select handle, needs_search, rules_flag as website_rules_flag, corrupted as website_corrupted from routed", *E)
def e2(s, d):
    return traced(s, d).select("handle", "needs_search", "website_rules_flag", "website_corrupted")


@query("e3_gate_needed", "select handle, gate_ran as gated from gated", *E)
def e3(s, d):
    return traced(s, d).select("handle", "gated")


@query("e4_verdicts", "select handle, verdict, gone as dropped, e_candidate_website as candidate_website from evd", *E)
def e4(s, d):
    return traced(s, d).select("handle", "verdict", "dropped", F.col("found_website").alias("candidate_website"))


@query("e5_type_fill", "select handle, t_val, t_conf from merged", *E)
def e5(s, d):
    return traced(s, d).select("handle", "t_val", "t_conf")


@query("e6_website_confidence", "select handle, verified, w1 as w_conf1 from vals", *E)
def e6(s, d):
    return traced(s, d).select("handle", "verified", "w_conf1")


@query("e7_size_upgrade", "select handle, s_val, s_conf from vals", *E)
def e7(s, d):
    return traced(s, d).select("handle", "s_val", "s_conf")


@query("e8_closure", "select handle, operating as still_operating, array_to_string(coalesce(signals, []), ',') as closure_signals from vals", *E)
def e8(s, d):
    return flat(traced(s, d)).select("handle", "still_operating", "closure_signals")


@query("e9_uncertain_fields", "select handle, uncertain from rz", *E)
def e9(s, d):
    return traced(s, d).select("handle", F.array_join("uncertain", ",").alias("uncertain"))


def _pick(*suffixes, extra=()):
    return ["handle", *[f"{f}_{x}" for f in F4 for x in suffixes], *extra]


def _cols_query(name, cols):
    @query(name, f"select {', '.join(cols)} from enriched", *X)
    def q(s, d, cols=tuple(cols)):
        return enriched(s, d).select(*cols)
    return q


_cols_query("e10_final_values", _pick("enriched", "confidence", "final"))
_cols_query("e11_original_correct", _pick("original_correct"))
_cols_query("e12_provenance_and_flags", _pick("pipeline_stage", "review_flag", extra=["operating_status_review_flag"]))
_cols_query("e13_enrichment_status", ["handle", "enrichment_status", "status"])
_cols_query("e14_stage_resolved", ["handle", "stage_resolved"])


@query("e_enriched_rows", f"select {', '.join(ev.OUTPUT)} from enriched", *X)
def e_all(s, d):
    return flat(enriched(s, d))


_LABELS = sorted(SECTOR_OF_LABEL)


@query("e10_raw_labels", "select handle, industry_enriched, industry_final, industry_snap_method from enriched", *views.PO_CTES,
       "tax(label, pos) as (values " + ", ".join(f"('{x}', {i})" for i, x in enumerate(_LABELS)) + ")", views.RAW_TEXTS_CTE, *CASCADE_CTES,
       f"snapmap as ({CASCADE})", *views.resolving_ctes(found=views.RAW_FOUND_CTE))
def e10_raw_labels(s, d):
    """Label texts as they were read go through the cascade on their way into the merge."""
    labels = s.createDataFrame([(x, i) for i, x in enumerate(_LABELS)], "label string, pos int")
    return ev.resolve(views.entities(s, d), views.raw_evidence(s, d), labels=labels).select(
        "handle", "industry_enriched", "industry_final", "industry_snap_method")


_BUDGET_COLS = ["website_original", "website_final", "website_confidence", "size_final", "type_review_flag", "still_operating", "industry_snap_method"]


@query("e15_rows_within_budget", "select handle, name, poc_segment, " + ", ".join(f"case when not exhausted then {c} end as {c}" for c in _BUDGET_COLS)
       + """, case when exhausted then 'budget_exhausted' else status end as status, case when exhausted then 'NO_CANDIDATE' else enrichment_status end as enrichment_status,
 case when exhausted then 0 else stage_resolved end as stage_resolved, '2' as pipeline_version from enriched join priced using (handle)""",
       *views.PO_CTES, views.PRICED_CTE, *views.resolving_ctes(closed=views.BUDGET_CLOSED_CTE))
def e15_rows(s, d):
    """The enriched rows of a run that stops at its budget, marked with the version that wrote them."""
    costs = stage(s, d, "per_order", views.per_order).selectExpr("concat('company/', k) as handle", "n as cost", "cast(1 as bigint) as closing_cost")
    rows = ev.resolve_within_budget(views.entities(s, d), views.evidence(s, d), costs, views.BUDGET_CAP, ["handle"], version="2")
    return rows.select("handle", "name", "poc_segment", *_BUDGET_COLS, "status", "enrichment_status", "stage_resolved", "pipeline_version")


@query("e15_budget_cut", """select event_id, cents, cast(sum(cents) over (order by ts, event_id) as bigint) as running,
 case when sum(cents) over (order by ts, event_id) - cents >= 5000000 then 'budget_exhausted' else 'completed' end as status from calls""", CALLS_CTE)
def e15(s, d):
    log = call_log(s, d).select("event_id", "ts", "cents")
    return rn.budget_cut(log, ["ts", "event_id"], "cents", 5000000).drop("ts")


@query("e16_call_cost", """select event_id, input_tokens/1e6*(case model when 'model-0' then 0.80e0 else 3e0 end)
 + output_tokens/1e6*(case model when 'model-0' then 4e0 else 15e0 end) as cost from calls""", CALLS_CTE)
def e16(s, d):
    prices = s.createDataFrame([("model-0", 0.80, 4.00), ("model-1", 3.00, 15.00)], "model string, input double, output double")
    return lg.call_cost(call_log(s, d), prices).select("event_id", "cost")


_ORD = "case {c} " + " ".join(f"when '{b}' then {i}" for i, b in enumerate(fv.SIZE_BANDS, 1)) + " end"


@query("e17_size_delta", f"select handle, coalesce(abs({_ORD.format(c='size_original')} - {_ORD.format(c='size_enriched')}) > 1, false) as recheck from enriched", *X)
def e17(s, d):
    return enriched(s, d).select("handle", ev.size_delta_flag().alias("recheck"))


# -- ledger and gates -------------------------------------------------------------

@query("g1_ledger", """select phase, count(*) as calls, cast(sum(cents) as bigint) as spent from calls group by phase
 union all select 'TOTAL', count(*), cast(sum(cents) as bigint) from calls""", CALLS_CTE)
def g1(s, d):
    return lg.ledger(call_log(s, d), "cents", places=None)


_CAPS = {"click": 3_000_000.0, "view": 9_000_000.0, "purchase": 9_000_000.0, "signup": 9_000_000.0}
_CAPSQL = "case phase when 'click' then 3000000 when 'error' then 0 when 'TOTAL' then 90000000 else 9000000 end"


@query("g2_budget_gate", f"""select 'budget:' || phase as gate, spent < {_CAPSQL} as passed, cast(spent as double) as observed from (
 select phase, sum(cents) as spent from calls group by phase union all select 'TOTAL', sum(cents) from calls)""", CALLS_CTE)
def g2(s, d):
    return lg.budget_gate(lg.ledger(call_log(s, d), "cents", places=None), _CAPS, 90_000_000.0).drop("detail")


def _checks(*rows):
    return " union all ".join(f"select '{g}' as gate, {ok} as passed, cast({obs} as double) as observed from {t}" for g, ok, obs, t in rows)


@query("g3_batch_gate", _checks(
    ("batch_size", "count(*) between 200 and 1000", "count(*)", "companies"),
    ("size_scope", "true", "count(*) filter (size = 'none')", "companies"),
    ("rules_applied", "true", "count(*) filter (website in ('https://www.facebook.com/p','weebly.com'))", "companies"),
    ("key_nulls", "true", "count(*) filter (handle is null)", "companies"),
    ("key_duplicates", "count(*) = count(distinct handle)", "count(*) - count(distinct handle)", "companies")), C)
def g3(s, d):
    return lg.batch_gate(companies(s, d)).drop("detail")


@query("g4_key_gate", _checks(
    ("key_nulls", "true", "count(*) filter (l_orderkey is null)", "lineitem"),
    ("key_duplicates", "count(*) = count(distinct l_orderkey)", "count(*) - count(distinct l_orderkey)", "lineitem")))
def g4(s, d):
    return lg.key_gate(table(s, d, "lineitem"), "l_orderkey").drop("detail")


@query("g5_cascade_gate", _checks(
    ("stage_distribution", "count(*) filter (stage_resolved = 4) / cast(count(*) as double) <= 0.40",
     "count(*) filter (stage_resolved = 4) / cast(count(*) as double)", "enriched"),
    ("no_silent_drops", "count(*) = count(status)", "count(*) - count(status)", "enriched")), *X)
def g5(s, d):
    return lg.cascade_gate(enriched(s, d)).drop("detail")


@query("g6_min_rows", _checks(("min_gap_candidates", "count(*) >= 3", "count(*)", "nation")))
def g6(s, d):
    return lg.min_rows_gate(table(s, d, "nation")).drop("detail")


@query("g7_failed_checks", "select gate, observed from (" + _checks(
    ("key_nulls", "true", "0", "region where r_regionkey = 0"),
    ("key_duplicates", "count(*) = count(distinct l_orderkey)", "count(*) - count(distinct l_orderkey)", "lineitem")) + ") where not passed")
def g7(s, d):
    checks = lg.key_gate(table(s, d, "lineitem"), "l_orderkey")
    return checks.where("not passed").select("gate", "observed")


def _reg_sql():
    rows = []
    for f in ("website", "industry", "size", "type"):
        rows.append((f"fill:{f}", f"count({f})*100e0/count(*)"))
    rows.append(("enum:size", f"count(*) filter (size is null or size in ({quoted(fv.SIZE_BANDS)}))*100e0/count(*)"))
    rows.append(("enum:state", "count(*) filter (state is null or state in ('California','Texas'))*100e0/count(*)"))
    parts = [f"select '{g}' as gate, (select {x} from companies) as before, (select {x} from cleaned) as after" for g, x in rows]
    return "select *, after - before as delta, after - before >= -5 as passed from (" + " union all ".join(parts) + ")"


@query("g8_regression_gate", _reg_sql(), C, K)
def g8(s, d):
    return lg.regression_gate(companies(s, d), cleaned(s, d), ("website", "industry", "size", "type"),
                              {"size": fv.SIZE_BANDS, "state": ("California", "Texas")})


@query("g8_confidence_gate", """select *, after - before as delta, after - before >= -5 as passed from (
 select 'confidence:website_confidence' as gate, (select quantile_disc(w1, 0.5) from vals) * 100e0 as before,
  (select quantile_disc(website_confidence, 0.5) from enriched) * 100e0 as after)""", *X)
def g8_confidence(s, d):
    """Median confidence of the final rows against that before the last step."""
    rows = traced(s, d)
    return lg.regression_gate(rows.select(F.col("w_conf1").alias("website_confidence")), rows.select("website_confidence"), (), {},
                              ("website_confidence",))


# -- reports ---------------------------------------------------------------------

def _dist(c):
    return f"select {c}, count(*) as records, count(*)*100e0/(select count(*) from enriched) as pct from enriched group by {c}"


@query("r1_outcomes", _dist("enrichment_status"), *X)
def r1(s, d):
    return rp.outcomes(enriched(s, d))


@query("r1_stages", _dist("stage_resolved"), *X)
def r1b(s, d):
    return rp.stages(enriched(s, d))


@query("r2_fill_lift", " union all ".join(f"""select '{f}' as field, count(*) filter ({f}_original is null) as originally_null,
 count(*) filter ({f}_original is null and {f}_final is not null) as newly_filled,
 count(*) filter ({f}_original is null and {f}_final is not null)*100e0/nullif(count(*) filter ({f}_original is null), 0) as lift_pct from enriched""" for f in F4), *X)
def r2(s, d):
    return rp.fill_lift(enriched(s, d))


@query("r3_coverage_delta", " union all ".join(f"""select '{f}' as field, count(*) as records, count({f}_original) as before, count({f}_final) as after,
 count({f}_original)*100e0/count(*) as before_pct, count({f}_final)*100e0/count(*) as after_pct,
 (count({f}_final)-count({f}_original))*100e0/count(*) as delta_pct from enriched""" for f in F4), *X)
def r3(s, d):
    return rp.coverage_delta(enriched(s, d))


def _rel(dim):
    return " union all ".join(f"""select '{f}' as field, {dim}, count(*) filter ({f}_original_correct) as correct,
 count(*) filter (not {f}_original_correct) as incorrect, count(*) filter ({f}_original_correct is null) as unknown,
 count(*) filter ({f}_original_correct)/nullif(cast(count({f}_original_correct) as double), 0) as reliability from enriched group by {dim}""" for f in F4)


@query("r4_reliability_by_segment", _rel("poc_segment"), *X)
def r4(s, d):
    return rp.source_reliability(enriched(s, d), "poc_segment")


@query("r4_reliability_by_size", _rel("size_original"), *X)
def r4b(s, d):
    return rp.source_reliability(enriched(s, d), "size_original")


@query("r5_operating_status", """select case when still_operating then 'Active' when not still_operating then 'Defunct' else 'Unknown' end as operating,
 count(*) as records, count(*)*100e0/(select count(*) from enriched) as pct from enriched group by 1""", *X)
def r5(s, d):
    return rp.operating_status(enriched(s, d))


@query("r5_closure_signals", """select signal, count(*) as records from (select unnest(string_split(closure_signals, ',')) as signal from enriched)
 where signal <> '' group by signal""", *X)
def r5b(s, d):
    return rp.closure_signals(enriched(s, d))


_AUD = """count(*) filter (b2b_vs_b2c='B2B') as b2b, count(*) filter (b2b_vs_b2c='B2C') as b2c, count(*) filter (b2b_vs_b2c='Both') as both,
 count(*) filter (b2b_vs_b2c is null) as unknown from enriched"""


@query("r6_audience_by_segment", f"select coalesce(poc_segment, '(none)') as segment, {_AUD} group by 1 union all select 'total', {_AUD}", *X)
def r6(s, d):
    return rp.audience_by_segment(enriched(s, d))


_ANY = "(" + " or ".join(f"{f}_review_flag" for f in (*F4, "operating_status")) + ")"


@query("r7_review_by_flag", " union all ".join(
    f"select '{n}' as field, count(*) filter ({c}) as flagged, count(*) as records from enriched"
    for n, c in [(f, f"{f}_review_flag") for f in (*F4, "operating_status")] + [("any", _ANY)]), *X)
def r7(s, d):
    return rp.review_by_flag(enriched(s, d))


@query("r7_review_by_segment", f"select coalesce(poc_segment,'(none)') as segment, count(*) filter ({_ANY}) as flagged, count(*) as records from enriched group by 1", *X)
def r7b(s, d):
    return rp.review_by_segment(enriched(s, d))


_QCOLS = ", ".join(f"case when {f}_review_flag then {f}_{x} end as {f}_{x}" for f in F4
                   for x in ("original", "enriched", "confidence", "pipeline_stage"))
_QUEUE = f"""select cast(case poc_segment when 'enterprise' then 1 when 'mid_market' then 2 when 'smb' then 3 when 'micro' then 4 else 9 end as integer) as priority,
 handle, name, city, state, poc_segment, concat_ws(', ', {', '.join(f"case when {f}_review_flag then '{f}' end" for f in F4)}) as fields_to_review, {_QCOLS}
 from enriched where {_ANY}"""


@query("r8_review_queue", _QUEUE, *X)
def r8(s, d):
    return rp.review_queue(enriched(s, d))


@query("r8_review_queue_places", f"""select handle, row_number() over (order by priority, website_confidence nulls last, handle) - 1 as place
 from ({_QUEUE})""", *X)
def r8_places(s, d):
    """Every row of the queue with its place, so that the order counts too."""
    return rp.review_queue_places(enriched(s, d)).select("handle", "place")


@query("i13_review_queue_csv", f"select priority, handle, poc_segment, nullif(fields_to_review, '') as fields_to_review from ({_QUEUE})", *X)
def i13(s, d):
    path = new_path(s, "review-csv")
    src.write_csv(rp.review_queue(enriched(s, d), ordered=False), path)
    back = s.read.option("header", True).csv(path)
    return back.select(F.col("priority").cast("int").alias("priority"), "handle", "poc_segment", "fields_to_review")


# -- evaluation ---------------------------------------------------------------------

# labels: companies whose key divides by 10, plus one in 7 with an unknown handle;
# values altered by the key, one field left out for some
_TRUTH = """truth as (select case when k % 7 = 0 then 'company/none' || k else handle end as handle, coalesce(seg, 'unknown') as segment, k,
 case when k % 3 = 0 then null when k % 4 = 0 then 'https://www.elsewhere' || k || '.example.com' else 'http://c' || k || '.example.com' end as website,
 case k % 4 when 0 then null when 1 then 'Privately Held' when 2 then ' nonprofit' else 'Public Company' end as type,
 case when k % 3 = 1 then 'Retail ' else industry end as industry, case when k % 3 = 2 then '51-200' else size end as size
 from (select *, cast(split_part(handle, '/', 2) as bigint) as k, """ + (
    "case size when '1-10' then 'micro' when '11-50' then 'smb' when '51-200' then 'mid_market' when '201-500' then 'mid_market' "
    "when '501-1K' then 'enterprise' when '1K-5K' then 'enterprise' when '5K-10K' then 'enterprise' when '10K+' then 'enterprise' end as seg"
) + """ from companies))"""
_NORM = "case when field = 'website' then nullif(regexp_extract(lower(trim({x})), '^(?:https://)?(?:http://)?(?:www\\.)?([^/?]*)', 1), '') else lower(trim({x})) end"
_LONG = "pairs0 as (" + " union all ".join(
    f"""select t.handle, segment, '{f}' as field, t.{f} as gt, e.{f}_final as pred, e.{f}_confidence as conf from truth t join enriched e using (handle)
 {"where t.k % 5 <> 0" if f == "size" else ""}""" for f in F4) + ")"
_PAIRS = f"""pairs1 as (select *, {_NORM.format(x='gt')} as g, {_NORM.format(x='pred')} as p from pairs0),
pairs as (select *, coalesce(g = p, false) as tp, p is not null and not coalesce(g = p, false) as fp, g is not null and not coalesce(g = p, false) as fn,
 g is not null and p is not null as "both", case when field = 'size' then abs({_ORD.format(c='gt')} - {_ORD.format(c='pred')}) end as distance from pairs1)"""
V = (*X, _TRUTH, _LONG, _PAIRS)


def truth(s, d):
    from fieldgauge.functions import bands
    k = F.split("handle", "/")[1].cast("bigint")
    return (companies(s, d).withColumn("k", k).select(
        F.expr("case when k % 7 = 0 then concat('company/none', k) else handle end").alias("handle"),
        F.coalesce(bands.segment(), F.lit("unknown")).alias("segment"),
        F.struct(
            F.expr("""case when k % 3 = 0 then null when k % 4 = 0 then concat('https://www.elsewhere', k, '.example.com')
             else concat('http://c', k, '.example.com') end""").alias("website"),
            F.expr("case k % 4 when 0 then null when 1 then 'Privately Held' when 2 then ' nonprofit' else 'Public Company' end").alias("type"),
            F.expr("case when k % 3 = 1 then 'Retail ' else industry end").alias("industry"),
            F.expr("case when k % 3 = 2 then '51-200' else size end").alias("size")).alias("ground_truth"),
        F.expr("case when k % 5 = 0 then array('website','type','industry') else array('website','type','industry','size') end").alias("present")))


def pairs(s, d):
    return el.compare(el.long_labels(truth(s, d)), enriched(s, d))


@query("v1_match_summary", """select count(*) as labelled, count(e.handle) as matched, count(*) - count(e.handle) as unmatched
 from truth left join enriched e using (handle)""", *V)
def v1(s, d):
    return el.match_summary(truth(s, d), enriched(s, d))


@query("v1_unmatched", "select handle from truth where handle not in (select handle from enriched)", *V)
def v1b(s, d):
    return el.unmatched(truth(s, d), enriched(s, d))


@query("v2_normalised", "select handle, field, g, p from pairs", *V)
def v2(s, d):
    return pairs(s, d).select("handle", "field", "g", "p")


_CONF = "count(*) filter (tp) as tp, count(*) filter (fp) as fp, count(*) filter (fn) as fn"
_PRF = """select *, tp/nullif(cast(tp+fp as double),0) as precision, tp/nullif(cast(tp+fn as double),0) as recall,
 2*(tp/nullif(cast(tp+fp as double),0))*(tp/nullif(cast(tp+fn as double),0))/nullif(tp/nullif(cast(tp+fp as double),0)+tp/nullif(cast(tp+fn as double),0),0) as f1"""


@query("v3_confusion", f"select field, {_CONF} from pairs group by field", *V)
def v3(s, d):
    return el.confusion(pairs(s, d))


@query("v4_precision_recall", f"{_PRF} from (select field, {_CONF} from pairs group by field)", *V)
def v4(s, d):
    return el.prf(el.confusion(pairs(s, d)), places=None)


@query("v5_by_segment", f"{_PRF} from (select segment, field, {_CONF} from pairs group by 1, 2)", *V)
def v5(s, d):
    return el.prf(el.confusion(pairs(s, d), ("segment", "field")), places=None)


def _mean(metric):
    total = " + ".join(f"coalesce(max(case when field='{f}' then {metric} end), 0)" for f in F4)
    return f"({total})/nullif(cast(count({metric}) as double), 0)"


@query("v6_macro", f"""select p as macro_precision, r as macro_recall, 2*p*r/nullif(p+r, 0) as macro_f1 from (
 select {_mean('precision')} as p, {_mean('recall')} as r from ({_PRF} from (select field, {_CONF} from pairs group by field)))""", *V)
def v6(s, d):
    return el.macro(el.prf(el.confusion(pairs(s, d)), places=None), places=None)


@query("v7_ordinal_error", """select count(*) as mismatches, count(*) filter (distance <= 1) as within_one, count(*) filter (distance <= 1)/cast(count(*) as double) as within_one_rate,
 cast(sum(distance) as double)/count(distance) as mean_distance from pairs where field = 'size' and "both" and not tp""", *V)
def v7(s, d):
    return el.ordinal_error(pairs(s, d))


@query("v8_calibration", """select field, count(*) filter (conf >= 0.80 and "both") as confident, count(*) filter (conf >= 0.80 and "both" and tp) as correct,
 count(*) filter (conf >= 0.80 and "both" and tp)/nullif(cast(count(*) filter (conf >= 0.80 and "both") as double), 0) as rate from pairs group by field""", *V)
def v8(s, d):
    return el.calibration(pairs(s, d))


@query("v9_mismatches", "select handle, field, gt, pred, segment, distance from pairs where fn", *V)
def v9(s, d):
    return el.mismatches(pairs(s, d))


@query("v10_weak_fields", f"""select field, coalesce(precision < 0.70, false) as low_precision, coalesce(recall < 0.60, false) as low_recall from (
 {_PRF} from (select field, {_CONF} from pairs group by field)) where precision < 0.70 or recall < 0.60""", *V)
def v10(s, d):
    return el.weak_fields(el.prf(el.confusion(pairs(s, d)), places=None))


@query("v11_go_no_go", f"""select m as lowest_precision, case when m >= 0.78 then 'GO' when m >= 0.70 then 'PIVOT' else 'STOP' end as decision from (
 select min(coalesce(precision, 0)) as m from ({_PRF} from (select field, {_CONF} from pairs group by field)) where field in ('website','industry'))""", *V)
def v11(s, d):
    return el.go_no_go(el.prf(el.confusion(pairs(s, d)), places=None))
