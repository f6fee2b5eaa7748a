"""Registered sampling, label matching and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.config import SAMPLE_QUOTAS
from fieldgauge.functions import bands
from fieldgauge.operators import labels as lb, sampling as sa
from fieldgauge.plans.catalog_coverage import ALL, cells
from fieldgauge.plans.registry import SEGMENT, query, quoted
from fieldgauge.plans.testbed import COMPANIES_CTE, cleaned, companies, sector_labels, table

C = COMPANIES_CTE
_COLS = "handle, name, website, industry, size, type, founded, city, state, country_code"


@query("s1_hash_sample", f"select {_COLS} from companies order by md5(handle || '42'), handle limit 200", C)
def s1(s, d):
    return sa.hash_sample(companies(s, d), 200)


_PLAT = " or ".join(f"contains(lower(website), '{h}')" for h in (*sa.SAMPLE_PLATFORMS, ".edu", ".gov", ".mil"))
_CONDS = {"missing_website": "website is null", "missing_industry": "industry is null", "platform_url": f"({_PLAT})"}


def _quota_sql():
    parts = []
    q = sa.quotas()
    for i, (c, pred) in enumerate(_CONDS.items()):
        for g in SAMPLE_QUOTAS:
            churn = "and not (founded >= 2015 and website is null and type is null)" if g == "micro" else ""
            parts.append(f"""(select {_COLS}, '{g}' as poc_segment, '{c}' as poc_condition, {i} as o from companies
 where state is not null and {SEGMENT.format(c='size')} = '{g}' {churn} and {pred} order by md5(handle || '42'), handle limit {q[g + '|' + c]})""")
    return ("quota as (select * exclude (o, rn) from (select *, row_number() over (partition by handle order by o) as rn from ("
            + " union all ".join(f"select * from {p}" for p in parts) + ")) where rn = 1)")


QUOTA = _quota_sql()


@query("s2_quota_sample", "select * from quota", C, QUOTA)
def s2(s, d):
    return sa.quota_sample(companies(s, d), seed="42")


@query("s3_sample_composition", "select poc_segment, poc_condition, count(*) as records from quota group by 1, 2", C, QUOTA)
def s3(s, d):
    return sa.sample_composition(sa.quota_sample(companies(s, d), seed="42"))


_ENT = quoted(bands.ENTERPRISE)
_SEED = "md5(handle || 'record_audit_v1_seed'), handle"
_POOL = "(website is not null or industry is not null)"


def _bad(sector, a, b):
    return f"""(select state from (select state, state_tier, row_number() over (partition by state_tier order by coverage, state) as rn
 from cells where sector = '{sector}') where rn <= case state_tier when 'A' then {a} else {b} end)"""


def _standard_sql(gap, sector, label, n=40, forced=2, a=2, b=1):
    return f"""select * exclude (rn, st), st = 1 as forced from (select *, row_number() over (partition by handle order by st) as rn from (
 select * from (select '{gap}' as gap, {_COLS}, 0 as st from cleaned where {_POOL} and industry = '{label}' and state in {_bad(sector, a, b)}
  order by {_SEED} limit {n - forced})
 union all select * from (select '{gap}' as gap, {_COLS}, 1 as st from cleaned where {_POOL} and industry = '{label}' and size in ({_ENT})
  order by {_SEED} limit {forced}))) where rn = 1"""


_AUDIT = f"""audit as ({_standard_sql('gap_1', '48-49', 'truck transportation')} union all {_standard_sql('gap_2', '23', 'construction')}
 union all select *, false as forced from (select 'gap_3' as gap, {_COLS} from cleaned where {_POOL} and size = '1-10'
  and industry in ('truck transportation','retail') and state in {_bad('48-49', 2, 1)} order by {_SEED} limit 40)
 union all select *, false as forced from (select 'gap_4' as gap, {_COLS} from cleaned where {_POOL} and state is not null and size in ({_ENT})
  order by {_SEED} limit 40))"""


def audit(s, d):
    gaps = s.createDataFrame([("gap_1", "standard", "48-49"), ("gap_2", "standard", "23"), ("gap_3", "micro", "48-49"),
                              ("gap_4", "size", None)], "gap string, kind string, sector string")
    return sa.audit_sample(cleaned(s, d).select(*_COLS.split(", ")), cells(s, d), sector_labels(s), gaps, n=40,
                           worst=(2, 1), worst_micro=(2, 1), food_sector="44-45")


@query("s4_audit_sample", "select * from audit where gap in ('gap_1','gap_2')", *ALL, _AUDIT)
def s4(s, d):
    return audit(s, d).where("gap in ('gap_1','gap_2')")


@query("s5_size_and_micro_sample", "select * from audit where gap in ('gap_3','gap_4')", *ALL, _AUDIT)
def s5(s, d):
    return audit(s, d).where("gap in ('gap_3','gap_4')")


@query("s6_sampled_states", """select gap, array_to_string(list_sort(list(distinct state)), ',') as states, count(*) as records
 from audit where state is not null group by gap""", *ALL, _AUDIT)
def s6(s, d):
    return sa.sampled_states(audit(s, d)).withColumn("states", F.array_join("states", ","))


@query("s7_union_dedup", """select handle, name, part from (select *, row_number() over (partition by handle order by p, name) as rn from (
 select handle, name, 'no_site' as part, 0 as p from companies where website is null
 union all select handle, name, 'no_label', 1 from companies where industry is null
 union all select handle, name, 'no_type', 2 from companies where type is null)) where rn = 1""", C)
def s7(s, d):
    df = companies(s, d)
    parts = [df.where(f"{c} is null").select("handle", "name", F.lit(tag).alias("part"))
             for c, tag in (("website", "no_site"), ("industry", "no_label"), ("type", "no_type"))]
    return sa.union_dedup(parts, "handle", [F.col("name")])


# -- label matching ----------------------------------------------------------------

# taxonomy: distinct "name type" of parts in alphabetic order, 0-based positions
_TAX = """tax as (select label, row_number() over (order by label) - 1 as pos from
 (select distinct lower(p_name || ' ' || p_type) as label from part))"""
_RAW = """raw as (select p_partkey, case p_partkey % 7 when 0 then p_name || ' ' || p_type when 1 then '  ' || upper(p_name) || ' '
 when 2 then p_type || ', ' || p_name when 3 then 'freight ' || p_name when 4 then substr(p_name, 2) || ' ' || p_type
 when 5 then 'the of' else 'zz' || substr(p_name, 1, 1) || 'qq' || substr(p_type, 3, 3) end as text from part)"""
_TEXTS = "texts as (select distinct trim(lower(text)) as text from raw)"


def taxonomy(s, d):
    """Part names as a taxonomy. Positions come from a window over distinct
    labels only, a set bounded by the vocabulary."""
    from pyspark.sql import Window
    labels = table(s, d, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("label")).distinct()
    return labels.withColumn("pos", F.row_number().over(Window.orderBy("label")) - 1)


def raw_texts(s, d):
    return table(s, d, "part").selectExpr("p_partkey", """case p_partkey % 7 when 0 then concat(p_name, ' ', p_type)
 when 1 then concat('  ', upper(p_name), ' ') when 2 then concat(p_type, ', ', p_name) when 3 then concat('freight ', p_name)
 when 4 then concat(substr(p_name, 2), ' ', p_type) when 5 then 'the of'
 else concat('zz', substr(p_name, 1, 1), 'qq', substr(p_type, 3, 3)) end as text""")


def texts(s, d):
    return raw_texts(s, d).select(lb.tidy("text").alias("text")).distinct()


_EXACT = """exact as (select text, arg_min(label, (case when label = text then 0 else 1 end) * 1000000 + pos) as label
 from texts join tax on label = text or starts_with(label, text || ' ') group by text)"""


@query("l1_exact_or_prefix", "select text, label from exact", _TAX, _RAW, _TEXTS, _EXACT)
def l1(s, d):
    return lb.snap_exact(texts(s, d), taxonomy(s, d))


_STOP = quoted(fv.LABEL_STOP_WORDS)
_TOK = f"list_distinct(list_filter(regexp_split_to_array(text, '[\\s,&/\\-]+'), lambda x: x <> '' and x not in ({_STOP})))"
_KWSQL = "case " + " ".join(
    f"when list_has_any(w, [{quoted(k)}]) then '{label}'" for k, label in fv.KEYWORD_LABELS) + " end"


@query("l2_keyword_rules", f"select text, {_KWSQL} as label from (select text, {_TOK} as w from texts)", _TAX, _RAW, _TEXTS)
def l2(s, d):
    return texts(s, d).select("text", lb.keyword_label("text").alias("label"))


@query("l3_cosine", """select vec_id, coalesce(case when s1 >= 0.40 then l1 end, case when s2 >= 0.40 then l2 end) as label,
 case when s1 >= 0.40 then 'sector' when s2 >= 0.40 then 'all' end as scope from (
 select vec_id, max(c) filter (sector = mine) as s1, arg_min(l, -c) filter (sector = mine) as l1, max(c) as s2, arg_min(l, -c) as l2 from (
  select v.vec_id, v.label//2 as mine, t.l, t.sector, list_cosine_similarity(v.embedding, t.vector) as c
  from embeddings v cross join (select 'label ' || label as l, label//2 as sector, arg_min(embedding, vec_id) as vector
   from embeddings group by label) t) group by vec_id)""")
def l3(s, d):
    v = table(s, d, "embeddings")
    half = F.floor(F.col("label") / 2).cast("int")
    tax = (v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
           .select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"), half.alias("sector"),
                   F.col("label").alias("pos"), "vector"))
    rows = v.select("vec_id", half.alias("sector"), F.col("embedding").alias("vector"))
    return lb.snap_cosine(rows, tax, "vec_id").select("vec_id", "label", "scope")


_OVERLAP = f"""overlap as (select text, label, score from (select *, row_number() over (partition by text order by score desc, pos) as rn from (
 select text, label, pos, 2*p*r/(p+r) as score from (select text, label, pos, h/cast(nt as double) as p, h/cast(nl as double) as r from (
  select t.text, l.label, l.pos, len(t.w) as nt, len(l.lw) as nl,
   len(list_filter(t.w, lambda x: len(list_filter(l.lw, lambda y: contains(y, x))) > 0)) as h
  from (select text, {_TOK} as w from texts) t join
   (select label, pos, list_distinct(list_filter(regexp_split_to_array(label, '[\\s,&/]+'), lambda x: x <> '' and x not in ({_STOP}))) as lw from tax) l
   on len(t.w) > 0) where h > 0))) where rn = 1 and score >= 0.35)"""


@query("l4_word_overlap", "select text, label, score from overlap", _TAX, _RAW, _TEXTS, _OVERLAP)
def l4(s, d):
    return lb.snap_overlap(texts(s, d), taxonomy(s, d))


_EDIT = """edit as (select text, case when score >= 0.45 then label end as label, score from (select text, label, score, row_number() over (partition by text order by score desc, pos) as rn
 from (select text, label, pos, 1e0 - levenshtein(text, label)/cast(greatest(length(text), length(label)) as double) as score from texts cross join tax))
 where rn = 1)"""


@query("l5_edit_distance", "select text, label, score from edit", _TAX, _RAW, _TEXTS, _EDIT)
def l5(s, d):
    return lb.snap_edit(texts(s, d), taxonomy(s, d))


# the cascade over texts, given tax and texts
CASCADE = f"""select t.text, coalesce(e.label, t.kw, case when len(t.w) > 0 then coalesce(o.label, d.label) end) as label,
  case when e.label is not null then 'exact' when t.kw is not null then 'keyword' when len(t.w) = 0 then 'none'
   when o.label is not null then 'overlap' when d.label is not null then 'edit' else 'none' end as step
 from (select text, w, {_KWSQL} as kw from (select text, {_TOK} as w from texts)) t left join exact e using (text)
 left join overlap o using (text) left join edit d using (text)"""
CASCADE_CTES = (_EXACT, _OVERLAP, _EDIT)


@query("l6_label_cascade", f"""select raw.p_partkey, label, step from raw left join (
 {CASCADE}) x on trim(lower(raw.text)) = x.text""", _TAX, _RAW, _TEXTS, *CASCADE_CTES)
def l6(s, d):
    raw = raw_texts(s, d)
    snapped = lb.snap_cascade(raw, taxonomy(s, d)).withColumnRenamed("text", "_t")
    return raw.join(snapped, lb.tidy("text") == F.col("_t"), "left").select("p_partkey", "label", "step")


_VTEXT = """case when vec_id % 5 = 0 then 'Label ' || label when vec_id % 5 = 1 then 'Retail ' || vec_id
 when vec_id % 5 = 2 then ' ' else 'zz ' || vec_id end"""


@query("l6_label_cascade_vectors", f"""with near as (
 select vec_id, coalesce(case when s1 >= 0.40 then l1 end, case when s2 >= 0.40 then l2 end) as label from (
 select vec_id, max(c) filter (sector = mine) as s1, arg_min(l, -c) filter (sector = mine) as l1, max(c) as s2, arg_min(l, -c) as l2 from (
  select v.vec_id, v.label//2 as mine, t.l, t.sector, list_cosine_similarity(v.embedding, t.vector) as c
  from embeddings v cross join (select 'label ' || label as l, label//2 as sector, arg_min(embedding, vec_id) as vector
   from embeddings group by label) t) group by vec_id))
 select vec_id, case vec_id % 5 when 0 then 'label ' || e.label when 1 then 'retail' when 2 then null else near.label end as label,
 case when vec_id % 5 = 0 then 'exact' when vec_id % 5 = 1 then 'keyword' when vec_id % 5 > 2 and near.label is not null then 'cosine'
  else 'none' end as step from embeddings e left join near using (vec_id)""")
def l6_vectors(s, d):
    """The cascade with vectors: a label's own text, a keyword, a blank text, and texts that only their vector places."""
    v = table(s, d, "embeddings")
    half = F.floor(F.col("label") / 2).cast("int")
    tax = (v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
           .select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"), half.alias("sector"),
                   F.col("label").alias("pos"), "vector"))
    rows = v.select("vec_id", F.expr(_VTEXT).alias("text"), half.alias("sector"), F.col("embedding").alias("vector"))
    return lb.snap_cascade_vectors(rows, tax, "vec_id")


@query("l7_name_divergence", """select c_custkey, score, score < 0.70 as diverges from (select c_custkey, case c_custkey % 3
  when 0 then 2e0 * length(c_name) / (2 * length(c_name) + 4) when 1 then 2e0 * (4 + length(c_custkey::varchar)) / (length(c_name) + 5 + length(c_custkey::varchar))
  else 1e0 end as score from customer)""")
def l7(s, d):
    """The oracle counts the matching blocks of the three kinds of pairs: the whole name, 'cust' and the number, all."""
    df = table(s, d, "customer").selectExpr("c_custkey", "c_name", """case c_custkey % 3 when 0 then concat(c_name, ' Inc')
 when 1 then concat('Cust ', c_custkey) else upper(c_name) end as other""")
    return df.select("c_custkey", lb.sequence_ratio(F.lower("c_name"), F.lower("other")).alias("score"),
                     lb.name_diverges("c_name", "other").alias("diverges"))
