"""Registered cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldgauge.functions import bands, text as tx
from fieldgauge.operators import cleaning as cl
from fieldgauge.operators.sampling import SAMPLE_PLATFORMS
from fieldgauge.plans.registry import query, quoted
from fieldgauge.plans.testbed import CLEANED_CTE, COMPANIES_CTE, cleaned, companies, table
from fieldgauge import fixed_values as fv

C, K = COMPANIES_CTE, CLEANED_CTE


def ruled(s, d):
    return cl.apply_rules(companies(s, d))


def _one(df, rule):
    return df.select("handle", rule["value"].alias("value"), rule["flag"].alias("flag"))


@query("c1_name", """select handle, case when name in ('n/a','x') then null else name end as value,
 case when name in ('n/a','x') then 'name_garbage' end as flag from companies""", C)
def c1(s, d):
    return _one(companies(s, d), cl.clean_name())


_NULLED = "('www','weebly.com','https://www.facebook.com/p','http://foo.wixsite.com/p')"


@query("c2_website", f"""select handle, case when website in {_NULLED} then null else website end as value,
 case when website='www' then 'website_placeholder' when website in {_NULLED} then 'website_platform_blocklist' end as flag
 from companies""", C)
def c2(s, d):
    return _one(companies(s, d), cl.clean_website())


@query("c2_page_urls", r"""select page_id, case when u = '' then null else u end as value,
 case when regexp_matches(h, '\.(edu|gov|mil)$') then 'website_institutional_tld' end as flag
 from (select page_id, trim(url) as u, regexp_extract(lower(url), '^https?://([^/?#]*)', 1) as h from pages)""")
def c2b(s, d):
    r = cl.clean_website("url")
    return table(s, d, "pages").select("page_id", r["value"].alias("value"), r["flag"].alias("flag"))


@query("c3_founded", """select handle, case when founded >= 1800 then founded end as value,
 case when founded < 1800 then 'founded_pre1800' end as flag from companies""", C)
def c3(s, d):
    df = companies(s, d)
    return _one(df, cl.clean_founded(F.col("founded"), df.schema["founded"].dataType))


@query("c3_founded_from_text", """select handle, case when founded >= 1800 then founded end as value,
 case when founded < 1800 then 'founded_pre1800' end as flag from
 (select handle, case when founded % 2 = 0 then founded when founded % 3 = 0 then null else founded end as founded from companies)""", C)
def c3b(s, d):
    y = F.col("founded")
    text = F.when(y % 2 == 0, F.concat(y.cast("string"), F.lit(".0"))).when(y % 3 == 0, "nan").otherwise(
        F.concat(F.lit(" "), y.cast("string")))
    return _one(companies(s, d).withColumn("founded", text), cl.clean_founded(F.col("founded")))


_STATE = """case state when 'York' then 'New York' when 'Tx Texas' then 'Texas' when 'Flrida' then 'Florida'
 when 'District Of Columbia' then 'District of Columbia' when 'N.Y.' then 'New York' when 'Ontario' then null else state end"""
_SFLAG = """case state when 'York' then 'state_city_recover' when 'Tx Texas' then 'state_redundant_prefix'
 when 'Flrida' then 'state_typo_fix' when 'District Of Columbia' then 'state_case_fix'
 when 'N.Y.' then 'state_abbrev_expand' when 'Ontario' then 'state_unresolvable' end"""


@query("c4_state", f"select handle, {_STATE} as value, {_SFLAG} as flag from companies", C)
def c4(s, d):
    return _one(companies(s, d), cl.clean_state())


@query("c5_city", """select handle, case when state='York' and city='New' then 'New York' when city='Ny' then null else city end as value,
 case when state='York' then 'city_state_recombine' when city='Ny' then 'city_junk' end as flag from companies""", C)
def c5(s, d):
    df = companies(s, d)
    return _one(df, cl.clean_city("city", "state", cl.clean_state()["flag"]))


@query("c6_cleaned_table", """select handle, name, website, industry, size, type, founded, city, state, country_code,
 rules_flags, has_non_latin_name, implausible_size_founded from cleaned""", C, K)
def c6(s, d):
    return ruled(s, d)


@query("c7_non_latin", r"""select doc_id, regexp_matches(text, '[\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}]') as non_latin from documents""")
def c7(s, d):
    return table(s, d, "documents").select("doc_id", tx.has_non_latin("text").alias("non_latin"))


@query("c8_implausible", "select handle, implausible_size_founded as flag from cleaned", C, K)
def c8(s, d):
    return ruled(s, d).select("handle", F.col("implausible_size_founded").alias("flag"))


@query("c9_recovery_by_flag", """select flag, count(*) as records from
 (select unnest(string_split(rules_flags, ',')) as flag from cleaned where rules_flags <> '') group by flag""", C, K)
def c9(s, d):
    return cl.recovery_by_flag(ruled(s, d))


@query("c9_recovery_stats", f"""select count(*) as total, count(*) filter (rules_flags<>'') as changed,
 (select count(*) from companies where state is not null and state not in ({quoted(bands.STATE_NAMES)})) as state_invalid,
 count(*) filter (regexp_matches(rules_flags, 'state_(case_fix|abbrev|redundant|typo|city)')) as state_recovered,
 count(*) filter (contains(rules_flags, 'state_unresolvable')) as state_nulled,
 count(*) filter (contains(rules_flags, 'name_garbage')) as name_nulled,
 count(*) filter (contains(rules_flags, 'city_state_recombine')) as city_recombined,
 count(*) filter (contains(rules_flags, 'city_junk')) as city_junked,
 count(*) filter (contains(rules_flags, 'website_')) as website_nulled,
 count(*) filter (contains(rules_flags, 'founded_')) as founded_nulled,
 count(*) filter (has_non_latin_name) as non_latin_names, count(*) filter (implausible_size_founded) as implausible_sizes,
 count(*) filter (has_shared_domain) as shared_domains from cleaned""", C, K)
def c9b(s, d):
    raw = companies(s, d)
    return cl.recovery_stats(raw, cl.clean(raw))


@query("c10_host", r"""select page_id, case when starts_with(h, 'www.') then substr(h, 5) else h end as host from
 (select page_id, regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#]*)', 1) as h from pages)""")
def c10(s, d):
    return table(s, d, "pages").select("page_id", tx.host("url").alias("host"))


@query("c11_bare_domain", r"""select page_id, nullif(rtrim(regexp_extract(lower(trim(url)),
 '^(?:https://)?(?:http://)?(?:www\.)?([^/?]*)', 1), '.'), '') as domain from pages""")
def c11(s, d):
    return table(s, d, "pages").select("page_id", tx.bare_domain("url").alias("domain"))


@query("c12_regex_domain", r"""select page_id,
 nullif(regexp_extract(lower(coalesce(url,'')), '(?:https?://)?(?:www\.)?([^/?#\s]+)', 1), '') as domain from pages""")
def c12(s, d):
    return table(s, d, "pages").select("page_id", tx.regex_domain("url").alias("domain"))


@query("c13_platform_prefix", """select handle, website is not null and
 (website in ('https://www.facebook.com/p','weebly.com') or website = 'betterhealth.vic.gov.au') as platform from companies""", C)
def c13(s, d):
    return companies(s, d).select("handle", tx.platform_by_prefix("website").alias("platform"))


_SUB = " or ".join(f"contains(lower(website), '{h}')" for h in (*SAMPLE_PLATFORMS, ".edu", ".gov", ".mil"))


@query("c14_platform_substring", f"select handle, coalesce({_SUB}, false) as platform from companies", C)
def c14(s, d):
    return companies(s, d).select("handle", tx.platform_by_substring("website", SAMPLE_PLATFORMS).alias("platform"))


@query("c15_gov_and_k12", """select handle, coalesce(website = 'betterhealth.vic.gov.au', false) as foreign_gov,
 coalesce(website = 'https://d1.k12.ny.us', false) as k12 from companies""", C)
def c15(s, d):
    return companies(s, d).select("handle", tx.foreign_government("website").alias("foreign_gov"),
                                  tx.k12_host("website").alias("k12"))


@query("c16_shared_domain", "select handle, has_shared_domain from cleaned", C, K)
def c16(s, d):
    return cl.clean(companies(s, d)).select("handle", "has_shared_domain")


@query("c16_shared_page_host", r"""select page_id, coalesce(h <> '' and count(*) over (partition by h) >= 3, false) as shared from
 (select page_id, regexp_replace(regexp_extract(lower(url), '^(?:https?://)?([^/?#]*)', 1), '^www\.', '') as h from pages)""")
def c16b(s, d):
    return cl.shared_domain_flag(table(s, d, "pages"), 3, "page_id", "url", "shared").select("page_id", "shared")


_MERGE = (("construction", "retail"), ("truck transportation", "manufacturing"), *fv.DUPLICATE_LABELS)


@query("c17_merged_labels", """select case industry when 'retail' then 'construction' when 'manufacturing' then 'truck transportation'
 else industry end as label, count(*) as records from companies group by 1""", C)
def c17(s, d):
    return companies(s, d).groupBy(cl.merge_labels(pairs=_MERGE).alias("label")).agg(F.count("*").alias("records"))


@query("c18_url_class", """select handle, case when website in ('https://www.facebook.com/p','weebly.com','http://foo.wixsite.com/p')
 then 'platform' when website = 'betterhealth.vic.gov.au' then 'foreign_government' end as url_class from companies""", C)
def c18(s, d):
    return companies(s, d).select("handle", cl.url_class().alias("url_class"))


@query("c19_state_from_city", """select a.handle, coalesce(a.state, case when b.lo = b.hi then b.lo end) as state,
 case when a.state is not null then 'original' when b.lo = b.hi then 'city_crosswalk' when b.lo is not null then 'STATE_AMBIGUOUS'
 else 'unknown' end as state_source
 from cleaned a left join (select lower(trim(name)) as c, min(state) as lo, max(state) as hi from cleaned
  where name is not null and state is not null group by 1) b on lower(trim(a.name)) = b.c""", C, K)
def c19(s, d):
    df = cleaned(s, d).select("handle", F.col("name").alias("city"), "state")
    return cl.recover_state(df, df).select("handle", "state", "state_source")


_PLAIN = """trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'),
 '\\b(inc|corp|corporation|co|company|ltd|llc|plc)\\b', '', 'g'))"""


@query("c20_type_from_list", f"""select a.handle, coalesce(a.type, case when b.n is not null then 'Public Company' end) as type,
 a.type is null and b.n is not null as type_from_list from cleaned a
 left join (select distinct {_PLAIN.format(c="c_name || ' Corp'")} as n from customer where c_acctbal >= 5000) b
 on {_PLAIN.format(c='a.name')} = b.n""", C, K)
def c20(s, d):
    listed = table(s, d, "customer").where("c_acctbal >= 5000").select(F.concat("c_name", F.lit(" Corp")).alias("name"))
    return cl.fill_type_from_list(cleaned(s, d), listed).select("handle", "type", "type_from_list")


@query("c21_high_churn", """select handle, size='1-10' and founded>=2015 and website is null and type is null as high_churn
 from companies""", C)
def c21(s, d):
    return companies(s, d).select("handle", bands.high_churn().alias("high_churn"))


@query("c22_low_signal", """select handle, website is null and industry is null and name is null as low_signal from cleaned""", C, K)
def c22(s, d):
    return cleaned(s, d).select("handle", bands.low_signal().alias("low_signal"))


@query("c23_type_from_name", """select handle,
 case when website = 'https://d1.k12.ny.us' then 'Educational' when name like 'City of %' then 'Government Agency'
  when name like '% Foundation' then 'Nonprofit' when name like '% LLP' then 'Partnership' when name like '% Inc' then 'Privately Held' end as type,
 case when website = 'https://d1.k12.ny.us' then 0.95e0 when name like 'City of %' then 0.93e0
  when name like '% Foundation' then 0.92e0 when name like '% LLP' then 0.76e0 when name like '% Inc' then 0.73e0 else 0e0 end as confidence,
 coalesce(website = 'https://d1.k12.ny.us', false) or coalesce(name like 'City of %' or name like '% Foundation' or name like '% LLP', false) as confirmed
 from companies""", C)
def c23(s, d):
    h = cl.infer_type()
    return companies(s, d).select("handle", h["type"].alias("type"), h["confidence"].alias("confidence"), h["confirmed"].alias("confirmed"))


@query("c24_audience", """select p_partkey, case when p_size in (44,45,61,71,72) then 'B2C' when p_size in (62,81) then 'Both'
 when p_size in (11,21,22,23,31,32,33,42,48,49,51,52,53,54,55,56,92) then 'B2B' end as audience from part""")
def c24(s, d):
    return table(s, d, "part").select("p_partkey", bands.audience("p_size").alias("audience"))


_STOPS = quoted(fv.NAME_DOMAIN_STOP_WORDS)


@query("c25_name_in_domain", f"""select page_id, case when len(w) = 0 then true
 else len(list_filter(w, lambda x: contains(d, x))) > 0 end as matches from (
 select page_id, regexp_replace(regexp_extract(lower(url), '^(?:https://)?(?:http://)?(?:www\\.)?([^/?]*)', 1), '[^a-z0-9]', '', 'g') as d,
  list_filter(regexp_split_to_array(lower(name), '[\\s\\-_&,./]+'), lambda x: length(x) >= 4 and x not in ({_STOPS})) as w
 from (select page_id, url, case page_id%3 when 0 then regexp_extract(url, '//([^./]+)', 1) || ' Company'
  when 1 then 'The Co' else 'Unrelated Traders' end as name from pages))""")
def c25(s, d):
    name = (F.when(F.col("page_id") % 3 == 0, F.concat(F.regexp_extract("url", "//([^./]+)", 1), F.lit(" Company")))
            .when(F.col("page_id") % 3 == 1, "The Co").otherwise("Unrelated Traders"))
    return table(s, d, "pages").select("page_id", tx.name_matches_domain(name, "url").alias("matches"))


@query("c26_email_domain", r"""select handle, case when not has_shared_domain then
 nullif(regexp_extract(lower(website), '^(?:https://)?(?:http://)?(?:www\.)?([^/?]*)', 1), '') end as email_domain from cleaned""", C, K)
def c26(s, d):
    df = cleaned(s, d)
    return df.select("handle", tx.email_domain("website", F.col("has_shared_domain")).alias("email_domain"))
