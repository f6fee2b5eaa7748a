"""Cleaning rules as column expressions. Each rule gives a struct
(value, flag): the cleaned value and the name of the rule that fired."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fieldgauge.functions.space import strip
from fieldgauge import fixed_values as fv
from fieldgauge.functions import bands
from fieldgauge.functions.text import (any_of, col, foreign_government, has_non_latin, host,
                                       in_domains, institutional, k12_host, lookup, platform_by_prefix)
from fieldgauge.operators.scale import left_lookup, scalar

def _result(value: Column | None, flag: Column | str | None = None) -> Column:
    value = F.lit(None).cast("string") if value is None else value
    flag = F.lit(flag) if isinstance(flag, str) else (F.lit(None) if flag is None else flag)
    return F.struct(value.alias("value"), flag.cast("string").alias("flag"))


# -- single-column rules --------------------------------------------------------

def clean_name(name: Column | str = "name") -> Column:
    c = col(name)
    t = strip(c)
    garbage = (F.length(t) < 2) | F.lower(t).isin(*fv.NAME_SENTINELS)
    return F.when(garbage, _result(None, "name_garbage")).otherwise(_result(c))


def clean_website(url: Column | str = "website", blocked: Iterable[str] = fv.PLATFORM_DOMAINS,
                  domain: Column | None = None) -> Column:
    """``domain`` is the host of the address when it is already at hand."""
    t = strip(col(url))
    domain = host(t) if domain is None else domain
    return (F.when(t.isNull() | (t == ""), _result(None))
            .when(F.lower(t).isin(*fv.PLACEHOLDER_URLS), _result(None, "website_placeholder"))
            .when(institutional(domain), _result(None, "website_institutional_tld"))
            .when(in_domains(domain, blocked), _result(None, "website_platform_blocklist"))
            .otherwise(_result(t)))


def clean_founded(year: Column, dtype: T.DataType | None = None) -> Column:
    """Numbers and number-like text become a year; anything else is NULL without
    a flag; years before 1800 are NULL with one."""
    if dtype is None or isinstance(dtype, T.StringType):
        parsed = strip(year.cast("string")).try_cast("double")
        value = F.when(~F.isnan(parsed), parsed).try_cast("bigint")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(year), year).try_cast("bigint")
    else:
        value = year.cast("bigint")
    return F.struct(F.when(value >= 1800, value).alias("value"),
                    F.when(value < 1800, "founded_pre1800").alias("flag"))


def _fix(value: str, flag: str) -> dict[str, str]:
    return {"value": value, "flag": flag}


def _state_codes() -> dict[str, dict]:
    return {form: _fix(name, "state_abbrev_expand") for code, _, name in fv.STATES
            for form in (code.lower(), ".".join(code.lower()))}


def _known_states() -> dict[str, dict]:
    """Lower-case spelling -> fix: names in other letter case, postal codes with
    and without dots, known typos. The spellings do not overlap."""
    known = {v.lower(): _fix(v, "state_case_fix") for v in bands.STATE_NAMES}
    known |= {k.lower(): _fix(v, "state_typo_fix") for k, v in fv.STATE_TYPOS.items()}
    return known | _state_codes()


def clean_state(state: Column | str = "state", city: Column | str = "city", low: Column | None = None) -> Column:
    """First match wins: exact, other letter case, postal code, valid name after
    dropping leading words, known typo, place split over city and state.
    ``low`` is the lower-case trimmed state when it is already at hand."""
    raw = strip(col(state))
    low = F.lower(raw) if low is None else low
    tails = {name.lower(): _fix(name, "state_redundant_prefix") for name in bands.STATE_NAMES}
    # lazily drop as few leading words as possible, so the longest name is tried first
    tail = F.regexp_extract(F.regexp_replace(low, r"\s+", " "), rf"^(?:\S+ )+?({any_of(tails)})$", 1)
    halves = lookup({k.lower(): {"first": v[0].lower(), "fix": _fix(v[1], "state_city_recover")}
                     for k, v in fv.SPLIT_PLACES.items()}, low)
    town = F.lower(strip(F.coalesce(col(city), F.lit(""))))
    return (F.when(F.coalesce(raw, F.lit("")) == "", _result(None))
            .when(raw.isin(*bands.STATE_NAMES), _result(raw))
            .otherwise(F.coalesce(
                lookup(_known_states(), low), lookup(_state_codes(), F.btrim(low, F.lit("."))), lookup(tails, tail),
                F.when(town.isin("", halves["first"]), halves["fix"]), _result(None, "state_unresolvable"))))


def clean_city(city: Column | str, raw_state: Column | str, state_flag: Column) -> Column:
    t = strip(col(city))
    whole = lookup({k.lower(): v[2] for k, v in fv.SPLIT_PLACES.items() if v[2]},
                   F.lower(strip(col(raw_state))))
    junk = (F.lower(t).isin(*fv.JUNK_CITIES) | ((F.length(t) <= 2) & t.rlike(r"^\p{L}+$"))
            | ((F.length(t) <= 3) & t.endswith("-")))
    return (F.when(t.isNull() | (t == ""), _result(None))
            .when((state_flag == "state_city_recover") & whole.isNotNull(), _result(whole, "city_state_recombine"))
            .when(junk, _result(None, "city_junk"))
            .otherwise(_result(col(city))))


# -- the whole table -------------------------------------------------------------

def apply_rules(df: DataFrame, blocked: Iterable[str] = fv.PLATFORM_DOMAINS) -> DataFrame:
    """All rules in one narrow pass: cleaned columns, ``rules_flags`` and the two
    row-level booleans. No shuffle."""
    keep = [c for c in df.columns if c not in ("name", "website", "founded", "city", "state")]
    # parts used several times come first, so each is computed once per row and
    # the generated code stays in methods small enough to be compiled
    parts = df.select(*keep, "name", "founded", "city", strip("state").alias("_raw_state"),
                      F.lower(strip("state")).alias("_low_state"), strip("website").alias("_url"),
                      host("website").alias("_host"))
    ruled = parts.select(
        *keep, "city", "_raw_state", clean_name().alias("_name"),
        clean_founded(F.col("founded"), df.schema["founded"].dataType).alias("_founded"),
        clean_state("_raw_state", "city", F.col("_low_state")).alias("_state"), "_url", "_host")
    ruled = ruled.withColumns({"_web": clean_website("_url", blocked, F.col("_host")),
                               "_city": clean_city("city", "_raw_state", F.col("_state.flag"))})
    flags = F.concat_ws(",", *[f"{c}.flag" for c in ("_name", "_state", "_city", "_web", "_founded")])
    value = {"name": "_name", "website": "_web", "founded": "_founded", "city": "_city", "state": "_state"}
    out = ruled.select(*[F.col(f"{value[c]}.value").alias(c) if c in value else F.col(c) for c in df.columns],
                       flags.alias("rules_flags"))
    return (out.withColumn("has_non_latin_name", has_non_latin("name"))
            .withColumn("implausible_size_founded", bands.implausible_size()))


def shared_domain_flag(df: DataFrame, min_keys: int = 50, key: str = "handle", url: str = "website",
                       flag: str = "has_shared_domain") -> DataFrame:
    """Mark rows whose domain occurs on at least ``min_keys`` distinct keys. One
    domain may hold any share of the table: the counts pre-aggregate on
    (domain, key), and the join back separates hot domains from the rest."""
    keyed = df.withColumn("_dom", F.coalesce(host(url), F.lit("")))
    # rows without a domain fold into one keyless group, which no threshold lets through
    counts = (keyed.select("_dom", F.when(F.col("_dom") != "", F.col(key)).alias("_k")).groupBy("_dom")
              .agg(F.count_distinct("_k").alias("_keys"), F.count("*").alias("_rows"))
              .where(F.col("_keys") >= min_keys).withColumn("_shared", F.lit(True)))
    out = left_lookup(keyed, counts, "_dom", key, "_rows", ["_shared"])
    return out.withColumn(flag, F.coalesce("_shared", F.lit(False))).drop("_dom", "_shared")


def clean(df: DataFrame, min_shared: int = 50) -> DataFrame:
    return shared_domain_flag(apply_rules(df), min_shared)


def recovery_by_flag(cleaned: DataFrame) -> DataFrame:
    return (cleaned.where("rules_flags <> ''").select(F.explode(F.split("rules_flags", ",")).alias("flag"))
            .groupBy("flag").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "flag"))


def recovery_stats(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """What cleaning changed, from two one-row aggregates."""
    before = raw.agg(F.struct(*[(F.count("*") - F.count(c)).alias(c) for c in ("state", "name", "website", "founded")],
                              F.count_if(~bands.valid_state()).alias("invalid_state")))
    flags = F.col("rules_flags")
    after = cleaned.agg(
        F.count("*").alias("total"), F.count_if(flags != "").alias("changed"),
        *[(F.count("*") - F.count(c)).alias(f"_{c}") for c in ("state", "name", "website", "founded")],
        F.count_if(F.contains(flags, F.lit("city_state_recombine"))).alias("city_recombined"),
        F.count_if(F.contains(flags, F.lit("city_junk"))).alias("city_junked"),
        F.count_if("has_non_latin_name").alias("non_latin_names"),
        F.count_if("implausible_size_founded").alias("implausible_sizes"),
        F.count_if("has_shared_domain").alias("shared_domains"))
    b = after.withColumn("_b", scalar(before))
    gone = {c: F.col(f"_{c}") - F.col(f"_b.{c}") for c in ("state", "name", "website", "founded")}
    return b.select("total", "changed", F.col("_b.invalid_state").alias("state_invalid"),
                    (F.col("_b.invalid_state") - gone["state"]).alias("state_recovered"),
                    gone["state"].alias("state_nulled"), gone["name"].alias("name_nulled"),
                    "city_recombined", "city_junked", gone["website"].alias("website_nulled"),
                    gone["founded"].alias("founded_nulled"), "non_latin_names", "implausible_sizes", "shared_domains")


# -- optional extra rules ----------------------------------------------------------

def merge_labels(label: Column | str = "industry", pairs: Sequence[tuple[str, str]] = fv.DUPLICATE_LABELS) -> Column:
    """Replace a duplicate label by its canonical form, others untouched."""
    c = col(label)
    return F.coalesce(lookup({dup: keep for keep, dup in pairs}, F.lower(c)), c)


def url_class(url: Column | str = "website") -> Column:
    """Class of address beyond the core platform list; NULL when it looks like a
    company's own. A parent brand's domain is a wrong entity, not a missing value."""
    d = host(url)
    out = F.when(in_domains(d, fv.PLATFORM_DOMAINS), "platform")
    for label, domains in fv.URL_CLASSES:
        out = out.when(in_domains(d, domains), label)
    return (out.when(d.rlike(r"(^|\.)blogspot\.[a-z.]+$"), "blog_platform")
            .when(d.rlike(r"(^|\.)yelp\.[a-z]{2}(\.[a-z]{2})?$|(^|\.)yelp\.co\.[a-z]{2}$"), "directory")
            .when(F.contains(strip(col(url)), F.lit("@")), "email_as_url")
            .when(d.rlike(fv.FOREIGN_GOV_HOST), "foreign_government")
            .when(in_domains(d, fv.PARENT_BRAND_DOMAINS), "wrong_entity"))


def unique_city_states(crosswalk: DataFrame) -> DataFrame:
    """Per lower-case city: its state when there is only one, and how many there are.
    min and max decide uniqueness, so no list of states is ever collected."""
    return (crosswalk.where("trim(city) <> '' and state is not null")
            .groupBy(F.lower(strip("city")).alias("_city"))
            .agg(F.min("state").alias("_lo"), F.max("state").alias("_hi")))


def recover_state(df: DataFrame, crosswalk: DataFrame, key: str = "handle") -> DataFrame:
    """Fill a missing state from the city where the city has one state only;
    cities with several are reported as STATE_AMBIGUOUS. Only rows that lack a
    state take part in the join."""
    states = unique_city_states(crosswalk)
    want = F.when(F.col("state").isNull(), F.lower(strip("city")))
    keyed = df.withColumn("_want", F.coalesce(want, F.lit("")))
    need = keyed.groupBy("_want").agg(F.count("*").alias("_n"))
    side = need.join(states, F.col("_want") == F.col("_city")).select("_want", "_n", "_lo", "_hi")
    out = left_lookup(keyed, side, "_want", key, "_n", ["_lo", "_hi"])
    unique = F.col("_lo") == F.col("_hi")
    return (out.withColumn("state_source", F.when(F.col("state").isNotNull(), "original")
                           .when(unique, "city_crosswalk").when(F.col("_lo").isNotNull(), "STATE_AMBIGUOUS")
                           .otherwise("unknown"))
            .withColumn("state", F.coalesce("state", F.when(unique, F.col("_lo"))))
            .drop("_want", "_lo", "_hi"))


def fill_type_from_list(df: DataFrame, listed: DataFrame, key: str = "handle", value: str = "Public Company") -> DataFrame:
    """Fill a missing type for names found in a list of public companies.
    Names are compared lower-case without punctuation and legal endings."""
    def plain(c: Column) -> Column:
        words = F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", "")
        return strip(F.regexp_replace(words, r"\b(inc|corp|corporation|co|company|ltd|llc|plc)\b", ""))

    names = listed.select(plain(F.col("name")).alias("_want")).where("_want <> ''").distinct()
    keyed = df.withColumn("_want", F.coalesce(F.when(F.col("type").isNull(), plain(F.col("name"))), F.lit("")))
    need = keyed.groupBy("_want").agg(F.count("*").alias("_n"))
    side = need.join(names, "_want").withColumn("_listed", F.lit(True))
    out = left_lookup(keyed, side, "_want", key, "_n", ["_listed"])
    return (out.withColumn("type", F.coalesce("type", F.when(F.col("_listed"), value)))
            .withColumn("type_from_list", F.coalesce("_listed", F.lit(False))).drop("_want", "_listed"))


def infer_type(name: Column | str = "name", url: Column | str = "website") -> Column:
    """Type suggested by a K-12 host or by the first name pattern that matches:
    struct (type, confidence, industry, confirmed), all NULL/0/false when none."""
    def guess(t, conf, industry, confirmed):
        return F.struct(F.lit(t).cast("string").alias("type"), F.lit(conf).cast("double").alias("confidence"),
                        F.lit(industry).cast("string").alias("industry"), F.lit(confirmed).alias("confirmed"))

    text = F.coalesce(col(name), F.lit(""))
    low = F.lower(text)
    out = F.when(k12_host(url), guess("Educational", 0.95, "primary and secondary education", True))
    for pattern, t, conf, confirmed in fv.NAME_TYPE_PATTERNS:
        # a plain search for its words settles a pattern for most names
        named = reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in plain_words(pattern)])
        out = out.when(named & text.rlike(pattern), guess(t, conf, None, confirmed))
    return out.otherwise(guess(None, 0.0, None, False))


def plain_words(pattern: str) -> list[str]:
    """The lower-case texts of which a name pattern needs one: words or groups of them between word borders."""
    words = re.sub(r"\(\?i\)|\\b|\\\.\?|\(\?:|\)", "", pattern).lower().split("|")
    if not all(re.fullmatch("[a-z ]+", w) for w in words):
        raise ValueError(f"no plain words in {pattern!r}")
    return words


def address_signals(url: Column | str = "website") -> dict[str, Column]:
    """Row-level address signals used before any evidence is looked at."""
    corrupted = foreign_government(url)
    return {"website_corrupted": corrupted, "k12": k12_host(url),
            "website_rules_flag": platform_by_prefix(url) | corrupted}
