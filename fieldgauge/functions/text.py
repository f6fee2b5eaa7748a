"""Column expressions over names and web addresses. All JVM-side."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from fieldgauge.functions.space import is_blank, strip
from fieldgauge import fixed_values as fv


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: Column | str) -> Column:
    """NULL, empty and blank all mean missing."""
    c = col(c)
    return c.isNull() | is_blank(c.cast("string"))


def present(c: Column | str) -> Column:
    """The value, with blank turned into NULL."""
    c = col(c)
    return F.when(~is_blank(c.cast("string")), c)


def literal(value: object) -> str:
    """A Python value as SQL literal text."""
    if value is None:
        return "NULL"
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def lookup(mapping: Mapping[str, object], key: Column) -> Column:
    """Value of ``key`` in a small literal map, NULL when absent."""
    pairs = ", ".join(literal(x) for kv in mapping.items() for x in kv)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def any_of(words: Iterable[str]) -> str:
    """Regex alternation of literal strings."""
    return "|".join(re.escape(w).replace("/", "\\/") for w in words)


# -- domains ---------------------------------------------------------------

def host(url: Column | str) -> Column:
    """Lower-case host: scheme and one leading ``www.`` removed, cut at / ? #."""
    return F.regexp_extract(F.lower(strip(col(url))), r"^(?:https?://)?(?:www\.)?([^/?#]*)", 1)


def bare_domain(url: Column | str) -> Column:
    """Domain for comparison: https, http, www prefixes off in that order, cut
    at / and ?, trailing dots off; NULL when nothing is left."""
    cut = F.regexp_extract(F.lower(strip(col(url))), r"^(?:https://)?(?:http://)?(?:www\.)?([^/?]*)", 1)
    return F.nullif(F.rtrim(cut, F.lit(".")), F.lit(""))


def regex_domain(url: Column | str) -> Column:
    """Domain as found anywhere in the text by one pattern; NULL when none."""
    found = F.regexp_extract(
        F.lower(F.coalesce(col(url), F.lit(""))), r"(?:https?://)?(?:www\.)?([^/?#\s]+)", 1)
    return F.nullif(found, F.lit(""))


def in_domains(domain: Column | str, blocked: Iterable[str]) -> Column:
    """True when the domain is one of ``blocked`` or lies under one: its last n
    labels are looked up among the blocked domains of n labels."""
    by_labels: dict[int, list[str]] = {}
    for b in blocked:
        by_labels.setdefault(b.count(".") + 1, []).append(b)
    hits = [F.substring_index(col(domain), ".", -n).isin(*names) for n, names in sorted(by_labels.items())]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def institutional(domain: Column | str) -> Column:
    d = col(domain)
    return F.substring_index(d, ".", -1).isin(*fv.INSTITUTIONAL_TLDS) & F.contains(d, F.lit("."))


def platform_by_prefix(url: Column | str, domains: Iterable[str] = fv.PLATFORM_DOMAINS,
                       tlds: bool = True) -> Column:
    """Address starts with a platform domain, or an institutional ending sits
    anywhere in its host. False for missing addresses."""
    bare = F.regexp_replace(F.lower(col(url)), r"^(https://)?(http://)?(www\.)?", "")
    hit = bare.rlike(rf"^({any_of(domains)})")
    if tlds:
        hit = hit | bare.rlike(rf"^[^/]*\.({any_of(fv.INSTITUTIONAL_TLDS)})")
    return F.coalesce(hit & ~is_missing(url), F.lit(False))


def platform_by_substring(url: Column | str, domains: Iterable[str]) -> Column:
    """A platform domain or institutional ending occurs anywhere in the address."""
    c = F.lower(col(url))
    pattern = rf"({any_of(domains)}|\.({any_of(fv.INSTITUTIONAL_TLDS)}))"
    return F.coalesce(c.rlike(pattern), F.lit(False))


def platform_by_host(url: Column | str, domains: Iterable[str] = fv.PLATFORM_DOMAINS) -> Column:
    """The host, with or without scheme, is exactly a platform domain."""
    c = F.lower(col(url))
    with_scheme = F.regexp_extract(c, r"https?://(?:www[.])?([^/]+)", 1)
    without = F.regexp_extract(c, r"^(?:www[.])?([^/]+)", 1)
    return F.coalesce(with_scheme.isin(*domains) | without.isin(*domains), F.lit(False))


def foreign_government(url: Column | str) -> Column:
    return F.coalesce(bare_domain(url).rlike(fv.FOREIGN_GOV_HOST), F.lit(False))


def k12_host(url: Column | str) -> Column:
    return F.coalesce(bare_domain(url).rlike(fv.K12_HOST), F.lit(False))


def email_domain(url: Column | str, shared: Column | None = None) -> Column:
    """Mail domain implied by a resolved address; NULL for platform,
    institutional-profile and shared domains."""
    d = bare_domain(url)
    ok = ~in_domains(d, fv.PLATFORM_DOMAINS)
    if shared is not None:
        ok = ok & ~F.coalesce(shared, F.lit(False))
    return F.when(ok, d)


# -- names -----------------------------------------------------------------

def has_non_latin(name: Column | str) -> Column:
    """Arabic (U+0600-06FF) or CJK (U+4E00-9FFF) characters present."""
    return F.coalesce(col(name).rlike("[\\u0600-\\u06FF\\u4E00-\\u9FFF]"), F.lit(False))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length, in 0..1; two empty strings give 1."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / longest)


def sorted_tokens(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(F.lower(strip(col(c))), r"\s+")), " ")


def name_matches_domain(name: Column | str, url: Column | str) -> Column:
    """Does any significant name word occur in the domain? True as well when
    there is no address or no significant word to test."""
    domain = F.regexp_replace(F.coalesce(bare_domain(url), F.lit("")), "[^a-z0-9]", "")
    words = F.filter(
        F.split(F.lower(F.coalesce(col(name), F.lit(""))), r"[\s\-_&,./]+"),
        lambda w: (F.length(w) >= 4) & ~w.isin(*fv.NAME_DOMAIN_STOP_WORDS))
    hit = F.exists(words, lambda w: F.contains(domain, w))
    return F.when(F.coalesce(col(url), F.lit("")) == "", True).when(F.size(words) == 0, True).otherwise(hit)


def first_percentage(text: Column | str) -> Column:
    """First ``12.5 %`` found in free text as a number, 0 when there is none."""
    found = F.regexp_extract(F.coalesce(col(text).cast("string"), F.lit("")), r"(\d+(?:\.\d+)?)\s*%", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))
