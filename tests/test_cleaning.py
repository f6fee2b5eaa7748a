import pytest
from pyspark.sql import functions as F

from fieldgauge.functions import bands, text as tx
from fieldgauge.operators import cleaning as cl
from fieldgauge.operators.anomalies import classify_invalid
from fieldgauge.operators.sampling import sample_segment


def pairs(spark, rows, ddl, rule):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ddl)
    return [(r["v"], r["f"]) for r in df.select("i", rule["value"].alias("v"), rule["flag"].alias("f")).orderBy("i").collect()]


def test_state_rules(spark):
    cases = [
        (("Texas", None), ("Texas", None)),
        ((" texas ", None), ("Texas", "state_case_fix")),
        (("District Of Columbia", None), ("District of Columbia", "state_case_fix")),
        (("TX", None), ("Texas", "state_abbrev_expand")),
        (("D.C.", None), ("District of Columbia", "state_abbrev_expand")),
        (("n.y", None), ("New York", "state_abbrev_expand")),
        (("..Tx..", None), ("Texas", "state_abbrev_expand")),
        (("Tx Texas", None), ("Texas", "state_redundant_prefix")),
        (("Wv  West  Virginia", None), ("West Virginia", "state_redundant_prefix")),
        (("Greater Area New York", None), ("New York", "state_redundant_prefix")),
        (("Flrida", None), ("Florida", "state_typo_fix")),
        (("York", "New"), ("New York", "state_city_recover")),
        (("York", ""), ("New York", "state_city_recover")),
        (("York", None), ("New York", "state_city_recover")),
        (("York", "Leeds"), (None, "state_unresolvable")),
        (("Orleans", "new"), ("Louisiana", "state_city_recover")),
        (("Texas.", None), (None, "state_unresolvable")),
        (("Ontario", None), (None, "state_unresolvable")),
        (("", None), (None, None)), ((None, "New"), (None, None)),
    ]
    got = pairs(spark, [c[0] for c in cases], "state string, city string", cl.clean_state())
    assert got == [c[1] for c in cases]


def test_website_rules(spark):
    cases = [
        (None, (None, None)), ("  ", (None, None)), ("www", (None, "website_placeholder")),
        ("HTTPS://", (None, "website_placeholder")), ("https://mit.edu/x", (None, "website_institutional_tld")),
        ("army.mil", (None, "website_institutional_tld")), ("weebly.com", (None, "website_platform_blocklist")),
        ("http://www.wixsite.com", (None, "website_platform_blocklist")),
        ("https://me.wordpress.com/a", (None, "website_platform_blocklist")),
        ("notfacebook.com", ("notfacebook.com", None)), ("facebook.com.evil.org", ("facebook.com.evil.org", None)),
        (" https://acme.com ", ("https://acme.com", None)), ("health.vic.gov.au", ("health.vic.gov.au", None)),
    ]
    assert pairs(spark, [c[0] for c in cases], "website string", cl.clean_website()) == [c[1] for c in cases]


def test_name_city_founded(spark):
    assert pairs(spark, ["Acme", " x ", "N/A", "...", "", None, "AB"], "name string", cl.clean_name()) == [
        ("Acme", None), (None, "name_garbage"), (None, "name_garbage"), (None, "name_garbage"),
        (None, "name_garbage"), (None, None), ("AB", None)]
    years = pairs(spark, ["1999", "1999.0", "nan", "abc", " 1700 ", None, ""], "y string", cl.clean_founded(F.col("y")))
    assert years == [(1999, None), (1999, None), (None, None), (None, None), (None, "founded_pre1800"), (None, None), (None, None)]
    city = cl.clean_city("city", "state", F.col("flag"))
    got = pairs(spark, [("New", "York", "state_city_recover"), ("New", "Hampshire", "state_city_recover"), ("Ny", "New York", None),
                        ("Qx", "Texas", None), ("B-", "Texas", None), ("AB-", "Texas", None), ("Waco", "Texas", None), (None, "Texas", None)],
                "city string, state string, flag string", city)
    assert got == [("New York", "city_state_recombine"), ("New", None), (None, "city_junk"), (None, "city_junk"),
                   (None, "city_junk"), (None, "city_junk"), ("Waco", None), (None, None)]


COLS = "handle string, name string, website string, industry string, size string, type string, founded bigint, city string, state string, country_code string"


def test_cleaning_is_idempotent_and_partition_free(spark):
    from fieldgauge.plans.testbed import companies
    raw = companies(spark, "/root/testdata/sf0.001")
    once = cl.clean(raw, 5)
    again = cl.clean(once.select(*raw.columns), 5)
    assert once.select(*raw.columns).exceptAll(again.select(*raw.columns)).count() == 0
    assert again.where("rules_flags <> ''").count() == 0
    assert once.exceptAll(cl.clean(raw.repartition(13), 5)).count() == 0


def test_shared_domain_with_one_hot_domain(spark):
    n = 3000
    rows = [(f"h{i}", "http://hot.com/a" if i % 3 == 0 else (None if i % 3 == 1 else f"s{i % 40}.com")) for i in range(n)]
    got = {r["handle"]: r["has_shared_domain"]
           for r in cl.shared_domain_flag(spark.createDataFrame(rows, "handle string, website string"), 50).collect()}
    from collections import Counter
    seen = Counter(w for _, w in rows if w)
    assert len(got) == n and got == {h: bool(w) and seen[w] >= 50 for h, w in rows}


def test_type_hints_and_signals(spark):
    rows = [("City of Reno", None, "Government Agency", 0.93, True), ("Acme Inc.", None, "Privately Held", 0.73, False),
            ("acme llp", None, None, 0.0, False), ("Acme LLP", None, "Partnership", 0.76, True),
            ("Foundation College", None, "Nonprofit", 0.92, True), ("Any", "https://x.k12.ny.us/", "Educational", 0.95, True), (None, None, None, 0.0, False)]
    df = spark.createDataFrame([(i, n, w) for i, (n, w, *_) in enumerate(rows)], "i int, name string, website string")
    h = cl.infer_type()
    got = df.select("i", h["type"], h["confidence"], h["confirmed"]).orderBy("i").collect()
    assert [tuple(g)[1:] for g in got] == [r[2:] for r in rows]


def test_url_classes(spark):
    cases = {"https://a.godaddysites.com": "site_builder", "x.blogspot.co.uk": "blog_platform", "yelp.ca/biz": "directory",
             "yelp.co.uk": "directory", "me@acme.com": "email_as_url", "gmail.com": "email_as_url", "health.gov.au": "foreign_government",
             "www.hilton.com/reno": "wrong_entity", "tinyurl.com/x": "shortener", "acme.com": None, "bbb.org": "directory", "facebook.com": "platform"}
    df = spark.createDataFrame([(k,) for k in cases], "website string")
    assert {r[0]: r[1] for r in df.select("website", cl.url_class()).collect()} == cases


def test_domain_forms(spark):
    df = spark.createDataFrame([("https://www.Acme.com./a?b",), ("http://weebly.com",), ("acme.com?x=1",), ("  ",)], "u string")
    got = [tuple(r) for r in df.select(tx.host("u"), tx.bare_domain("u")).collect()]
    assert got == [("acme.com.", "acme.com"), ("weebly.com", "weebly.com"), ("acme.com", "acme.com"), ("", None)]


def test_non_latin_and_three_valued_churn(spark):
    df = spark.createDataFrame([("东方 Co",), ("شركة",), ("Café",), (None,)], "name string")
    assert [r[0] for r in df.select(tx.has_non_latin("name")).collect()] == [True, True, False, False]
    rows = [("1-10", 2016, None, None), ("1-10", None, None, None), ("1-10", 2016, "a.com", None), ("1-10", 2000, None, None), (None, 2016, None, None)]
    seg = spark.createDataFrame(rows, "size string, founded bigint, website string, type string").select(sample_segment().alias("s"))
    # undecided churn (no founding year) leaves the row out as well
    assert [r["s"] for r in seg.collect()] == [None, None, "micro", "micro", None]


def test_state_recovery_and_listed_types(spark):
    people = spark.createDataFrame([("a", "Reno", None), ("b", "springfield", None), ("c", "X", "Ohio"), ("d", None, None)], "handle string, city string, state string")
    xw = spark.createDataFrame([("reno", "Nevada"), ("Springfield", "Ohio"), ("Springfield", "Iowa")], "city string, state string")
    got = {r["handle"]: (r["state"], r["state_source"]) for r in cl.recover_state(people, xw).collect()}
    assert got == {"a": ("Nevada", "city_crosswalk"), "b": (None, "STATE_AMBIGUOUS"), "c": ("Ohio", "original"), "d": (None, "unknown")}
    firms = spark.createDataFrame([("a", "Acme, Inc.", None), ("b", "Other", None), ("c", "ACME", "Nonprofit")], "handle string, name string, type string")
    listed = spark.createDataFrame([("acme corp",)], "name string")
    assert {r["handle"]: r["type"] for r in cl.fill_type_from_list(firms, listed).collect()} == {"a": "Public Company", "b": None, "c": "Nonprofit"}


def test_invalid_state_categories(spark):
    df = spark.createDataFrame([("Puerto Rico", None), ("York", "New"), ("Dubai", None), ("Null", None), ("Zzz", None), ("Ohio", None)], "state string, city string")
    got = {r["category"] for r in classify_invalid(df.withColumn("_s", cl.clean_state()), F.col("_s")).collect()}
    assert got == {"territory", "city_leak", "foreign", "junk", "unclassified"}


@pytest.mark.parametrize("n,tier", [(50000, "A"), (49999, "B"), (10000, "B"), (9999, "C")])
def test_tiers(spark, n, tier):
    assert spark.range(1).select(bands.volume_tier(F.lit(n))).first()[0] == tier
