"""Taxonomies in blocks, the one-shuffle merge, raw label texts and the budget stop."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import lev

from fieldgauge.operators import blocks, evidence as ev, labels as lb
from fieldgauge.plans import evidence_views as views
from conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_edit(texts, labels):
    out = {}
    for t in texts:
        best = max((1.0 - lev(t, l) / max(len(t), len(l), 1), -i) for i, l in enumerate(labels))
        out[t] = (labels[-best[1]], best[0])
    return out


@pytest.mark.parametrize("block", [40, 4096])
def test_edit_match_is_that_of_measuring_all(spark, monkeypatch, block):
    monkeypatch.setattr(lb, "in_blocks", lambda *a: blocks.in_blocks(*a, block=block, slice_=7))
    rng = random.Random(block)
    words = ["steel", "steal", "care", "cares", "health", "é𝒳", "retail", "b", "wholesale", "of"]
    labels = sorted({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(120)})
    rng.shuffle(labels)
    texts = ["", "zz", "qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq", "retial", "helth cares"] + [
        "".join(c for c in l if rng.random() > 0.15) for l in labels[:40]] + labels[:5]
    want = brute_edit(set(texts), labels)
    got = lb.snap_edit(spark.createDataFrame([(t,) for t in texts + [None]], "text string"),
                       spark.createDataFrame([(l, i) for i, l in enumerate(labels)], "label string, pos int"))
    rows = {r["text"]: (r["label"], r["score"]) for r in got.collect()}
    assert rows.pop(None) == (None, None)
    assert rows == {t: (l if s >= 0.45 else None, s) for t, (l, s) in want.items()}


def test_edit_match_measures_few_of_many_labels(spark):
    """50,000 labels: what is measured grows with the texts, and the answer is that of Spark's own measure over all."""
    rng = random.Random(7)
    syllables = ["ma", "nu", "fac", "tur", "ing", "re", "tail", "tra", "de", "ser", "vi", "ces", "con", "sul", "health", "care", "bo", "ok"]
    labels = set()
    while len(labels) < 50_000:
        labels.add(" ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(rng.randint(1, 3))))
    labels = sorted(labels)
    tax = spark.createDataFrame([(l, i) for i, l in enumerate(labels)], "label string, pos int").repartition(8).cache()

    def spoil(l):
        at = rng.randrange(len(l))
        return l[:at] + rng.choice("xyz") + l[at + 1:]
    texts = sorted({spoil(l) for l in rng.sample(labels, 80)})
    measured = []
    for part in (texts[::2], texts[1::2], texts):
        df = spark.createDataFrame([(t,) for t in part], "text string")
        measured.append(lb.edit_candidates(df, tax).agg(F.sum("tried")).first()[0])
    assert measured[2] < 0.01 * len(texts) * len(labels)
    assert measured[2] == measured[0] + measured[1]      # a text's share does not depend on the others
    few = spark.createDataFrame([(t,) for t in texts[:8]], "text string")
    want = {r["text"]: r["s"] for r in few.join(tax, F.lit(True)).groupBy("text").agg(F.max(lb.similarity("text", "label")).alias("s")).collect()}
    assert {r["text"]: r["score"] for r in lb.snap_edit(few, tax).collect()} == want


def test_cosine_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lb, "in_blocks", lambda *a: blocks.in_blocks(*a, block=16, slice_=9))
    rng = np.random.default_rng(4)
    label_v, row_v = rng.normal(size=(200, 12)), rng.normal(size=(60, 12))
    label_v[7] = label_v[3]
    row_v[0] = label_v[3]
    row_v[5] = 0
    sector = [int(i % 5) for i in range(200)]
    mine = [None if i % 7 == 0 else int(i % 6) for i in range(60)]   # sector 5 has no labels
    tax = spark.createDataFrame([(f"l{i}", sector[i], i, v.tolist()) for i, v in enumerate(label_v)], "label string, sector int, pos int, vector array<double>")
    rows = spark.createDataFrame([(i, mine[i], v.tolist()) for i, v in enumerate(row_v)] + [(99, 1, None)], "id int, sector int, vector array<double>")
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    sims = unit(row_v) @ unit(label_v).T
    want = {}
    for i in range(60):
        own = [j for j in range(200) if sector[j] == mine[i]]
        top = max(own, key=lambda j: (sims[i, j], -j)) if own else None
        if top is not None and sims[i, top] >= 0.4:
            want[i] = (f"l{top}", "sector")
        else:
            top = max(range(200), key=lambda j: (sims[i, j], -j))
            want[i] = (f"l{top}", "all") if sims[i, top] >= 0.4 else (None, None)
    got = {r["id"]: (r["label"], r["scope"]) for r in lb.snap_cosine(rows, tax, "id").collect()}
    assert got == want and got[0][0] == "l3"


def test_sources_meet_in_one_exchange_and_one_join(spark):
    evidence = {n: spark.createDataFrame([], f"handle string, {ddl}") for n, ddl in ev.SOURCES.items()}
    entities = spark.createDataFrame([("a", 1)], "handle string, x int")
    out = ev.gather(entities, evidence)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(ev.gather(entities, evidence))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == 2   # the union, and the entities
    assert [r["found"] for r in out.collect()] == [None]
    assert ev.gather(entities, {}).columns == out.columns


def test_rows_without_a_key_meet_nobody(spark):
    gate = spark.createDataFrame([("a", "MATCH"), (None, "NO_MATCH")], "handle string, entity_verdict string")
    entities = spark.createDataFrame([("a",), ("b",), (None,)], "handle string")
    got = {r["handle"]: r["gate"] and r["gate"][0] for r in ev.gather(entities, {"gate": gate}).collect()}
    assert got == {"a": "MATCH", "b": None, None: None}


def test_raw_labels_reach_every_row(spark):
    texts = ["Retail ", "retail", "constructoin", None, " ", "zzzz"]
    found = spark.createDataFrame([(f"h{i}", texts[0] if i % 3 == 0 else texts[i % 6]) for i in range(3000)], "handle string, industry_raw string")
    tax = spark.createDataFrame([("construction", 0), ("retail", 1)], "label string, pos int")
    want = {"Retail ": "retail", "retail": "retail", "constructoin": "construction"}
    rows = ev.snap_raw_labels(found, tax).collect()
    assert len(rows) == 3000 and all(r["industry_snapped"] == want.get(r["industry_raw"]) for r in rows)


def test_budget_stops_work_and_then_the_closure_check(spark):
    cols = "handle string, name string, website string, industry string, size string, type string, city string, state string, poc_segment string, poc_condition string"
    entities = spark.createDataFrame([(f"h{i}", f"Name {i}", None, "retail", None, None, "c", "s", "smb", "none") for i in range(6)], cols)
    closed = spark.createDataFrame([(f"h{i}", True, None, False) for i in range(6)], "handle string, still_operating boolean, closure_signals array<string>, error boolean")
    found = spark.createDataFrame([(f"h{i}",) for i in range(6)], "handle string").select(
        "handle", *[F.lit(None).cast(d.split(" ", 1)[1]).alias(d.split(" ", 1)[0]) for d in ev.FINDING.split(", ")])
    costs = spark.createDataFrame([(f"h{i}", 10, 3) for i in range(5)], "handle string, cost int, closing_cost int")
    evidence = {"found": found, "closed": closed}
    got = {r["handle"]: r for r in ev.resolve_within_budget(entities, evidence, costs, 27, ["handle"], version="7").collect()}
    assert [got[f"h{i}"]["status"] for i in range(6)] == ["completed"] * 3 + ["budget_exhausted"] * 3
    # h2 has spent 20 + 7 before its closure check, so that does not run; h1 is at 17
    assert [got[f"h{i}"]["still_operating"] for i in range(6)] == [True, True, None, None, None, None]
    late = got["h4"].asDict()
    assert late["enrichment_status"] == "NO_CANDIDATE" and late["stage_resolved"] == 0 and late["name"] == "Name 4"
    assert all(late[c] is None for c in late if c.endswith(("_final", "_flag", "_original", "_confidence")))
    assert {r["pipeline_version"] for r in got.values()} == {"7"}


def test_the_merge_runs_whole_on_derived_evidence(spark):
    rows = ev.resolve(views.entities(spark, SF), views.evidence(spark, SF), version="1")
    assert rows.count() == 1500 and rows.columns[-1] == "pipeline_version"


def test_letters_rule_out_names_without_comparing(spark):
    rng = random.Random(9)
    words = ["customer#000000012", "totally", "different", "company", "smith", "johnson", "law", "é𝒳", "", "llc"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 3))), " ".join(rng.choices(words, k=rng.randint(0, 3)))) for _ in range(150)]
    pairs += [("Customer#000000012", "Totally Different Company"), (None, "x"), ("x", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in lb.with_divergence(df, "a", "b", "differ").select(
            "*", lb.name_diverges("a", "b").alias("plain"), lb.names_far(F.lower("a"), F.lower("b"), 0.70).alias("far")).collect():
        if r["b"] is not None:
            assert r["differ"] == (SequenceMatcher(None, (r["a"] or "").lower(), r["b"].lower()).ratio() < 0.70)
        assert r["differ"] == r["plain"] and (r["differ"] or not r["far"])
        assert r["far"] or r["b"] != "Totally Different Company"


def test_the_merge_stays_in_methods_the_jvm_compiles(spark):
    """Above 8,000 bytes a method is interpreted for good; the keys are sorted by a number."""
    rows = ev.resolve(views.entities(spark, SF), views.evidence(spark, SF), trace=True).select(
        *ev.OUTPUT, *views.TRACE, F.col("ev.candidate_website").alias("found_website"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rows.select("*")._jdf.queryExecution().executedPlan()
        parts = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
        assert max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())) <= 8000
        assert "Sort [xxhash64(handle" in plan.toString() or "SortAggregate(key=[_groupingexpression" in plan.toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_names_are_compared_as_difflib_does(monkeypatch):
    rng = random.Random(5)
    pairs = [("".join(rng.choices(letters, k=rng.randint(0, 25))), "".join(rng.choices(letters, k=rng.randint(0, 25))))
             for letters in ("ab", "abc", "abcdefgh ", "é𝒳a ") for _ in range(300)]
    pairs += [("".join(rng.choices("abc", k=rng.randint(190, 210))), "".join(rng.choices("abc", k=rng.randint(190, 210)))) for _ in range(12)]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [lb.matching_share(a, b) for a, b in pairs] == want
    monkeypatch.setattr("difflib.SequenceMatcher", None)   # slow, and not needed for names
    assert lb.matching_share("customer#000000123", "customer#000915123") == 30 / 36


def test_types_from_names_try_few_patterns(spark):
    import re
    from fieldgauge import fixed_values as fv
    from fieldgauge.operators import cleaning
    words = ["City", "of", "city OF", "County of", "Incorporated", "inc.", "Inc", "CORP", "corpse", "llp", "LLP", "ISD", "school", "district",
             "Fire Dept", "ministries", "Foundation", "TOWNSHIP", "university", "x", "é", "ſchool district", ""]
    rng = random.Random(6)
    names = [" ".join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(400)] + [None, "a\nCity of b"]
    rows = spark.createDataFrame([(n, None) for n in names], "name string, website string").select("name", cleaning.infer_type().alias("t"))
    for r in rows.collect():
        first = next(((t, c, ok) for p, t, c, ok in fv.NAME_TYPE_PATTERNS if re.search(p, r["name"] or "", re.ASCII)), (None, 0.0, False))
        assert (r["t"]["type"], r["t"]["confidence"], r["t"]["confirmed"]) == first, r
    for p, *_ in fv.NAME_TYPE_PATTERNS:
        assert cleaning.plain_words(p) and all(re.search(p, w if "(?i)" in p else w.upper()) for w in cleaning.plain_words(p))


def test_blank_values_are_told_from_one_end(spark):
    from fieldgauge.functions.space import WHITE
    from fieldgauge.functions.text import is_missing, present
    values = [None, "", " ", WHITE, WHITE + "a", "a" + WHITE, "a", "\u200b"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", is_missing("v").alias("m"), present("v").alias("p"))
    for r in rows.collect():
        blank = r["v"] is None or r["v"].strip(WHITE) == ""
        assert r["m"] == blank and r["p"] == (None if blank else r["v"])
    whole = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "ltrim(" in whole and " trim(" not in whole and "(trim(" not in whole and "btrim(" not in whole
