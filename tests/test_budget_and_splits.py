"""Live budget stop, hot keys of label joins, audit samples in one pass, sector slices and sequence ratios."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from test_operators import lev

from fieldgauge.operators import anomalies as an, coverage as cv, labels as lb, sampling as sa
from fieldgauge.streaming.budget import LiveBudget


def test_live_budget_with_late_calls_and_repeated_batches(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    caps, late = {"hot": 300, "none": 0}, timedelta(hours=1)
    live = LiveBudget(spark, caps, late)
    spent, clock, want = {}, None, {}
    for batch_id in range(4):
        rows = [(1000 * batch_id + i, start + timedelta(minutes=90 * batch_id + rng.randrange(200)), rng.choice(["hot", "hot", "none", "free", None]), rng.randrange(20)) for i in range(60)]
        for _ in range(2 if batch_id in (1, 3) else 1):
            live.apply(spark.createDataFrame(rows, "event_id bigint, ts timestamp, phase string, cents bigint"), batch_id)
        before = clock
        for i, ts, phase, cents in sorted(rows, key=lambda r: (r[1], r[0])):
            if before is not None and ts < before - late:
                want[i] = (None, "late")
                continue
            if phase is None:
                continue        # calls of no phase have no cap; their running sum restarts with each batch
            want[i] = (spent.get(phase, 0), "over_budget" if spent.get(phase, 0) >= caps.get(phase, float("inf")) else "counted")
            spent[phase] = spent.get(phase, 0) + cents
        clock = max([r[1] for r in rows] + ([clock] if clock else []))
    got = {r["event_id"]: (r["spent_before"], r["status"]) for r in live.calls().collect()}
    assert len(got) == 240 and {i: got[i] for i in want} == want
    assert {s for _, s in want.values()} == {"late", "over_budget", "counted"}


def group_sizes(short, long_, keys):
    """Pairs that meet on each key."""
    return (short.groupBy(*keys).agg(F.count("*").alias("a")).join(long_.groupBy(*keys).agg(F.count("*").alias("b")), keys)
            .agg(F.max("b"), F.sum(F.col("a") * F.col("b"))).first())


def test_similar_labels_with_one_piece_in_half_of_them(spark):
    rng = random.Random(9)
    stem = "manufacturing"
    tail = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(13))
    labels = sorted({stem + tail() for _ in range(300)} | {tail() + tail() for _ in range(300)})
    labels += [labels[5][:-1] + "z", labels[9][:15] + "q" + labels[9][16:], labels[-2][1:]]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    want = {tuple(sorted((a, b))) for i, a in enumerate(labels) for b in labels[i + 1:] if a != b and 1 - lev(a, b) / max(len(a), len(b)) >= 0.85 - 1e-12}
    for hot in (an.HOT, 20):
        assert {(r["label_a"], r["label_b"]) for r in an.similar_labels(df, 0.85, hot).collect()} == want
    largest, pairs = group_sizes(*an._similar_keys(df, 0.85, 50), ["n", "start", "piece", "salt"])
    assert largest <= 80 and pairs < 60 * len(labels)      # all pairs of the 300 alone would be 90,000


def test_subset_labels_with_a_word_that_all_share(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    labels = sorted({"services " + " ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(400)} | {"services", "services other"})
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    want = {(a, b) for a in labels for b in labels if set(a.split()) < set(b.split())}
    for hot in (an.HOT, 30):
        assert {tuple(r) for r in an.subset_labels(df, hot).collect()} == want
    largest, _ = group_sizes(*an._subset_keys(df, 30), ["first", "second", "salt"])
    assert largest <= 60


def test_audit_sample_reads_its_pool_once(spark, tmp_path):
    rows = [(f"h{i}", f"s{i % 3}", ["retail", "food", "bank"][i % 3] if i % 5 else None, ["1-10", "10K+", None][i % 3 if i % 7 else 1], "w" if i % 4 else None) for i in range(600)]
    spark.createDataFrame(rows, "handle string, state string, industry string, size string, website string").write.parquet(f"{tmp_path}/pool")
    df = spark.read.parquet(f"{tmp_path}/pool")
    cells = spark.createDataFrame([(s, f"s{i}", "A", "A", 0.1 * i) for s in ("44-45", "72") for i in range(3)], "sector string, state string, state_tier string, tier string, coverage double")
    labels = spark.createDataFrame([("retail", "44-45"), ("food", "72")], "label string, sector string")
    gaps = spark.createDataFrame([("g1", "standard", "44-45"), ("g2", "micro", "44-45"), ("g3", "size", None)], "gap string, kind string, sector string")
    out = sa.audit_sample(df, cells, labels, gaps, n=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/pool") == 1 and plan.count("Scan parquet") == 1
    got = out.groupBy("gap").count().collect()
    assert {r["gap"]: r["count"] <= 20 for r in got} == {"g1": True, "g2": True, "g3": True}


def test_one_sector_holds_what_the_slice_counts_hold(spark):
    rows = spark.createDataFrame([("TX", "Retail")] * 10 + [("TX", "bank")] * 4 + [(None, "bank")], "state string, industry string")
    spelled = spark.createDataFrame([("Retail", "44-45"), ("retail", "72"), ("bank", "52"), ("Bank", "??")], "label string, sector string")
    counts = {r["sector"]: r["slice_records"] for r in cv.slice_counts(rows, spelled).collect()}
    assert counts == {"44-45": 10, "52": 4}
    for sector in ("44-45", "72", "52"):
        assert cv.in_sector(rows, spelled, sector).count() == counts.get(sector, 0)


def test_over_indexed_sectors(spark):
    combined = spark.createDataFrame([("23", 140.0, 0.9), ("44-45", 100.0, 0.5), ("72", None, None), ("52", 100.5, 0.4)], "sector string, employer_only_pct double, coverage double")
    assert [tuple(r) for r in cv.over_indexed(combined).orderBy("sector").collect()] == [("23", 140.0, 0.9), ("52", 100.5, 0.4)]


def test_sequence_ratio_is_that_of_matching_blocks(spark):
    rng = random.Random(1)
    words = ["smith", "johnson", "law", "llc", "é𝒳", "group", "of", ""]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for _ in range(200)] * 2
    pairs += [("smith johnson law", "johnson law"), ("", ""), ("a" * 300 + "b", "a" * 299)]
    df = spark.createDataFrame(pairs + [(None, "x"), ("x", None)], "a string, b string")
    for r in df.select("a", "b", lb.sequence_ratio("a", "b").alias("s")).collect():
        want = None if r["a"] is None or r["b"] is None else SequenceMatcher(None, r["a"], r["b"]).ratio() if not (r["a"].startswith(r["b"]) or r["b"].startswith(r["a"])) else (
            2 * min(len(r["a"]), len(r["b"])) / (len(r["a"]) + len(r["b"])) if r["a"] or r["b"] else 1.0)
        assert r["s"] == (want if want is None else pytest.approx(want))
    same = spark.createDataFrame([("Smith Johnson Law", "Johnson Law"), ("Acme Corp", "Zenith Bakery")], "a string, b string")
    assert [r[0] for r in same.select(lb.name_diverges("a", "b")).collect()] == [False, True]
