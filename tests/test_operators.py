import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.operators import anomalies as an, coverage as cv, evaluate as el, labels as lb, ledger as lg, reports as rp, running as rn, sampling as sa, scale
from fieldgauge.sources import benchmarks as bm, companies as src
from fieldgauge.sources.store import VersionedStore
from fieldgauge.sources.workspace import new_path
from fieldgauge.streaming.upsert import stream_upsert


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.85, 0.95])
def test_similar_labels_against_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words = ["care", "cares", "health", "heath", "retail", "retails", "metal", "b", "mining"]
    labels = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(90)})
    form = {x: " ".join(sorted(x.split())) for x in labels}
    want = {(a, b) for i, a in enumerate(labels) for b in labels[i + 1:]
            if 1 - lev(form[a], form[b]) / max(len(form[a]), len(form[b])) >= threshold - 1e-12}
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = [(r["label_a"], r["label_b"]) for r in an.similar_labels(df, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = an.similar_labels(df, threshold)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_subset_labels_against_all_pairs(spark):
    rng = random.Random(3)
    labels = sorted({" ".join(rng.choices("abcdef", k=rng.randint(1, 4))) for _ in range(120)})
    want = {(a, b) for a in labels for b in labels if set(a.split()) < set(b.split())}
    got = {tuple(r) for r in an.subset_labels(spark.createDataFrame([(x,) for x in labels], "label string")).collect()}
    assert got == want


def test_top_per_group_with_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, g string")
    got = {(r["g"], r["id"]) for r in scale.top_per_group(df, ["g"], sa.hash_order("id", "s"), 9, 9, F.col("id")).collect()}
    want = set()
    for g in {g for _, g in rows}:
        ids = sorted((hashlib.md5(f"{i}s".encode()).hexdigest(), i) for i, x in rows if x == g)[:9]
        want |= {(g, i) for _, i in ids}
    assert got == want


def test_left_lookup_keeps_every_row(spark):
    rows = [(f"r{i}", "" if i % 4 == 0 else ("hot" if i % 4 == 1 else f"k{i % 500}")) for i in range(4000)]
    df = spark.createDataFrame(rows, "row string, key string")
    side = df.groupBy("key").agg(F.count("*").alias("n")).where("key <> 'k3'").withColumn("v", F.concat(F.lit("v-"), "key"))
    got = {r["row"]: r["v"] for r in scale.left_lookup(df, side, "key", "row", "n", ["v"]).collect()}
    assert len(got) == 4000
    assert got == {r: (None if k in ("", "k3") else f"v-{k}") for r, k in rows}


def test_left_lookup_spreads_answered_and_keyless_rows(spark):
    rows = [(f"r{i}", "" if i % 2 else ("hot" if i % 4 else f"k{i}")) for i in range(8000)]
    df = spark.createDataFrame(rows, "row string, key string")
    side = df.where("key <> ''").groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.concat(F.lit("v-"), "key"))
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = scale.left_lookup(df, side, "key", "row", "n", ["v"])
        sizes = out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.count("v").alias("found"))
        dealt = sizes.agg(F.max("n"), F.sum("n"), F.sum("found")).first()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert dealt[1] == len(rows) and dealt[2] == len(rows) / 2 and dealt[0] < len(rows) / 4   # 8 partitions


@pytest.mark.parametrize("limit", [5_000, 3])
def test_lookup_join_of_small_and_large_sides(spark, limit):
    rows = [(i, None if i % 5 == 0 else "" if i % 5 == 1 else "hot" if i % 5 == 2 else f"k{i % 30}", [i]) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:7], "row int, asks string, list array<int>")
    side = spark.createDataFrame([("hot", "H", 1), ("", "E", 2), ("k3", "three", None), ("k4", None, 4), ("unasked", "U", 5)], "name string, v string, w int")
    known = {r["name"]: (r["v"], r["w"]) for r in side.collect()}
    got = scale.lookup_join(df, side, F.col("asks"), "name", ["v", "w"], limit=limit)
    assert got.columns == ["row", "asks", "list", "v", "w"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*r, *known.get(r[1], (None, None)))) for r in rows + rows[:7])
    assert scale.lookup_join(df.where("false"), side, F.col("asks"), "name", ["v"], limit=limit).count() == 0
    assert scale.lookup_join(df, side.where("false"), F.col("asks"), "name", ["v"], limit=limit).where("v is null").count() == 3007


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_running_total_with_ties(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, c bigint")
    total, want = 0, {}
    for a, b, c in sorted(rows):
        total += c
        want[b] = total
    assert {r["b"]: r["running"] for r in rn.running_total(df, ["a", "b"], "c", partitions=partitions).collect()} == want
    cut = rn.budget_cut(df, ["a", "b"], "c", 1000).where("status = 'completed'").collect()
    assert all(r["running"] - r["c"] < 1000 for r in cut) and len(cut) == sum(want[b] - c < 1000 for _, b, c in rows)


def test_review_queue_numbers_every_row(spark):
    rng = random.Random(2)
    rows = [(f"h{i:04}", rng.choice(["enterprise", "smb", None]), rng.choice([0.1, 0.5, None]), i % 4 > 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "handle string, poc_segment string, c double, flag boolean")
    for f in rp.FIELDS:
        df = df.withColumns({f"{f}_review_flag": F.col("flag"), f"{f}_confidence": F.col("c"), **{f"{f}_{x}": F.lit("x") for x in ("original", "enriched", "pipeline_stage")}})
    df = df.withColumns({"name": F.lit("n"), "city": F.lit("c"), "state": F.lit("s"), "operating_status_review_flag": F.lit(False)})
    flagged = sorted((r for r in rows if r[3]), key=lambda r: (rp.PRIORITY.get(r[1], 9), r[2] is None, r[2] or 0, r[0]))
    got = {r["handle"]: r["place"] for r in rp.review_queue_places(df).collect()}
    assert got == {r[0]: i for i, r in enumerate(flagged)} and len(got) == 1500


def test_keyword_cascade_defaults(spark):
    labels = spark.createDataFrame([("food and beverage manufacturing", 0), ("legal services", 1), ("food retail", 2), ("pet services", 3)], "label string, pos int")
    texts = spark.createDataFrame([(t,) for t in (" Legal Services", "food", "law firm", "P.A.", "beverages and foods", "pet servces", "the of", None, "qqqqqq")], "text string")
    got = {r["text"]: (r["label"], r["step"]) for r in lb.snap_cascade(texts, labels).collect()}
    assert got == {"legal services": ("legal services", "exact"), "food": ("food and beverage manufacturing", "exact"),
                   "law firm": ("law practice", "keyword"), "p.a.": ("law practice", "keyword"),
                   "beverages and foods": (None, "none"), "pet servces": ("pet services", "overlap"),
                   "the of": (None, "none"), "qqqqqq": (None, "none")}


def test_cosine_prefers_sector_then_widens(spark):
    labels = spark.createDataFrame([("a", 1, 0, [1.0, 0.0]), ("b", 1, 1, [0.7, 0.7]), ("c", 2, 2, [0.0, 1.0])], "label string, sector int, pos int, vector array<float>")
    rows = spark.createDataFrame([(1, 1, [0.0, 1.0]), (2, 2, [1.0, 0.1]), (3, None, [1.0, 0.0]), (4, 9, [-1.0, -1.0])], "id int, sector int, vector array<float>")
    got = {r["id"]: (r["label"], r["scope"]) for r in lb.snap_cosine(rows, labels, "id").collect()}
    assert got == {1: ("b", "sector"), 2: ("a", "all"), 3: ("a", "all"), 4: (None, None)}


def test_verdict_branches(spark):
    rows = [("s1", .8, .5, 5000, 90., 90.), ("s2", .8, .2, 5000, 90., 90.), ("s3", .1, .2, 10, 90., 90.), ("s4", .1, .2, 5000, 30., 40.), ("s5", .7, .2, 5000, 90., 90.)]
    df = spark.createDataFrame(rows, "sector string, nonemployer_share double, employer_coverage double, slice_records bigint, website_fill_pct double, industry_fill_pct double")
    assert [r["verdict"] for r in cv.verdict(df).orderBy("sector").collect()] == ["ARTIFACT", "CONFIRMED", "CONFIRMED", "PLAUSIBLE", "PLAUSIBLE"]
    claimed = df.withColumns({"claimed_coverage": F.lit(0.1), "observed_coverage": F.lit(0.2)})
    assert {r["verdict"] for r in cv.verdict(claimed, overstated_by=0.3).collect()} == {"OVERSTATED"}


def test_upper_median(spark):
    def roll(values):
        df = spark.createDataFrame([(f"s{i}", "23", v) for i, v in enumerate(values)], "state string, sector string, coverage double")
        cells = df.withColumns({"sector_name": F.lit("x"), "gap_tier": F.lit("ADEQUATE"), "our_records": F.lit(1), "universe": F.lit(2), "employers": F.lit(2), "nonemployers": F.lit(0)})
        return cv.sector_rollup(cells).first()["median_coverage"]
    for values in ([.1], [.1, .4], [.3, .1, .2], [.4, .1, .3, .2], [.2, .2, .1, .9, .5, .5]):
        assert roll(values) == sorted(values)[len(values) // 2]


def test_golden_evaluation(spark):
    """The published confusion counts of a 20-row labelled set, rebuilt from its
    mismatch list: 18/1/2, 15/4/5, 12/4/4 and 7/9/9 for type, industry, website, size."""
    sizes = fv.SIZE_BANDS
    truth, output = [], []
    apart = [1, 3, 1, 1, 1, 4, 2, 1, 1]
    for i in range(20):
        has = ["type", "industry"] + (["website"] if i < 18 else []) + (["size"] if i < 16 else [])
        gt = {"type": "Nonprofit", "industry": "banking", "website": None if i >= 16 else f"www.a{i}.com", "size": sizes[0] if i < 16 else None}
        pred = {"type": {0: "Public Company", 1: None}.get(i, "nonprofit"), "industry": None if i == 1 else ("law practice" if i < 6 and i != 0 else "Banking"),
                "website": None if i == 0 else (f"b{i}.com" if i < 4 else (f"https://a{i}.com/x" if i < 16 else ("z.com" if i == 16 else None))),
                "size": sizes[apart[i]] if i < 9 else sizes[0]}
        truth.append((f"h{i}", "enterprise" if i < 12 else "mid_market", has, gt))
        output.append((f"h{i}", *[pred[f] for f in ("website", "type", "industry", "size")], 0.9, 0.9, 0.9, 0.9))
    labels = spark.createDataFrame(truth, "handle string, segment string, present array<string>, ground_truth struct<website:string,type:string,industry:string,size:string>")
    out = spark.createDataFrame(output, "handle string, website_final string, type_final string, industry_final string, size_final string, "
                                "website_confidence double, type_confidence double, industry_confidence double, size_confidence double")
    pairs = el.compare(el.long_labels(labels), out)
    scored = el.prf(el.confusion(pairs))
    got = {r["field"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in scored.collect()}
    assert got == {"type": (18, 1, 2, 0.923), "industry": (15, 4, 5, 0.769), "website": (12, 4, 4, 0.75), "size": (7, 9, 9, 0.438)}
    m = el.macro(scored).first()
    assert (m["macro_precision"], m["macro_recall"], m["macro_f1"]) == (0.731, 0.71, 0.72)
    o = el.ordinal_error(pairs).first()
    assert (o["mismatches"], o["within_one"], round(o["mean_distance"], 2)) == (9, 6, 1.67)
    assert el.go_no_go(scored).first()["decision"] == "PIVOT"


def test_gates_raise(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "handle string")
    with pytest.raises(lg.GateFailure, match="key_nulls"):
        lg.enforce(lg.key_gate(df), "keys")
    lg.enforce(lg.min_rows_gate(df), "rows")
    spent = spark.createDataFrame([("part_4", 1, 8.0), ("TOTAL", 1, 8.0)], "phase string, calls int, spent double")
    at_cap = {r["gate"]: r["passed"] for r in lg.budget_gate(spent, {"part_4": 8.0}, 10.0).collect()}
    assert at_cap == {"budget:part_4": False, "budget:TOTAL": True}
    assert all(r["passed"] for r in lg.budget_gate(spent, {"part_4": 8.0}, 10.0, strict=False).collect())


def test_store_replay_is_idempotent(spark):
    store = VersionedStore(spark)
    rows = lambda *r: spark.createDataFrame(r, "handle string, v int")
    store.apply(rows(("a", 1), ("b", 1)), version=0)
    for _ in range(2):
        store.apply(rows(("b", 2), ("c", 2)), version=1)
    assert {tuple(r) for r in store.read().collect()} == {("a", 1), ("b", 2), ("c", 2)}
    store.apply(rows(("z", 9)), force=True)
    assert [tuple(r) for r in store.read().collect()] == [("z", 9)]


def test_store_rewrites_touched_buckets_only(spark):
    store = VersionedStore(spark, buckets=8)
    store.apply(spark.createDataFrame([(f"k{i}", 0) for i in range(200)], "handle string, v int"))
    before = {f for f in store.read().inputFiles()}
    store.apply(spark.createDataFrame([("k7", 1)], "handle string, v int"))
    state = store.read()
    assert {r["handle"]: r["v"] for r in state.collect()} == {f"k{i}": int(i == 7) for i in range(200)}
    assert len({f.rsplit("/", 1)[0] for f in before & set(state.inputFiles())}) == 7
    store.apply(spark.createDataFrame([], "handle string, v int"))
    assert store.read().count() == 200


def test_loaders_take_public_file_quirks(spark, tmp_path):
    f = tmp_path / "emp.csv"
    f.write_text('﻿State,"State\nName",NAICS,"Enterprise\nSize",Firms\n1,Alabama,--,01: Total,"1,234"\n'
                 '00,United States,23,01: Total,"9,000"\n06,California,23,01: Total,77\n06,California,23,02: <5,5\n99,Nowhere,--,01: Total,1\n', encoding="utf-8")
    rows = bm.employer_rows(spark, str(f))
    assert [tuple(r) for r in bm.employer_states(rows).collect()] == [("Alabama", 1234)]
    assert [tuple(r) for r in bm.employer_sectors(rows).collect()] == [("23", 9000)]
    assert [tuple(r) for r in bm.employer_cells(rows).collect()] == [("California", "23", 77)]
    m = tmp_path / "map.json"
    m.write_text(json.dumps({"Retail": "44-45", "x": "23"}))
    assert {tuple(r) for r in src_map(spark, m)} == {("Retail", "44-45"), ("x", "23")}
    g = tmp_path / "gt.json"
    g.write_text(json.dumps([{"handle": "a", "segment": "smb", "ground_truth": {"website": None, "type": "x"}}, {"handle": "b", "segment": "smb", "ground_truth": {"size": "1-10"}}]))
    got = {r["handle"]: (sorted(r["present"]), r["ground_truth"]["type"]) for r in src.read_ground_truth(spark, str(g)).collect()}
    assert got == {"a": (["type", "website"], "x"), "b": (["size"], None)}


def src_map(spark, path):
    return bm.read_label_map(spark, str(path)).collect()


def test_sample_ignores_partitioning(spark):
    from fieldgauge.plans.testbed import companies
    df = companies(spark, "/root/testdata/sf0.001")
    a = sa.quota_sample(df).orderBy("handle").collect()
    assert a == sa.quota_sample(df.repartition(11)).orderBy("handle").collect()
    assert new_path(spark, "x") != new_path(spark, "x")


def test_upsert_order_holds_across_batches(spark):
    for first, second in ((10, 5), (5, 10)):
        store = VersionedStore(spark)
        store.apply(spark.createDataFrame([("a", "stored"), ("b", "stored")], "handle string, v string"), version=0)
        for version, seq in enumerate((first, second, second), 1):
            batch = spark.createDataFrame([("a", f"at {seq}", seq)], "handle string, v string, _seq int")
            store.apply(batch, version=version, order="_seq")
        assert {r["handle"]: r["v"] for r in store.read().collect()} == {"a": "at 10", "b": "stored"}


def test_label_spellings_count_once(spark):
    from fieldgauge.operators import coverage

    rows = spark.createDataFrame([("TX", "retail")] * 10, "state string, industry string")
    spelled = spark.createDataFrame([("Retail", "44"), ("retail", "44")], "label string, sector string")
    sector = next(iter(coverage.fv.SECTORS))
    spelled = spelled.select("label", F.lit(sector).alias("sector"))
    assert [r["our_records"] for r in coverage.label_counts_to_sector(rows, spelled).collect()] == [10]
    plan = coverage.in_sector(rows, spelled, sector)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_white_space_of_every_kind_goes(spark):
    from fieldgauge.functions.space import WHITE, strip
    from fieldgauge.operators import cleaning

    assert "".join(WHITE.split()) == "" and len(set(WHITE)) == len(WHITE) == sum(chr(c).isspace() for c in range(0x110000))
    df = spark.createDataFrame([("Texas\t", "\tx\u00a0", "www\n", "\n")], "state string, name string, website string, city string")
    got = df.select(strip("state"), strip("name"), cleaning.clean_website("website")["value"], cleaning.clean_website("city")["value"]).first()
    assert tuple(got) == ("Texas", "x", None, None)


def test_stream_upsert_over_several_files_in_either_order(spark, tmp_path):
    import os

    for name, order in (("up", (0, 1, 2)), ("down", (2, 1, 0))):
        folder = tmp_path / name
        for at, i in enumerate(order):  # files are read oldest first, one a batch
            part = f"{folder}/part-{i}"
            spark.createDataFrame([("a", f"at {i}", i), (f"own {i}", "x", i)], "handle string, v string, _seq int").coalesce(1).write.parquet(part)
            for f in os.listdir(part):
                os.utime(f"{part}/{f}", (1_700_000_000 + 100 * at,) * 2)
        store = VersionedStore(spark)
        store.apply(spark.createDataFrame([("a", "stored"), ("b", "stored")], "handle string, v string"), version=0)
        stream = (spark.readStream.schema("handle string, v string, _seq int").option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", True).parquet(str(folder)))
        stream_upsert(stream, store, "_seq", new_path(spark, "upsert-state"), first_version=1).awaitTermination()
        assert len(store.versions()) == 4
        assert {r["handle"]: r["v"] for r in store.read().collect()} == {"a": "at 2", "b": "stored", "own 0": "x", "own 1": "x", "own 2": "x"}


def test_overlap_join_gives_a_row_for_each_text_word(spark):
    from fieldgauge.operators import labels as lb

    tax = spark.createDataFrame([(f"alpha{i} services", i) for i in range(300)], "label string, pos int")
    texts = spark.createDataFrame([("alpha services",), ("services alpha7",), ("none such",)], "text string")
    out = lb.snap_overlap(texts, tax)
    assert {tuple(r)[:2] for r in out.collect()} == {("alpha services", "alpha0 services"), ("services alpha7", "alpha7 services")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_posted" in plan
    labels = 6000
    many = spark.createDataFrame([(f"word{i} trade", i) for i in range(labels)], "label string, pos int")
    got = lb.snap_cascade(spark.createDataFrame([("word5999 trade",), ("xword17y",)], "text string"), many).collect()
    assert {r["text"]: (r["label"], r["step"]) for r in got}["word5999 trade"] == ("word5999 trade", "exact")


def test_reports_read_their_table_once(spark, tmp_path):
    from fieldgauge.operators import profile as pr

    rows = [(f"h{i}", f"n{i % 3}", f"http://d{i % 5}.com" if i % 2 else None, "c", "TX" if i % 4 else None, "1-10", None) for i in range(50)]
    spark.createDataFrame(rows, "handle string, name string, website string, city string, state string, size string, type string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    keys = pr.key_report(df)
    assert keys._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["candidate_key"]: (r["distinct_values"], r["nulls_in_key"]) for r in keys.collect()}["name + state"] == (6, 13)
    rates = pr.null_rate_by(df, "state", ("website", "type"))
    assert {r["state"]: (r["records"], r["type_vs_all"]) for r in rates.collect()} == {"TX": (37, 0.0), None: (13, 0.0)}
