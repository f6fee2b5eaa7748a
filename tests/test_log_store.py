"""The log-structured store against a dictionary, and what its batches cost."""

import os
import random

import pytest

from fieldgauge.sources.log_store import LogStore
from fieldgauge.streaming.upsert import stream_upsert
from fieldgauge.sources.workspace import new_path


def size(store, kind=""):
    root = store.root.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names
               if f.endswith(".parquet") and os.path.relpath(d, root).startswith(kind))


@pytest.mark.parametrize("order", [None, "n"])
def test_batches_against_a_dictionary(spark, order):
    rng = random.Random(5)
    store, want = LogStore(spark, fan=3, share=0.9), {}
    for version in range(9):
        rows = {f"k{rng.randrange(40)}": (rng.randrange(9) if order else version, f"v{version}") for _ in range(15)}
        df = spark.createDataFrame([(k, n, v) for k, (n, v) in rows.items()], "handle string, n int, v string")
        for _ in range(1 + (version % 4 == 2)):      # some batches come twice
            store.apply(df, version=version, order=order)
        for k, (n, v) in rows.items():
            if order is None or k not in want or n >= want[k][0]:
                want[k] = (n, v)
        if version == 5:
            store.expire()
        assert {r["handle"]: (r["n"], r["v"]) for r in store.read().collect()} == want
    assert len(store._live()) == 5            # the base, and eight batches as 3 + 3 + 1 + 1
    store.compact(now=True)
    assert store.expire() and len(store._runs()) == 1
    assert {r["handle"]: (r["n"], r["v"]) for r in store.read().collect()} == want
    assert {r["handle"] for r in store.read(keys=["k1", "k2", "nobody"]).collect()} <= {"k1", "k2"}


def test_a_late_repeat_of_a_compacted_batch_changes_nothing(spark):
    rows = lambda *r: spark.createDataFrame(r, "handle string, v int")
    store = LogStore(spark)
    store.apply(rows(("a", 1), ("b", 1)), version=0)
    store.apply(rows(("a", 2)), version=1)
    store.apply(rows(("a", 3)), version=2)
    store.compact(now=True)
    store.apply(rows(("a", 2)), version=1)
    assert {tuple(r) for r in store.read().collect()} == {("a", 3), ("b", 1)}
    assert {tuple(r) for r in store.read(below=1).collect()} == {("a", 1), ("b", 1)}


def test_what_a_batch_writes_grows_with_the_batch(spark):
    """Random keys touch every range of a large store; only the batch is written."""
    store = LogStore(spark, fan=100, share=9.0)
    store.apply(spark.range(200_000).selectExpr("concat('k', id) as handle", "md5(cast(id as string)) as v"), version=0)
    base, seen = size(store), []
    for version, n in enumerate((100, 1000, 10_000), 1):
        before = size(store)
        store.apply(spark.range(n).selectExpr(f"concat('k', pmod(hash(id), 200000)) as handle", "'new' as v").dropDuplicates(["handle"]), version=version)
        seen.append(size(store) - before)
    assert seen[0] < base / 200 and seen[1] < base / 100 and seen[2] < 40 * seen[1] and seen[2] < base / 5
    assert size(store, "b") == base


def test_bytes_over_many_batches_stay_in_proportion(spark):
    store, written = LogStore(spark, fan=4, share=0.5), 0
    store.apply(spark.range(2000).selectExpr("concat('k', id) as handle", "md5(cast(id as string)) as v"), version=0)
    batch = spark.range(300).selectExpr("concat('k', id * 5) as handle", "md5(concat('x', id)) as v")
    for version in range(1, 17):
        before = size(store)
        store.apply(batch, version=version)
        written += size(store) - before
    one = LogStore(spark)
    one.apply(batch)
    assert written < 16 * size(one) * 4      # each byte is merged once per width: log to the base fan of the batches
    assert store.read().count() == 2000


def test_lookup_reads_few_files(spark):
    store = LogStore(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.apply(spark.range(20_000).selectExpr("concat('k', lpad(id, 6, '0')) as handle", "id as v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    df = store.read(keys=["k000777"])
    assert [r["v"] for r in df.collect()] == [777]
    assert "PushedFilters: [In(handle" in df._jdf.queryExecution().toString() or "EqualTo(handle" in df._jdf.queryExecution().toString()


def test_keys_that_are_missing_and_new_columns(spark):
    store = LogStore(spark)
    assert store.read() is None
    store.apply(spark.createDataFrame([("a", 1), (None, 5)], "handle string, v int"))
    store.apply(spark.createDataFrame([("a", 2, "w"), (None, 6, "z")], "handle string, v int, w string"))
    store.apply(spark.createDataFrame([], "handle string, v int"))
    got = sorted(((r["handle"], r["v"], r["w"]) for r in store.read().collect()), key=str)
    assert got == sorted([("a", 2, "w"), (None, 5, None), (None, 6, "z")], key=str)
    store.apply(spark.createDataFrame([("z", 9)], "handle string, v int"), force=True)
    assert [tuple(r) for r in store.read().collect()] == [("z", 9)]


def test_stream_of_several_files_into_the_log(spark, tmp_path):
    for i in range(5):
        spark.createDataFrame([("a", f"at {i}", i), (f"own {i}", "x", i)], "handle string, v string, _seq int").coalesce(1).write.parquet(f"{tmp_path}/part-{i}")
    store = LogStore(spark, fan=2)
    store.apply(spark.createDataFrame([("a", "stored"), ("b", "stored")], "handle string, v string"), version=0)
    stream = (spark.readStream.schema("handle string, v string, _seq int").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(str(tmp_path)))
    stream_upsert(stream, store, "_seq", new_path(spark, "upsert-state"), first_version=1).awaitTermination()
    assert max(store.versions()) == 5
    assert {r["handle"]: r["v"] for r in store.read().collect()} == {"a": "at 4", "b": "stored"} | {f"own {i}": "x" for i in range(5)}


def test_newest_per_key_spreads_a_batch_of_one_file(spark):
    from fieldgauge.streaming.upsert import newest_per_key
    rows = [("hot" if i % 2 else f"k{i % 50}", i, f"v{i}") for i in range(4000)] + [(None, 1, "lost"), ("none", None, "x")]
    batch = spark.createDataFrame(rows, "handle string, seq int, name string").coalesce(1)
    out = newest_per_key(batch, "handle", "seq")
    best = {}
    for h, q, n in rows:
        if q is not None and q >= best.get(h, (-1, None))[0]:
            best[h] = (q, n)
    assert {r["handle"]: (r["seq"], r["name"]) for r in out.where("seq is not null").collect()} == best
    # the one task that reads the file deals its rows by key and order before any fold sorts them
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("RepartitionByExpression" in x and "seq" in x for x in plan)
