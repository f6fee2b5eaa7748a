"""Registered streaming queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgauge.plans.registry import query
from fieldgauge.plans.testbed import CALLS_CTE, COMPANIES_CTE, call_log, companies, table
from fieldgauge.sources.log_store import LogStore
from fieldgauge.sources.workspace import new_path
from fieldgauge.streaming.budget import LiveBudget
from fieldgauge.streaming.ledger import running_cost, windowed_cost
from fieldgauge.streaming.upsert import stream_upsert


def _calls_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("phase"),
                      F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def _drain(stream: DataFrame, mode: str, name: str, keep_last: bool = False) -> DataFrame:
    """Run a stream over what is there and read back what it wrote."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    if keep_last:
        def replace(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        writer = stream.writeStream.outputMode(mode).foreachBatch(replace)
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("t1_running_ledger", "select phase, count(*) as calls, cast(sum(cents) as bigint) as spent from calls group by phase", CALLS_CTE)
def t1(s, d):
    return _drain(running_cost(_calls_stream(s, d)), "complete", "ledger", keep_last=True)


@query("t1_windowed_ledger", """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, phase, count(*) as calls, cast(sum(cents) as bigint) as spent
 from calls where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from calls) group by 1, 2""", CALLS_CTE)
def t1b(s, d):
    """Windows the watermark has closed once all files are read."""
    out = _drain(windowed_cost(_calls_stream(s, d)), "append", "windows")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "phase", "calls", "spent")


def _arriving(s, d, parts: list) -> DataFrame:
    """The call log as files that arrive one after the other, one a batch."""
    path = new_path(s, "arriving")
    calls = call_log(s, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "phase", "cents")
    for i, part in enumerate(parts):
        calls.where(part).coalesce(1).write.parquet(f"{path}/part-{i}")
    return s.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


@query("t1_late_calls", """select strftime(w, '%Y-%m-%d') as day, phase, count(*) as calls, cast(sum(cents) as bigint) as spent from (
 select *, date_trunc('day', ts) as w, case event_id % 3 when 2 then (select max(ts) from calls where event_id % 3 = 0) end - interval 1 hour as mark from calls)
 where (mark is null or w + interval 1 day > mark) and w + interval 1 day <= (select max(ts) - interval 1 hour from calls) group by 1, 2""", CALLS_CTE)
def t1_late(s, d):
    """Three files, each over all days. Calls of windows that the watermark had closed are dropped; a batch drops by the
    watermark that the batch before it started with, so that is the first file's for the third."""
    stream = _arriving(s, d, [f"event_id % 3 = {i}" for i in range(3)])
    out = _drain(windowed_cost(stream), "append", "late-windows")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "phase", "calls", "spent")


_CAPS = {"click": 60_000.0, "view": 200_000.0, "purchase": 0.0}


@query("t1_budget_stop", f"""select event_id, phase, cast(spent - cents as bigint) as spent_before, case when spent - cents >= (case phase {' '.join(f"when '{p}' then {c:.0f}" for p, c in _CAPS.items())} end)
 then 'over_budget' else 'counted' end as status from (select *, sum(cents) over (partition by phase order by ts, event_id) as spent from calls)""", CALLS_CTE)
def t1_budget(s, d):
    """Four files in the order of time; every call with what its phase had spent before it, marked once that reaches the cap."""
    day = "day(ts)"
    live = LiveBudget(s, _CAPS, timedelta(hours=1))
    live.run(_arriving(s, d, [f"{day} < 8", f"{day} between 8 and 15", f"{day} between 16 and 23", f"{day} > 23"]), new_path(s, "budget-state")).awaitTermination()
    return live.calls()


@query("t2_stream_upsert", """select handle, name, state from companies where handle not in (select 'company/' || o_custkey from orders)
 union all select 'company/' || o_custkey, 'updated ' || max(o_orderkey), 'from stream' from orders
 where o_custkey in (select o_orderkey from orders) group by o_custkey
 union all select 'company/' || o_custkey, 'updated ' || max(o_orderkey), 'from stream' from orders
 where o_custkey not in (select o_orderkey from orders) group by o_custkey""", COMPANIES_CTE)
def t2(s, d):
    """A stored company set takes orders as arriving updates keyed by customer number, four files in as many batches; the
    newest order per key wins, whichever batch brings it."""
    store = LogStore(s)
    store.apply(companies(s, d).select("handle", "name", "state"), version=0)
    arriving = new_path(s, "orders")
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey")
    orders.repartition(4, F.pmod(F.hash("o_orderkey"), F.lit(4))).write.parquet(arriving)
    raw = s.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    updates = raw.select(F.concat(F.lit("company/"), F.col("o_custkey").cast("string")).alias("handle"),
                         F.concat(F.lit("updated "), F.col("o_orderkey").cast("string")).alias("name"),
                         F.lit("from stream").alias("state"), F.col("o_orderkey").alias("_seq"))
    stream_upsert(updates, store, "_seq", new_path(s, "upsert-state"), first_version=1).awaitTermination()
    return store.read().select("handle", "name", "state")
