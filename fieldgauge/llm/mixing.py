"""Mixing sources to target weights by weighted fair queueing.

Each document of a source, in shuffled order, gets a virtual finish time: the words of its source up to and including
it, divided by the source's target. All sources reach their targets at time 1, so serving documents by finish time
until the budget is spent brings every source near its target. A source may be read twice.

Finish times of a source are spread evenly over time, because equal times hold equal shares of its target; ranges of
equal width are therefore a balanced range sort whose borders need no sampling, and any rerun deals the same rows.
Running sums never gather a source: it is cut into slices of the shuffle order, slices are summed first.

Defined results: null text has size 0; null source is a source of its own, last in order; a null or repeated doc_id is
an ordinary row; identical rows are interchangeable; a source without words has target 0; no rows give no rows; other
columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldgauge.llm.common import WORD, apart, query, table
from fieldgauge.sources.workspace import materialise

WEIGHTS = (3, 1, 2)
SLICES = 4096
TIMES = 65536


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, times_size=2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): targets share 150 % of all sizes by weight; one that
    would exceed ``times_size`` times its size stops there and the others share the rest. The sources that stop are
    those with least size per weight, so the level is found by one running sum over sources in that order."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("_w")), F.col("_i")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    t = (sizes.withColumn("_i", F.row_number().over(order) - 1).withColumn("_w", pick.cast("bigint"))
         .withColumn("_all", F.sum("source_size").over(whole)).withColumn("_w_all", F.sum("_w").over(whole))
         .withColumn("_s_up", F.sum("source_size").over(by_ratio)).withColumn("_w_up", F.sum("_w").over(by_ratio)))
    # with the sources before this one stopped, does its own share of the rest exceed its limit?
    rest = 3 * F.col("_all") - 2 * times_size * (F.col("_s_up") - F.col("source_size"))
    rest_w = F.col("_w_all") - (F.col("_w_up") - F.col("_w"))
    stops = F.col("_w") * rest >= 2 * times_size * F.col("source_size") * rest_w
    t = (t.withColumn("_stops", stops)
         .withColumn("_s_stop", F.sum(F.when(F.col("_stops"), F.col("source_size")).otherwise(0)).over(whole))
         .withColumn("_w_free", F.sum(F.when(F.col("_stops"), 0).otherwise(F.col("_w"))).over(whole)))
    free = (F.col("_w") * (3 * F.col("_all") - 2 * times_size * F.col("_s_stop"))).cast("double") / (2.0 * F.col("_w_free"))
    return t.select("source", "source_size", F.when(F.col("_stops"), (times_size * F.col("source_size")).cast("double"))
                    .otherwise(free).alias("target"))


def fair_queue(docs: DataFrame, weights=WEIGHTS, times_size: int = 2) -> DataFrame:
    """One row per document: doc_id, source, _order, size, source_size, target, taken. Words are counted once and the
    narrow rows kept; everything after works on those."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    narrow = materialise(docs.select("doc_id", "source", order.alias("_order"), word_count(F.col("text")).alias("size"))
                         .withColumn("_slice", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")))
    slices = materialise(narrow.groupBy("source", "_slice").agg(F.sum("size").alias("_sum")))
    budgets = targets(slices.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, times_size)
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (slices.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
              .join(budgets.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src")))
              .select(F.col("source").alias("_s"), F.col("_slice").alias("_t"), "_start", "source_size", "target"))
    within = Window.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (narrow.withColumn("_cum", F.sum("size").over(within))
              .withColumn("_row", F.row_number().over(Window.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size")))
              .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_t")))
              .withColumn("_cum", F.col("_start") + F.col("_cum")))
    queued = materialise(queued.select("doc_id", "source", "_order", "_slice", "_row", "size", "source_size", "target", "_cum"))

    def time_of(p):
        finish = (p * F.col("source_size") + F.col("_cum")).cast("double") / F.col("target")
        return F.least(F.floor(finish * TIMES / 2), F.lit(TIMES)).cast("int")

    # the range of time in which the budget runs out, from one sum per range; only its rows are ranked one by one
    budget = slices.agg(F.floor(F.sum("_sum") * 3 / 2).alias("b")).first()["b"] or 0
    passes = F.explode(F.sequence(F.lit(0), F.lit(times_size - 1)))
    served = queued.where("size > 0").withColumn("_pass", passes).withColumn("_time", time_of(F.col("_pass")))
    upto = Window.orderBy("_time").rowsBetween(Window.unboundedPreceding, 0)
    last = (served.groupBy("_time").agg(F.sum("size").alias("_sum")).withColumn("_upto", F.sum("_sum").over(upto))
            .where(F.col("_upto") > budget).orderBy("_time").select("_time", (F.col("_upto") - F.col("_sum")).alias("_before")).first())
    cut, spent = (last["_time"], last["_before"]) if last else (TIMES + 1, 0)
    times = [time_of(F.lit(p)) for p in range(times_size)]
    early = sum((F.when(t < cut, 1).otherwise(0) for t in times[1:]), F.when(times[0] < cut, 1).otherwise(0))
    at_cut = (F.col("size") > 0) & F.array_contains(F.array(*times), F.lit(cut))
    finish = (F.col("_pass") * F.col("source_size") + F.col("_cum")).cast("double") / F.col("target")
    ranked = (Window.orderBy(finish, F.col("source").isNull(), "source", "_pass", "_slice", "_row")
              .rowsBetween(Window.unboundedPreceding, 0))
    edge = (served.where(F.col("_time") == cut).withColumn("_in", (F.sum("size").over(ranked) + F.lit(spent) <= budget).cast("int"))
            .groupBy(*queued.columns).agg(F.sum("_in").alias("_late")))
    rest = queued.where(~F.coalesce(at_cut, F.lit(False))).withColumn("_late", F.lit(0).cast("bigint"))
    out = rest.unionByName(edge).withColumn("_n", F.when(F.col("size") > 0, early + F.col("_late")).otherwise(0))
    return out.select("doc_id", "source", "_order", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
                      (F.col("_n") * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, columns unchanged: one row for each time a document is taken. Documents without words
    cost nothing and stay once. Rows equal in doc_id, source and size are interchangeable: the copies taken are dealt
    to them in turn."""
    key = ["doc_id", "source", "size"]
    share = (fair_queue(docs).groupBy(*key).agg(F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1)).cast("bigint").alias("_n"),
                                                F.count("*").alias("_of")))
    named = {c: f"_m_{c}" for c in key}
    share = share.select(*[F.col(c).alias(n) for c, n in named.items()], "_n", "_of").where("_n > 0")
    held, back = apart(docs, "doc_id", "source", "text")
    rows = held.withColumn("_words", word_count(F.col("text")))
    on = (F.col("doc_id").eqNullSafe(F.col("_m_doc_id")) & F.col("source").eqNullSafe(F.col("_m_source")) & (F.col("_words") == F.col("_m_size")))
    rows = rows.join(share, on)
    turn = F.when(F.col("_of") == 1, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy("_m_doc_id", "_m_source", "_m_size").orderBy(F.lit(1))))
    if share.where("_of > 1").isEmpty():
        rows = rows.withColumn("_times", F.col("_n"))
    else:
        rows = rows.withColumn("_turn", turn).withColumn("_times", F.floor((F.col("_n") + F.col("_of") - F.col("_turn")) / F.col("_of")))
    return back(rows.where("_times > 0").withColumn("_e", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))))


@query("op7_mix_sources", r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
           md5(coalesce(doc_id::varchar, '')) as ord from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from s),
r as (select *, sum(source_size) over () as total, sum(w) over () as w_all,
      sum(source_size) over o - source_size as s_before, sum(w) over o - w as w_before
      from w window o as (order by source_size / w, source nulls last rows unbounded preceding)),
f as (select *, w * (3 * total - 4 * s_before) >= 4 * source_size * (w_all - w_before) as stops from r),
g as (select *, sum(case when stops then source_size else 0 end) over () as s_stop,
      sum(case when stops then 0 else w end) over () as w_free from f),
t as (select source, source_size, case when stops then (2 * source_size)::double
      else (w * (3 * total - 4 * s_stop))::double / (2.0::double * w_free) end as target from g),
q as (select d.*, source_size, target, sum(size) over (partition by d.source order by ord, doc_id, size rows unbounded preceding) as cum
      from d join t on d.source is not distinct from t.source),
p as (select *, (pass * source_size + cum)::double / target as finish from q, (values (0), (1)) v(pass) where size > 0),
n as (select *, sum(size) over (order by finish, source nulls last, pass, ord, doc_id rows unbounded preceding) as run from p),
k as (select doc_id, source, cum, sum(size) as taken from n
      where run <= (select sum(size) * 3 // 2 from d) group by all)
select q.doc_id, q.size, q.source_size::bigint as source_size, q.target, coalesce(k.taken, 0)::bigint as taken
from q left join k on q.doc_id is not distinct from k.doc_id and q.source is not distinct from k.source and q.cum = k.cum and q.size > 0""")
def op7_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return fair_queue(docs).select("doc_id", "size", "source_size", "target", "taken")
