"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fieldgauge.sources.workspace import materialise

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with oracle text where SQL can say it."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame, *need: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but those an operator works on under numbered names, where none can clash with the
    operator's own, and the function that gives the columns back as they were."""
    names = [c if c in need else f"_rest_{i}" for i, c in enumerate(docs.columns)]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    return docs.toDF(*names), back


def one_space(text: Column) -> Column:
    """``text`` with each run of white space as one space; null counts as empty. Runs that are one space already are
    not matched, which leaves most of a text alone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def rows_out(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    """A batch from a list of row tuples."""
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, schema)], schema=schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in col.cast(pa.large_binary()).to_pylist()]


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple]:
    """From batches sorted by integer ``keys``: (key values, column arrays) of each run of equal keys, joined over
    batch borders. Meant for runs whose length is bounded by the caller."""
    held: list[np.ndarray] | None = None
    names = keys + columns
    for batch in batches:
        now = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            now = [np.concatenate(p) for p in zip(held, now)]
        size = len(now[0])
        if not size:
            continue
        new = np.zeros(size, bool)
        for k in range(len(keys)):
            new[1:] |= now[k][1:] != now[k][:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield [c[a] for c in now[:len(keys)]], [c[a:b] for c in now[len(keys):]]
        held = [c[cuts[-1]:].copy() for c in now]
    if held is not None and len(held[0]):
        yield [c[0] for c in held[:len(keys)]], held[len(keys):]


class Forest:
    """Union-find over 0..n-1 that keeps only the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def unite(self, left: np.ndarray, right: np.ndarray) -> None:
        """Union many links; links inside one tree are skipped together."""
        while len(left):
            roots = self.roots()
            apart = roots[left] != roots[right]
            left, right = roots[left[apart]], roots[right[apart]]
            if not len(left):
                return
            lo, hi = np.minimum(left, right), np.maximum(left, right)
            order = np.unique(hi, return_index=True)[1]
            self.up[hi[order]] = lo[order]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph with long edges (a, b): the smallest node reachable. Every round takes the least
    label among neighbours, then the label of that label, and writes its result, so lineage stays short; it ends when
    no label changes. A node without edges is not listed."""
    both = materialise(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")))
        step = (labels.join(near, labels["node"] == near["a"], "left")
                .select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid")))
        hop = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = materialise(step.join(hop, F.col("mid") == F.col("_n"), "left")
                          .select("node", F.least("mid", "_l").alias("label"), (F.least("mid", "_l") != F.col("old")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def numbered(rows: DataFrame, group: list[str], order: Iterable[str], name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with the place of each within its group by ``order``, from 0 without gaps. Rows go to ranges of group,
    order and a number of their own, pinned as partition numbers must not change between the two reads; so neither a
    large group nor equal rows meet in one task. Counts have one row for each group and each range border."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, "_own"]
    placed = materialise(rows.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange(n, *group, *order)
                         .withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy(*group, "_pid").agg(F.count("*").alias("_n"))
              .select(*[F.col(g).alias(f"_g_{i}") for i, g in enumerate(group)], F.col("_pid").alias("_p"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    on = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, "_pid").orderBy(*order)) - 1
    return placed.withColumn("_in", inside).join(starts, on).select(
        *[c for c in rows.columns if c != name], (F.col("_in") + F.col("_before")).cast("bigint").alias(name))
