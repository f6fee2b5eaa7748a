"""Near-duplicates by SimHash through an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes. Any 5 positions have 3 within one half of the 8, so such a pair meets in at least one of 8 posting
lists keyed by three bytes of a half (4 triples a half). Within a list the shared positional bytes of each pair are
tallied, pairs with fewer than 5 are passed over, the others are verified bit by bit. A list too long for that is
dealt out again: a pair in it shares two more of the 5 other positions, so it meets in one of 10 finer lists, whose
five fixed bytes leave at most 2**24 fingerprints. Only distinct fingerprints are indexed, and each list passes on
links that join its groups, at most one per fingerprint.

Defined results: null, empty and blank texts have fingerprint 0 and link like any other; repeated rows come out as often
as they came in; a null doc_id is larger than any number and is the component id only where no other id is; no rows
give no rows; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import Forest, apart, components, query, sorted_runs, table, texts_of
from fieldgauge.sources.workspace import materialise

SHINGLE = 3
MAX_BITS = 3
SHARED = 8 - MAX_BITS
LONG_LIST = 512
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)

def fingerprints(batches):
    """(doc_id, fp) of (doc_id, text): bits set in over half of the shingle hashes, counted by byte histograms."""
    from xxhash import xxh64_intdigest

    def hashes(raw: bytes) -> np.ndarray:
        words = raw.lower().split()
        n = len(words)
        if n <= SHINGLE:
            return np.array([xxh64_intdigest(b" ".join(words), 42)] if n else [], np.uint64)
        ends = list(accumulate(len(w) + 1 for w in words))
        line = b" ".join(words)
        starts = [0, *ends]
        parts = map(line.__getitem__, map(slice, starts, [e - 1 for e in ends[SHINGLE - 1:]]))
        return np.fromiter(map(xxh64_intdigest, parts, repeat(42)), np.uint64, n - SHINGLE + 1)

    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    for batch in batches:
        fps = []
        for raw in texts_of(batch):
            h = hashes(raw)
            octets = h.view(np.uint8).reshape(-1, 8)
            out = 0
            for i in range(8 if len(h) else 0):
                ones = np.bincount(octets[:, i], minlength=256) @ bits
                out |= int(np.packbits(2 * ones > len(h), bitorder="little")[0]) << (8 * i)
            fps.append(out - (1 << 64) if out >> 63 else out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

def linked(fps: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (left, right) of the pairs of ``fps`` within MAX_BITS, found block against block."""
    n = len(fps)
    forest = Forest(n)
    for i in range(0, n, block):
        for j in range(i, n, block):
            x = fps[i:i + block, None] ^ fps[None, j:j + block]
            same = sum(((x >> np.int64(8 * k)) & 255) == 0 for k in range(8))  # tally of shared positional bytes
            a, b = np.nonzero(same >= SHARED)
            close = np.bitwise_count(x[a, b].view(np.uint64)) <= MAX_BITS
            forest.unite(a[close] + i, b[close] + j)
    roots = forest.roots()
    off = np.flatnonzero(roots != np.arange(n))
    return fps[roots[off]], fps[off]

def _lists(batches):
    for _, (fps,) in sorted_runs(batches, ["lst", "key"], ["fp"]):
        if len(fps) > 1:
            a, b = linked(fps)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

def _byte(col, i: int):
    return F.shiftright(col, 8 * i).bitwiseAND(F.lit(255))

def _key(fp, positions):
    out = F.lit(0).cast("bigint")
    for p in positions:
        out = out * 256 + _byte(fp, p)
    return out

def _post(fps: DataFrame, lists: list[tuple[int, ...]], keep: str | None = None) -> DataFrame:
    """(lst, key, fp) rows, one per list; lists that hold one fingerprint are left out, n has the others' lengths."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("lst"), _key(F.col("fp"), p).alias("key")) for i, p in enumerate(lists)]))
    posted = fps.select("fp", each.alias("e")).select("e.lst", "e.key", "fp")
    sizes = posted.groupBy("lst", "key").agg(F.count("*").alias("n")).where("n > 1")
    return posted.join(sizes, ["lst", "key"])

def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of distinct fingerprints ``fp`` under at most MAX_BITS differing bits."""
    posted = materialise(_post(fps, TRIPLES))
    short = posted.where(F.col("n") <= LONG_LIST)

    def compare(rows):
        return rows.repartition("lst", "key").sortWithinPartitions("lst", "key").mapInArrow(_lists, "a bigint, b bigint")

    out = compare(short.select("lst", "key", "fp"))
    long = posted.where(F.col("n") > LONG_LIST)
    if not long.isEmpty():
        fine = []
        for i, t in enumerate(TRIPLES):
            rest = [p for p in range(8) if p not in t]
            for j, pair in enumerate(combinations(rest, 2)):
                fine.append((i, 10 * i + j, t + pair))
        each = F.array(*[F.struct(F.lit(i).alias("of"), F.lit(l).alias("lst"), _key(F.col("fp"), p).alias("key")) for i, l, p in fine])
        finer = (long.select("lst", "fp").withColumn("e", F.explode(F.filter(each, lambda e: e["of"] == F.col("lst"))))
                 .select("e.lst", "e.key", "fp"))
        sizes = finer.groupBy("lst", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        out = out.unionByName(compare(finer.join(sizes, ["lst", "key"])))
    return out

def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row. Rows with one fingerprint are a class; classes are linked and the
    smallest doc_id of a component goes back to its classes. Classes of many rows get their component by broadcast."""
    rows = materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(fingerprints, "doc_id bigint, fp bigint"))
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    comps = components(links(classes.select("fp")))
    named = classes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    # most components are a class alone; only classes that are more than one row or linked need a lookup
    found = materialise(named.join(least, "c").where(F.col("n").cast("bigint") > 1).select("fp", "n", "component_id")
                        .unionByName(named.join(least, "c").where((F.col("n") == 1) & ~F.col("least").eqNullSafe(F.col("component_id")))
                                     .select("fp", "n", "component_id")))
    top = found.orderBy(F.desc("n"), "fp").limit(1000)
    hot = F.broadcast(top.select(F.col("fp").alias("_hf"), F.struct("component_id").alias("_hot")))
    cold = found.join(F.broadcast(top.select("fp")), "fp", "left_anti").select(F.col("fp").alias("_cf"), F.lit(0).alias("_z"), F.struct("component_id").alias("_cold"))
    out = rows.join(hot, F.col("fp") == F.col("_hf"), "left")
    done = F.col("_hot").isNotNull()  # such rows carry another key, which meets nothing and spreads them
    out = (out.withColumn("_k", F.when(done, F.xxhash64("doc_id")).otherwise(F.col("fp"))).withColumn("_d", done.cast("int"))
           .join(cold, (F.col("_k") == F.col("_cf")) & (F.col("_d") == F.col("_z")), "left"))
    got = F.coalesce("_hot", "_cold")
    return out.select("doc_id", "fp", F.when(got.isNull(), F.col("doc_id")).otherwise(got["component_id"]).alias("component_id"))

def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each component: the row with its smallest doc_id, once if it is repeated. An id
    that stands for unlike texts stays with all of them if any of them is its component's smallest, so that no
    component is lost."""
    found = near_duplicates(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = found.where(stays).groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n"))
    goes = found.where(~stays).select(F.col("doc_id").alias("_gone")).distinct()
    goes = goes.join(kept, F.col("_gone").eqNullSafe(F.col("_kept")), "left_anti")
    held, back = apart(docs, "doc_id", "text")
    out = held.join(goes, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_gone")), "left_anti")
    return back(out if kept.where("_n > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"]))


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
