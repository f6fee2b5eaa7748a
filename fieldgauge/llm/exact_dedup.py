"""Grace hash deduplication of whole texts.

Texts are equal when identical after each run of ASCII white space became one space; null counts as empty. Records are
dealt into buckets by bits of their content hash; a bucket goes through an open-addressing table that compares complete
contents. A bucket that outgrows the table is written to spill files in the shared folder and dealt again by the next
bits, until every bucket fits.

Defined results: no rows give no rows; a null doc_id counts as larger than any number and a group of null ids keeps a
null; of rows that repeat doc_id and text exactly one is kept; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import apart, one_space, query, table
from fieldgauge.sources.workspace import new_path

TABLE_BYTES = 32 << 20
BITS_A_LEVEL = 16

_LEADER = pa.schema([("digest", pa.binary()), ("keep", pa.int64()), ("n", pa.int64()), ("n_keep", pa.int64()),
                     ("text", pa.large_binary())])
_PROBED = pa.schema([("fits", pa.bool_()), *_LEADER])
_LEADER_DDL = "digest binary, keep bigint, n bigint, n_keep bigint, text binary"
_PROBED_DDL = "fits boolean, " + _LEADER_DDL


class ContentTable:
    """Open addressing with linear probing; a slot holds the row number of a distinct content."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.rows: list[list] = []
        self.bytes = 0

    def _place(self, h: int, i: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        self.slots[at] = i

    def add(self, digest: bytes, keep, n: int, n_keep: int, text: bytes) -> None:
        h = int.from_bytes(digest[-8:], "little")
        mask = len(self.slots) - 1
        at = h & mask
        while (i := int(self.slots[at])) >= 0:
            if self.hashes[i] == h and self.rows[i][0] == digest:
                row = self.rows[i]
                if row[4] != text:
                    raise ValueError("two different texts have one SHA-256 digest")
                if keep == row[1]:
                    row[3] += n_keep
                elif row[1] is None or keep is not None and keep < row[1]:
                    row[1], row[3] = keep, n_keep
                row[2] += n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.hashes.append(h)
        self.rows.append([digest, keep, n, n_keep, text])
        self.bytes += len(text) + 200
        if 2 * len(self.rows) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for i, h in enumerate(self.hashes):
                self._place(h, i)


def _batches(rows: list, schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``size`` bytes of text."""
    part, held = [], 0
    for r in rows:
        part.append(r)
        held += len(r[-1] or b"") + 64
        if held >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), schema)], schema=schema)


def _combine(limit: int):
    """Copies that meet within a task become one leader, so a large group sends a few rows for each task."""
    def run(batches):
        t = ContentTable()
        for b in batches:
            cols = b.to_pydict()
            for digest, keep, text in zip(cols["digest"], cols["keep"], cols["text"]):
                t.add(digest, keep, 1, 1, text)
                if t.bytes > limit:
                    yield from _batches(t.rows, _LEADER)
                    t.clear()
        yield from _batches(t.rows, _LEADER)
    return run


def _probe(limit: int):
    """Rows come sorted by bucket. Groups of a bucket that fits leave without text; the rest leaves whole, to be dealt again."""
    def run(batches):
        t, bucket, over = ContentTable(), None, False

        def settled():
            return [(True, d, k, n, m, None) for d, k, n, m, _ in t.rows if n > 1]

        def spilled():
            return [(False, *r) for r in t.rows]

        for b in batches:
            cols = b.to_pydict()
            for to, digest, keep, n, m, text in zip(*(cols[c] for c in ("bucket", *_LEADER.names))):
                if to != bucket:
                    yield from _batches(spilled() if over else settled(), _PROBED)
                    t.clear()
                    bucket, over = to, False
                t.add(digest, keep, n, m, text)
                if t.bytes > limit and len(t.rows) > 1:
                    over = True
                    yield from _batches(spilled(), _PROBED)
                    t.clear()
        yield from _batches(spilled() if over else settled(), _PROBED)
    return run


def _bits(level: int, width: int):
    """The bits of the digest that deal out at this level."""
    start = 2 * level
    return F.conv(F.substring(F.hex("digest"), 1 + 2 * start, 4), 16, 10).cast("int").bitwiseAND(F.lit((1 << width) - 1))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_digest``, the SHA-256 of the normalised text."""
    return docs.withColumn("_digest", F.unhex(F.sha2(one_space(F.col(text)).cast("binary"), 256)))


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Groups of two or more equal texts: digest, keep (smallest id), n rows, n_keep rows that carry that id."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text)) + F.lit(200))).first()[0] or 0
    width = min(BITS_A_LEVEL, max(6, math.ceil(math.log2(max(1, 4 * total / table_bytes)))))
    content = docs.select(F.col(doc_id).cast("bigint").alias("keep"), one_space(F.col(text)).cast("binary").alias("text"))
    pending = (content.select(F.unhex(F.sha2("text", 256)).alias("digest"), "keep", "text")
               .mapInArrow(_combine(table_bytes // 2), _LEADER_DDL))
    done, level = [], 0
    while True:
        path = new_path(spark, f"grace-{level}")
        (pending.withColumn("bucket", _bits(level, width)).repartition("bucket").sortWithinPartitions("bucket")
         .mapInArrow(_probe(table_bytes), _PROBED_DDL).write.parquet(path))
        probed = spark.read.schema(_PROBED_DDL).parquet(path)
        done.append(probed.where("fits").drop("fits", "text"))
        pending = probed.where("not fits").drop("fits")
        if pending.isEmpty():
            break
        level, width = level + 1, BITS_A_LEVEL
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with _digest, _keep_id, _group_size and _kept. The largest 1,000 groups reach their rows by broadcast,
    the others by a shuffle of digests in which no key is hot."""
    groups = duplicate_groups(docs, doc_id, text, table_bytes)
    top = groups.orderBy(F.desc("n"), "digest").limit(1000)
    hot = F.broadcast(top.select(F.col("digest").alias("_hd"), F.struct("keep", "n", "n_keep").alias("_hot")))
    cold = (groups.join(F.broadcast(top.select("digest")), "digest", "left_anti")
            .select(F.col("digest").alias("_cd"), F.struct("keep", "n", "n_keep").alias("_cold")))
    rows = keyed(docs, doc_id, text).join(hot, F.col("_digest") == F.col("_hd"), "left")
    # rows already answered carry a key of another length that meets nothing and spreads them
    spread = F.unhex(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")))
    rows = (rows.withColumn("_k", F.when(F.col("_hot").isNull(), F.col("_digest")).otherwise(spread))
            .join(cold, F.col("_k") == F.col("_cd"), "left")
            .withColumn("_g", F.coalesce("_hot", "_cold")).drop("_hd", "_cd", "_hot", "_cold", "_k"))
    this = F.col(doc_id).cast("bigint")
    rows = (rows.withColumn("_keep_id", F.when(F.col("_g").isNull(), this).otherwise(F.col("_g.keep")))
            .withColumn("_group_size", F.coalesce(F.col("_g.n"), F.lit(1).cast("bigint")))
            .withColumn("_kept", this.eqNullSafe(F.col("_keep_id"))))
    if groups.where("n_keep > 1").isEmpty():
        return rows.drop("_g")
    # rows that repeat the kept id: one of them stays, the others turn into dropped ones
    several = F.col("_kept") & (F.coalesce(F.col("_g.n_keep"), F.lit(1)) > 1)
    again = rows.where(several)
    one = again.dropDuplicates(["_digest"])
    more = (again.groupBy(*[c for c in rows.columns if c != "_g"]).agg(F.count("*").alias("_c"))
            .join(one.select("_digest", *[F.col(c).alias(f"_one_{i}") for i, c in enumerate(docs.columns)]), "_digest"))
    same = F.lit(True)
    for i, c in enumerate(docs.columns):
        same = same & F.col(c).eqNullSafe(F.col(f"_one_{i}"))
    more = (more.withColumn("_c", F.col("_c") - F.when(same, 1).otherwise(0)).where("_c > 0")
            .withColumn("_e", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c")))).withColumn("_kept", F.lit(False)))
    cols = [c for c in rows.columns if c != "_g"]
    return rows.where(~several).select(*cols).unionByName(one.select(*cols)).unionByName(more.select(*cols))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, columns unchanged."""
    held, back = apart(docs, "doc_id", "text")
    return back(exact_dedup(held).where("_kept"))


@query("op10_exact_dedup", r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents)
select doc_id, min(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
       doc_id = min(doc_id) over (partition by n) as kept, sha256(n) as text_sha256
from t""")
def op10_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"),
                                    F.col("_kept").alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))
