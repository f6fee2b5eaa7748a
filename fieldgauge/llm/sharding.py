"""Sharding by jump consistent hashing, in DataFrame functions only.

The key's text is hashed to 64 bits, which seed the linear congruential generator of the algorithm. Each step jumps to
the next number of shards at which the key would move; the last jump below the number of shards is the key's shard. No
ring or table is kept, and since the state after the last jump also tells the next move, the shard under one more shard
comes from the same pass: the key stays, or goes to the new shard.

The generator works on limbs of 22, 22 and 20 bits, so no product leaves 64-bit integers and ANSI overflow checks may stay on.

Defined results: no rows give no rows; a null key is hashed as the empty text, so all its rows share a shard; rows that
repeat a key share its shard and take slots of their own; a null text has no bytes and the CRC of the empty text. Other
columns are carried along; one named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fieldgauge.llm.common import numbered, query, table
from fieldgauge.sources.workspace import materialise

SHARDS = 24
ROW_BYTES = 8
MULTIPLIER = 2862933555777941757  # of the published algorithm
LIMB = 22
_LOW, _HIGH = (1 << LIMB) - 1, (1 << 20) - 1
_M = [MULTIPLIER & _LOW, MULTIPLIER >> LIMB & _LOW, MULTIPLIER >> 2 * LIMB]


def _long(value) -> Column:
    return F.lit(value).cast("bigint")


def jump(key: Column, shards: int) -> Column:
    """Struct of ``at``, the key's shard among ``shards``, and ``to``, the number of shards beyond which it moves next.
    Every jump goes up by one at least, so ``shards`` steps are enough; a key that is through costs one comparison."""
    digest = F.md5(key.cast("binary"))
    low = F.conv(F.substring(digest, 6, 11), 16, 10).cast("bigint")
    start = F.struct(_long(-1).alias("at"), _long(0).alias("to"), low.bitwiseAND(_long(_LOW)).alias("a"),
                     F.shiftright(low, LIMB).alias("b"), F.conv(F.substring(digest, 1, 5), 16, 10).cast("bigint").alias("c"))

    def step(s: Column, _: Column) -> Column:
        a = s["a"] * _long(_M[0]) + _long(1)
        b = s["a"] * _long(_M[1]) + s["b"] * _long(_M[0]) + F.shiftright(a, LIMB)
        c = s["a"] * _long(_M[2]) + s["b"] * _long(_M[1]) + s["c"] * _long(_M[0]) + F.shiftright(b, LIMB)
        a, b, c = a.bitwiseAND(_long(_LOW)), b.bitwiseAND(_long(_LOW)), c.bitwiseAND(_long(_HIGH))
        top = F.shiftleft(c, 11).bitwiseOR(F.shiftright(b, 11)) + _long(1)  # the upper 31 bits, plus one
        to = F.floor((s["to"] + _long(1)).cast("double") * (F.lit(float(1 << 31)) / top.cast("double")))
        next_ = F.struct(s["to"].alias("at"), to.alias("to"), a.alias("a"), b.alias("b"), c.alias("c"))
        return F.when(s["to"] >= _long(shards), s).otherwise(next_)
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: F.struct(s["at"].alias("at"), s["to"].alias("to")))


def sharded(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``shard`` and ``grown_shard``, the shard if one more is appended. Nothing is shuffled."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = jump(F.coalesce(F.col(key).cast("string"), F.lit("")), shards)
    return (rows.withColumn("_jump", state).withColumn("shard", F.col("_jump.at").cast("int"))
            .withColumn("grown_shard", F.when(F.col("_jump.to") == shards, F.lit(shards)).otherwise(F.col("_jump.at")).cast("int"))
            .drop("_jump"))


def with_slots(placed: DataFrame, order: Sequence[str]) -> DataFrame:
    """``placed`` with ``slot``, the place of a row in its shard by ``order``, from 0 without gaps. Rows equal in
    ``order`` are interchangeable. A shard is numbered in ranges, so no task holds one."""
    return numbered(materialise(placed), ["shard"], order, "slot")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", order: Sequence[str] = ("doc_id",),
                 shards: int = SHARDS) -> None:
    """Whole rows as Parquet, one folder for each shard, in the order of their slots."""
    out = with_slots(sharded(docs, key, shards), order)
    (out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


@query("op12_jump_sharding", r"""
with tab as (select list(list_reduce([n::ubigint] || range(8)::ubigint[], lambda x, i: case when x % 2 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end) order by n) as t from range(256) r(n)),
d as (select doc_id, coalesce(text, '') as x, md5(coalesce(doc_id::varchar, '')) as m from documents),
z as (select doc_id, strlen(x) + 8 as size,
      xor(list_reduce([4294967295::ubigint] || list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda p: ('0x' || p)::ubigint),
          lambda c, b: xor(c >> 8, t[(xor(c, b) % 256)::int + 1])), 4294967295::ubigint)::bigint as text_crc32,
      list_reduce(list_transform(range(24), lambda i: {'at': 0::bigint, 'to': 0::bigint, 'k': 0::uhugeint}),
          lambda s, e: case when s.to >= 24 then s else {'at': s.to, 'to': floor((s.to + 1)::double * (2147483648::double /
              (((s.k * 2862933555777941757 + 1) % 18446744073709551616::uhugeint) // 8589934592 + 1)::double))::bigint,
              'k': (s.k * 2862933555777941757 + 1) % 18446744073709551616::uhugeint} end,
          {'at': -1::bigint, 'to': 0::bigint, 'k': ('0x' || substr(m, 1, 16))::uhugeint}) as j
      from d, tab)
select doc_id, size, text_crc32, 'key' as law, j.at::int as shard,
       row_number() over (partition by j.at order by doc_id nulls first, text_crc32, size) - 1 as slot,
       (case when j.to = 24 then 24 else j.at end)::int as grown_shard
from z""")
def op12_jump_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    return (with_slots(sharded(rows), ["doc_id", "text_crc32", "size"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))
