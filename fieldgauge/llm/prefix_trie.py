"""Prefix trie of conversations in balanced parentheses.

Sequences of turns are sorted and cut into shards, neighbouring ranges of that order. A shard writes the trie of its
sequences as balanced parentheses: an opening one for a node in preorder, a closing one behind its subtree. Blocks of
the excess (opening minus closing) keep their minimum in a min tree, through which findclose delimits each subtree;
the rank of the pairs "()" counts its leaves, and cumulative arrays over preorder give members and savings. Only the
nodes on the paths of a shard's first and last sequence can have members elsewhere. These spines leave the shard
as two paths with what hangs off them, and the paths of all shards are a smaller input of the same kind, until one
shard is left. Texts never travel: a turn is the first 16 bytes of the SHA-256 of its role and text, and the number of
bytes of the text.

Defined results: rows without conv_id belong to no conversation and are left out; no conversations give no nodes; null
role or text is empty; turns sort by number, null first, and equal numbers by the digest of role and text; the
remainder of a negative id by 5 is taken as in mathematics, from 0 to 4; columns other than conv_id, turn, role and text
are not read. The turns of one conversation, 24 bytes each, are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import query, table
from fieldgauge.sources.workspace import materialise

FAMILY = 5          # conversations that take their head from the first of them
HEADS = 9           # a head has crc32 mod HEADS turns
UNIT = 16           # bytes of a turn's digest
SHARD_TURNS = 1 << 18
LEAST_TURNS = 1 << 12
BLOCK = 64          # excess values of a block
IDS_BITS = 12       # ids of copies travel in lists of at most 2**IDS_BITS
SALTS = 64
NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()

_SEQ_DDL = "conv_id bigint, seq binary, sizes binary"
_SEQ = pa.schema([("conv_id", pa.int64()), ("seq", pa.binary()), ("sizes", pa.binary())])
_PATH = [("seq", pa.binary()), ("sizes", pa.binary()), ("at", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
         ("low", pa.list_(pa.int64())), ("kids", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int64())),
         ("saved", pa.list_(pa.int64())), ("ends", pa.list_(pa.string()))]
_NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
         ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
         ("node_key", pa.binary()), ("parent_key", pa.binary())]
_OUT = pa.schema(_NODE + _PATH)
_OUT_DDL = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
            "saved_tokens bigint, ends_sha256 string, node_key binary, parent_key binary, seq binary, sizes binary, "
            "at array<bigint>, n array<bigint>, low array<bigint>, kids array<bigint>, leaves array<bigint>, "
            "saved array<bigint>, ends array<string>")


# ---- sequences ---------------------------------------------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """One narrow row for each turn: conversation, its family and head length, turn, digest and bytes of the text."""
    c, role, text = F.col("conv_id").cast("bigint"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    what = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return conversations.where("conv_id is not null").select(
        c.alias("conv_id"), (c - F.pmod(c, F.lit(FAMILY))).alias("family"),
        (F.crc32(c.cast("string").cast("binary")) % HEADS).cast("int").alias("head"), F.col("turn").alias("turn"),
        F.unhex(F.substring(F.sha2(what, 256), 1, 2 * UNIT)).alias("digest"),
        F.octet_length(text.cast("binary")).cast("bigint").alias("size"))


def _rebuild(batches) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and turn, the first of a family before the others."""
    now, parts, sizes = None, [], []
    donor = (None, b"", b"")
    out, held = [], 0

    def done():
        nonlocal donor
        c, family, head = now
        seq, wide = b"".join(parts), b"".join(sizes)
        if c == family:
            donor = (c, seq[:UNIT * (HEADS - 1)], wide[:8 * (HEADS - 1)])
            return c, seq, wide
        first, first_wide = donor[1:] if donor[0] == family else (b"", b"")
        return c, first[:UNIT * head] + seq[UNIT * head:], first_wide[:8 * head] + wide[8 * head:]

    for b in batches:
        c = b.column(0).to_numpy()
        digests, wide = b.column(3).to_pylist(), b.column(4).to_numpy().tobytes()
        cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if now is None or int(c[x]) != now[0]:
                if now is not None:
                    out.append(done())
                    held += 24 + len(out[-1][1]) * 3 // 2
                now, parts, sizes = (int(c[x]), b.column(1)[x].as_py(), b.column(2)[x].as_py()), [], []
            parts.append(b"".join(digests[x:y]))
            sizes.append(wide[8 * x:8 * y])
        if held > 4 << 20:
            yield _batch(out, _SEQ)
            out, held = [], 0
    if now is not None:
        out.append(done())
    if out:
        yield _batch(out, _SEQ)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes) of every conversation: the head of its family's first conversation, then its own turns
    behind the head. One shuffle of digests does both the sorting and the exchange of heads."""
    rows = turns(conversations)
    return (rows.repartition("family").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest")
            .select("conv_id", "family", "head", "digest", "size").mapInArrow(_rebuild, _SEQ_DDL))


# ---- one shard ---------------------------------------------------------------------------------------------------

class MinTree:
    """Minima of a complete binary tree over an array."""

    def __init__(self, values: np.ndarray):
        self.width = 1 << max(0, int(len(values) - 1).bit_length())
        self.tree = np.full(2 * self.width, NONE if values.dtype == np.int64 else np.iinfo(values.dtype).max, values.dtype)
        self.tree[self.width:self.width + len(values)] = values
        at = self.width
        while at > 1:
            self.tree[at // 2:at] = np.minimum(self.tree[at:2 * at:2], self.tree[at + 1:2 * at:2])
            at //= 2

    def first_at_most(self, start: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The first place from ``start`` with a value of ``most`` or less; there must be one."""
        node = start + self.width
        while (high := self.tree[node] > most).any():
            node = np.where(high, np.where(node & 1, (node >> 1) + 1, node + 1), node)
        while (inner := node < self.width).any():
            left = np.where(inner, 2 * node, node)
            node = np.where(inner & (self.tree[left] > most), left + 1, left)
        return node - self.width

    def least(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The minimum of each range [start, stop)."""
        a, b = start + self.width, stop + self.width
        out = np.full(len(start), NONE)
        while (some := a < b).any():
            left = some & (a & 1 == 1)
            out[left] = np.minimum(out[left], self.tree[a[left]])
            right = some & (b & 1 == 1)
            out[right] = np.minimum(out[right], self.tree[b[right] - 1])
            a, b = np.where(left, a + 1, a) >> 1, b >> 1
            a, b = np.where(some, a, 1), np.where(some, b, 1)
        return out


def find_close(excess: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """For each opening parenthesis the place of its closing one: the first later place whose excess is one less, in
    its own block or in the first later block whose minimum reaches that."""
    blocks = -(-len(excess) // BLOCK)
    padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
    padded[:len(excess)] = excess
    padded = padded.reshape(blocks, BLOCK)
    tree = MinTree(padded.min(1))
    out, inside = np.empty(len(opened), np.int64), np.arange(BLOCK)
    for a in range(0, len(opened), 1 << 15):
        at = opened[a:a + (1 << 15)]
        block, most = at // BLOCK, (excess[at] - 1).astype(np.int32)
        hit = (padded[block] <= most[:, None]) & (inside > (at % BLOCK)[:, None])
        far = ~hit.any(1)
        block[far] = tree.first_at_most(block[far] + 1, most[far])
        hit[far] = padded[block[far]] <= most[far, None]
        out[a:a + len(at)] = block * BLOCK + hit.argmax(1)
    return out


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the start."""
    low, high = 0, min(len(a), len(b)) // UNIT
    if a[:UNIT * high] == b[:UNIT * high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[UNIT * low:UNIT * mid] == b[UNIT * low:UNIT * mid]:
            low = mid
        else:
            high = mid
    return low


class _Item:
    """A sequence with values at some of its prefixes."""
    __slots__ = ("seq", "sizes", "values")

    def __init__(self, seq: bytes, sizes: bytes, values: list[tuple]):
        self.seq, self.sizes, self.values = seq, sizes, values  # (depth, n, low, kids, leaves, saved, ends)


def _copies(batches) -> Iterator[_Item]:
    """Items of distinct sequences from rows sorted by sequence and id list; the ids of its copies go through one hash."""
    now = hasher = None
    for b in batches:
        cols = b.to_pydict()
        for seq, sizes, n, low, ids in zip(*(cols[c] for c in ("seq", "sizes", "n", "low", "ids"))):
            if now is None or seq != now[0]:
                if now is not None:
                    yield _Item(now[0], now[1], [(len(now[0]) // UNIT, now[2], now[3], 0, 0, 0, hasher.hexdigest())])
                now, hasher = [seq, sizes, n, low], hashlib.sha256(ids.encode())
            else:
                now[2], now[3] = now[2] + n, min(now[3], low)
                hasher.update(b"," + ids.encode())
    if now is not None:
        yield _Item(now[0], now[1], [(len(now[0]) // UNIT, now[2], now[3], 0, 0, 0, hasher.hexdigest())])


def _paths(batches) -> Iterator[_Item]:
    for b in batches:
        cols = b.to_pydict()
        for seq, sizes, *values in zip(*(cols[c] for c, _ in _PATH)):
            yield _Item(seq, sizes, list(zip(*values)))


def _keys(items: list[_Item], shared: np.ndarray, wanted: dict[int, list[int]]) -> dict[tuple[int, int], bytes]:
    """(item, depth) -> digest of that prefix, for the depths wanted of each item."""
    out = {}
    for i, depths in wanted.items():
        h, d, seq = hashlib.sha256(), 0, items[i].seq
        for to in sorted(depths):
            h.update(seq[UNIT * d:UNIT * to])
            d = to
            out[i, to] = h.copy().digest()[:UNIT]
    return out


def shard(items: list[_Item], last: bool, keyed: bool) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard, then the paths of its spines. ``last``: nothing is shared with others, all nodes are final.
    ``keyed``: nodes carry the key that children of an earlier round know them by."""
    count = len(items)
    length = np.array([len(t.seq) // UNIT for t in items])
    shared = np.array([-1, *(_common(a.seq, b.seq) for a, b in zip(items, items[1:]))])
    fresh = length - shared
    stop = np.cumsum(fresh)
    base, total = stop - fresh, int(stop[-1])
    item = np.repeat(np.arange(count), fresh)
    depth = np.arange(total) - base[item] + shared[item] + 1
    size = np.concatenate([np.concatenate([[0], np.frombuffer(t.sizes, np.int64)])[s + 1:] for t, s in zip(items, shared)])

    # the parentheses: nodes of a sequence open, then close up to what the next one shares
    runs = np.empty(2 * count, np.int64)
    runs[::2], runs[1:-1:2], runs[-1] = fresh, length[:-1] - shared[1:], length[-1] + 1
    signs = np.repeat(np.tile(np.array([1, -1], np.int8), count), runs)
    excess = np.cumsum(signs, dtype=np.int32)
    opened = np.flatnonzero(signs == 1)
    closed = find_close(excess, opened)
    rank = np.cumsum(signs == 1)
    end = rank[closed]  # preorder number behind the subtree
    pre = np.arange(total)

    # nodes of one depth in preorder: a parent is the last one above, a prefix of a sequence the last one up to its end
    by_depth = np.lexsort((pre, depth))
    sorted_key = depth[by_depth] * total + by_depth
    node_at = lambda d, upto: by_depth[np.searchsorted(sorted_key, d * total + upto, "right") - 1]
    parent = np.where(depth > 0, node_at(np.maximum(depth - 1, 0), pre), -1)
    child = np.bincount(parent[1:], minlength=total)

    n, kids, leaves, saved = (np.zeros(total, np.int64) for _ in range(4))
    low, ends = np.full(total, NONE), {}
    values = [(i, *v) for i, t in enumerate(items) for v in t.values]
    if values:
        who, at, v_n, v_low, v_kids, v_leaves, v_saved = (np.array(c, np.int64) for c in list(zip(*values))[:7])
        node = node_at(at, stop[who] - 1)
        for into, v in ((n, v_n), (kids, v_kids), (leaves, v_leaves), (saved, v_saved)):
            np.add.at(into, node, v)
        np.minimum.at(low, node, v_low)
        ends = {int(x): v[7] for x, v in zip(node, values) if v[7] is not None}

    spine = np.zeros(total, bool)
    if not last:
        spine[:stop[0]] = True
        spine[node_at(np.arange(length[-1] + 1), total - 1)] = True
    summed = lambda v: (c := np.concatenate([[0], np.cumsum(v)]))[end] - c[pre]
    members = summed(n)
    smallest = MinTree(low).least(pre, end)
    pairs = np.zeros(len(signs), np.int64)
    tips = (signs[:-1] == 1) & (signs[1:] == -1)
    pairs[:-1][tips] = ~spine[rank[:-1][tips] - 1] & (kids[rank[:-1][tips] - 1] == 0)
    pair_rank = np.concatenate([[0], np.cumsum(pairs)])
    tipped = pair_rank[closed] - pair_rank[opened] + summed(leaves)
    spared = summed(np.where(spine, 0, (members - 1) * size) + saved)
    children = child + kids

    inner = np.flatnonzero(~spine)
    above = parent[inner]
    outside = (above >= 0) & spine[above]
    wanted: dict[int, list[int]] = {}
    for x in np.unique(above[outside]).tolist():
        wanted.setdefault(int(item[x]), []).append(int(depth[x]))
    if keyed:
        for x in inner.tolist():
            wanted.setdefault(int(item[x]), []).append(int(depth[x]))
    keys = _keys(items, shared, {i: sorted(set(d)) for i, d in wanted.items()})
    key_of = lambda x: keys[int(item[x]), int(depth[x])]
    blank = pa.nulls(len(inner))
    node_cols = [pa.array(smallest[inner]), pa.array(depth[inner]),
                 pa.array(smallest[np.maximum(above, 0)], mask=(above < 0) | outside), pa.array(members[inner]),
                 pa.array(children[inner]), pa.array(tipped[inner]), pa.array(spared[inner]),
                 pa.array([ends.get(x, EMPTY) for x in inner.tolist()]),
                 pa.array([key_of(x) if keyed else None for x in inner.tolist()], pa.binary()),
                 pa.array([key_of(x) if o else None for x, o in zip(above.tolist(), outside.tolist())], pa.binary())]
    for a in range(0, len(inner), 1 << 14):
        part = [c.slice(a, 1 << 14) for c in node_cols]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, (_, t) in zip(part, _NODE)]
                                         + [blank.slice(a, 1 << 14).cast(t) for _, t in _PATH], schema=_OUT)
    if last:
        return

    # what hangs off a spine node: all below it less what hangs off or below its children on a spine
    on = np.flatnonzero(spine)
    below = on[parent[on] >= 0]
    hang = {"n": members.copy(), "leaves": tipped.copy(), "saved": spared.copy(), "kids": children.copy()}
    for name, whole in (("n", members), ("leaves", tipped), ("saved", spared)):
        np.subtract.at(hang[name], parent[below], whole[below])
    np.subtract.at(hang["kids"], parent[below], 1)
    least = low.copy()
    loose = inner[outside]
    np.minimum.at(least, parent[loose], smallest[loose])
    rows, seen = [], set()
    for i in dict.fromkeys((0, count - 1)):
        path = node_at(np.arange(length[i] + 1), stop[i] - 1)
        held = [x for x in path.tolist() if x not in seen and (least[x] != NONE or x in ends)]
        seen.update(path.tolist())
        rows.append((items[i].seq, items[i].sizes, depth[held].tolist(), *(hang[c][held].tolist() if c != "low" else least[held].tolist()
                     for c in ("n", "low", "kids", "leaves", "saved")), [ends.get(x) for x in held]))
    yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), t) for _, t in _NODE]
                                     + [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PATH)], schema=_OUT)


def _shards(read, last: bool, keyed: bool, most: int):
    """Cuts the sorted items of a task into shards of about ``most`` turns."""
    def run(batches):
        held, size = [], 0
        for t in chain(read(batches), [None]):
            if t is None or size > most and not last:
                if held:
                    yield from shard(held, last, keyed)
                held, size = [], 0
            if t is not None:
                held.append(t)
                size += len(t.seq) // UNIT + 1
    return run


# ---- all shards --------------------------------------------------------------------------------------------------

def trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """The nodes of all sequences (conv_id, seq, sizes). Copies of a sequence become one item with lists of ids first,
    so no group of copies makes a shard large."""
    spark = sequences.sparkSession
    items = materialise(sequences.groupBy("seq", F.shiftright("conv_id", IDS_BITS).alias("ids_at"))
                        .agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("low"),
                             F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")))
    rows, order, read, keyed, before = items, ["seq", "ids_at"], _copies, False, None
    found = []
    while True:
        size = rows.agg(F.sum(F.octet_length("seq") / UNIT + 1)).first()[0] or 0
        last = size <= least_turns or before is not None and (size <= shard_turns or 2 * size > before)
        n = max(-(-int(size) // shard_turns), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // least_turns)))
        dealt = rows.repartition(1) if last else rows.repartitionByRange(n, "seq")
        out = materialise(dealt.sortWithinPartitions(*order).mapInArrow(_shards(read, last, keyed, shard_turns), _OUT_DDL))
        found.append(out.where("seq is null").select(*[c for c, _ in _NODE]))
        if last:
            break
        rows, order, read, keyed, before = out.where("seq is not null").select(*[c for c, _ in _PATH]), ["seq"], _paths, True, size
    nodes = found[0]
    for f in found[1:]:
        nodes = nodes.unionByName(f)
    if len(found) == 1:
        return nodes.drop("node_key", "parent_key")
    # nodes of spines are few; children whose parent is one of them learn its smallest member, the root's spread by salt
    keyed_nodes = nodes.where("node_key is not null").select(F.col("node_key").alias("_k"), F.col("conv_id").alias("_low"))
    salted = keyed_nodes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")
    asked = F.coalesce("parent_key", F.unhex(F.md5(F.col("conv_id").cast("string"))), F.lit(b""))
    joined = nodes.withColumn("_ask", F.when(F.col("parent_key").isNull(), F.concat(asked, F.lit(b"-"))).otherwise(asked)).withColumn("_salt", salt)
    return (joined.join(salted, (F.col("_ask") == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left")
            .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_low")).select(*[c for c, _ in _NODE[:8]]))


def prefix_trie(conversations: DataFrame, **sizes) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return trie(rebuilt(conversations), **sizes)


@query("op11_prefix_trie", r"""
with t as (select conv_id as c, coalesce(text, '') as x, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as h,
           row_number() over (partition by conv_id order by turn nulls first,
               sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as p
           from conversations where conv_id is not null),
w as (select distinct c, c - ((c % 5) + 5) % 5 as f,
      xor(list_reduce([4294967295::ubigint] || list_transform(regexp_extract_all(hex(encode(c::varchar)), '..'), lambda v: ('0x' || v)::ubigint),
          lambda a, b: list_reduce([xor(a, b)] || range(8)::ubigint[], lambda q, i: case when q % 2 = 1 then xor(q >> 1, 3988292384::ubigint) else q >> 1 end)),
          4294967295::ubigint) % 9 as k from t),
b as (select w.c, 0 as own, p, h, x from w join t on t.c = w.f where p <= k
      union all select w.c, 1, p, h, x from w join t on t.c = w.c where p > k),
s as (select c, row_number() over o as d, string_agg(h, '') over o as pre, strlen(x) as size
      from b window o as (partition by c order by own, p rows unbounded preceding)),
m as (select c, d, pre, size from s union all select c, 0, '', 0 from w),
n as (select pre, d, min(c) as low, count(*) as n, any_value(size) as size from m group by pre, d),
e as (select pre, sha256(string_agg(c::varchar, ',' order by c)) as ends from (select *, max(d) over (partition by c) as z from m) where d = z group by pre),
k as (select substr(pre, 1, 64 * (d - 1)) as up, count(*) as kids from n where d > 0 group by up),
u as (select n.*, coalesce(kids, 0) as kids from n left join k on k.up = n.pre),
a as (select substr(pre, 1, 64 * j) as pre, sum((kids = 0)::int) as leaves, sum((n - 1) * size) as saved
      from (select *, unnest(range(d + 1)) as j from u) group by all)
select u.low as conv_id, u.d::bigint as depth, v.low as parent_conv_id, u.n as n_convs, u.kids as n_children, a.leaves::bigint as n_leaves,
       a.saved::bigint as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from u join a on a.pre = u.pre left join e on e.pre = u.pre left join n v on u.d > 0 and v.d = u.d - 1 and v.pre = substr(u.pre, 1, 64 * (u.d - 1))""")
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
