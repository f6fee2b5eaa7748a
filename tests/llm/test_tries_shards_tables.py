"""Prefix trie, sharding and lookup-table clustering on small fixtures with the odd cases, against brute force."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from fieldgauge.llm import lookup_kmeans, prefix_trie, sharding
from fieldgauge.llm.common import numbered

# ---- op11 ------------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, seq string, depth int"


def turn_key(r):
    role, text = r[2] or "", r[3] or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute_rebuilt(rows):
    own = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    for v in own.values():
        v.sort(key=lambda r: (r[1] is not None, r[1] or 0, turn_key(r)[:16]))
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = [(r[2] or "", r[3] or "") for r in own.get(c - c % 5, [])[:h] + v[h:]]
    return out


def brute_trie(rows):
    convs = brute_rebuilt(rows)
    nodes = collections.defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(who) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = collections.Counter()
    for p, who in nodes.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        out[min(who), len(p), min(nodes[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def odd_turns(seed, convs, first_share=0.4):
    """Shared first turns, copies, families with holes, null parts, equal turn numbers, one long conversation."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in sorted({int(x) for x in rng.integers(-20, 4 * convs, convs)}):
        length = int(rng.integers(1, 12))
        for t in range(length):
            text = "same" if t < 2 and rng.random() < first_share else ["a", "b", "é𝒳", "", None][int(rng.integers(0, 5))]
            rows.append((c, None if rng.random() < 0.05 else int(t), ["user", "assistant", None, ""][int(rng.integers(0, 4))], text, "x", 1))
    for c in range(900, 905):
        rows += [(c, t, "user", "long" if t < 190 else f"t{t % 7}{c % 2}", "x", 1) for t in range(200)]
    rows += [(c, t, "user", "copy", "x", 1) for c in range(8000, 8400, 5) for t in range(3)]
    rows += [(None, 0, "user", "nobody", "x", 1), (7001, 0, "user", "only", None, None), (7001, 0, "user", "only", None, None), (7003, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_turns": 300, "least_turns": 40}, {"shard_turns": 20, "least_turns": 20}])
def test_trie_against_brute_force(spark, sizes):
    rows = odd_turns(3, 120)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), **sizes).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "x", 1)], TURNS)).count() == 0


def test_turns_cannot_run_into_each_other(spark):
    rows = [(5, 0, "user", "ab", "", 1), (10, 0, "usera", "b", "", 1), (15, 0, "", "userab", "", 1)]
    assert prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).where("depth = 1").count() == 3


@pytest.mark.parametrize("seed", range(4))
def test_find_close(seed):
    rng = np.random.default_rng(seed)
    signs, depth = [], 0
    while len(signs) < 3000 or depth:
        up = not depth or (len(signs) < 3000 and rng.random() < 0.55)
        signs.append(1 if up else -1)
        depth += signs[-1]
    stack, want = [], {}
    for i, s in enumerate(signs):
        if s > 0:
            stack.append(i)
        else:
            want[stack.pop()] = i
    opened = np.array(sorted(want))
    got = prefix_trie.find_close(np.cumsum(np.array(signs, np.int8), dtype=np.int32), opened)
    assert dict(zip(opened.tolist(), got.tolist())) == want


def test_range_minima():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, 77)
    tree = prefix_trie.MinTree(v)
    a = rng.integers(0, 77, 200)
    b = np.minimum(77, a + rng.integers(1, 77, 200))
    assert tree.least(a, b).tolist() == [v[x:y].min() for x, y in zip(a, b)]


# ---- op12 ------------------------------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, shard string, size int, at int"
ROWS = [(i, f"text {i % 7}", "clash", 1, 2) for i in range(400)] + [(None, None, None, None, None)] * 3 + [(5, "text 5", "clash", 1, 2)] * 50 + [(6, "é" * 9, "x", 0, 0), (-7, "", "x", 0, 0), (2 ** 63 - 1, "z" * 300000, "x", 0, 0)]


def brute_jump(key, shards):
    k = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)
    b, j = -1, 0
    while j < shards:
        b, k = j, (k * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 1000])
def test_jump_matches_the_published_loop(spark, shards):
    got = sharding.sharded(spark.createDataFrame(ROWS, DOCS), shards=shards)
    assert got.columns == ["doc_id", "text", "shard", "size", "at", "grown_shard"]
    want = collections.Counter((r[0], brute_jump(r[0], shards), brute_jump(r[0], shards + 1)) for r in ROWS)
    assert collections.Counter((r["doc_id"], r["shard"], r["grown_shard"]) for r in got.collect()) == want


def test_only_the_needed_rows_move(spark):
    rows = sharding.sharded(spark.range(20000).withColumnRenamed("id", "doc_id")).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {24} and 0.8 < len(moved) / (20000 / 25) < 1.2
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) < 1.25 * 20000 / 24


def test_slots_have_no_gaps(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    got = sharding.with_slots(sharding.sharded(df), ["doc_id", "text"]).collect()
    assert len(got) == len(ROWS)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    for v in slots.values():
        v.sort()
        assert [s for s, _ in v] == list(range(len(v)))
        ids = [i for _, i in v]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert sharding.with_slots(sharding.sharded(df.limit(0)), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.sharded(df, shards=0)


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    sharding.write_shards(spark.createDataFrame(ROWS, DOCS).drop("shard"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and back.where("doc_id = 5").select("shard").distinct().count() == 1


def test_numbering_splits_a_hot_group(spark):
    rows = spark.range(5000).selectExpr("cast(0 as int) as g", "cast(1 as int) as o", "id")
    got = [r["place"] for r in numbered(rows, ["g"], ["o"], "place", partitions=16).collect()]
    assert sorted(got) == list(range(5000))


# ---- op13 ------------------------------------------------------------------------------------------------------

VECS = "vec_id bigint, embedding array<float>, label int, cluster string, distance int"


def brute_kmeans(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [q for _, q in sorted(kept, key=lambda t: (name(t[0]), t[1]))[:k]]
    dist = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    near = lambda q: min(range(len(cents)), key=lambda c: (dist(q, cents[c]), c))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, q in kept:
            groups[near(q)].append(q)
        cents = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else cents[c] for c in range(len(cents))]
    most = 2 ** 63 - 1
    out = [(i, near(q), min(dist(q, cents[near(q)]), most)) for i, q in kept]
    of = collections.Counter()
    for _, c, d in out:
        of[c] += d
    return collections.Counter((i, c, d, min(of[c], most), min(sum(min(v, most) for v in of.values()), most),
                                hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out)


def vectors(seed, n, huge=False):
    rng = np.random.default_rng(seed)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(int(i), f(rng.normal(0, 0.3, 64))) for i in range(n)]
    rows += [(None, f(rng.normal(0, 1, 64)))] * 2 + [(3, rows[3][1] if n else f(np.ones(64)))] * 2
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] + [0.5] * 63),
             (906, [float("-inf")] + [0.5] * 63), (907, [0.0] * 64), (908, [-0.0] * 64), (909, f([-1 / 64] * 64))]
    if huge:
        rows += [(910, f([3e38] + [-3e38] * 63)), (911, f([1e7] * 64)), (912, f([1e30, -1e30] * 32))]
    return rows


@pytest.mark.parametrize("n,huge", [(0, False), (150, False), (60, True)])
def test_lookup_kmeans_against_brute_force(spark, n, huge):
    rows = vectors(2, n, huge)
    df = spark.createDataFrame([(i, e, 1, "x", 2) for i, e in rows], VECS)
    got = lookup_kmeans.with_inertia(*lookup_kmeans.cluster(df)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_kmeans(rows)


def test_lookup_kmeans_of_nothing(spark):
    out = lookup_kmeans.with_inertia(*lookup_kmeans.cluster(spark.createDataFrame([], VECS)))
    assert out.count() == 0 and set(out.columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}


def test_tables_in_small_blocks(spark, monkeypatch):
    rows = vectors(5, 100)
    want = brute_kmeans(rows)
    df = spark.createDataFrame([(i, e, 1, "x", 2) for i, e in rows], VECS)
    monkeypatch.setattr(lookup_kmeans, "BLOCK_BYTES", 8 * 64 * 16 * 7)
    got = lookup_kmeans.with_inertia(*lookup_kmeans.cluster(df)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert collections.Counter(tuple(r) for r in got.collect()) == want
