"""Centroid clustering by scalar lookup tables.

Components become integers, floor(scale * x). In every round each block of vectors tabulates, for each dimension, each
integer that occurs there and each centroid, the squared difference; the distance of a vector to a centroid is then the
sum of one table entry for each dimension. Sums of the vectors of a cluster are pre-aggregated in each task, so a round
moves some thousand numbers whatever the number of vectors. All arithmetic is exact: 64-bit integers where no square
can leave them, Python integers for larger components.

Defined results: a vector that is null, has another length than ``dims``, or holds a component that is null, not finite
or not finite after scaling is left out; no vectors give no rows; fewer vectors than ``k`` give that many centroids; a
null id is hashed as the empty text; rows that repeat an id and a vector are vectors of their own; a distance or a sum
of distances beyond 2**63 - 1 is given as that number; columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import query, table
from fieldgauge.sources.workspace import materialise

BLOCK_BYTES = 32 << 20  # a table holds at most this many bytes: one row for each component of a block
SAFE = 1 << 27          # components up to this size keep all sums of squares of 64 dimensions within 64 bits
LONG_MAX = (1 << 63) - 1
LIMB = 32

_SUMS = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("part", pa.int64())])
_SUMS_DDL = "cluster int, dim int, limb int, part bigint"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = 64,
              scale: float = 64.0) -> DataFrame:
    """(vec_id, q): the vectors that are kept, their components as whole numbers in doubles, where every value of
    2**53 or more is whole already."""
    e = F.col(embedding)
    scaled = F.transform(e, lambda x: x.cast("double") * F.lit(float(scale)))
    whole = F.transform("_x", lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x))
    return (vectors.where(e.isNotNull() & (F.size(e) == dims)).select(F.col(vec_id).alias("vec_id"), scaled.alias("_x"))
            .where(F.forall("_x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
            .select("vec_id", whole.alias("q")))


def _exact(values: np.ndarray) -> np.ndarray:
    """Whole doubles as Python integers."""
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors, centroids) of a block, by table. ``centroids`` holds Python integers."""
    n, dims = q.shape
    small = max(np.abs(q).max(), max(abs(c) for c in centroids.ravel())) <= SAFE and dims <= 64
    values, codes, dim_of, held = [], np.empty((n, dims), np.int64), [], 0
    for d in range(dims):
        occurring, at = np.unique(q[:, d], return_inverse=True)
        codes[:, d] = at + held
        held += len(occurring)
        values.append(occurring)
        dim_of.append(np.full(len(occurring), d))
    values, dim_of = np.concatenate(values), np.concatenate(dim_of)
    if small:
        tables = (values.astype(np.int64)[:, None] - centroids.T.astype(np.int64)[dim_of]) ** 2
    else:
        tables = (_exact(values)[:, None] - centroids.T[dim_of]) ** 2
    out = tables[codes[:, 0]]
    for d in range(1, dims):
        out = out + tables[codes[:, d]]
    return out


def _blocks(batches, dims: int, k: int):
    """(ids, matrix) of bounded blocks."""
    size = max(1, BLOCK_BYTES // (8 * dims * k))
    for b in batches:
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for a in range(0, b.num_rows, size):
            yield b.column(0).slice(a, size), flat[a:a + size]


def _sums(centroids: np.ndarray):
    """Sums and counts (dimension -1) of each cluster over a task, in limbs so that Spark's sums stay exact."""
    k, dims = centroids.shape

    def run(batches):
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for _, q in _blocks(batches, dims, k):
            near = distances(q, centroids).argmin(1)
            order = np.argsort(near, kind="stable")
            there, first = np.unique(near[order], return_index=True)
            held = q[order].astype(np.int64) if np.abs(q).max() <= SAFE else _exact(q[order])
            total[there] += np.add.reduceat(held, first, axis=0).astype(object)
            count[there] += np.diff([*first, len(near)])
        rows = [(c, -1, 0, int(count[c])) for c in range(k) if count[c]]
        for c in np.flatnonzero(count).tolist():
            for d in range(dims):
                v, limb = int(total[c, d]), 0
                sign, v = (-1, -v) if v < 0 else (1, v)
                while v:
                    rows.append((c, d, limb, sign * (v & ((1 << LIMB) - 1))))
                    v, limb = v >> LIMB, limb + 1
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _SUMS)], schema=_SUMS)
    return run


def _assigned(centroids: np.ndarray, id_type: pa.DataType):
    k, dims = centroids.shape
    schema = pa.schema([("vec_id", id_type), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for ids, q in _blocks(batches, dims, k):
            d = distances(q, centroids)
            near = d.argmin(1)
            best = d[np.arange(len(near)), near]
            if best.dtype == object:
                best = np.array([min(v, LONG_MAX) for v in best], np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(best)], schema=schema)
    return run


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 16, rounds: int = 3,
            dims: int = 64, scale: float = 64.0, seed: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector kept, the final centroids). The first centroids are the ``k`` vectors
    with the smallest SHA-256 of ``seed:id``; equal hashes go by the vector. The driver holds k * dims numbers."""
    kept = materialise(quantised(vectors, vec_id, embedding, dims, scale))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(name.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    id_ddl = kept.schema["vec_id"].dataType.simpleString()
    if not first:
        return kept.sparkSession.createDataFrame([], f"vec_id {id_ddl}, cluster int, distance bigint"), []
    centroids = _exact(np.array([r["q"] for r in first]))
    for _ in range(rounds):
        sums = (kept.mapInArrow(_sums(centroids), _SUMS_DDL).groupBy("cluster", "dim", "limb").agg(F.sum("part").alias("part")))
        count, total = {}, {}
        for c, d, limb, part in sums.collect():  # at most k * (dims + 1) * limbs rows
            if d < 0:
                count[c] = part
            else:
                total[c, d] = total.get((c, d), 0) + (part << (LIMB * limb))
        for c, n in count.items():
            centroids[c] = [total.get((c, d), 0) // n for d in range(dims)]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_ddl]
    out = kept.mapInArrow(_assigned(centroids, id_type), f"vec_id {id_ddl}, cluster int, distance bigint")
    return materialise(out), centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and the digest of the cluster's centroid; the side that is broadcast
    has one row for each centroid."""
    big = F.sum(F.col("distance").cast("decimal(20,0)"))
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(big).collect()}
    whole = min(sum(sums.values()), LONG_MAX)
    rows = [(c, min(s, LONG_MAX), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
            for c, s in sorted(sums.items())]
    side = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(side), "cluster")


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds as common table expressions: distances over all dimensions, nearest, floors of the means."""
    parts = [f"""with k as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
     where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by h) - 1 as c, q from (select sha256('1:' || vec_id) as h, q from k order by h limit {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""d{r} as (select vec_id, k.q, c, list_sum(list_transform(list_zip(k.q, m.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as dist
       from k cross join c{r} m),
a{r} as (select vec_id, q, c, dist from d{r} qualify row_number() over (partition by vec_id order by dist, c) = 1)""")
        if r < rounds:
            parts.append(f"""u{r} as (select c, i, sum(v)::hugeint as s, count(*) as n
       from (select c, unnest(q) as v, unnest(range(64)) as i from a{r}) group by c, i),
c{r + 1} as (select o.c, coalesce(w.q, o.q) as q from c{r} o left join
       (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as q from u{r} group by c) w on o.c = w.c)""")
    return ",\n".join(parts) + f"""
select a.vec_id, a.c::int as cluster, a.dist as distance, (sum(dist) over (partition by a.c))::bigint as cluster_inertia,
       (sum(dist) over ())::bigint as inertia, sha256(array_to_string(m.q, ',')) as centroid_sha256
from a{rounds} a join c{rounds} m on a.c = m.c"""


@query("op13_lookup_kmeans", _sql())
def op13_lookup_kmeans(spark, sf_dir):
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))
