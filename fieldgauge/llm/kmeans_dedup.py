"""Embedding near-duplicates within cells of spherical k-means.

Vectors are compared in double precision when their labels are equal and not null. Equal vectors of a label are one
class. A label starts as one cell; a cell of more than two times CELL_ROWS classes is split by spherical k-means, level
after level, so cells grow in number with the rows. Centroids of a cell are fitted on a sample of some SAMPLE_ROWS of its
classes (those whose hash falls below a share) and every class is assigned. A split that would save less than a third of
the products, by the sample, is not made.

A class lives in the cell of its nearest centroid and is a guest in others. If x lives in cell i and y in cell j, x lies
on c_i's side of the great circle between c_i and c_j; so y within the link angle t of x is at most t beyond that
circle: y . (c_j - c_i) <= sin(t) |c_j - c_i|. Of the two, one visits the other, which one by the numbers of the cells,
and counts for both; guests of a split cell go on to its parts by the same test. So no link is lost. Within a cell, home
blocks of bounded size meet the stream of all that visit the cell in blocked products; counts and joining links leave,
never all pairs.

Defined results: vectors that are null, empty or zero or hold null or non-finite components, and rows with a null label,
link with nothing; vectors of unlike length don't compare; a null vec_id counts as larger than any number; repeated rows
are other vectors and link; no rows give no rows; other columns are never looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldgauge.llm.common import Forest, components, query, table
from fieldgauge.operators.scale import broadcast_if_small
from fieldgauge.sources.workspace import materialise

COSINE = 0.93
SAMPLE_ROWS = 8192
MAX_CELLS = 256  # parts of one split; also the base of cell numbers
LEVELS = 6
CELL_ROWS = 2048
SLICE_ROWS = 65536
BLOCK = 1024
WORTH = 2 / 3
AT = ["label", "width", "cell"]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit rows."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], c)
    return c


def _vectors(batch, name: str = "v") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    x = np.array(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _guests(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each unit row, and the cells it is close enough to for a link into them."""
    dots = x @ c.T
    home = dots.argmax(1)
    apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2)
    reach = math.sqrt(1 - cosine * cosine) if cosine > 0 else math.inf
    beyond = dots[np.arange(len(x)), home][:, None] - dots
    return home, (beyond <= reach * apart[home] + 1e-9) | (cosine <= 0)


def _visits(near: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Of two cells, the one whose rows visit: the larger number if both are even or both odd, else the smaller."""
    cell = np.arange(near.shape[1])[None, :]
    own = home[:, None]
    return near & ((cell == own) | ((cell < own) ^ ((cell + own) % 2 == 1)))


def _fit(cosine: float, cell_rows: int):
    """The centroids of a cell from a sample of its residents, or nothing if they would save too little."""
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("key").combine_chunks()
        x = _vectors(part.to_batches()[0])
        k = min(MAX_CELLS, math.ceil(part.column("homes")[0].as_py() / cell_rows), len(x))
        c = spherical_kmeans(x, k)
        residents, visitors = np.zeros(k), np.zeros(k)
        for s in range(0, len(x), BLOCK):
            home, near = _guests(x[s:s + BLOCK], c, cosine)
            residents += np.bincount(home, minlength=k)
            visitors += _visits(near, home).sum(0)
        worth = residents @ visitors < WORTH * len(x) ** 2
        flat = pa.array([c.ravel().tolist()], pa.list_(pa.float64()))
        return pa.Table.from_arrays([*[part.column(n).slice(0, 1) for n in AT], flat], names=[*AT, "v"]).slice(0, int(worth))
    return run


def _place(cosine: float):
    """Rows sorted by (label, width, cell, slice, kind): the centroids of a cell come first, then its rows."""
    def run(batches):
        at, c = None, None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in (*AT, "slice")]
            kind = batch.column(batch.schema.get_field_index("kind")).to_numpy()
            living = batch.column(batch.schema.get_field_index("home")).to_numpy(zero_copy_only=False).astype(bool)
            change = kind == 0
            change[1:] |= kind[:-1] == 0
            cuts = sorted({0, *np.flatnonzero(change).tolist(), batch.num_rows})
            for i, j in zip(cuts, cuts[1:]):
                part = batch.slice(i, j - i)
                if kind[i] == 0:
                    at = tuple(col[i] for col in cols)
                    c = np.array(part.column(part.schema.get_field_index("v"))[0].as_py()).reshape(-1, int(at[1]))
                    continue
                home, near = _guests(_vectors(part), c, cosine)
                own = living[i:j]
                near[own] = _visits(near[own], home[own])
                row, cell = np.nonzero(near)
                take = part.select(["label", "width", "key", "n", "v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*take.columns, pa.array(at[2] * MAX_CELLS + cell), pa.array(own[row] & (home[row] == cell)), pa.array(np.ones(len(row), bool))],
                    names=[*take.schema.names, "cell", "home", "fresh"])
    return run


def _cells(classes: DataFrame, cosine: float, cell_rows: int) -> DataFrame:
    """(label, width, key, n, v, cell, home) rows: one at home, one in each cell visited."""
    columns = ["label", "width", "key", "n", "v", "cell", "home", "fresh"]
    placed = classes.select("label", "width", "key", "n", "v", F.lit(1).cast("bigint").alias("cell"), F.lit(True).alias("home"), F.lit(True).alias("fresh"))
    for _ in range(LEVELS):
        full = materialise(placed.where("fresh").groupBy(*AT).agg(F.count_if("home").alias("homes"), F.count("*").alias("rows"))
                           .where(F.col("homes") > 2 * cell_rows))
        if full.isEmpty():
            break
        sample = (placed.where("fresh and home").join(broadcast_if_small(full), AT).where(F.pmod("key", "homes") < SAMPLE_ROWS)
                  .select(*AT, "key", "homes", "v"))
        models = materialise(sample.groupBy(*AT).applyInArrow(_fit(cosine, cell_rows), "label bigint, width int, cell bigint, v array<double>"))
        if models.isEmpty():
            break
        slices = models.select(*AT).join(full, AT).select(*AT, F.ceil(F.col("rows") / SLICE_ROWS).alias("slices"))
        tagged = placed.join(broadcast_if_small(slices), AT, "left")
        moving = tagged.where("slices is not null").select(*columns, F.pmod("key", "slices").alias("slice"), F.lit(1).alias("kind"))
        zero = F.lit(0).cast("bigint")
        heads = (models.join(slices, AT).withColumn("slice", F.explode(F.sequence(zero, F.col("slices") - 1)))
                 .select("label", "width", zero.alias("key"), zero.alias("n"), "v", "cell", F.lit(False).alias("home"), F.lit(True).alias("fresh"), "slice", F.lit(0).alias("kind")))
        by = [*AT, "slice"]
        parts = (heads.unionByName(moving).repartition(*by).sortWithinPartitions(*by, "kind")
                 .mapInArrow(_place(cosine), "label bigint, width int, key bigint, n bigint, v array<double>, cell bigint, home boolean, fresh boolean"))
        placed = materialise(parts.unionByName(tagged.where("slices is null").select(*columns).withColumn("fresh", F.lit(False))))
    return placed.drop("fresh")


def _compare(cosine: float):
    """Rows sorted by (label, width, cell, block, visiting): home rows of a block come first (0), then all that visit it,
    from the same cell (1) or from others (2); links of the latter count here for both sides, as they meet once."""
    def run(batches):
        at, homes, keys, counts, sizes = None, None, None, None, None
        forest: Forest | None = None
        pending: list = []

        def settle():
            if at is None:
                return
            k, n = np.concatenate(keys), np.concatenate(counts)
            roots = forest.roots() if forest is not None else np.arange(len(k))
            off = np.flatnonzero(roots != np.arange(len(k)))
            nothing = np.full(len(k), -1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(nothing, mask=nothing < 0), pa.array(n)], names=["a", "b", "n"])
            if len(off):
                yield pa.RecordBatch.from_arrays([pa.array(k[off]), pa.array(k[roots[off]]), pa.array(np.zeros(len(off), np.int64))], names=["a", "b", "n"])

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("label", "width", "cell", "block")]
            visiting = batch.column(batch.schema.get_field_index("visiting")).to_numpy()
            key = batch.column(batch.schema.get_field_index("key")).to_numpy()
            size = batch.column(batch.schema.get_field_index("n")).to_numpy()
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                now = tuple(c[i] for c in cols)
                if now != at:
                    yield from settle()
                    at, homes, keys, counts, sizes, forest = now, [], [], [], [], None
                x, vis, k, n = _vectors(batch.slice(i, j - i)), visiting[i:j] > 0, key[i:j], size[i:j]
                own, foreign = ~vis, visiting[i:j][vis] == 2
                if own.any():
                    homes.append(x[own]); keys.append(k[own]); counts.append(np.zeros(own.sum(), np.int64)); sizes.append(n[own])
                if vis.any():
                    if forest is None:
                        homes, keys, counts, sizes = [np.concatenate(homes)], [np.concatenate(keys)], [np.concatenate(counts)], [np.concatenate(sizes)]
                        forest = Forest(len(keys[0]))
                    h, hk = homes[0], keys[0]
                    for s in range(0, int(vis.sum()), BLOCK):
                        y, yk, yn = x[vis][s:s + BLOCK], k[vis][s:s + BLOCK], n[vis][s:s + BLOCK]
                        near = (y @ h.T) >= cosine
                        near &= yk[:, None] != hk[None, :]
                        counts[0] += near.T @ yn
                        r, c = np.nonzero(near)
                        if len(r):
                            first = np.r_[True, r[1:] != r[:-1]]
                            lead = c[first][np.cumsum(first) - 1]
                            forest.unite(lead, c)  # two homes that one visitor links are in one component
                            theirs = np.where(foreign[s:s + BLOCK], near @ sizes[0], 0)
                            yield pa.RecordBatch.from_arrays([pa.array(yk[r[first]]), pa.array(hk[c[first]]), pa.array(theirs[r[first]])], names=["a", "b", "n"])
        yield from settle()
    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v"))
    usable = (F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
              & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    # scaled by the largest component, so squares neither overflow nor vanish
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x / top)))
    rows = rows.withColumn("hash", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("label", "v")), 256)))
    classes = (rows.where("ok").groupBy("hash").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
               .withColumn("width", F.size("v")).withColumn("key", F.xxhash64("hash")))
    classes = materialise(classes)
    placed = _cells(classes, cosine, cell_rows)
    cells = (placed.groupBy("label", "width", "cell").agg(F.count_if("home").alias("homes"))
             .select(*AT, F.greatest(F.lit(1), F.ceil(F.col("homes") / cell_rows)).alias("blocks")))
    placed = placed.join(broadcast_if_small(cells), AT)
    own = placed.where("home").withColumn("block", F.pmod("key", "blocks")).withColumn("visiting", F.lit(0))
    guests = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumn("visiting", F.when(F.col("home"), 1).otherwise(2))
    order = ["label", "width", "cell", "block"]
    met = materialise(own.unionByName(guests).drop("blocks", "home").repartition(*order).sortWithinPartitions(*order, "visiting")
                      .mapInArrow(_compare(cosine), "a bigint, b bigint, n bigint"))
    degree = met.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_links"))
    comps = components(met.where("b is not null").select("a", "b"))
    named = classes.select("hash", "key", "least", "n").join(comps, F.col("key") == F.col("node"), "left").withColumn("c", F.coalesce("component", "key"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(least, "c").join(degree, F.col("key") == F.col("_a")).select(
        F.col("hash").alias("_h"), "n", "component_id", (F.col("n") - 1 + F.col("_links")).alias("n_links"))
    named = materialise(named)
    # a class that many rows share reaches them by broadcast; there are at most 1,000 such
    often = named.orderBy(F.desc("n"), "_h").limit(1000)
    hot = F.broadcast(often.select(F.col("_h").alias("_hh"), F.struct("component_id", "n_links").alias("_hot")))
    cold = named.join(F.broadcast(often.select("_h")), "_h", "left_anti").select(F.col("_h").alias("_ch"), F.struct("component_id", "n_links").alias("_cold"))
    out = rows.select("vec_id", "hash").join(hot, F.col("hash") == F.col("_hh"), "left")
    spread = F.concat(F.lit("-"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    out = (out.withColumn("_k", F.when(F.col("_hot").isNull() & F.col("hash").isNotNull(), F.col("hash")).otherwise(spread))
           .join(cold, F.col("_k") == F.col("_ch"), "left").withColumn("_g", F.coalesce("_hot", "_cold")))
    comp = F.when(F.col("_g").isNull(), F.col("vec_id")).otherwise(F.col("_g.component_id"))
    return out.select("vec_id", F.coalesce("_g.n_links", F.lit(0).cast("bigint")).alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))


@query("op8_kmeans_near_dedup", """
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.v, b.v) >= 0.93),
r as (select vec_id, vec_id as reach from embeddings union select r.vec_id, l.b from r join l on r.reach = l.a)
select v.vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, min(r.reach) as component_id, v.vec_id = min(r.reach) as kept
from embeddings v join r on r.vec_id = v.vec_id group by v.vec_id""")
def op8_kmeans_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
