"""A keyed set stored as a log: batches are appended, reads merge, compaction keeps both cheap."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgauge.sources.workspace import new_path


def fold(batches: DataFrame, key: str, order: str | None, version: str = "_v") -> DataFrame:
    """One row per key: the greatest by order, then version; a row without an order is the least. Rows without a key
    stay as they are."""
    rank = F.struct(F.col(order), F.col(version)) if order else F.col(version)
    cols = [c for c in batches.columns if c != version]
    known = batches.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*cols), rank).alias("_r"))
    return known.select("_r.*").unionByName(batches.where(F.col(key).isNull()).select(*cols))


def overlay(base: DataFrame, newest: DataFrame, key: str, order: str | None) -> DataFrame:
    """``base`` with the rows of ``newest``, at most one per key, put over it. With an ``order`` a stored row of a greater
    one stays. The base is never shuffled where the new rows are few enough for Spark to broadcast."""
    if order is None or order not in base.columns:
        return base.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)
    new = newest.select(F.col(key).alias("_k"), F.col(order).alias("_o"))
    met = base.join(new, F.col(key) == F.col("_k"), "left")
    beaten = F.col(order).isNull() | F.coalesce(F.col("_o") >= F.col(order), F.lit(False))
    stays = met.where(F.col("_k").isNull() | ~beaten).select(*base.columns)
    losers = met.where(F.col("_k").isNotNull() & ~beaten).select(F.col("_k").alias("_lost"))
    wins = newest.join(losers, F.col(key) == F.col("_lost"), "left_anti")
    return stays.unionByName(wins, allowMissingColumns=True)


class LogStore:
    """Keyed rows under one folder as a base and runs of batches after it.

    ``apply`` writes its batch and nothing else, sorted by key in key ranges, so what a batch costs does not depend on the
    size of the store or on which keys it touches. ``read`` folds the runs by key and puts them over the base. After
    ``fan`` runs of one width they are merged into one, so the runs to read grow with the logarithm of the batches;
    once they hold ``share`` of the base's bytes a new base is written, 1 / share bytes for each byte applied.
    Replaced runs stay until ``expire``. A run counts once its _SUCCESS marker is there; no path that may be
    read is overwritten but by a repeat of its own version, and versions a base holds already are not read again.

    A batch has at most one row per key. Rows without a key replace nothing and are never replaced.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, key: str = "handle", fan: int = 8, share: float = 0.25):
        self.spark, self.key, self.fan, self.share = spark, key, fan, share
        self.root = root or new_path(spark, "log-store")

    # a run is (first version, last version, base or not, order column or None)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _path(self, run: tuple) -> str:
        first, last, base, order = run
        return f"{self.root}/{'b' if base else 'd'}{first:012d}-{last:012d}/_by={order or ''}"

    def _bytes(self, run: tuple) -> int:
        p, fs = self._fs(self._path(run))
        return fs.getContentSummary(p).getLength()

    def _runs(self) -> list[tuple]:
        """All complete runs."""
        out = []
        for name in self._list(self.root):
            if name[:1] in ("b", "d"):
                first, last = map(int, name[1:].split("-"))
                out += [(first, last, name[0] == "b", by[4:] or None) for by in self._list(f"{self.root}/{name}")
                        if by.startswith("_by=") and "_SUCCESS" in self._list(f"{self.root}/{name}/{by}")]
        return out

    def _live(self, below: int | None = None) -> list[tuple]:
        """The newest base, then the widest runs behind it, in order of version."""
        runs = [r for r in self._runs() if below is None or r[1] < below]
        out = [max((r for r in runs if r[2]), key=lambda r: r[1])] if any(r[2] for r in runs) else []
        upto = out[0][1] if out else -1
        for r in sorted((r for r in runs if not r[2]), key=lambda r: (r[0], -r[1])):
            if r[0] > upto:
                out.append(r)
                upto = r[1]
        return out

    def versions(self) -> list[int]:
        return sorted({r[1] for r in self._runs()})

    def _scan(self, run: tuple, keys: list | None) -> DataFrame:
        rows = self.spark.read.parquet(self._path(run))
        return rows if keys is None else rows.where(F.col(self.key).isin(keys))

    def _merged(self, runs: list[tuple], keys: list | None = None) -> DataFrame | None:
        """Runs over one another, neighbours of one order folded together first."""
        state = None
        if runs and runs[0][2]:
            state, runs = self._scan(runs[0], keys), runs[1:]
        for order, some in groupby(runs, key=lambda r: r[3]):
            parts = [self._scan(r, keys).withColumn("_v", F.lit(r[1])) for r in some]
            newest = fold(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), self.key, order)
            state = newest if state is None else overlay(state, newest, self.key, order)
        return state

    def read(self, below: int | None = None, keys: list | None = None) -> DataFrame | None:
        """The state, or that before version ``below``; None without any. With ``keys`` only their rows, for which most
        files are passed over by their key range."""
        return self._merged(self._live(below), keys)

    def _write(self, rows: DataFrame, run: tuple) -> None:
        rows.repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(self._path(run))

    def apply(self, batch: DataFrame, version: int | None = None, force: bool = False, order: str | None = None) -> None:
        """Append ``batch`` as ``version``. With an ``order`` column, which the store keeps, its rows replace only rows whose
        order is not greater. ``force`` replaces the whole store. A repeated version is written again with the same
        content; one a base holds already is left out."""
        have = self.versions()
        version = (have[-1] + 1 if have else 0) if version is None else version
        first = force or not any(r[1] < version for r in self._runs())
        self._write(batch, (version, version, first, order))
        self.compact()

    def compact(self, now: bool = False) -> None:
        """Merge trailing runs of equal width, then write a new base if the runs have grown to their share of it."""
        while True:
            tail = [r for r in self._live() if not r[2]][-self.fan:]
            if len(tail) < self.fan or len({(r[1] - r[0], r[3]) for r in tail}) > 1:
                break
            self._write(self._merged(tail), (tail[0][0], tail[-1][1], False, tail[0][3]))
        live = self._live()
        if len(live) > 1 and live[0][2]:
            if now or sum(self._bytes(r) for r in live[1:]) >= self.share * max(self._bytes(live[0]), 1 << 20):
                self._write(self._merged(live), (live[0][0], live[-1][1], True, live[-1][3]))

    def expire(self) -> list[tuple]:
        """Remove the runs that no read of the present state needs, and name them."""
        live = set(self._live())
        gone = [r for r in self._runs() if r not in live]
        for r in gone:
            p, fs = self._fs(self._path(r))
            fs.delete(p.getParent(), True)
        return gone
