"""A stored entity set that takes keyed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgauge.sources.workspace import new_path


def upsert(existing: DataFrame, batch: DataFrame, key: str = "handle", order: str | None = None) -> DataFrame:
    """Rows of ``batch`` replace stored rows with the same key; the rest stay. With an ``order`` column, which the store
    keeps, a row replaces a stored one only if its order is not smaller; a stored row without one is oldest."""
    if order is not None:
        if order not in existing.columns:
            existing = existing.withColumn(order, F.lit(None).cast(batch.schema[order].dataType))
        old = existing.select(F.col(key).alias("_k"), F.col(order).alias("_o"))
        batch = (batch.join(old, F.col(key) == F.col("_k"), "left")
                 .where(F.col("_o").isNull() | (F.col(order) >= F.col("_o"))).drop("_k", "_o"))
    return existing.join(batch.select(key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


class VersionedStore:
    """Keyed rows under one folder, dealt into ``buckets`` by hash of the key. A version holds, whole, the buckets that
    its batch touches; the newest version of each bucket is the state. A version is written to its own path and counts
    once its _SUCCESS marker is there, so the path being read is never overwritten, and a lost executor or repeated
    batch leaves one result. The number of buckets belongs to the folder and must not change."""

    BUCKET = "_bucket"

    def __init__(self, spark: SparkSession, root: str | None = None, key: str = "handle", buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.root = root or new_path(spark, "store")

    def _path(self, version: int, whole: bool) -> str:
        return f"{self.root}/{'w' if whole else 'v'}{version:012d}"

    def _list(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _versions(self) -> list[tuple[int, bool, list[int]]]:
        """(version, replaces all before, buckets) of each complete version, oldest first."""
        out = []
        for name in self._list(self.root):
            inside = self._list(f"{self.root}/{name}")
            if name[:1] in ("v", "w") and "_SUCCESS" in inside:
                out.append((int(name[1:]), name[0] == "w", sorted(int(n.split("=")[1]) for n in inside if n.startswith(self.BUCKET))))
        return sorted(out)

    def versions(self) -> list[int]:
        return [v for v, _, _ in self._versions()]

    def read(self, below: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of all buckets, or of some, before version ``below``; None without any."""
        newest: dict[int, str] = {}
        for version, whole, held in self._versions():
            if below is None or version < below:
                if whole:
                    newest.clear()
                newest.update({b: f"{self._path(version, whole)}/{self.BUCKET}={b}" for b in held})
        paths = [p for b, p in newest.items() if buckets is None or b in buckets]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def apply(self, batch: DataFrame, version: int | None = None, force: bool = False, order: str | None = None) -> None:
        """Write version ``version``: the touched buckets as they were before it, with the batch. ``force`` replaces
        the whole store. Repeating a version recomputes the same content."""
        last = self.versions()[-1:]
        version = (last[0] + 1 if last else 0) if version is None else version
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        base = None
        if not force:
            touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
            base = self.read(below=version, buckets=touched)
        out = batch if base is None else upsert(base, batch, self.key, order)
        out.withColumn(self.BUCKET, bucket).write.mode("overwrite").partitionBy(self.BUCKET).parquet(self._path(version, force))
