from pyspark.sql import functions as F

from fieldgauge.operators import sketches as sk
from fieldgauge.sources.workspace import new_path


def test_stored_sketches_add_up(spark):
    keys = {"id": ([F.col("a")], ["a"]), "pair": ([F.col("a"), F.col("b")], ["a", "b"])}
    df = spark.range(60_000).selectExpr("cast(id % 20000 as string) as a", "if(id % 10 = 0, null, cast(id % 3 as string)) as b")
    path = new_path(spark, "sketches")
    for batch in (0, 1, 2, 1):                       # a batch that comes twice counts once
        sk.store_batch(df.where(f"pmod(hash(a, b), 3) = {batch}"), keys, path, batch)
    got = {r["candidate_key"]: r for r in sk.key_estimates(spark, path).collect()}
    for key, cols in (("id", ["a"]), ("pair", ["a", "b"])):
        exact = df.select(*cols).distinct().count()
        r = got[key]
        assert r["total_records"] == 60_000 and r["distinct_low"] <= exact <= r["distinct_high"]
        assert abs(r["distinct_estimate"] - exact) <= sk.ERROR * exact
    assert got["id"]["nulls_in_key"] == 0 and got["pair"]["nulls_in_key"] == 6_000
    part = sk.key_estimates(spark, path, [0]).where("candidate_key = 'id'").first()
    assert part["total_records"] == df.where("pmod(hash(a, b), 3) = 0").count()


def test_nulls_keep_their_place_in_a_key(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), ("x", "x"), (None, None), (None, None)], "a string, b string")
    r = sk.sketched(df, {"k": ([F.col("a"), F.col("b")], ["a", "b"])}).select(F.hll_sketch_estimate("sketch"), "nulls").first()
    assert tuple(r) == (4, 4)
