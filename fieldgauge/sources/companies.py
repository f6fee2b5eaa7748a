"""Reading and writing entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

COMPANY = T.StructType([T.StructField(c, T.LongType() if c == "founded" else T.StringType(), c != "handle") for c in (
    "handle", "name", "website", "industry", "size", "type", "founded", "city", "state", "country_code")])

CALL_LOG = ("timestamp string, phase string, model string, tokens bigint, cost double, prompt_version string, "
            "outcome string, metadata map<string,string>")

GROUND_TRUTH = ("handle string, name string, segment string, poc_condition string, "
                "ground_truth struct<website:string,type:string,industry:string,size:string>, notes string")


def ingest_csv(spark: SparkSession, path: str, country: str | None = "US", schema: T.StructType = COMPANY) -> DataFrame:
    """Explicit schema, so no inference pass; the country filter is applied while parsing."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df if country is None else df.where(F.col("country_code") == country)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALL_LOG).json(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Hand-labelled rows from one JSON array. ``present`` lists the fields each
    label really has, since an absent field and a null one score differently."""
    raw = (spark.read.option("multiLine", True)
           .schema(GROUND_TRUTH.replace("struct<website:string,type:string,industry:string,size:string>", "string")).json(path))
    truth = F.from_json("ground_truth", "struct<website:string,type:string,industry:string,size:string>")
    return raw.withColumn("present", F.json_object_keys("ground_truth")).withColumn("ground_truth", truth)
