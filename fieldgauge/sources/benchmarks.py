"""Loaders for government business counts and label maps.

Employer files: all text, possibly a byte-order mark and line breaks in the
header, thousands commas in the firm count. Non-employer files: two-digit rows
for plain sectors, three-digit rows that add up to range sectors, totals where
the legal form is ``-``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldgauge import fixed_values as fv
from fieldgauge.functions.text import lookup

STATE_OF_FIPS = {fips: name for _, fips, name in fv.STATES if fips}
ALL_SIZES = "01: Total"
NATION = "00"


def _text_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("inferSchema", False).csv(path)
    names = [" ".join(c.replace("﻿", "").split()) for c in raw.columns]
    return raw.toDF(*names)


def _firms() -> Column:
    return F.regexp_replace("Firms", ",", "").try_cast("bigint")


def employer_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _text_csv(spark, path, multi_line).where(F.col("Enterprise Size") == ALL_SIZES)


def employer_states(rows: DataFrame) -> DataFrame:
    """All-sector firms per state; FIPS codes are padded, unknown ones dropped."""
    state = lookup(STATE_OF_FIPS, F.lpad("State", 2, "0"))
    return (rows.where((F.col("NAICS") == "--") & (F.col("State") != NATION))
            .select(state.alias("state"), _firms().alias("employers")).where("state is not null"))


def employer_sectors(rows: DataFrame) -> DataFrame:
    return (rows.where((F.col("State") == NATION) & F.col("NAICS").isin(*fv.SECTORS))
            .select(F.col("NAICS").alias("sector"), _firms().alias("employers")))


def employer_cells(rows: DataFrame) -> DataFrame:
    codes = [c for c in fv.SECTORS if c != "99"]
    return (rows.where((F.col("State") != NATION) & F.col("NAICS").isin(*codes))
            .select(F.col("State Name").alias("state"), F.col("NAICS").alias("sector"), _firms().alias("employers")))


def nonemployer_rows(spark: SparkSession, path: str) -> DataFrame:
    """Total rows with their sector: a plain sector's own two-digit row, or the
    three-digit rows below a range sector. Non-numeric counts are 0."""
    plain = {c: c for c in fv.SECTORS if "-" not in c and c not in fv.NO_NONEMPLOYER_SECTORS}
    ranges = {str(n): c for c in fv.SECTORS if "-" in c for n in range(int(c[:2]), int(c[3:]) + 1)}
    code = F.col("NAICS")
    sector = F.when(F.length(code) == 3, lookup(ranges, F.substring(code, 1, 2))).otherwise(lookup(plain, code))
    return (_text_csv(spark, path).where(F.col("LFO") == "-")
            .select("ST", sector.alias("sector"), F.coalesce(F.col("ESTAB").try_cast("double"), F.lit(0.0)).alias("_n"))
            .where("sector is not null"))


def nonemployer_sectors(rows: DataFrame) -> DataFrame:
    """Every sector once, 0 where there is no non-employer count."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(c,) for c in fv.SECTORS], "sector string")
    sums = rows.groupBy("sector").agg(F.sum("_n").cast("bigint").alias("_n"))
    return every.join(sums, "sector", "left").select("sector", F.coalesce("_n", F.lit(0)).alias("nonemployers"))


def nonemployer_cells(rows: DataFrame) -> DataFrame:
    """Dense grid of 51 states x all sectors, zero filled; the grid is two literal lists."""
    spark = rows.sparkSession
    grid = (spark.createDataFrame([(f, s) for f, s in STATE_OF_FIPS.items()], "ST string, state string")
            .withColumn("sector", F.explode(F.array(*[F.lit(c) for c in fv.SECTORS]))))
    sums = rows.groupBy("ST", "sector").agg(F.sum("_n").cast("bigint").alias("_n"))
    return (grid.join(sums, ["ST", "sector"], "left")
            .select("state", "sector", F.coalesce("_n", F.lit(0)).alias("nonemployers")))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, sector) rows from one JSON object of label -> sector."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "sector"))
