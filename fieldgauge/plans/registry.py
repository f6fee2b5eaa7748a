"""Registered queries: a name, a DataFrame builder and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldgauge import fixed_values as fv
from fieldgauge.config import VolumeTiers
from fieldgauge.functions import bands
from fieldgauge.plans import testbed as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# thresholds that suit the size of the driver's tables
TIERS = VolumeTiers(2000, 1000)


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a builder under ``name`` together with its oracle text."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = tb.sql(sql, *ctes)
        return fn
    return add


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


VALID = quoted(bands.STATE_NAMES)
US_CTE = f"us as (select * from companies where state in ({VALID}))"
SET_CTE = "placed as (select * from cleaned where state is not null)"
BAND_ORD = "case {c} " + " ".join(f"when '{b}' then {i}" for i, b in enumerate(fv.SIZE_BANDS, 1)) + " end"
SEGMENT = "case {c} " + " ".join(f"when '{b}' then '{s}'" for b, s in fv.SEGMENT_OF_BAND.items()) + " end"
TIER = "case when {c} >= 2000 then 'A' when {c} >= 1000 then 'B' else 'C' end"
