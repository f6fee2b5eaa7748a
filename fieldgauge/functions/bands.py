"""Ordinals, tiers, segments and ratios as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from fieldgauge.functions.space import strip
from fieldgauge import fixed_values as fv
from fieldgauge.config import GapTiers, VolumeTiers
from fieldgauge.functions.text import col, lookup

STATE_NAMES = tuple(name for _, _, name in fv.STATES)
UPPER_BANDS = fv.SIZE_BANDS[1:]
ENTERPRISE = tuple(b for b, s in fv.SEGMENT_OF_BAND.items() if s == "enterprise")
MID_MARKET = tuple(b for b, s in fv.SEGMENT_OF_BAND.items() if s == "mid_market")


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d as double; NULL when d is 0."""
    return col(n).cast("double") / F.nullif(col(d).cast("double"), F.lit(0.0))


def pct(n: Column | str, d: Column | str) -> Column:
    """100 n / d, unrounded; NULL when d is 0."""
    return col(n) * F.lit(100.0) / F.nullif(col(d).cast("double"), F.lit(0.0))


def valid_state(c: Column | str = "state", names: Sequence[str] = STATE_NAMES) -> Column:
    return col(c).isin(*names)


def size_ordinal(c: Column | str = "size") -> Column:
    """1-based position of a size band, NULL when it is not a band."""
    return lookup({b: i for i, b in enumerate(fv.SIZE_BANDS, 1)}, col(c))


def segment(c: Column | str = "size") -> Column:
    return lookup(fv.SEGMENT_OF_BAND, col(c))


def volume_tier(n: Column | str, tiers: VolumeTiers = VolumeTiers()) -> Column:
    n = col(n)
    return F.when(n >= tiers.a_min, "A").when(n >= tiers.b_min, "B").otherwise("C")


def gap_tier(r: Column | str, tiers: GapTiers = GapTiers()) -> Column:
    r = col(r)
    return (F.when(r < tiers.high, "HIGH_GAP").when(r < tiers.moderate, "MODERATE_GAP")
            .otherwise("ADEQUATE"))


def audience(sector2: Column | str) -> Column:
    """B2B / B2C / Both for a two-digit sector number."""
    pairs = {code: label for label, codes in fv.SECTOR_AUDIENCE.items() for code in codes}
    return lookup(pairs, col(sector2).cast("int"))


def high_churn() -> Column:
    """Micro firm, founded 2015 or later, no website, no type (three-valued)."""
    return ((F.col("size") == "1-10") & (F.col("founded") >= 2015)
            & F.col("website").isNull() & F.col("type").isNull())


def implausible_size() -> Column:
    return F.coalesce((F.col("size") == "10K+") & (F.col("founded") >= 2021), F.lit(False))


def low_signal() -> Column:
    """No website, no industry, and a placeholder or missing name."""
    name = F.col("name")
    placeholder = name.isNull() | name.rlike(fv.PLACEHOLDER_NAME) | F.lower(strip(name)).isin(*fv.NAME_SENTINELS)
    return F.col("website").isNull() & F.col("industry").isNull() & placeholder
