"""Thresholds handed to the operators. Plain, immutable and driver-side."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class VolumeTiers:
    """Groups with at least ``a_min`` rows are tier A, at least ``b_min`` tier B, else C."""

    a_min: int = 50_000
    b_min: int = 10_000


@dataclass(frozen=True)
class GapTiers:
    """Coverage ratio below ``high`` is HIGH_GAP, below ``moderate`` MODERATE_GAP."""

    high: float = 0.10
    moderate: float = 0.30


@dataclass(frozen=True)
class AcceptAt:
    """Confidence from which an enriched value replaces the original."""

    website: float = 0.70
    type: float = 0.65
    size: float = 0.55
    industry: float = 0.65

    def of(self, name: str) -> float:
        return getattr(self, name)


@dataclass(frozen=True)
class EvidenceRules:
    verify_below: float = 0.72
    escalate_below: float = 0.60
    size_search_below: float = 0.55
    refuted_cap: float = 0.45
    name_diverges_below: float = 0.70
    accept: AcceptAt = field(default_factory=AcceptAt)


@dataclass(frozen=True)
class SourcingLimit:
    """A sector is a sourcing limit when both shares are reached."""

    nonemployer_share: float = 0.70
    employer_coverage: float = 0.35


# parity targets: segment -> (website, industry, size) fill share
PARITY_TARGETS = {
    "enterprise": (0.99, 0.99, 0.99),
    "mid_market": (0.92, 0.97, 0.98),
    "smb": (0.85, 0.93, 0.96),
    "micro": (0.75, 0.85, 0.93),
}
TIER_B_SLACK = 0.05

SAMPLE_QUOTAS = {"enterprise": 60, "mid_market": 80, "smb": 80, "micro": 80}
SAMPLE_SPLIT = {"missing_website": 0.50, "missing_industry": 0.30, "platform_url": 0.20}

BUDGET_TOTAL = 10.00
PHASE_BUDGETS = {"part_0": 0.0, "part_1": 0.0, "part_2": 2.0, "part_3": 0.0,
                 "part_4": 8.0, "part_5": 0.0}
BATCH_SIZE = (200, 1000)
STAGE4_SHARE_MAX = 0.40
CALIBRATION_AT = 0.80
CALIBRATION_TARGET = 0.80
