"""Default thresholds. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Confidence:
    hit_high: float = 0.72
    hit_low: float = 0.55
    drift_weight: float = 0.10
    drift_floor: float = 0.25
    age_weight: float = 0.30
    age_floor: float = 0.40
    feedback_weight: float = 0.10
    max_age_days: float = 90.0


@dataclass(frozen=True)
class QaThresholds:
    sim_floor: float = 0.40
    tier_steps: tuple[float, ...] = (0.9, 0.8, 0.7, 0.6, 0.5)
    jaccard_min: float = 0.5
    novel_k: int = 20
    provenance_k: int = 10
    digest_schedule: tuple[int, ...] = (10, 12, 13, 15, 18)
    provenance_schedule: tuple[int, ...] = (5, 6, 7, 8, 10)
    max_entries: int = 1000


@dataclass(frozen=True)
class Search:
    top_k: int = 10
    rrf_k: int = 60
    max_tokens: int = 8000
    over_fetch: int = 3
    decay_rate: float = 0.01
    summary_ratio: float = 0.6
    summary_min_score: float = 0.35


@dataclass(frozen=True)
class Chunking:
    max_lines: int = 51
    overlap: int = 6
    max_entities: int = 10


@dataclass(frozen=True)
class Quorum:
    slots: int = 3
    similarity: float = 0.85
    ban_strikes: int = 3
    strike_trust: float = 0.2
    accept_trust: float = 0.1


@dataclass(frozen=True)
class Maintenance:
    decay_floor: float = 0.1
    history_days: int = 90
    inactive_days: int = 7
    min_pattern_confidence: float = 0.3
    transfer_most: int = 1000


@dataclass(frozen=True)
class Cascade:
    tolerance_theme: float = 0.3
    tolerance_project: float = 0.5
