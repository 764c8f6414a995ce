"""Scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.config import Confidence, QaThresholds

DAY_MS = 86_400_000
#: Ages saturate at the largest unsigned 32-bit number of milliseconds.
MOST_MS = 4_294_967_295


def between(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def decay(score: Column, age_hours: Column, rate: float = 0.01, enabled: bool = True) -> Column:
    """Exponential decay with age; unchanged if disabled or the age is not positive."""
    if not enabled:
        return score
    return F.when(age_hours > 0, score * F.exp(-F.lit(rate) * age_hours)).otherwise(score)


def salience(created_ms: Column, accessed_ms: Column, count: Column, now_ms: Column, half_life_days: float = 30.0, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    """Recency of access, frequency and recency of creation, weighted, within [0, 1]."""
    a, f, c = weights

    def recency(ms: Column) -> Column:
        age = F.least(F.greatest(now_ms - ms, F.lit(0)), F.lit(MOST_MS))
        return F.pow(F.lit(0.5), age / F.lit(half_life_days * DAY_MS))

    total = a + f + c
    if total <= 0:
        return F.lit(0.0)
    return between((a * recency(accessed_ms) + f * (1 - 1 / (1 + count.cast("double"))) + c * recency(created_ms)) / total, 0, 1)


def confidence(similarity: Column, drift: Column, age_days: Column, confirmed: Column, contradicted: Column, cfg: Confidence = Confidence()) -> Column:
    """Trust in a map: similarity, worn by drift and age, plus feedback, within [0, 1]."""
    finite = F.when(F.isnan(similarity) | (F.abs(similarity) == float("inf")), 0.0).otherwise(F.coalesce(similarity, F.lit(0.0)))
    sim = between(finite, 0, 1)
    d = F.greatest(1 - cfg.drift_weight * F.least(drift, F.lit(1 << 24)), F.lit(cfg.drift_floor))
    ratio = F.lit(1.0) if cfg.max_age_days <= 0 else F.least(age_days, F.lit(1 << 24)) / cfg.max_age_days
    a = F.greatest(1 - cfg.age_weight * ratio, F.lit(cfg.age_floor))
    return between(sim * d * a + cfg.feedback_weight * feedback_ratio(confirmed, contradicted), 0, 1)


def feedback_ratio(confirmed: Column, contradicted: Column) -> Column:
    n = confirmed + contradicted
    return F.when(n == 0, 0.0).otherwise(F.try_divide((confirmed - contradicted).cast("double"), n))


def hit_class(similarity: Column, cfg: Confidence = Confidence()) -> Column:
    return F.when(similarity >= cfg.hit_high, "strong").when(similarity >= cfg.hit_low, "related").otherwise("none")


def qa_plan(similarity: Column, jaccard: Column, t: QaThresholds = QaThresholds()) -> Column:
    """``(is_miss, tier, digest_k, provenance_k)`` for the similarity of a cached question and the overlap of results."""
    tier = F.lit(None).cast("int")
    for i in reversed(range(len(t.tier_steps))):
        tier = F.when(similarity >= t.tier_steps[i], i).otherwise(tier)
    miss = (similarity < t.sim_floor) | tier.isNull() | (jaccard < t.jaccard_min)

    def scheduled(schedule: tuple[int, ...], default: int) -> Column:
        out = F.lit(default)
        for i, k in enumerate(schedule):
            out = F.when(tier == i, k).otherwise(out)
        return out

    digest = F.least(scheduled(t.digest_schedule, t.novel_k), F.lit(t.novel_k))
    provenance = F.greatest(F.least(scheduled(t.provenance_schedule, t.novel_k), digest), F.lit(1))
    return F.struct(
        miss.alias("is_miss"), F.when(miss, -1).otherwise(tier).alias("tier"), F.when(miss, t.novel_k).otherwise(digest).alias("digest_k"), F.when(miss, t.provenance_k).otherwise(provenance).alias("provenance_k")
    )


def eviction_weight(access_count: Column, age_ms: Column, half_ms: float) -> Column:
    return access_count / (1 + age_ms / F.lit(float(half_ms)))


def summary_split(total: int, ratio: float, qualifying: int) -> tuple[int, int]:
    """How many of ``total`` results are summaries and how many chunks; one chunk at least."""
    take = min(int(total * ratio), qualifying)
    if total and take >= total:
        take = total - 1
    return max(take, 0), total - max(take, 0)


def backoff_ms(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(most)))


def cost_usd(tokens: Column, price_per_million: Column) -> Column:
    return tokens / 1e6 * price_per_million


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Position between low and high; 1 where all values are equal."""
    return F.when(high - low < 1e-9, 1.0).otherwise(F.try_divide(x - low, high - low))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two id sets; 0 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), n))
