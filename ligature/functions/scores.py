"""Scores and schedules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sa_norm(score: Column) -> Column:
    """Synthetic accessibility 1..10 as 1..0, clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (score - 1.0) / 9.0))


def reward(valid: Column, qed: Column, sa: Column, w_valid: float = 1.0, w_qed: float = 1.0, w_sa: float = 1.0) -> Column:
    """Weighted sum; qed and sa count 0 for an invalid string or a weight of 0."""
    v = valid.cast("double")
    part = lambda c, w: F.when((v > 0) & F.lit(w > 0), F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return w_valid * v + w_qed * part(qed, w_qed) + w_sa * part(sa, w_sa)


def tf_prob(kind: str, epoch: Column, total: int, k: float | None = None, warmup: int = 0, least: float = 0.0) -> Column:
    """Teacher-forcing probability: linear, exponential or inverse_sigmoid; 1 in the warm-up, clamped below."""
    t, span = epoch - warmup, total - warmup
    if span <= 0:
        return F.when(epoch < warmup, 1.0).otherwise(float(least))
    if kind == "linear":
        raw = 1.0 - t / F.lit(float(span))
    elif kind == "exponential":
        raw = F.pow(F.lit(0.95 if k is None else k), t)
    elif kind == "inverse_sigmoid":
        s = float(max(1.0, total / 5) if k is None else k)
        raw = F.lit(s) / (s + F.exp(t / s))
    else:
        raise ValueError(f"no such schedule: {kind}")
    return F.when(epoch < warmup, 1.0).otherwise(F.greatest(F.lit(float(least)), F.least(F.lit(1.0), raw)))


def rl_weight(epoch: Column, start: int = 0, most: float = 0.5, progressive: bool = True) -> Column:
    grown = F.least(F.lit(float(most)), (epoch - start) / F.lit(20.0)) if progressive else F.lit(float(most))
    return F.when(epoch < start, 0.0).otherwise(grown)
