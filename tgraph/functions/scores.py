"""Scalar score and time functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tgraph.functions.arrays import add, cosine, dot


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def link_score(a: Column | str, b: Column | str) -> Column:
    """Probability of a link from the dot product of its end vectors."""
    return sigmoid(dot(a, b))


def anomaly_from_link(p: Column | str) -> Column:
    return F.lit(1.0) - _c(p)


def quadratic_score(
    h_i: Column | str, h_j: Column | str, a: list[float], b: list[float], beta: float, mu: float
) -> Column:
    """``sigmoid(beta * |a*h_i + b*h_j|^2 - mu)`` with fixed vectors a and b."""
    wa = F.array(*[F.lit(float(x)) for x in a])
    wb = F.array(*[F.lit(float(x)) for x in b])
    left = F.zip_with(wa, _c(h_i), lambda w, x: w * x.cast("double"))
    right = F.zip_with(wb, _c(h_j), lambda w, x: w * x.cast("double"))
    mixed = add(left, right)
    return sigmoid(F.lit(float(beta)) * dot(mixed, mixed) - F.lit(float(mu)))


def time_frequencies(size: int, top: float = 9.0) -> list[float]:
    """Angular frequencies ``10^-x`` for x evenly spaced over 0..top."""
    if size == 1:
        return [1.0]
    return [10.0 ** -(top * i / (size - 1)) for i in range(size)]


def time_encoding(t: Column | str, size: int, top: float = 9.0, log: bool = False) -> Column:
    """Cosines of a time at fixed frequencies; of ``ln(1+t)`` with ``log``."""
    x = _c(t).cast("double")
    x = F.log1p(x) if log else x
    waves = F.array(*[F.lit(w) for w in time_frequencies(size, top)])
    return F.transform(waves, lambda w: F.cos(x * w))


def time_decay(delta_seconds: Column | str) -> Column:
    """``1 / (ln(|dt| / 3600 + 1) + 1)``."""
    hours = F.abs(_c(delta_seconds)).cast("double") / F.lit(3600.0)
    return F.lit(1.0) / (F.log1p(hours) + F.lit(1.0))


def clip(x: Column | str, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(_c(x), high))


def deviation_bucket(z: Column | str) -> Column:
    """Bucket 0..6 by the thresholds -3, -2, -1, 1, 2, 3."""
    bucket = F.lit(0)
    for cut in (-3.0, -2.0, -1.0, 1.0, 2.0, 3.0):
        bucket = bucket + (_c(z) > F.lit(cut)).cast("int")
    return bucket


def drift_score(
    now: Column | str, before: Column | str, seen: Column | str, kind: str = "both"
) -> Column:
    """How far a node's state moved and how badly its message fits the state.

    ``both`` is ``(2 - cos(now, before) - cos(seen, now)) / 4``; ``drift`` and
    ``recovery`` use one part, as ``(1 - cos) / 2``.
    """
    drift, recovery = cosine(now, before), cosine(seen, now)
    if kind == "drift":
        return (F.lit(1.0) - drift) / 2.0
    if kind == "recovery":
        return (F.lit(1.0) - recovery) / 2.0
    return (F.lit(2.0) - drift - recovery) / 4.0


def softmax_weights(n: int, decay: float = 1.0) -> list[float]:
    """Fixed attention weights over the last n states, the newest highest."""
    raw = [math.exp(-decay * i) for i in range(n)]
    return [x / sum(raw) for x in raw]
