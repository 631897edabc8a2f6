"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine(a, b)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d)


def hadamard(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))


def average(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") + y.cast("double")) / 2.0)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") + y.cast("double"))


def pad(a: Column | str, size: int, fill: Column) -> Column:
    """Right-pad to ``size``; longer arrays stay as they are."""
    missing = F.greatest(F.lit(0), F.lit(size) - F.size(_c(a)))
    return F.concat(_c(a), F.array_repeat(fill, missing))


def left_pad(a: Column | str, size: int, fill: Column) -> Column:
    missing = F.greatest(F.lit(0), F.lit(size) - F.size(_c(a)))
    return F.concat(F.array_repeat(fill, missing), _c(a))


def pad_mask(a: Column | str, size: int) -> Column:
    """1 for real slots, 0 for padding."""
    n = F.size(_c(a))
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i <= n).cast("int"))
