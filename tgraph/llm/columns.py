"""Other columns of a table that are called like the inner ones of an operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def set_aside(docs: DataFrame, inner: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns called like ``inner`` ones renamed, and their names {old: new}.

    Names are compared without case, as Spark does. Without such columns the
    table and its plan stay as they are.
    """
    inner = {c.lower() for c in inner}
    taken = inner | {c.lower() for c in docs.columns}
    away = {}
    for c in docs.columns:
        if c.lower() in inner:
            new = next(n for i in range(len(taken) + 1) if (n := f"{c}_{i}").lower() not in taken)
            taken.add(new.lower())
            away[c] = new
    return (docs.withColumnsRenamed(away) if away else docs), away


def put_back(out: DataFrame, away: dict[str, str]) -> DataFrame:
    """``out`` with the columns that were set aside under their own names."""
    return out.withColumnsRenamed({new: old for old, new in away.items()}) if away else out
