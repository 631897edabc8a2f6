"""Reproducible uniform numbers from a hash of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = float(2**52)


def u01(seed: object, *keys: Column | str) -> Column:
    """Uniform number in [0, 1) fixed by ``seed`` and the key columns.

    Taken from the first 13 hex digits of an md5, so its value depends on the
    row only, never on partitioning or on a retried task.
    """
    parts = [F.lit(str(seed))]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(_SPAN)


def pick(size: Column | int, seed: object, *keys: Column | str) -> Column:
    """Uniform integer in [0, size) fixed by the key."""
    bound = size if isinstance(size, Column) else F.lit(size)
    return F.floor(u01(seed, *keys) * bound).cast("bigint")


ROUNDS = 4


def permuted_range(size: int) -> int:
    """How many numbers ``permuted`` permutes to reach all of [0, size): less than 4 * size, or 4."""
    return 4 ** max(1, (max(1, (size - 1).bit_length()) + 1) // 2)


def permuted(rows: DataFrame, index: str, size: int, seed: object, name: str) -> DataFrame:
    """Rows whose ``index`` is mapped into [0, size) by a keyed permutation, as ``name``.

    The permutation is a Feistel network over ``permuted_range(size)`` numbers. No
    two indices share a value, and the whole range has every value once. Sizes end at 2**62.
    """
    if not 0 < size <= 1 << 62:
        raise ValueError("the size must be between 1 and 2**62")
    half = permuted_range(size).bit_length() // 2
    low = F.lit((1 << half) - 1)
    out = rows.withColumns({"_l": F.shiftright(index, half), "_r": F.col(index).bitwiseAND(low)})
    for i in range(ROUNDS):
        mixed = F.col("_l").bitwiseXOR(pick(1 << half, seed, F.lit(f"round{i}"), "_r"))
        out = out.withColumns({"_l": F.col("_r"), "_r": mixed})
    out = out.withColumn(name, F.shiftleft("_l", half).bitwiseOR(F.col("_r"))).drop("_l", "_r")
    return out.filter(F.col(name) < F.lit(size))
