"""Token sequences as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def cut_length(ids: Column, ends: list[int], most: int) -> Column:
    """Tokens up to and with the first end token; ``most`` where there is none and the sequence is as long; else NULL."""
    at = [F.nullif(F.array_position(ids, F.lit(e).cast("bigint")), F.lit(0).cast("bigint")) for e in ends]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.coalesce(first, F.when(F.size(ids) >= most, F.lit(most).cast("bigint")))


def differences(a: Column, b: Column) -> Column:
    """Absolute differences element by element; NULL where the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def first_mismatch(a: Column, b: Column) -> Column:
    """Position, from 0, of the first difference; the shorter length if one is a prefix of the other; NULL if equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True))
    shorter = F.least(F.size(a), F.size(b)).cast("bigint")
    return F.when((at > 0), F.least(at - 1, shorter))


def ranges(n: Column, size: int) -> Column:
    """``[start, end)`` of consecutive ranges of a length that cover 0 to n."""
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(size).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + F.lit(size), n).alias("stop")))
