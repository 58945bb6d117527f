"""Joins whose small side is broadcast only after its size was measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers or short strings up to which a side may be broadcast: some MB.
BROADCAST_ROWS = 50_000
#: Rows of one whole number up to which a side may be broadcast: about 40 bytes each.
BROADCAST_IDS = 400_000


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys in which NULL equals NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join ``right``, which has one row for each key, to ``left`` on ``keys`` (NULL equals NULL).

    ``right`` should be materialised: it is counted.  Up to ``limit`` rows it is broadcast.  Beyond
    that both sides are shuffled by the keys and a salt, with ``right`` repeated for each salt, so one
    hot key of ``left`` is dealt to ``salts`` tasks.  The keys of ``right`` are dropped.
    """
    names = {k: f"__r_{k}" for k in keys}
    small = right.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys])
    if right.count() <= limit:
        return left.join(F.broadcast(small), cond, how).drop(*names.values())
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    small = small.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(small, cond & (F.col("__salt") == F.col("__r_salt")), how).drop(*names.values(), "__salt", "__r_salt")
