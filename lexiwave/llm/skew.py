"""Joins whose keys may be very unequal.

A key with more than one row in ``PARTS`` is heavy, so a table of any size has fewer than ``PARTS`` heavy
keys: their list is small by count, not by hope, and may go to every executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 2000
SALTS = 64


def heavy_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The heavy keys of a saved table of distinct ``keys`` and their numbers of rows ``n``."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > F.lit(total / PARTS)).select(*keys)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], heavy: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (distinct keys) on ``keys``, rows of heavy keys dealt over ``SALTS`` tasks by a hash of ``spread``.

    ``how`` is inner or left. Null keys join with nothing.
    """
    marked = F.broadcast(heavy.withColumn("__heavy", F.lit(True)))  # fewer than PARTS rows
    salt = F.when(F.col("__heavy"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(marked, keys, "left").withColumn("__salt", salt).drop("__heavy")
    right = one.join(marked, keys, "left").withColumn("__salt", F.explode(salts)).drop("__heavy")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
