"""Negative natural logs: impossible is +inf, smaller is likelier. Guards keep ``inf - inf`` and ln(0) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.scratch import small

LEAST_PROBABILITY = 1e-15


def inf() -> Column:
    return F.lit(float("inf"))


def neglog(p: Column) -> Column:
    """-ln p, and +inf for null or p under the least probability."""
    return F.when(p < LEAST_PROBABILITY, inf()).otherwise(F.coalesce(-F.ln(p), inf()))


def add(x: Column, y: Column) -> Column:
    """Neglog of the sum of two probabilities."""
    low, high = F.least(x, y), F.greatest(x, y)
    return F.when(high == float("inf"), low).otherwise(low - F.log1p(F.exp(low - high)))


def group_sums(df: DataFrame, keys: list[str], x: str, out: str = "nlp") -> DataFrame:
    """(keys, out): neglog of the sum of each group's probabilities ``x``, stable whatever lies between its terms.

    The least term is found first and joined to the group's rows, and then terms are summed relative to it, both
    before the shuffle too, so a group is never gathered. Nulls are left out; a group with impossible terms
    alone is impossible. Null keys are keys.
    """
    live = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"))
    low = live.groupBy(*keys).agg(F.min("__x").alias("__low")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__low")
    near = live.join(small(low), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    total = F.sum(F.when(F.col("__low") == float("inf"), F.lit(1.0)).otherwise(F.exp(F.col("__low") - F.col("__x"))))
    return near.groupBy(*keys, "__low").agg(total.alias("__p")).select(*keys, F.when(F.col("__low") == float("inf"), inf()).otherwise(F.col("__low") - F.ln("__p")).alias(out))


def array_sum(xs: Column) -> Column:
    """Neglog of the sum of an array's probabilities."""
    low = F.array_min(xs)
    return F.when(low == float("inf"), low).otherwise(low - F.ln(F.aggregate(xs, F.lit(0.0), lambda s, v: s + F.exp(low - v))))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def clamp(p: Column) -> Column:
    """Between 1e-9 and 1."""
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-9))
