"""Word error rate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiwave.functions.shipping import ship


def edit_distance(a: list[str], b: list[str]) -> int:
    """Least insertions, deletions and substitutions of words; one array operation a word of ``a``."""
    codes = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    other = np.array([codes[w] for w in b], np.int64)
    at = np.arange(len(b) + 1)
    row = at.copy()
    for i, w in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (other != codes[w]), out=best[1:])
        row = np.minimum.accumulate(best - at) + at
    return int(row[-1])


def error_rates(said: Iterable[str], meant: Iterable[str]) -> list[float]:
    """The rate of every pair; the words of one pair alone are held."""
    return [edit_distance(x.split(" "), words) / len(words) for x, words in ((x, y.split(" ")) for x, y in zip(said, meant))]


def wer(spark, recognised: Column, reference: Column) -> Column:
    """Edit distance by number of reference words. Texts are split at single spaces, so an empty one has one
    empty word; nulls count as empty."""
    ship(spark)

    @F.pandas_udf(T.DoubleType())
    def rate(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for said, meant in columns:
            yield pd.Series(error_rates(said.fillna(""), meant.fillna("")), dtype="float64")

    return rate(recognised, reference)


def wer_sql(recognised: Column, reference: Column) -> Column:
    """The same as an expression, by folding the rows of the table of distances; for short texts."""
    a, b = F.split(F.coalesce(recognised, F.lit("")), " "), F.split(F.coalesce(reference, F.lit("")), " ")
    first = F.sequence(F.lit(0), F.size(b))

    def row(before: Column, w: Column) -> Column:
        def cell(s: Column, j: Column) -> Column:
            best = F.least(F.element_at(before, j + 1) + 1, F.element_at(before, j) + F.when(F.element_at(b, j) == w, 0).otherwise(1), F.element_at(s, -1) + 1)
            return F.concat(s, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(before[0] + 1), cell)

    return F.element_at(F.aggregate(a, first, row), -1) / F.size(b)
