"""Bounded samples that do not depend on how a table is partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiwave.functions.scratch import Scratch, small


def smallest_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows whose hashed keys are the smallest.

    Of a large table, rows above a cut that leaves about a quarter more than wanted are dropped first, so
    tasks hold and send a share of the sample each and not a sample each.
    """
    total, h = df.count(), F.xxhash64(key)
    if total > 2 * rows:
        df = df.where(h < F.lit(int(2**64 * 1.25 * rows / total) - 2**63))
    return df.orderBy(h, key).limit(rows)


def smallest_hashes_by(df: DataFrame, group: str, key: str, rows: int) -> DataFrame:
    """``rows`` rows in all, an equal share a group (one at least): those whose hashed keys are the smallest.

    A group's different keys are estimated first; of a large group, rows above a cut that leaves about half
    more than its share are dropped before any sorting. Rows of one key count once, and all but one of them
    go before the shuffle, so a key of very many rows fills no task. The groups must be few, such as languages.
    """
    sizes = df.groupBy(F.col(group).alias("s_group")).agg(F.approx_count_distinct(key).alias("s_n"))
    sizes = Scratch(df.sparkSession, "sample").save(sizes, "sizes")
    sizes = sizes.withColumn("s_share", F.greatest(F.lit(1), F.floor(F.lit(rows) / F.count("*").over(Window.partitionBy()))))
    h = F.xxhash64(key)
    cut = F.least(F.lit(1.0), F.lit(1.5) * F.col("s_share") / F.col("s_n") + F.lit(30.0) / F.col("s_n"))
    near = df.join(small(sizes), F.col(group) == F.col("s_group")).where(F.pmod(h, F.lit(1 << 30)) < cut * (1 << 30))
    near = near.dropDuplicates(["s_group", key])
    by = Window.partitionBy("s_group").orderBy(F.pmod(h, F.lit(1 << 30)), h, key)
    return near.withColumn("s_rank", F.row_number().over(by)).where(F.col("s_rank") <= F.col("s_share")).select(*df.columns)
