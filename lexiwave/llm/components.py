"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.scratch import Scratch
from lexiwave.llm.skew import PARTS, spread_join


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place joined to each of n places by the edges (a, b), by spreading minima and jumping."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _joined(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges with the least neighbour ``m`` of u; edges of a node that has more than one in ``PARTS`` are dealt over many tasks."""
    heavy = least.where(F.col("n") > F.lit(total / PARTS)).select("u")
    return spread_join(edges, least.select("u", "m"), ["u"], heavy, F.col("v"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest node among it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    return _joined(both, least, 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges have u > v."""
    least = _least(edges)
    moved = _joined(edges, least, total).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node with an edge; a component is its smallest node.

    ``edges`` has two bigint columns. The graph is turned into stars by large-star and small-star steps
    (a few passes; each keeps the components and never has more edges than before), with every pass
    written down. Edges of a node of very many are aggregated before the shuffle and joined in parts. Loops and null ends are dropped; an empty table has no components.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, seen, turn = scratch.save(now.distinct(), f"{name}0"), None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if mark == seen or mark[0] == 0:
            break
        turn, seen = turn + 1, mark
        now = scratch.save(_small_star(_large_star(now, mark[0]), mark[0]), f"{name}{turn}")
        if turn > 1:
            scratch.drop(f"{name}{turn - 2}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return scratch.save(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), f"{name}-of")
