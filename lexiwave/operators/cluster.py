"""k-means and Gaussian mixtures over (id, x) points.

Points stay distributed: an iteration sends every batch's sums for each cluster to be added up, and only
the k parameter rows come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship

RIDGE = 1e-5


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, x, k, d2): nearest of the (k, centre) rows by Euclidean distance, the least k of equals.

    ``centres`` is one row a cluster, so it is sent to every executor whatever the number of points.
    """
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("k", "centre"))).alias("cs"))
    crossed = points.join(F.broadcast(packed))
    per = F.transform("cs", lambda c: F.struct(
        F.aggregate(F.arrays_zip(F.col("x").alias("x"), c["centre"].alias("centre")), F.lit(0.0), lambda s, z: s + (z["x"] - z["centre"]) * (z["x"] - z["centre"])).alias("d2"),
        c["k"].alias("k")))
    return crossed.withColumn("near", F.array_min(per)).select("id", "x", F.col("near.k").alias("k"), F.col("near.d2").alias("d2"))


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(k, centre) after one step: means of the assigned points; an empty cluster's centre becomes zeros."""
    means = (
        assign(points, centres).select("k", F.posexplode("x").alias("i", "v")).groupBy("k", "i").agg(F.avg("v").alias("v"))
        .groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("mean"))
    )
    return centres.join(means, "k", "left").select("k", F.coalesce("mean", F.transform("centre", lambda _: F.lit(0.0))).alias("centre"))


@dataclass
class Clusters:
    """Per cluster: weight, centre [d], covariance [d, d]; ``sse`` of all points."""

    weight: np.ndarray
    centre: np.ndarray
    covariance: np.ndarray
    sse: float


def _stats(points: DataFrame, centre: np.ndarray, score, squares: bool = True) -> list:
    """Sums of (share, share * x, share * x x', score) by cluster; ``score(x) -> (shares [n, k], per-point number)``.

    Every task adds up its batches; without ``squares`` second moments are left out.
    """
    ship(points.sparkSession)
    k, d = centre.shape

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, second, total = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                share, number = score(x)
                n += share.sum(0)
                first += share.T @ x
                if squares:
                    second += np.einsum("nk,ni,nj->kij", share, x, x, optimize=True)
                total += float(number.sum())
        sums = [np.concatenate([[n[i], total if i == 0 else 0.0], first[i], second[i].ravel() if squares else []]) for i in range(k)]
        yield pd.DataFrame({"k": range(k), "sums": sums})

    parts = points.select("x").mapInPandas(work, "k int, sums array<double>")
    rows = parts.select("k", F.posexplode("sums").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).groupBy("k").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums")).orderBy("k").collect()
    sums = np.array([r.sums for r in rows])
    return [sums[:, 0], sums[:, 2 : 2 + d], sums[:, 2 + d :].reshape(k, d, d) if squares else None, float(sums[:, 1].sum())]


def _vectors(points: DataFrame) -> DataFrame:
    """(n, x): points by the batch as bytes, which many passes hand to Python as they are."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(0)
                sizes = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
                if len(sizes) > 1:
                    raise ValueError("points are vectors of one length")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "x"])

    return points.select("x").mapInArrow(pack, "n long, x binary")


def _lloyd_sums(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """(sizes, sums, squared error) of the points nearest to the centres of each run, all runs in one pass."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {run: np.zeros((len(c), 2 + c.shape[1])) for run, c in centres.items()}
        for batch in batches:
            for n, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(held.as_buffer(), "<f8").reshape(n, -1)
                for run, centre in centres.items():
                    far = np.stack([((x - c) ** 2).sum(1) for c in centre], 1)
                    near = far.argmin(1)
                    share = np.eye(len(centre))[near]
                    sums[run][:, 0] += share.sum(0)
                    sums[run][0, 1] += far[np.arange(n), near].sum()
                    sums[run][:, 2:] += share.T @ x
        for run, v in sums.items():
            flat = v.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(flat), pa.int32()), pa.array(np.arange(len(flat), dtype="int32")), pa.array(flat)], names=["run", "i", "v"])

    rows = vectors.mapInArrow(work, "run int, i int, v double").groupBy("run", "i").agg(F.sum("v").alias("v")).collect()  # a run's parameters
    out = {run: np.zeros(c.shape[0] * (2 + c.shape[1])) for run, c in centres.items()}
    for r in rows:
        out[r.run][r.i] = r.v
    tables = {run: v.reshape(len(centres[run]), -1) for run, v in out.items()}
    return {run: (v[:, 0], v[:, 2:], float(v[0, 1])) for run, v in tables.items()}


def kmeans(points: DataFrame, k: int, turns: int = 1000, attempts: int = 5, seed: int = 0, start: np.ndarray | None = None) -> Clusters:
    """The best by squared error of several runs from random distinct points, each until no centre moves by a millionth of the spread.

    With ``start``, [k, d] centres, there is one run, from these. Runs take their turns side by side, a pass over
    the points for all that still move. Second moments are summed once, for the best run. Fewer than ``k``
    distinct points are an error.
    """
    if k < 1 or attempts < 1 or turns < 1:
        raise ValueError("clusters, attempts and turns are 1 or more")
    attempts = attempts if start is None else 1
    some = np.array([r.x for r in points.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(k * attempts * 4).collect()])
    if len(some) < k:
        raise ValueError(f"{len(some)} distinct points for {k} clusters")
    ship(points.sparkSession)
    kept = _vectors(points).persist()  # read by every turn; lost blocks are read again
    rng = np.random.default_rng(seed)
    least = 1e-6 * max(float(some.std()), 1e-12)

    def score(centre):
        def of(x):
            far = ((x[:, None, :] - centre[None, :, :]) ** 2).sum(2)
            near = far.argmin(1)
            return np.eye(len(centre))[near], far[np.arange(len(x)), near]

        return of

    try:
        now = {run: some[rng.permutation(len(some))[:k]] if start is None else np.asarray(start, float) for run in range(attempts)}
        moving, errors = set(now), {}
        for _ in range(turns):
            for run, (n, first, sse) in _lloyd_sums(kept, {run: now[run] for run in sorted(moving)}).items():
                new = np.where(n[:, None] > 0, first / np.maximum(n, 1)[:, None], 0.0)
                if np.abs(new - now[run]).max() <= least:
                    moving.discard(run)
                now[run], errors[run] = new, sse
            if not moving:
                break
    finally:
        kept.unpersist()
    centre = now[min(errors, key=lambda run: (errors[run], run))]
    n, first, second, sse = _stats(points, centre, score(centre))
    mean = first / np.maximum(n, 1)[:, None]
    cov = (second - n[:, None, None] * mean[:, :, None] * mean[:, None, :]) / np.maximum(n - 1, 1)[:, None, None] + RIDGE * np.eye(centre.shape[1])
    return Clusters(n / n.sum(), centre, cov, sse)


@dataclass
class Mixture:
    """A Gaussian mixture with full covariances."""

    weight: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray

    def component_nlp(self, x: np.ndarray) -> np.ndarray:
        """[n, k] neglog densities of weighted components; inverse and determinant are made once a component."""
        out = np.empty((len(x), len(self.weight)))
        for k, (w, m, c) in enumerate(zip(self.weight, self.mean, self.covariance)):
            factor = np.linalg.cholesky(c)
            z = np.linalg.solve(factor, (x - m).T)
            out[:, k] = 0.5 * (len(m) * np.log(2 * np.pi) + (z * z).sum(0)) + np.log(np.diag(factor)).sum() - (np.log(w) if w > 0 else -np.inf)
        return out

    def nlp(self, x: np.ndarray) -> np.ndarray:
        each = self.component_nlp(np.atleast_2d(x))
        low = each.min(1)
        return np.where(np.isinf(low), low, low - np.log(np.exp(np.where(np.isinf(low), 0, low)[:, None] - each).sum(1)))

    def pdf(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self.nlp(x))


def densities(points: DataFrame, mixture: Mixture) -> DataFrame:
    """(id, nlp) of (id, x): the neglog density of every point."""
    ship(points.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "nlp": mixture.nlp(np.stack(batch["x"].to_numpy()))})

    return points.select("id", "x").mapInPandas(work, f"id {points.schema['id'].dataType.simpleString()}, nlp double")


def one_component(points: DataFrame) -> Mixture:
    """The closed form of a one-component mixture: mean and population covariance with a ridge."""
    d = len(points.first().x)
    n, first, second, _ = _stats(points, np.zeros((1, d)), lambda x: (np.ones((len(x), 1)), np.zeros(len(x))))
    mean = first / n[:, None]
    return Mixture(np.ones(1), mean, second / n[:, None, None] - mean[:, :, None] * mean[:, None, :] + RIDGE * np.eye(d))


def mixture_start(points: DataFrame, k: int, init: str = "kmeans", turns: int = 1000, attempts: int = 5, seed: int = 0) -> Mixture:
    """Where expectation maximisation begins: clusters, or equal weights, random distinct points and the points' sample covariance."""
    if init == "kmeans":
        got = kmeans(points, k, turns, attempts, seed)
        return Mixture(got.weight, got.centre, got.covariance)
    if init != "random":
        raise ValueError("a mixture starts from kmeans or random points")
    means = [r.x for r in points.select("x").distinct().orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(k).collect()]
    if len(means) < k:
        raise ValueError(f"{len(means)} distinct points for {k} components")
    d = len(means[0])
    n, first, second, _ = _stats(points, np.zeros((1, d)), lambda x: (np.ones((len(x), 1)), np.zeros(len(x))))
    cov = (second[0] - np.outer(first[0], first[0]) / n[0]) / max(n[0] - 1, 1)
    return Mixture(np.full(k, 1 / k), np.array(means), np.repeat(cov[None], k, 0))


def gmm(points: DataFrame, start: Mixture, turns: int = 1000, eps: float = 1e-5, ignore_eps: bool = False) -> Mixture:
    """Expectation maximisation with responsibilities in log space; covariances about the old means.

    Stops after the step in which neither means nor covariances move by ``eps``.
    """
    now = start
    for _ in range(turns):
        def score(x, m=now):
            each = m.component_nlp(x)
            low = each.min(1, keepdims=True)
            share = np.exp(low - each)
            return share / share.sum(1, keepdims=True), m.nlp(x)

        n, first, second, _ = _stats(points, now.mean, score)
        size = np.maximum(n, 1e-300)
        mean = first / size[:, None]
        old = now.mean
        about = second / size[:, None, None] - mean[:, :, None] * old[:, None, :] - old[:, :, None] * mean[:, None, :] + old[:, :, None] * old[:, None, :]
        new = Mixture(n / n.sum(), mean, about + RIDGE * np.eye(mean.shape[1]))
        still = np.linalg.norm(new.mean - now.mean) < eps and np.linalg.norm(new.covariance - now.covariance) < eps
        now = new
        if still and not ignore_eps:
            break
    return now
