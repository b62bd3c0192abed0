"""Acoustic word models from recordings: phone mixtures, monophone models, model tables and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship
from lexiwave.operators.cluster import RIDGE, Mixture
from lexiwave.operators.hmm import INF, WordModel, train_words

TABLES = ("states", "moves", "components")


def phone_mixtures(frames: DataFrame) -> dict[str, Mixture]:
    """One-component mixtures of (phone, features) rows, by phone.

    Batches send sums by phone, so only a row a phone and number comes back, however many frames there are.
    """
    ship(frames.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for phone, own in batch.groupby("phone"):
                x = np.stack(own["features"].to_numpy())
                rows.append((phone, np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])))
            yield pd.DataFrame(rows, columns=["phone", "sums"])

    parts = frames.where("phone is not null and features is not null").select("phone", "features").mapInPandas(work, "phone string, sums array<double>")
    summed = parts.select("phone", F.posexplode("sums").alias("i", "v")).groupBy("phone", "i").agg(F.sum("v").alias("v")).groupBy("phone").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))
    out = {}
    for r in summed.collect():
        sums = np.array(r.sums)
        d = int(round((np.sqrt(4 * len(sums) - 3) - 1) / 2))
        mean = sums[1 : d + 1] / sums[0]
        out[r.phone] = Mixture(np.ones(1), mean[None], (sums[d + 1 :].reshape(d, d) / sums[0] - np.outer(mean, mean) + RIDGE * np.eye(d))[None])
    return out


def monophone(word: str, phones: list[str], mixtures: dict[str, Mixture], states_per_phone: int = 1) -> WordModel:
    """A left-to-right model with ``states_per_phone`` states a phone, named ``phone_0`` and so on.

    Every state may be first, with one over the number of phones; the last state ends the word.
    """
    names = [f"{p}_{i}" for p in phones for i in range(states_per_phone)]
    missing = sorted(set(names) - set(mixtures))
    if missing:
        raise ValueError(f"no recordings of {', '.join(missing)}")
    return WordModel(word, names, [mixtures[n] for n in names], initial=np.full(len(names), np.log(len(phones))))


def train_monophones(topologies: DataFrame, phone_frames: DataFrame, word_frames: DataFrame, turns: int = 100, states_per_phone: int = 1) -> dict[str, WordModel]:
    """Word models of (word, phones): mixtures from (phone, features), then Baum-Welch on (word, utt, frame_no, features)."""
    mixtures = phone_mixtures(phone_frames)
    models = {r.word: monophone(r.word, list(r.phones), mixtures, states_per_phone) for r in topologies.select("word", "phones").collect()}
    return train_words(word_frames, models, turns)


def model_tables(spark: SparkSession, models: list[WordModel]) -> dict[str, DataFrame]:
    """``TABLES`` of word models; impossible moves are left out."""
    states, moves, components = [], [], []
    for m in models:
        for i, phone in enumerate(m.phones):
            states.append((m.word, i, phone, float(m.initial[i]), i == m.begin, i == m.end))
            moves += [(m.word, i, j, float(c)) for j, c in enumerate(m.transitions[i]) if np.isfinite(c)]
            if m.states:
                s = m.states[i]
                components += [(m.word, i, k, float(s.weight[k]), s.mean[k].tolist(), s.covariance[k].ravel().tolist()) for k in range(len(s.weight))]
    return {
        "states": spark.createDataFrame(states, "word string, state int, phone string, initial double, is_begin boolean, is_end boolean"),
        "moves": spark.createDataFrame(moves, "word string, i int, j int, nlp double"),
        "components": spark.createDataFrame(components, "word string, state int, k int, weight double, mean array<double>, covariance array<double>"),
    }


def models_of(tables: dict[str, DataFrame]) -> list[WordModel]:
    """Word models of their tables, in the order of words."""
    words: dict[str, dict] = {}
    for r in tables["states"].orderBy("word", "state").collect():
        w = words.setdefault(r.word, {"phones": [], "initial": [], "begin": 0, "end": -1})
        w["phones"].append(r.phone)
        w["initial"].append(r.initial)
        w["begin"], w["end"] = r.state if r.is_begin else w["begin"], r.state if r.is_end else w["end"]
    for w in words.values():
        w["transitions"] = np.full((len(w["phones"]),) * 2, INF)
        w["parts"] = [[] for _ in w["phones"]]
    for r in tables["moves"].collect():
        words[r.word]["transitions"][r.i, r.j] = r.nlp
    for r in tables["components"].orderBy("word", "state", "k").collect():
        words[r.word]["parts"][r.state].append(r)
    out = []
    for name, w in words.items():
        mixtures = [Mixture(np.array([c.weight for c in p]), np.array([c.mean for c in p]), np.array([c.covariance for c in p]).reshape(len(p), len(p[0].mean), -1)) for p in w["parts"] if p]
        out.append(WordModel(name, w["phones"], mixtures, w["transitions"], np.array(w["initial"]), w["begin"], w["end"]))
    return out


def report(model: WordModel, converged: bool | None = None, mixtures: bool = False, logs: bool = False) -> str:
    """A word model as text; probabilities, or with ``logs`` their neglogs."""
    show = (lambda x: x) if logs else (lambda x: np.exp(-x))
    lines = [f"HMM {model.word}"] + ([] if converged is None else ["training converged" if converged else "training did not converge"])
    lines += [f"states: {len(model.phones)} ({' '.join(model.phones)})", f"initial: {show(model.initial)}", f"transitions:\n{show(model.transitions)}"]
    for i, s in enumerate(model.states if mixtures else []):
        lines += [f"state {i}: {len(s.weight)} components", f"weights: {s.weight}", f"means:\n{s.mean}", f"covariances:\n{s.covariance}"]
    return "\n".join(lines) + "\n"


def density_grid(spark: SparkSession, model: WordModel, low: float = -20, high: float = 20, step: float = 0.001) -> DataFrame:
    """(state, component, x, density) of one-dimensional components at low, low + step and so on up to high."""
    if any(s.mean.shape[1] != 1 for s in model.states):
        raise ValueError("densities are drawn over one dimension")
    parts = [(i, k, float(s.mean[k, 0]), float(s.covariance[k, 0, 0])) for i, s in enumerate(model.states) for k in range(len(s.weight))]
    grid = spark.range(int(np.floor((high - low) / step + 1e-9)) + 1).select((F.col("id") * step + low).alias("x"))
    z = (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")) / F.col("variance")
    own = spark.createDataFrame(parts, "state int, component int, mean double, variance double")
    return grid.join(F.broadcast(own)).select("state", "component", "x", (F.exp(-z / 2) / F.sqrt(2 * np.pi * F.col("variance"))).alias("density"))
