"""Hidden Markov models over utterances: forward, backward, occupancies, Baum-Welch, word models.

All probabilities are neglogs. Recursions over states are array operations. Training sums expected moves and
occupancies of blocks of all utterances in the cluster, and only model-sized tables come back. What takes a
sequence as one array is for short ones; ``segments`` has the same for sequences of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.neglog import array_sum
from lexiwave.functions.shipping import ship
from lexiwave.functions.scratch import Scratch
from lexiwave.operators import segments
from lexiwave.operators.cluster import RIDGE, Mixture
from lexiwave.operators.segments import Chain, logsum

INF = np.inf


@dataclass
class WordModel:
    """States named by phones, with start neglogs [n] and transitions [n, n]; ``states`` score observations.

    Without transitions the model goes left to right: stay or step on with one half each, and stay in the
    last state. Words begin in the first state and end in the last one unless told otherwise.
    """

    word: str
    phones: list[str]
    states: list[Mixture] = field(default_factory=list)
    transitions: np.ndarray | None = None
    initial: np.ndarray | None = None
    begin: int = 0
    end: int = -1

    def __post_init__(self) -> None:
        n = len(self.phones)
        if not n:
            raise ValueError("a word model has a begin and an end state")
        self.end %= n
        if self.initial is None:
            self.initial = np.where(np.arange(n) == 0, 0.0, INF)
        if self.transitions is None:
            half = -np.log(0.5)
            self.transitions = np.full((n, n), INF)
            at = np.arange(n - 1)
            self.transitions[at, at] = self.transitions[at, at + 1] = half
            self.transitions[-1, -1] = 0.0
        if self.transitions.shape != (n, n):
            raise ValueError("transitions are one row and one column a state")
        if (np.abs(logsum(self.transitions, 1)) > 1e-7).any():
            raise ValueError("every row of transitions sums to probability 1")

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """[T, n], each frame once for every state that differs from the others."""
        return tied_emissions([self], x)[0]


@dataclass
class Symbols:
    """A state that gives numbered symbols, the one feature of a frame, with neglogs ``table``."""

    table: np.ndarray

    def nlp(self, x: np.ndarray) -> np.ndarray:
        return self.table[np.atleast_2d(x)[:, 0].astype(int)]


def _content(state: Mixture | Symbols) -> bytes:
    return b"|".join(np.ascontiguousarray(v, np.float64).tobytes() for v in vars(state).values())


def tied_emissions(models: list[WordModel], x: np.ndarray) -> list[np.ndarray]:
    """[T, n] of every model. States of equal content, such as a phone that many words share, are scored once."""
    table: dict[bytes, np.ndarray] = {}
    out = []
    for m in models:
        columns = []
        for s in m.states:
            key = _content(s)
            if key not in table:
                table[key] = s.nlp(x)
            columns.append(table[key])
        out.append(np.stack(columns, axis=1))
    return out


def forward(initial: np.ndarray, transitions: np.ndarray, emissions: np.ndarray) -> np.ndarray:
    out = np.empty_like(emissions)
    out[0] = initial + emissions[0]
    for t in range(1, len(out)):
        out[t] = logsum(out[t - 1][:, None] + transitions, 0) + emissions[t]
    return out


def backward(transitions: np.ndarray, emissions: np.ndarray) -> np.ndarray:
    out = np.zeros_like(emissions)
    for t in range(len(out) - 2, -1, -1):
        out[t] = logsum(transitions + (emissions[t + 1] + out[t + 1])[None, :], 1)
    return out


def occupancy(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """[T, n] neglog of being in a state, given all observations."""
    both = alpha + beta
    return both - logsum(both, 1)[:, None]


def transit(alpha: np.ndarray, beta: np.ndarray, transitions: np.ndarray, emissions: np.ndarray) -> np.ndarray:
    """[T - 1, n, n] neglog of a move between states, given all observations."""
    all_ = alpha[:-1, :, None] + transitions[None] + (emissions[1:] + beta[1:])[:, None, :]
    return all_ - logsum(all_.reshape(len(all_), -1), 1)[:, None, None]


def component_occupancy(gamma: np.ndarray, model: WordModel, x: np.ndarray) -> np.ndarray:
    """[n, components, T] neglog of each state's mixture component."""
    return np.stack([(gamma[:, i][:, None] + s.component_nlp(x) - s.nlp(x)[:, None]).T for i, s in enumerate(model.states)])


def refit_mixtures(model: WordModel, features: list[np.ndarray], gammas: list[np.ndarray]) -> WordModel:
    """Mixtures re-estimated from the occupancies of their components: weights by the state's, covariances about the old means."""
    x = np.concatenate(features)
    shares = np.exp(-np.concatenate([np.moveaxis(component_occupancy(g, model, own), 2, 0) for g, own in zip(gammas, features)]))
    states = []
    for i, s in enumerate(model.states):
        share = shares[:, i]
        size = np.maximum(share.sum(0), 1e-300)
        covariance = []
        for k in range(len(s.weight)):
            apart = x - s.mean[k]
            covariance.append((share[:, k, None] * apart).T @ apart / size[k] + RIDGE * np.eye(x.shape[1]))
        states.append(Mixture(size / size.sum(), share.T @ x / size[:, None], np.array(covariance)))
    return replace(model, states=states)


def baum_welch(
    model: WordModel, emissions: list[np.ndarray], eps: float = 1e-4, turns: int = 1000, ignore_eps: bool = False, features: list[np.ndarray] | None = None,
) -> tuple[WordModel, bool]:
    """Start and transition probabilities from many utterances' emissions; whether it converged.

    Statistics of the utterances are summed. States that are never left keep their row. With ``features``
    the mixtures are re-estimated too, from the same occupancies, and give the next turn's emissions; their
    states must have the same number of components.
    """
    before = INF
    for _ in range(turns):
        start, moved, left, gammas, likelihood = [], [], [], [], 0.0
        if features is not None:
            emissions = [model.emissions(x) for x in features]
        for e in emissions:
            alpha, beta = forward(model.initial, model.transitions, e), backward(model.transitions, e)
            gamma = occupancy(alpha, beta)
            gammas.append(gamma)
            start.append(gamma[0])
            if len(e) > 1:
                moved.append(logsum(transit(alpha, beta, model.transitions, e), 0))
                left.append(logsum(gamma[:-1], 0))
            likelihood += float(logsum(alpha[-1], 0))
        initial = logsum(np.stack(start), 0) + np.log(len(start))
        transitions = model.transitions
        if moved:
            total, rows = logsum(np.stack(moved), 0), logsum(np.stack(left), 0)
            transitions = np.where(np.isinf(rows)[:, None], transitions, total - np.where(np.isinf(rows), 0, rows)[:, None])
        if features is not None:
            model = refit_mixtures(model, features, gammas)
        model = replace(model, initial=initial, transitions=transitions)
        if not ignore_eps and abs(likelihood - before) < eps:
            return model, True
        before = likelihood
    return model, False


def _expectations(blocks: segments.Blocks, models: dict[str, WordModel], mixtures: bool, scratch: Scratch, name: str) -> dict[str, np.ndarray]:
    """A word's sums over its utterances: likelihood, number, expected moves [n + 1, n] (the last row from the beginning) and, with
    ``mixtures``, size, sum and scatter about the old mean of every component. A task adds up its blocks and sends a row a word."""
    chains = {w: Chain(m.initial, m.transitions, m.emissions) for w, m in models.items()}
    told = segments.with_context(blocks, lambda values: chains[values[0]], scratch, name, rows=blocks.rows.where(F.col("word").isin(*models)))
    key, width = blocks.key, blocks.width

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for (word, *_), chain, rows, e, lengths, xs in segments.batches(key, width, lambda values: chains[values[0]], batch):
                alpha, beta, total, before = segments.smooth(chain, rows, e, lengths)
                begins = np.isfinite(before[:, -1])
                one = [np.array([total[begins].sum(), begins.sum()]), segments.moves(chain, alpha, beta, total, before, e, lengths).sum(0).ravel()]
                if mixtures:
                    gamma, x = total[:, None] - alpha - beta, np.concatenate(xs)
                    own = -np.concatenate([gamma[:n, i] for i, n in enumerate(lengths)])  # neglogs of occupancies
                    one += [_component_sums(s, own[:, i], x) for i, s in enumerate(models[word].states)]
                sums[word] = sums.get(word, 0.0) + np.concatenate(one)
        if sums:
            yield pd.DataFrame({"word": list(sums), "sums": list(sums.values())})

    parts = told.mapInPandas(work, "word string, sums array<double>")
    added = parts.select("word", F.posexplode("sums").alias("i", "v")).groupBy("word", "i").agg(F.sum("v").alias("v")).groupBy("word").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("sums"))
    return {r.word: np.array(r.sums) for r in added.collect()}  # a row a word, of a model's size


def _component_sums(state: Mixture, gamma: np.ndarray, x: np.ndarray) -> np.ndarray:
    share = np.exp(-(gamma[:, None] + state.component_nlp(x) - state.nlp(x)[:, None]))
    parts = []
    for k, mean in enumerate(state.mean):
        apart = x - mean
        parts += [share[:, k].sum()[None], share[:, k] @ x, ((share[:, k, None] * apart).T @ apart).ravel()]
    return np.concatenate(parts)


def _refitted(state: Mixture, sums: np.ndarray) -> Mixture:
    d = state.mean.shape[1]
    rows = sums.reshape(len(state.weight), 1 + d + d * d)
    size = np.maximum(rows[:, 0], 1e-300)
    scatter = rows[:, 1 + d :].reshape(-1, d, d) / size[:, None, None] + RIDGE * np.eye(d)
    return Mixture(size / size.sum(), rows[:, 1 : 1 + d] / size[:, None], scatter)


def _maximised(model: WordModel, sums: np.ndarray, mixtures: bool) -> WordModel:
    """The model of a word's sums; states that are never left keep their row."""
    n = len(model.phones)
    moved = sums[2 : 2 + (n + 1) * n].reshape(n + 1, n)
    left = moved[:n].sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        transitions = np.where(left > 0, -np.log(moved[:n] / left), model.transitions)
        initial = -np.log(moved[n] / sums[1])
    states = model.states
    if mixtures:
        sizes = [len(s.weight) * (1 + s.mean.shape[1] * (1 + s.mean.shape[1])) for s in states]
        edges = np.cumsum([2 + (n + 1) * n, *sizes])
        states = [_refitted(s, sums[a:b]) for s, a, b in zip(states, edges, edges[1:])]
    return replace(model, initial=initial, transitions=transitions, states=states)


def train_words(
    frames: DataFrame, models: dict[str, WordModel], turns: int = 100, eps: float = 1e-4, ignore_eps: bool = False, mixtures: bool = False, size: int = segments.BLOCK,
) -> dict[str, WordModel]:
    """Baum-Welch of every word's model on its utterances: (word, utt, frame_no, features) rows.

    Utterances are cut into blocks of at most ``size`` frames, which are read by every turn and may lie in any
    task, so neither a word of very many utterances nor an utterance of any length is one task's work. A word
    stops after the turn in which its likelihood moves by less than ``eps``; the others go on. With
    ``mixtures`` the states' mixtures are re-estimated too. Words without utterances keep their model.
    """
    scratch = Scratch(frames.sparkSession, "train_words")
    own = frames.where(F.col("word").isin(*models)).select(F.col("word").cast("string"), "utt", "frame_no", F.transform("features", lambda v: v.cast("double")).alias("features"))
    blocks = segments.blocks_of(own, ["word", "utt"], ["frame_no"], "features", scratch, size=size)
    out, before, active = dict(models), {}, set(models)
    for turn in range(turns):
        found = _expectations(blocks, {w: out[w] for w in sorted(active)}, mixtures, scratch, f"turn{turn}")
        for word, sums in found.items():
            out[word] = _maximised(out[word], sums, mixtures)
            if not ignore_eps and abs(sums[0] - before.get(word, INF)) < eps:
                active.discard(word)
            before[word] = sums[0]
        active &= set(found)
        if not active:
            break
    return out


def likelihoods(sequences: DataFrame, key: str, emissions: str, initial: np.ndarray, transitions: np.ndarray) -> DataFrame:
    """(key, nlp, path_cost, gamma, xi) of rows with an array of emission arrays, in one pass over each."""
    ship(sequences.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, e in batch.itertuples(index=False):
                e = np.stack(e)
                alpha, beta = forward(initial, transitions, e), backward(transitions, e)
                gamma = np.exp(-occupancy(alpha, beta)).sum(0)
                xi = np.exp(-transit(alpha, beta, transitions, e)).sum(0).ravel() if len(e) > 1 else np.zeros(len(initial) ** 2)
                rows.append((k, float(logsum(alpha[-1], 0)), float(logsum(initial + e[0] + beta[0], 0)), gamma, xi))
            yield pd.DataFrame(rows, columns=[key, "forward_nlp", "backward_nlp", "gamma", "xi"])

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.select(key, emissions).mapInPandas(work, f"{key} {kind}, forward_nlp double, backward_nlp double, gamma array<double>, xi array<double>")


def best_paths(sequences: DataFrame, key: str, emissions: str, initial: np.ndarray, transitions: np.ndarray) -> DataFrame:
    """(key, cost, path) of rows with an array of emission arrays: the Viterbi path, of equal ones the least state at each step back."""
    ship(sequences.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, e in batch.itertuples(index=False):
                e = np.stack(e)
                cost, came = initial + e[0], np.zeros((len(e), len(initial)), int)
                for t in range(1, len(e)):
                    ways = cost[:, None] + transitions
                    came[t] = ways.argmin(0)
                    cost = ways.min(0) + e[t]
                path = [int(cost.argmin())]
                for t in range(len(e) - 1, 0, -1):
                    path.append(int(came[t][path[-1]]))
                rows.append((k, float(cost.min()), path[::-1]))
            yield pd.DataFrame(rows, columns=[key, "cost", "path"])

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.select(key, emissions).mapInPandas(work, f"{key} {kind}, cost double, path array<int>")


def posteriors(sequences: DataFrame, key: str, emissions: str, initial: np.ndarray, transitions: np.ndarray) -> DataFrame:
    """(key, t, beta, gamma) of every frame: neglogs of what follows it, and probabilities of its states."""
    ship(sequences.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, e in batch.itertuples(index=False):
                e = np.stack(e)
                beta = backward(transitions, e)
                gamma = np.exp(-occupancy(forward(initial, transitions, e), beta))
                yield pd.DataFrame({key: k, "t": np.arange(len(e), dtype="int32"), "beta": list(beta), "gamma": list(gamma)})

    kind = sequences.schema[key].dataType.simpleString()
    return sequences.select(key, emissions).mapInPandas(work, f"{key} {kind}, t int, beta array<double>, gamma array<double>")


def _matrix(rows: np.ndarray) -> Column:
    return F.array(*[F.array(*map(F.lit, r)) for r in np.asarray(rows).tolist()])


def forward_sql(emissions: Column, initial: np.ndarray, transitions: np.ndarray, best: bool = False) -> Column:
    """Neglog likelihood (or, with ``best``, the Viterbi cost) of an array of emission arrays, as an expression.

    For short sequences and few states; impossible moves are a large finite number.
    """
    n = len(initial)
    finite = lambda x: np.where(np.isinf(x), 1e30, x)
    columns = _matrix(finite(transitions).T)
    combine = F.array_min if best else array_sum

    def step(state: Column, e: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.lit(n)), lambda j: combine(F.zip_with(state, F.element_at(columns, j), lambda a, b: a + b)) + F.element_at(e, j))

    first = F.zip_with(emissions[0], F.array(*map(F.lit, finite(initial).tolist())), lambda a, b: a + b)
    return combine(F.aggregate(F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0))), first, step))
