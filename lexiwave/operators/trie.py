"""A back-off language model as a compact trie, which every executor may hold while it searches.

Grams of one order are a level: sorted keys (node of all words but the last, last word), costs, back-off
weights of the gram as a context, and links to the gram without its first word. Levels are arrays, so a
million grams are some tens of megabytes. A model with more grams than a stated number is not sent; scoring
by joins has no such bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship
from lexiwave.operators import lm as lms
from lexiwave.operators.text import END, START, UNKNOWN

MOST_GRAMS = 1_000_000

#: (level, node): the longest context of a history that the model knows; level 0 is no context
State = tuple[int, int]


@dataclass
class Level:
    key: np.ndarray
    cost: np.ndarray
    weight: np.ndarray
    link: np.ndarray

    def find(self, key: np.ndarray) -> np.ndarray:
        """Nodes of keys, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1) if len(self.key) else np.full(np.shape(key), -1)


class GramTrie:
    def __init__(self, words: list[str], levels: list[Level]):
        self.words, self.levels = words, levels
        self.ids = {w: i for i, w in enumerate(words)}
        self._rows: dict[State, tuple[np.ndarray, list[State]]] = {}

    @property
    def n(self) -> int:
        return len(self.levels)

    @classmethod
    def of(cls, model: lms.LanguageModel, most: int = MOST_GRAMS) -> "GramTrie":
        """The trie of a Katz model, trained or restored, of one corpus; more than ``most`` grams are an error."""
        if model.kind != "katz":
            raise ValueError("a trie holds a model that backs off")
        tables = model.katz()
        probs = tables.probs.select("ord", "gram", "nlp")
        if probs.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} grams; score by joins instead")
        own = probs.toPandas()
        weights = tables.backoffs.select((F.col("ord") - 1).alias("ord"), "ctx", "nla").toPandas()
        words = sorted({g[0] for g in own.loc[own["ord"] == 1, "gram"]})
        out = cls(words, [])
        for m in range(1, model.n + 1):
            grams = own[own["ord"] == m]
            ids = np.array([[out.ids[w] for w in g] for g in grams["gram"]], np.int64).reshape(-1, m)
            key = out._nodes(ids[:, :-1]) * len(words) + ids[:, -1] if m > 1 else ids[:, 0]
            if (key < 0).any() or len(set(key.tolist())) < len(key):
                raise ValueError(f"grams of order {m} lack their contexts, or are of several models")
            order = np.argsort(key)
            link = out._nodes(ids[order, 1:]) if m > 1 else np.zeros(len(key), np.int64)
            out.levels.append(Level(key[order], grams["nlp"].to_numpy(float)[order], np.zeros(len(key)), link))
        for m in range(1, model.n):
            some = weights[weights["ord"] == m]
            ids = np.array([[out.ids.get(w, -1) for w in c] for c in some["ctx"]], np.int64).reshape(-1, m)
            node = out._nodes(ids)
            out.levels[m - 1].weight[node[node >= 0]] = some["nla"].to_numpy(float)[node >= 0]
        return out

    def _nodes(self, grams: np.ndarray) -> np.ndarray:
        """Nodes of grams [k, m] of word ids, -1 where the model has none."""
        node = np.zeros(len(grams), np.int64)
        for i in range(grams.shape[1]):
            found = self.levels[i].find(node * len(self.words) + grams[:, i] if i else grams[:, i])
            node = np.where((node >= 0) & (grams[:, i] >= 0), found, -1)
        return node

    def word(self, w: str) -> int:
        """The number of a word, of an unknown one that of the unknown mark."""
        return self.ids.get(w, self.ids.get(UNKNOWN, -1))

    def begin(self) -> State:
        """The state of a history of start marks alone."""
        state: State = (0, 0)
        for _ in range(self.n - 1):
            node = self._nodes(np.full((1, state[0] + 1), self.ids.get(START, -1)))[0]
            if node < 0:
                break
            state = (state[0] + 1, int(node))
        return state

    def step(self, state: State, word: int) -> tuple[float, State]:
        """The cost of a word behind a state, and the state behind it."""
        level, node, carried = *state, 0.0
        while True:
            at = int(self.levels[level].find(np.array([node * len(self.words) + word if level else word]))[0]) if word >= 0 else -1
            if at >= 0:
                known = self.levels[level]
                return carried + float(known.cost[at]), (level + 1, at) if level + 1 < self.n else (level, int(known.link[at]))
            if not level:
                return np.inf, (0, 0)
            context = self.levels[level - 1]
            carried += float(context.weight[node])
            level, node = level - 1, int(context.link[node])

    def row(self, state: State, words: list[int], remembered: int = 4096) -> tuple[np.ndarray, list[State]]:
        """Costs of some words behind a state, always the same words, and the states behind them; remembered for a number of states."""
        if state not in self._rows:
            if len(self._rows) >= remembered:
                self._rows.clear()
            steps = [self.step(state, w) for w in words]
            self._rows[state] = np.array([c for c, _ in steps]), [s for _, s in steps]
        return self._rows[state]

    def pairs(self, words: list[str]) -> np.ndarray:
        """[words, words] costs of a word behind another alone, for a search by bigrams."""
        ids = [self.word(w) for w in words]
        return np.array([[self.step(self.step((0, 0), a)[1], b)[0] for b in ids] for a in ids]).reshape(len(ids), len(ids))


def scored(seqs: DataFrame, trie: GramTrie, remembered: int = 200_000) -> DataFrame:
    """(model, windows, nlp) of (model, toks): each sequence's words and end mark, costed where the rows lie, without a shuffle.

    Steps are remembered, up to a number of them.
    """
    ship(seqs.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[State, int], tuple[float, State]] = {}
        begin, unknown = trie.begin(), trie.word(UNKNOWN)
        for batch in batches:
            rows = []
            for model, toks in batch.itertuples(index=False):
                now, total = begin, 0.0
                for w in (*toks, END):
                    at = now, trie.ids.get(w, unknown)
                    found = known.get(at)
                    if found is None:
                        if len(known) >= remembered:
                            known.clear()
                        found = known[at] = trie.step(*at)
                    cost, now = found
                    total += cost
                rows.append((model, len(toks) + 1, total))
            yield pd.DataFrame(rows, columns=["model", "windows", "nlp"])

    return seqs.select("model", "toks").mapInPandas(work, "model string, windows long, nlp double")
