"""Decoding utterances into words: Viterbi and N-best search with a bigram model, and second-pass rescoring."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.scratch import Scratch
from lexiwave.functions.shipping import ship
from lexiwave.operators import lm as lms
from lexiwave.operators.hmm import WordModel, tied_emissions
from lexiwave.operators.text import END
from lexiwave.operators.trie import GramTrie

LM_SCALE, WORD_PENALTY = 15.0, 0.5
#: words of a table of all pairs
MOST_WORDS = 2000
HYPOTHESES = "utt string, rank int, cost double, words array<string>, phones array<string>"


@dataclass
class Hypothesis:
    cost: float
    words: list[str]
    phones: list[str]


class Decoder:
    """Search over word models joined by word-to-word costs ``lm[i, j]`` (neglog of word j behind word i), or by a ``GramTrie`` of any order.

    With a trie each path carries the context that its words leave, the first word is costed behind the start
    marks, and the search is by token passing; costs of words behind a context are looked up when one is met,
    so no table of all pairs is made.

    ``compat`` keeps the customs that the recognised words depend on: a word may begin in the very frame in
    which another ends, without an emission of its own; one counter of decoded words a rank scales the
    penalty of all paths; any state may be last; and a step back over a word boundary still goes back a
    frame. Without it, a new word starts in the next frame, pays its emission, and each path its own penalty.
    """

    def __init__(self, models: list[WordModel], lm: np.ndarray | GramTrie, scale: float = LM_SCALE, penalty: float = WORD_PENALTY, compat: bool = True):
        if isinstance(lm, GramTrie):
            if compat:
                raise ValueError("a trie is searched by token passing; compatible search takes bigram costs, such as the trie's pairs")
            self._ids = [lm.word(m.word) for m in models]
        elif lm.shape != (len(models), len(models)):
            raise ValueError("the search needs a bigram cost for every two words")
        self.models, self.lm, self.scale, self.penalty, self.compat = models, lm, scale, penalty, compat

    def decode(self, emissions: list[np.ndarray]) -> Hypothesis | None:
        """The best path for [T, states] emissions of every word model."""
        return next(iter(self.n_best(emissions, 1)), None)

    def n_best(self, emissions: list[np.ndarray], n: int, distinct_words: bool = False) -> list[Hypothesis]:
        """The n best state paths; with ``distinct_words`` one a word sequence."""
        if n < 1:
            raise ValueError("one hypothesis or more")
        search = self._compat if self.compat else self._passing
        found, seen = [], set()
        for h in search(emissions, n):
            if not distinct_words or tuple(h.words) not in seen:
                seen.add(tuple(h.words))
                found.append(h)
        return found

    # an entry is (cost, word, state it came from or -1, whether a word boundary, rank it came from)

    def _within(self, before: list[list[tuple]], w: int, emission: np.ndarray, n: int) -> list[list[tuple]]:
        """The n best ways into each state of a word from the frame before."""
        moves = self.models[w].transitions
        out = []
        costs = np.array([e[0] for entries in before for e in entries])
        if not len(costs):
            return [[] for _ in emission]
        state = np.repeat(np.arange(len(before)), [len(entries) for entries in before])
        rank = np.concatenate([np.arange(len(entries)) for entries in before])
        ways = costs[:, None] + moves[state] + emission[None, :]
        order = np.argsort(ways, axis=0, kind="stable")[:n]  # of equals the least state, then the least rank
        for j, best in enumerate(order.T):
            out.append([(float(ways[x, j]), w, int(state[x]), False, int(rank[x])) for x in best if np.isfinite(ways[x, j])])
        return out

    def _compat(self, emissions: list[np.ndarray], n: int) -> Iterator[Hypothesis]:
        models, steps = self.models, len(emissions[0])
        table = [[[[(c, w, -1, False, -1)] if np.isfinite(c := float(m.initial[i] + emissions[w][0, i])) else [] for i in range(len(m.phones))] for w, m in enumerate(models)]]
        ended: list[int] = []
        decoded = np.ones(n)
        for t in range(1, steps):
            now = [self._within(table[-1][w], w, emissions[w][t], n) for w in range(len(models))]
            ended += [w for w, m in enumerate(models) if w not in ended and now[w][m.end]]
            begun = np.zeros(n, bool)
            for w, m in enumerate(models) if ended else ():
                extra = [
                    (e[0] + self.lm[v, w] * self.scale - decoded[r] * np.log(self.penalty), v, models[v].end, True, r)
                    for v in ended for r, e in enumerate(now[v][models[v].end])
                ]
                old = now[w][m.begin]
                new = sorted([*old, *(e for e in extra if np.isfinite(e[0]))], key=lambda e: (e[0], e[3]))[:n]
                for r, e in enumerate(new):
                    begun[r] |= r >= len(old) or e[0] < old[r][0]
                now[w][m.begin] = new
            decoded += begun
            table.append(now)
        last = ((e[0], w, i, r) for w in range(len(models)) for i, entries in enumerate(table[-1][w]) for r, e in enumerate(entries))
        for cost, w, i, r in heapq.nsmallest(n, last):
            path, t = [(w, i, True)], steps - 1
            while t >= 0 and r < len(table[t][w][i]) and table[t][w][i][r][2] >= 0:
                _, w, i, crossed, r = table[t][w][i][r]
                path.append((w, i, crossed))
                t -= 1
            path.reverse()
            yield Hypothesis(cost, [models[v].word for v, _, c in path if c], [models[v].phones[s] for v, s, _ in path])

    def _begins(self) -> tuple[np.ndarray, list]:
        """Costs of the words as first ones, and the contexts they leave."""
        if isinstance(self.lm, GramTrie):
            return self.lm.row(self.lm.begin(), self._ids)
        return np.zeros(len(self.models)), list(range(len(self.models)))

    def _follows(self, context) -> tuple[np.ndarray, list]:
        if isinstance(self.lm, GramTrie):
            return self.lm.row(context, self._ids)
        return self.lm[context], list(range(len(self.models)))

    def _passing(self, emissions: list[np.ndarray], n: int) -> Iterator[Hypothesis]:
        """Token passing: a token is (cost, words, phones, context), and each state keeps its n best."""
        models, fee = self.models, -np.log(self.penalty)
        first, contexts = self._begins()
        now = [[[(float(m.initial[i] + emissions[w][0, i] + first[w] * self.scale), (m.word,), (m.phones[i],), contexts[w])] for i in range(len(m.phones))] for w, m in enumerate(models)]
        for t in range(1, len(emissions[0])):
            ends = [(k, *self._follows(k[3])) for v, m in enumerate(models) for k in now[v][m.end] if np.isfinite(k[0])]
            new = []
            for w, m in enumerate(models):
                states = []
                for j in range(len(m.phones)):
                    ways = [(k[0] + m.transitions[i, j], k[1], k[2], k[3]) for i in range(len(m.phones)) for k in now[w][i]]
                    if j == m.begin:
                        ways += [(k[0] + costs[w] * self.scale + fee, (*k[1], m.word), k[2], after[w]) for k, costs, after in ends]
                    cost = float(emissions[w][t, j])
                    states.append([(c + cost, a, (*b, m.phones[j]), x) for c, a, b, x in heapq.nsmallest(n, ways, key=lambda k: k[:3]) if np.isfinite(c)])
                new.append(states)
            now = new
        for c, a, b, _ in heapq.nsmallest(n, (k for w in now for s in w for k in s if np.isfinite(k[0])), key=lambda k: k[:3]):
            yield Hypothesis(c, list(a), list(b))


def recognise_arrays(utterances: DataFrame, decoder: Decoder, n: int = 1) -> DataFrame:
    """The same of (utt, frames) rows, whose frames are an array of feature arrays in order: no shuffle."""
    ship(utterances.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for utt, frames in batch.itertuples(index=False):
                yield _found(utt, np.stack(frames), decoder, n)

    return utterances.where(F.size("frames") > 0).select("utt", "frames").mapInPandas(work, HYPOTHESES)


def _found(utt: str, x: np.ndarray, decoder: Decoder, n: int) -> pd.DataFrame:
    found = decoder.n_best(tied_emissions(decoder.models, x), n)
    return pd.DataFrame({
        "utt": utt, "rank": np.arange(len(found), dtype="int32"), "cost": [h.cost for h in found], "words": [h.words for h in found], "phones": [h.phones for h in found]})


def recognise(frames: DataFrame, decoder: Decoder, n: int = 1) -> DataFrame:
    """(utt, rank, cost, words, phones) of (utt, frame_no, features): utterances are decoded side by side."""
    ship(frames.sparkSession)

    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        return _found(key[0], np.stack(rows.sort_values("frame_no")["features"].to_numpy()), decoder, n)

    return frames.select("utt", "frame_no", "features").groupBy("utt").applyInPandas(work, HYPOTHESES)


def word_costs(words: list[str], model: lms.LanguageModel) -> np.ndarray:
    """Bigram neglogs of every two words, from a bigram model: a table of at most ``MOST_WORDS`` squared; larger vocabularies take a trie."""
    if model.n != 2:
        raise ValueError("the decoder takes a bigram model")
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words; search with the model's trie")
    if model.kind == "katz":
        return GramTrie.of(model).pairs(words)
    spark = model.vocab.sparkSession
    rows = spark.createDataFrame([("all", [a, b], 1) for a in words for b in words], "model string, gram array<string>, times int")
    scored = {tuple(r.gram): r.nlp for r in model.score(rows).collect()}
    return np.array([[scored[a, b] for b in words] for a in words])


def rescore(hypotheses: DataFrame, model: lms.LanguageModel, compat: bool = False) -> DataFrame:
    """(utt, rank, words, second_cost, best): N-best word sequences under a language model of any order.

    The cost is the sum over words and the end mark; ``compat`` ranks by the end mark alone. The best has
    the least cost, and of equals the least rank.
    """
    from lexiwave.operators.text import padded, windows

    scratch = Scratch(hypotheses.sparkSession, "rescore")
    hypotheses = scratch.save(hypotheses.select("utt", "rank", "words"), "hypotheses")  # a search is not run again for each use
    n = model.n
    seq = padded(F.col("words"), n) if n > 1 else F.concat("words", F.array(F.lit(END)))
    exploded = hypotheses.select("utt", "rank", F.posexplode(windows(seq, n)).alias("pos", "gram"), F.size("words").alias("size"))
    if compat:
        exploded = exploded.where(F.col("pos") == F.col("size"))
    grams = exploded.withColumn("gram", F.col("gram")).select(F.lit("all").alias("model"), "gram", "utt", "rank")
    scored = model.score(grams.withColumn("times", F.lit(1)))
    sums = scratch.save(scored.groupBy("utt", "rank").agg(F.sum("nlp").alias("second_cost")), "sums")
    best = sums.groupBy("utt").agg(F.min(F.struct("second_cost", "rank"))["rank"].alias("best_rank"))
    return hypotheses.select("utt", "rank", "words").join(sums, ["utt", "rank"]).join(best, "utt").select(
        "utt", "rank", "words", "second_cost", (F.col("rank") == F.col("best_rank")).alias("best"))
