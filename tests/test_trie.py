import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiwave.operators import decode, hmm, lm, text, trie
from lexiwave.operators.trie import GramTrie

from .test_speech import state

CORPUS = ["low high low mid low high", "high high low mid mid", "mid low"]


def katz(spark, n):
    return lm.train("katz", text.sequences(spark.createDataFrame([(t,) for t in CORPUS], ["text"])), n)


def joined(spark, model, seqs):
    """Costs of sequences' words by joins, the end mark's left out."""
    rows = spark.createDataFrame([(i, list(s)) for i, s in enumerate(seqs)], "id int, words array<string>")
    known = {r.token for r in model.vocab.collect()}
    rows = rows.select("id", F.transform("words", lambda w: F.when(w.isin(*known), w).otherwise(text.UNKNOWN)).alias("words"))
    grams = rows.select("id", F.posexplode(text.windows(text.padded(F.col("words"), model.n) if model.n > 1 else F.col("words"), model.n)).alias("at", "gram"), F.size("words").alias("size")).where("at < size")
    out = model.score(grams.select(F.lit("all").alias("model"), "gram", "id", F.lit(1).alias("times"))).groupBy("id").agg(F.sum("nlp").alias("c")).collect()
    return {tuple(seqs[r.id]): r.c for r in out}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_trie_equals_joins(spark, n):
    model = katz(spark, n)
    trie = GramTrie.of(model)
    seqs = list(itertools.product(["low", "high", "mid", "new"], repeat=4))
    want = joined(spark, model, seqs)
    for s in seqs:
        now, total = trie.begin(), 0.0
        for w in s:
            cost, now = trie.step(now, trie.word(w))
            total += cost
        assert np.isclose(total, want[s])
    assert trie.n == n and len(trie.levels[-1].key) == model.katz().probs.where(F.col("ord") == n).count()


def test_bounds(spark):
    model = katz(spark, 2)
    with pytest.raises(ValueError, match="joins"):
        GramTrie.of(model, most=3)
    with pytest.raises(ValueError):
        GramTrie.of(lm.train("laplace", text.sequences(spark.createDataFrame([("a b",)], ["text"])), 2))
    with pytest.raises(ValueError):
        decode.word_costs(["w"] * (decode.MOST_WORDS + 1), model)
    words = ["low", "high", "mid"]
    pairs = joined_pairs(spark, model, words)
    assert np.allclose(decode.word_costs(words, model), pairs)
    trie = GramTrie.of(model)
    rows = [trie.row(trie.begin(), [0, 1], remembered=2) for _ in range(3)]
    assert all((r[0] == rows[0][0]).all() for r in rows)


def joined_pairs(spark, model, words):
    rows = spark.createDataFrame([("all", [a, b], 1) for a in words for b in words], "model string, gram array<string>, times int")
    got = {tuple(r.gram): r.nlp for r in model.score(rows).collect()}
    return np.array([[got[a, b] for b in words] for a in words])


@pytest.mark.parametrize("n", [2, 3])
def test_search_with_a_trie_equals_all_paths(spark, n):
    """Every path of a small search, its words costed by joins, against the tokens that pass by the trie."""
    model = katz(spark, n)
    models = [hmm.WordModel(w, [w[0]], [state(x)]) for w, x in (("low", 0), ("high", 2), ("mid", 4))]
    x = np.array([[0.0], [2.1], [3.0], [0.4]])
    e = [m.emissions(x) for m in models]
    paths = []
    for first in range(3):
        for rest in itertools.product([None, 0, 1, 2], repeat=3):  # stay, or go over to a word
            words, now, cost = [models[first].word], first, e[first][0, 0]
            for t, w in enumerate(rest, 1):
                if w is not None:
                    now, cost = w, cost - np.log(0.5)
                    words.append(models[w].word)
                cost += e[now][t, 0]
            paths.append((cost, tuple(words)))
    want = joined(spark, model, sorted({w for _, w in paths}))
    every = sorted((c + 2.0 * want[w], w) for c, w in paths)
    got = decode.Decoder(models, GramTrie.of(model), scale=2.0, penalty=0.5, compat=False).n_best(e, len(paths))
    assert np.allclose([h.cost for h in got], [c for c, _ in every]) and tuple(got[0].words) == every[0][1]
    with pytest.raises(ValueError):
        decode.Decoder(models, GramTrie.of(model))
    frames = spark.createDataFrame([("u", t, v.tolist()) for t, v in enumerate(x)], "utt string, frame_no int, features array<double>")
    best = decode.recognise(frames, decode.Decoder(models, GramTrie.of(model), scale=2.0, compat=False), 1).first()
    assert tuple(best.words) == every[0][1] and np.isclose(best.cost, every[0][0])


def test_steps_of_a_trie_are_remembered(spark):
    """However few are kept, the costs are the same; a step that is kept is not looked up again."""
    model = lm.train("katz", text.sequences(spark.createDataFrame([("a b a c b a",)], "text string")), 3)
    held = trie.GramTrie.of(model)
    calls = spark.sparkContext.accumulator(0)

    class Counting(trie.GramTrie):
        def step(self, state, word):
            calls.add(1)
            return trie.GramTrie.step(self, state, word)

    seqs = spark.createDataFrame([("m", ["a", "b", "z"])] * 50, "model string, toks array<string>").coalesce(1)
    got = [tuple(r) for r in trie.scored(seqs, Counting(held.words, held.levels)).collect()]
    assert calls.value == 4 and got == [tuple(r) for r in trie.scored(seqs, held, remembered=1).collect()]
