import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiwave.functions.scratch import Scratch
from lexiwave.operators import cluster, hmm, segments


def chain(seed, n=3, symbols=4):
    rng = np.random.default_rng(seed)
    moves = rng.dirichlet(np.ones(n), n)
    moves[0, 1] = 0
    moves[0] /= moves[0].sum()
    emit = -np.log(rng.dirichlet(np.ones(symbols), n))
    with np.errstate(divide="ignore"):
        return segments.Chain(-np.log(rng.dirichlet(np.ones(n))), -np.log(moves), lambda x: emit[:, x[:, 0].astype(int)].T)


ONE, TWO = chain(1), chain(2, n=2)


def of(values):
    return TWO if values[0] == "b" else ONE


def rows(lengths, seed=0):
    rng = np.random.default_rng(seed)
    return {k: rng.integers(0, 4, n) for k, n in lengths.items()}


@pytest.mark.parametrize("size", [1, 3, 7, 64, 5000])
def test_blocks_of_any_size_give_one_result(spark, size):
    obs = rows({("a", 1): 1, ("a", 2): 2, ("b", 1): 90, ("c", None): 61, ("a", 3): 7, ("b", 7): 200})
    data = spark.createDataFrame([(*k, i, [float(o)]) for k, xs in obs.items() for i, o in enumerate(xs)] + [("z", 0, 0, None)], "w string, u int, i int, x array<double>")
    scratch = Scratch(spark, "t")
    blocks = segments.blocks_of(data.repartition(3), ["w", "u"], ["i"], "x", scratch, size=size)
    assert blocks.cut == (size < 200) and blocks.rows.where(F.size("x") > size).count() == 0
    nlp = {(r.w, r.u): r.nlp for r in segments.likelihoods(blocks, of, scratch).collect()}
    post = {(r.w, r.u, r.t): r for r in segments.posteriors(blocks, of, scratch).collect()}
    path = {(r.w, r.u, r.t): (r.state, r.cost) for r in segments.best_paths(blocks, of, scratch).collect()}
    assert nlp.keys() == obs.keys() and len(post) == len(path) == sum(map(len, obs.values()))
    for k, xs in obs.items():
        c = of(k)
        e = c.emit(xs[:, None])
        alpha, beta = hmm.forward(c.initial, c.transitions, e), hmm.backward(c.transitions, e)
        gamma = np.exp(-hmm.occupancy(alpha, beta))
        assert np.isclose(nlp[k], hmm.logsum(alpha[-1], 0))
        cost, came = c.initial + e[0], []
        for t in range(1, len(e)):
            ways = cost[:, None] + c.transitions
            came.append(ways.argmin(0))
            cost = ways.min(0) + e[t]
        best = [int(cost.argmin())]
        for back in came[::-1]:
            best.append(int(back[best[-1]]))
        for t in range(len(xs)):
            assert np.allclose(post[(*k, t)].beta, beta[t]) and np.allclose(post[(*k, t)].gamma, gamma[t])
            assert path[(*k, t)][0] == best[::-1][t] and np.isclose(path[(*k, t)][1], cost.min())


def test_one_long_sequence_is_many_pieces(spark):
    data = spark.range(200_000).select(F.lit("a").alias("w"), F.lit(1).alias("u"), F.col("id").alias("i"), F.array((F.xxhash64("id") % 4 + 4).cast("int") % 4).cast("array<double>").alias("x"))
    scratch = Scratch(spark, "t")
    blocks = segments.blocks_of(data, ["w", "u"], ["i"], "x", scratch, size=1000)
    assert blocks.rows.select("piece").distinct().count() > 2 and blocks.rows.count() >= 200
    nlp = segments.likelihoods(blocks, of, scratch).first().nlp
    path = segments.best_paths(blocks, of, scratch).agg(F.count("*"), F.countDistinct("t"), F.max("t"), F.max("cost"), F.min("cost")).first()
    assert path[:3] == (200_000, 200_000, 199_999) and path[3] == path[4] > nlp
    x = np.array([r.x for r in data.orderBy("i").select("x").collect()])
    e, c = ONE.emit(x), ONE
    assert np.isclose(nlp, hmm.logsum(hmm.forward(c.initial, c.transitions, e)[-1], 0))


def test_empty_and_unequal(spark):
    none = spark.createDataFrame([], "w string, u int, i int, x array<double>")
    scratch = Scratch(spark, "t")
    blocks = segments.blocks_of(none, ["w", "u"], ["i"], "x", scratch)
    assert not blocks.cut and segments.best_paths(blocks, of, scratch).count() == segments.likelihoods(blocks, of, scratch).count() == 0
    with pytest.raises(ValueError):
        segments.blocks_of(spark.createDataFrame([("a", 1, 1, [1.0]), ("a", 1, 2, [1.0, 2.0])], none.schema), ["w", "u"], ["i"], "x", scratch, "bad")


def utterances(words, seed=0, dims=2):
    rng = np.random.default_rng(seed)
    return {(w, u): np.concatenate([rng.normal(m, 0.7, (rng.integers(2, 12), dims)) for m in means]) for w, (n, means) in words.items() for u in range(n)}


def mixture(*means):
    return cluster.Mixture(np.full(len(means), 1 / len(means)), np.array([[float(m)] * 2 for m in means]), np.repeat(np.eye(2)[None], len(means), 0))


def as_frames(spark, seqs):
    return spark.createDataFrame([(w, u, t, x.tolist()) for (w, u), xs in seqs.items() for t, x in enumerate(xs)], "word string, utt int, frame_no int, features array<double>")


@pytest.mark.parametrize("size,mixtures", [(4096, True), (5, True), (1, False), (8, False)])
def test_training_equals_one_machine(spark, size, mixtures):
    seqs = utterances({"w": (7, (0, 4)), "v": (3, (2, -3, 1)), "other": (1, (0,))})
    models = {"w": hmm.WordModel("w", ["a", "b"], [mixture(0, 1), mixture(3, 5)]), "v": hmm.WordModel("v", ["a", "b", "c"], [mixture(2), mixture(-2), mixture(0)]), "none": hmm.WordModel("none", ["a"], [mixture(0)])}
    frames = as_frames(spark, seqs).repartition(3)
    got = hmm.train_words(frames, models, turns=3, ignore_eps=True, mixtures=mixtures, size=size)
    assert got.keys() == models.keys() and got["none"] is models["none"]
    for w in ("w", "v"):
        own = [x for (v, _), x in seqs.items() if v == w]
        want, _ = hmm.baum_welch(models[w], [models[w].emissions(x) for x in own], turns=3, ignore_eps=True, features=own if mixtures else None)
        assert np.allclose(np.exp(-got[w].transitions), np.exp(-want.transitions)) and np.allclose(np.exp(-got[w].initial), np.exp(-want.initial))
        for a, b in zip(got[w].states, want.states):
            assert np.allclose(a.weight, b.weight) and np.allclose(a.mean, b.mean) and np.allclose(a.covariance, b.covariance)


def test_words_stop_by_themselves(spark):
    seqs = utterances({"w": (4, (0, 4)), "v": (1, (2,))})
    models = {w: hmm.WordModel(w, ["a", "b"], [mixture(0), mixture(4)]) for w in "wv"}
    got = hmm.train_words(as_frames(spark, seqs), models, turns=60)
    for w in "wv":
        own = [models[w].emissions(x) for (v, _), x in seqs.items() if v == w]
        want, done = hmm.baum_welch(models[w], own, turns=60)
        assert done and np.allclose(np.exp(-got[w].transitions), np.exp(-want.transitions))


def test_a_word_of_many_utterances_is_many_tasks(spark):
    """A thousand utterances: blocks lie in several tasks, each of which sends one row of sums."""
    seqs = utterances({"w": (1000, (0, 4))}, seed=3)
    model = hmm.WordModel("w", ["a", "b"], [mixture(0), mixture(3)])
    frames = as_frames(spark, seqs)
    blocks = segments.blocks_of(frames, ["word", "utt"], ["frame_no"], "features", Scratch(spark, "t"))
    assert not blocks.cut and blocks.rows.count() == 1000
    got = hmm.train_words(frames, {"w": model}, turns=2, ignore_eps=True, mixtures=True)["w"]
    want, _ = hmm.baum_welch(model, [model.emissions(x) for x in seqs.values()], turns=2, ignore_eps=True, features=list(seqs.values()))
    assert np.allclose(np.exp(-got.transitions), np.exp(-want.transitions)) and np.allclose(got.states[1].mean, want.states[1].mean)


def test_tied_states_are_scored_once(monkeypatch):
    x = np.random.default_rng(0).normal(size=(6, 2))
    models = [hmm.WordModel("w", ["a", "b"], [mixture(0), mixture(3)]), hmm.WordModel("v", ["b", "a", "b"], [mixture(3), mixture(0), mixture(3)])]
    want = [np.stack([s.nlp(x) for s in m.states], axis=1) for m in models]
    calls, score = [], cluster.Mixture.nlp
    monkeypatch.setattr(cluster.Mixture, "nlp", lambda self, x: calls.append(1) or score(self, x))
    got = hmm.tied_emissions(models, x)
    assert len(calls) == 2 and all((a == b).all() for a, b in zip(got, want))


def test_paths_of_equal_cost_are_told_apart_as_step_by_step(spark, tmp_path):
    """Many ways cost the same here; sums of blocks in another order would differ in their last digits."""
    rng = np.random.default_rng(5)
    initial, moves = -np.log([0.3, 0.3, 0.4]), -np.log([[0.4, 0.3, 0.3], [0.3, 0.4, 0.3], [0.3, 0.3, 0.4]])
    emit = -np.log([[0.6, 0.2, 0.2], [0.2, 0.6, 0.2], [0.2, 0.2, 0.6]])
    found = {u: rng.integers(0, 3, 40) for u in range(40)}
    steps = spark.createDataFrame([(u, t, [float(o)]) for u, os in found.items() for t, o in enumerate(os)], "u long, t long, x array<double>")
    chain = segments.Chain(initial, moves, lambda x: emit[:, x[:, 0].astype(int)].T)
    scratch = Scratch(spark, "ties")
    blocks = segments.blocks_of(steps, ["u"], ["t"], "x", scratch, size=5)
    got = {}
    for r in segments.best_paths(blocks, lambda _: chain, scratch).collect():
        got.setdefault(r.u, {})[r.t] = (r.state, r.cost)
    rows = spark.createDataFrame([(u, emit[:, os].T.tolist()) for u, os in found.items()], "u long, e array<array<double>>")
    for r in hmm.best_paths(rows, "u", "e", initial, moves).collect():
        assert [got[r.u][t][0] for t in range(40)] == list(r.path) and {c for _, c in got[r.u].values()} == {r.cost}
