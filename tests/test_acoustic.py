import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiwave.operators import acoustic, cluster, decode, hmm, lm, text
from lexiwave.operators.recogniser import KATZ_FROM_FILE, Recogniser
from lexiwave.sources import arpa

from .test_speech import state, wav


def tone(hertz, seconds, rate=8000, seed=0):
    t = np.arange(int(seconds * rate)) / rate
    return np.round(8000 * np.sin(2 * np.pi * hertz * t) + np.random.default_rng(seed).normal(0, 60, len(t))).astype(int)


PHONES = {"a": 300, "b": 900, "c": 2100}
WORDS = {"low": ["a", "b"], "high": ["c", "b"]}


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    top = tmp_path_factory.mktemp("recordings")
    for phone, hertz in PHONES.items():
        (top / "phones" / f"{phone}_0").mkdir(parents=True)
        for i in range(2):
            (top / "phones" / f"{phone}_0" / f"{i}.wav").write_bytes(wav(tone(hertz, 0.3, seed=i)))
    for word, phones in WORDS.items():
        (top / "words" / f"of-{word}" / "dataset").mkdir(parents=True)
        (top / "words" / f"of-{word}" / "topology.txt").write_text(" ".join([word, *phones]))
        for i in range(2):
            sound = np.concatenate([tone(PHONES[p], 0.2, seed=5 + i) for p in phones])
            (top / "words" / f"of-{word}" / "dataset" / f"{i}.wav").write_bytes(wav(sound))
    (top / "heard").mkdir()
    for name, words in (("x", ["low"]), ("y", ["high"]), ("z", ["low", "high"])):
        (top / "heard" / f"{name}.wav").write_bytes(wav(np.concatenate([tone(PHONES[p], 0.2, seed=9) for w in words for p in WORDS[w]])))
    (top / "corpus.txt").write_text("low high low\nhigh high low")
    return str(top)


def test_from_folders_to_words(spark, recordings, tmp_path):
    r = Recogniser(spark).train(f"{recordings}/words", f"{recordings}/phones", turns=5)
    assert [m.word for m in r.models] == ["high", "low"] and r.models[1].phones == ["a_0", "b_0"]
    r.save(str(tmp_path / "models"))
    again = Recogniser(spark).restore(str(tmp_path / "models"))
    for a, b in zip(r.models, again.models):
        assert a.word == b.word and a.phones == b.phones and np.allclose(a.transitions, b.transitions) and np.allclose(a.initial, b.initial)
        assert all(np.allclose(x.mean, y.mean) and np.allclose(x.covariance, y.covariance) for x, y in zip(a.states, b.states))
    model = r.language_model("laplace", 2, f"{recordings}/corpus.txt")
    again.use(model)
    got = {row.utt.rsplit("/", 1)[1]: row.words for row in again.decode(f"{recordings}/heard", compat=False).collect()}
    assert got["x.wav"][0] == "low" and got["y.wav"][0] == "high" and got["z.wav"] == ["low", "high"]
    again.use(model, again.language_model("additive", 3, f"{recordings}/corpus.txt"), n_best=3)
    second = again.decode(f"{recordings}/heard", compat=False)
    assert second.count() == 3 and again.search(second, " Low ").count() >= 1
    pair = again.perplexity(f"{recordings}/corpus.txt")
    assert all(p > 1 for p in pair) and again.oov_rate(f"{recordings}/corpus.txt") == (0.0, 0.0)
    for bad in (lambda: again.use(again.rescore_lm), lambda: again.use(model, model, 1), lambda: again.search(second, "  "), lambda: again.language_model(KATZ_FROM_FILE), lambda: again.language_model("mle"), lambda: Recogniser(spark).decode("x")):
        with pytest.raises(ValueError):
            bad()


def test_model_from_a_file(spark, recordings, tmp_path):
    model = Recogniser(spark).language_model("katz", 2, f"{recordings}/corpus.txt")
    trained = model.katz()
    arpa.write_arpa(arpa.arpa_lines(trained.probs.drop("model"), trained.backoffs.drop("model"), 2), str(tmp_path / "lm"))
    back = Recogniser(spark).language_model(KATZ_FROM_FILE, arpa_path=str(tmp_path / "lm"))
    seqs = text.sequences(spark.createDataFrame([("low low high other",)], ["text"]))
    a, b = model.perplexity(seqs).first(), back.perplexity(seqs).first()
    assert back.n == 2 and a.windows == b.windows and abs(a.perplexity - b.perplexity) < 1e-6
    assert back.probs().count() == trained.probs.count() and back.oov_rate(seqs).first().unseen == model.oov_rate(seqs).first().unseen


def test_mixtures_begin_and_phones(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.2, (40, 2)), rng.normal(3, 0.2, (60, 2))])
    df = spark.createDataFrame([(i, r.tolist(), "p" if i % 2 else "q") for i, r in enumerate(x)], "id int, x array<double>, phone string")
    got = cluster.mixture_start(df, 2)
    assert np.allclose(sorted(got.weight), [0.4, 0.6]) and np.allclose(sorted(got.mean[:, 0]), [x[:40, 0].mean(), x[40:, 0].mean()])
    some = cluster.mixture_start(df, 3, "random")
    assert np.allclose(some.weight, 1 / 3) and np.allclose(some.covariance[1], np.cov(x.T)) and all(m.tolist() in x.tolist() for m in some.mean)
    phones = acoustic.phone_mixtures(df.select("phone", F.col("x").alias("features")))
    assert np.allclose(phones["q"].mean[0], x[::2].mean(0)) and np.allclose(phones["q"].covariance[0], np.cov(x[::2].T, ddof=0) + 1e-5 * np.eye(2))
    for bad in (lambda: cluster.mixture_start(df, 2, "none"), lambda: cluster.kmeans(df.limit(1), 2), lambda: cluster.kmeans(df, 0), lambda: cluster.mixture_start(df.limit(1), 2, "random"), lambda: acoustic.monophone("w", ["p"], phones)):
        with pytest.raises(ValueError):
            bad()


def test_report_and_densities(spark):
    model = hmm.WordModel("w", ["a", "b"], [state(0), state(4)])
    said = acoustic.report(model, True, mixtures=True)
    assert "HMM w" in said and "converged" in said and "states: 2 (a b)" in said and "means" in said and "0.5" in said
    assert "inf" in acoustic.report(model, logs=True)
    grid = acoustic.density_grid(spark, model, -1, 1, 0.5).collect()
    assert len(grid) == 10 and abs(next(r.density for r in grid if r.state == 0 and r.x == 0) - 1 / np.sqrt(2 * np.pi)) < 1e-12
    flat = cluster.Mixture(np.ones(1), np.zeros((1, 2)), np.eye(2)[None])
    with pytest.raises(ValueError):
        acoustic.density_grid(spark, hmm.WordModel("w", ["a"], [flat]))


def test_training_of_mixtures():
    rng = np.random.default_rng(5)
    two = lambda a, b: cluster.Mixture(np.array([0.5, 0.5]), np.array([[a], [b]]), np.ones((2, 1, 1)))
    model = hmm.WordModel("w", ["a", "b"], [two(-1.0, 1.0), two(3.0, 6.0)])
    seqs = [np.concatenate([rng.normal(0, 1.5, (6, 1)), rng.normal(5, 1, (8, 1))]) for _ in range(3)]
    gammas = []
    for x in seqs:
        e = model.emissions(x)
        alpha, beta = hmm.forward(model.initial, model.transitions, e), hmm.backward(model.transitions, e)
        gammas.append(hmm.occupancy(alpha, beta))
    new = hmm.refit_mixtures(model, seqs, gammas)
    x, g = np.concatenate(seqs), np.exp(-np.concatenate(gammas))
    for i, s in enumerate(model.states):  # sums over frames, component by component
        each = np.exp(-s.component_nlp(x))
        share = g[:, i : i + 1] * each / each.sum(1, keepdims=True)
        assert np.allclose(new.states[i].weight, share.sum(0) / g[:, i].sum())
        for k in range(2):
            assert np.allclose(new.states[i].mean[k], (share[:, k] @ x) / share[:, k].sum())
            assert np.allclose(new.states[i].covariance[k], (share[:, k] * (x[:, 0] - s.mean[k, 0]) ** 2).sum() / share[:, k].sum() + 1e-5)
    score = lambda m: sum(float(hmm.logsum(hmm.forward(m.initial, m.transitions, m.emissions(s))[-1], 0)) for s in seqs)
    trained, _ = hmm.baum_welch(model, [], turns=8, features=seqs)
    assert score(trained) < score(hmm.baum_welch(model, [model.emissions(s) for s in seqs], turns=8)[0]) < score(model)


def enumerated(models, emissions, lm_costs, scale, compat):
    """Costs of all paths, frame by frame; without a penalty, so compatible counters do not matter."""
    steps, out = len(emissions[0]), []
    reached = [None] * len(models)  # the first frame a word can have ended in, not counting frame 0
    for w, m in enumerate(models):
        cost = m.initial + emissions[w][0]
        for t in range(1, steps):
            cost = (cost[:, None] + m.transitions).min(0) + emissions[w][t]
            if reached[w] is None and np.isfinite(cost[m.end]):
                reached[w] = t

    def go(t, w, i, cost, fresh):
        if not np.isfinite(cost):
            return
        m = models[w]
        if compat and not fresh and t > 0 and i == m.end and reached[w] is not None and t >= reached[w]:
            for v, other in enumerate(models):  # another word begins in this very frame
                go(t, v, other.begin, cost + lm_costs[w, v] * scale, True)
        if t == steps - 1:
            out.append(cost)
            return
        for j in range(len(m.phones)):
            go(t + 1, w, j, cost + m.transitions[i, j] + emissions[w][t + 1, j], False)
        if not compat and i == m.end:
            for v, other in enumerate(models):
                go(t + 1, v, other.begin, cost + lm_costs[w, v] * scale + emissions[v][t + 1, other.begin], False)

    for w, m in enumerate(models):
        for i in range(len(m.phones)):
            go(0, w, i, m.initial[i] + emissions[w][0, i], False)
    return sorted(out)


@pytest.mark.parametrize("compat", [True, False])
def test_search_against_all_paths(compat):
    rng = np.random.default_rng(6)
    for _ in range(4):
        models = []
        for word, n in (("u", 2), ("v", 3)):
            moves = np.triu(rng.dirichlet(np.ones(n), n))
            moves = -np.log(np.maximum(moves / moves.sum(1, keepdims=True), 0) + np.where(moves > 0, 0, 0.0) + 1e-300)
            moves[moves > 600] = np.inf
            models.append(hmm.WordModel(word, list("abc"[:n]), [], moves))
        emissions = [rng.uniform(0, 3, (5, len(m.phones))) for m in models]
        costs = rng.uniform(0.1, 1, (2, 2))
        decoder = decode.Decoder(models, costs, scale=1.5, penalty=1.0, compat=compat)
        expect = enumerated(models, emissions, costs, 1.5, compat)
        got = [h.cost for h in decoder.n_best(emissions, 10_000)]
        assert len(got) == len(expect) and np.allclose(got, expect)
        assert np.allclose([h.cost for h in decoder.n_best(emissions, 4)][0], expect[0])
    with pytest.raises(ValueError):
        decoder.n_best(emissions, 0)


def test_runs_of_kmeans_share_their_passes(spark, monkeypatch):
    rows = [(i, [float((i * 7) % 13), float((i * i) % 11)]) for i in range(60)]
    points, passes = spark.createDataFrame(rows, "id long, x array<double>"), []
    monkeypatch.setattr(cluster, "_lloyd_sums", lambda v, centres, run=cluster._lloyd_sums: (passes.append(sorted(centres)), run(v, centres))[1])
    got = cluster.kmeans(points, 3, turns=4, attempts=3)
    assert len(passes) <= 4 and passes[0] == [0, 1, 2]
    alone = [cluster.kmeans(points, 3, turns=4, start=c) for c in _starts(points, 3, 3)]
    assert min(a.sse for a in alone) == pytest.approx(got.sse)


def _starts(points, k, attempts):
    some = np.array([r.x for r in points.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(k * attempts * 4).collect()])
    rng = np.random.default_rng(0)
    return [some[rng.permutation(len(some))[:k]] for _ in range(attempts)]
