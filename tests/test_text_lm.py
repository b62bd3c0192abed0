import math
from collections import Counter

import pytest

from lexiwave.functions import neglog
from lexiwave.operators import lm, text
from lexiwave.sources import arpa
from pyspark.sql import functions as F

TRAIN = ["a b a b c a", "b a", "c c a b"]
TEST = ["a b c", "d a"]


def seqs(spark, texts):
    return text.sequences(spark.createDataFrame([(t,) for t in texts], "text string"))


def counted(n, texts=TRAIN):
    out = Counter()
    for t in texts:
        w = t.split()
        p = w if n == 1 else ["<s>"] * (n - 1) + w + ["</s>"]
        for m in range(1, n + 1):
            out.update(tuple(p[i : i + m]) for i in range(len(p) - m + 1))
    return out


def test_tokens(spark):
    df = spark.createDataFrame([("Ab1c d_e. <S> x</s>", ), (None,), ("",), ("É/ß",)], "text string")
    got = [r.t for r in df.select(text.tokens(F.col("text")).alias("t")).collect()]
    assert got == [["ab", "c", "d", "e.", "x</s>"], [], [], ["é/ß"]]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_counts(spark, n):
    got = {tuple(r.gram): r.cnt for r in text.gram_counts(seqs(spark, TRAIN), n).collect()}
    assert got == dict(counted(n))
    assert text.dropped_grams(text.gram_counts(seqs(spark, TRAIN), n)).count() == 0


@pytest.mark.parametrize("kind", ["laplace", "additive", "good_turing", "katz"])
def test_contexts_sum_to_one(spark, kind):
    model = lm.train(kind, seqs(spark, ["a b a b c a d a a b b c d e f a b", "b a c d e a a b", "c c a b"]), 2)
    words = [r.token for r in model.vocab.collect() if r.token != "<s>" or kind != "katz"]
    rows = spark.createDataFrame([("all", [h, w], 1) for h in ("a", "b") for w in words], "model string, gram array<string>, times int")
    total = Counter()
    for r in model.score(rows).collect():
        total[r.gram[0]] += math.exp(-r.nlp)
    if kind != "katz":
        assert all(abs(v - 1) < 1e-6 for v in total.values())
    assert all(v < 1 + 1e-6 for v in total.values())


def test_mle_and_perplexity(spark):
    model = lm.train("mle", seqs(spark, TRAIN), 2)
    c = counted(2)
    for r in model.probs().collect():
        g = tuple(r.gram)
        assert abs(r.nlp + math.log(c[g] / c[g[:1]])) < 1e-9
    laplace = lm.train("laplace", seqs(spark, TRAIN), 2)
    got = laplace.perplexity(seqs(spark, TEST)).first()
    v, total, number = 6, 0.0, 0
    for t in TEST:
        p = ["<s>"] + [w if w in "abc" else "<unk>" for w in t.split()] + ["</s>"]
        for g in zip(p, p[1:]):
            ctx = sum(x for k, x in c.items() if len(k) == 2 and k[0] == g[0])
            total -= math.log((c[g] + 1) / (ctx + v))
            number += 1
    assert got.windows == number and abs(got.perplexity - math.exp(total / number)) < 1e-9


def test_other_tokens(spark):
    df = spark.createDataFrame([("Ab1 c2d </s> x-y",)], "text string")
    other = text.tokens(F.col("text"), r"[a-z]+|[0-9]", keep=lambda t: t != "y")
    assert df.select(other.alias("t")).first().t == ["b", "1", "c", "2", "d", "s", "x"]
    assert df.select(text.tokens(F.col("text"), r"[\p{L}\p{N}]+").alias("t")).first().t == ["ab1", "c2d", "s", "x", "y"]


@pytest.mark.parametrize("orders", [[1], [2], [3], [1, 3], [2, 3]])
def test_counts_of_some_orders(spark, orders):
    got = {tuple(r.gram): r.cnt for r in text.gram_counts(seqs(spark, [*TRAIN, ""]), 3, orders).collect()}
    assert got == {g: c for g, c in counted(3, [*TRAIN, ""]).items() if len(g) in orders}
    with pytest.raises(ValueError):
        text.gram_counts(seqs(spark, TRAIN), 2, [3])


def test_scoring_needs_only_contexts_of_the_test(spark):
    model = lm.train("katz", seqs(spark, TRAIN), 3)
    test = lm.test_windows(seqs(spark, TEST), model.vocab, 3)
    whole = {tuple(r.gram): r.nlp for r in lm.score_katz(test, model.katz()).collect()}
    some = {tuple(r.gram): r.nlp for r in model.score(test).collect()}
    assert whole.keys() == some.keys() and all(abs(whole[g] - some[g]) < 1e-12 or whole[g] == some[g] for g in whole)
    assert model.katz(test).probs.count() < model.katz().probs.count()


@pytest.mark.parametrize("kind,n", [("laplace", 1), ("laplace", 2), ("good_turing", 1), ("good_turing", 2), ("katz", 3)])
def test_contexts_with_more_grams_than_a_task_holds(spark, kind, n, monkeypatch):
    model = lm.train(kind, seqs(spark, [*TRAIN, "c d a", "a d", "d b c"]), n)
    one_task = {(len(r.gram), *r.gram): (r.cnt, r.nlp) for r in model.probs().collect()}
    monkeypatch.setattr(lm, "WINDOW_ROWS", 2)
    assert any(v > 2 for v in Counter(g[1:-1] for g in one_task).values())
    spread = {(len(r.gram), *r.gram): (r.cnt, r.nlp) for r in model.probs().collect()}
    assert one_task.keys() == spread.keys()
    assert all(a[0] == spread[g][0] and abs(a[1] - spread[g][1]) < 1e-9 for g, a in one_task.items())


def test_bad_settings(spark):
    for k, reserved in ((0, 0.01), (5, 0.0), (5, 1.0)):
        with pytest.raises(ValueError):
            lm.train("katz", seqs(spark, TRAIN), 2, k=k, reserved=reserved)
    with pytest.raises(ValueError):
        text.search_phrase(" ")
    for kind, n, extra in (("nope", 2, 1), ("mle", 0, 1), ("additive", 2, 0)):
        with pytest.raises(ValueError):
            lm.train(kind, seqs(spark, TRAIN), n, extra)


def test_arpa_round_trip(spark, tmp_path):
    model = lm.katz(text.gram_counts(seqs(spark, TRAIN), 3), 3)
    for log10 in (False, True):
        arpa.write_arpa(arpa.arpa_lines(model.probs.drop("model"), model.backoffs.drop("model"), 3, log10), str(tmp_path / "lm"))
        lines = [x for f in sorted((tmp_path / "lm").glob("part-*.txt")) for x in f.read_text().splitlines()]
        assert lines[0] == "\\data\\" and lines[-1] == "\\end\\" and any(x.endswith("\t<unk>\t0.0") or x.endswith("\t<unk>\t-0.0") for x in lines)
        back = arpa.read_arpa(spark, str(tmp_path / "lm"), log10)
        assert back.n == 3 and abs(back.reserved - 0.01) < 1e-9
        a = {(r.ord, tuple(r.gram)): r.nlp for r in model.probs.collect()}
        b = {(r.ord, tuple(r.gram)): r.nlp for r in back.probs.collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
        test = spark.createDataFrame([("all", ["a", "b", "c"], 1), ("all", ["c", "b", "c"], 1), ("all", ["<unk>", "a", "a"], 1)], "model string, gram array<string>, times int")
        x = {tuple(r.gram): r.nlp for r in lm.score_katz(test, model).collect()}
        y = {tuple(r.gram): r.nlp for r in lm.score_katz(test, back).collect()}
        assert all(abs(x[k] - y[k]) < 1e-9 for k in x)


def test_oov(spark):
    model = lm.train("mle", seqs(spark, TRAIN), 2)
    r = model.oov_rate(seqs(spark, TEST)).first()
    new = {g for g in counted(2, TEST) if len(g) == 2}
    unseen = new - counted(2).keys()
    assert (r.unseen, r.distinct_grams) == (len(unseen), len(new))
    t = lm.token_oov_rate(seqs(spark, TEST), model.vocab).first()
    assert (t.unseen, t.total_tokens) == (1, 5)


def test_empty_corpus(spark):
    assert lm.train("katz", seqs(spark, []), 2).probs().count() == 0
    assert lm.train("laplace", seqs(spark, []), 1).probs().count() == 0


def test_phrase(spark):
    df = spark.createDataFrame([("x of the y", " Of The "), ("", ""), ("ab", "abc")], "t string, p string")
    assert [r.f for r in df.select(text.contains_phrase(F.col("t"), F.col("p")).alias("f")).collect()] == [True, True, False]


def test_one_arpa_file(spark, tmp_path):
    """One file in order, read back whole; a header that names other numbers is an error."""
    model = lm.train("katz", text.sequences(spark.createDataFrame([("a b a c a b",), ("c a b d",)], ["text"])), 3).katz()
    lines = arpa.arpa_lines(model.probs.drop("model"), model.backoffs.drop("model"), 3)
    path = tmp_path / "model.arpa"
    for _ in range(2):  # a second writing takes the place of the first
        arpa.write_arpa_file(lines.repartition(5), f"file://{path}")
    shown = path.read_text().split("\n")
    assert path.is_file() and shown[0] == "\\data\\" and shown[-2:] == ["\\end\\", ""] and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["model.arpa"]
    order = [int(x[1]) for x in shown if x.endswith("-grams:")]
    assert order == [1, 2, 3] and shown[shown.index("\\1-grams:") + 1].split("\t")[1] == "<unk>"
    back = arpa.read_arpa(spark, str(path))
    key = lambda df: sorted((r.ord, tuple(r.gram), round(r.nlp, 9)) for r in df.collect())
    assert back.n == 3 and key(back.probs) == key(model.probs)
    said = next(x for x in shown if x.startswith("ngram 2="))
    other = tmp_path / "other.arpa"
    other.write_text("\n".join(said + "1" if x == said else x for x in shown))
    with pytest.raises(ValueError, match="order 2"):
        arpa.read_arpa(spark, str(other))
    assert arpa.read_arpa(spark, str(other), check=False).n == 3


def test_sums_of_neglogs(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3000.0), ("b", 5000.0), ("b", 5000.0), ("c", float("inf")), ("c", float("inf")), (None, 2.0), (None, float("inf")), ("d", None)]
    got = {r.k: r.nlp for r in neglog.group_sums(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    want = {"a": -math.log(math.exp(-1) + math.exp(-2)), "b": 5000 - math.log(2), "c": math.inf, None: 2.0}
    assert got.keys() == want.keys() and all(got[k] == v or abs(got[k] - v) < 1e-9 for k, v in want.items())
    pair = spark.range(1).select(neglog.add(F.lit(1.0), F.lit(2.0)).alias("x"), neglog.add(neglog.inf(), neglog.inf()).alias("y")).first()
    assert abs(pair.x - want["a"]) < 1e-9 and pair.y == math.inf


def _final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_all_orders_are_made_from_one_shuffle_of_words(spark):
    seqs = spark.createDataFrame([("a", "x y z x y".split()), ("a", []), ("b", ["x"])], "model string, toks array<string>").repartition(2)
    counts = text.gram_counts(seqs, 3)
    assert _final(counts).count("Generate explode") == 1
    got = {(r.model, r.ord, tuple(r.gram)): r.cnt for r in counts.collect()}
    want = {}
    for model, toks in (("a", "x y z x y".split()), ("a", []), ("b", ["x"])):
        p = ["<s>", "<s>", *toks, "</s>"]
        for m in (1, 2, 3):
            for i in range(len(p) - m + 1):
                want[model, m, tuple(p[i : i + m])] = want.get((model, m, tuple(p[i : i + m])), 0) + 1
    assert got == want


def test_katz_gathers_no_context(spark):
    """Totals of contexts are joined to their grams, so no task holds a context's grams."""
    seqs = spark.createDataFrame([("a", [f"w{i % 7}" for i in range(j, j + 9)]) for j in range(20)], "model string, toks array<string>")
    model = lm.train("katz", seqs, 3).katz()
    assert "Window" not in _final(model.probs) and "Window" not in _final(model.backoffs)
