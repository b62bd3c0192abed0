"""Katz trigram tables from one shuffle, against those that are joined from counts."""

import math
import random

import pyarrow as pa
import pytest

from lexiwave.operators import lm, text, triples
from lexiwave.plans import catalogue


def corpus(spark, n=60):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["the"] * 25 + ["of"] * 12 + ["<unk>", "</s>x", "é"]
    rows = [(m, [rng.choice(words) for _ in range(rng.randrange(25))]) for m in ("a", "b", "ü") for _ in range(n)]
    rows += [("a", ["the", "of", "the", "w1"])] * 30 + [("lone", ["once"]), ("none", []), (None, ["x"])]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "model string, toks array<string>").repartition(3)


def same(left, right):
    return left.keys() == right.keys() and all(x == y or abs(x - y) < 1e-9 * max(1, abs(y)) for x, y in ((left[k], right[k]) for k in left))


#: numbers for all, for some and for none; words dealt by themselves and by the next; pieces of all sizes
LIMITS = [{}, {"WORDS": 9, "MODELS": 2, "SHARE": 30, "PIECE": 40, "CHUNK": 50, "GIVEN": 7}, {"WORDS": 1, "MODELS": 1, "LOOKED_UP": 20, "SHARE": 10**6}, {"WORDS": 30, "LOOKED_UP": 20, "GROUP": 40, "PIECE": 1, "CHUNK": 1}]


@pytest.mark.parametrize("k,limits", [(5, LIMITS[0]), (2, LIMITS[1]), (5, LIMITS[1]), (5, LIMITS[2]), (5, LIMITS[3])])
def test_tables_equal_those_of_joins(spark, monkeypatch, k, limits):
    for name, value in limits.items():
        monkeypatch.setattr(triples, name, value)
    seqs = corpus(spark)
    want = lm.katz(text.gram_counts(seqs.where("model is not null"), 3), 3, k)
    rows = triples.probs(seqs, k).collect()
    got = {(r.model, r.ord, tuple(r.gram)): r.nlp for r in rows}
    assert len(got) == len(rows) and same(got, {(r.model, r.ord, tuple(r.gram)): r.nlp for r in want.probs.collect()})
    assert {(r.model, tuple(r.gram)): r.cnt for r in rows} == {(r.model, tuple(r.gram)): r.cnt for r in want.probs.collect()}
    rows = triples.backoffs(seqs, k).collect()
    got = {(r.model, r.ord, tuple(r.ctx)): r.nla for r in rows}
    assert len(got) == len(rows) and same(got, {(r.model, r.ord, tuple(r.ctx)): r.nla for r in want.backoffs.collect()})
    assert any(math.isfinite(v) and abs(v) > 1e-6 for v in got.values())


def test_rows_of_a_middle_word_stay_together():
    """Whatever batches they come in; words that share a key are told apart."""
    code = lambda a, b, c: 1 << 3 * triples.BITS | a << 2 * triples.BITS | b << triples.BITS | c
    rows = [(1, code(2, 3, 4), None), (1, code(2, 3, 4), None), (1, code(5, 3, 4), None), (7, code(2, 1, 4), "x"), (7, code(2, 1, 4), "y"), (7, code(2, 1, 4), "x"), (9, code(2, 6, 0), None)]
    table = pa.table({"key": [r[0] for r in rows], "g": [r[1] for r in rows], **{c: pa.nulls(len(rows), pa.string()) for c in ("m", "r1", "r3")}, "r2": pa.array([r[2] for r in rows], pa.string()), "cnt": [1] * len(rows)})
    for chunk in (1, 2, 3, 100):
        with pytest.MonkeyPatch.context() as at:
            at.setattr(triples, "CHUNK", chunk)
            for size in (1, 3, 7):
                got = [tuple(r[c] for c in ("g", "r2", "cnt", "ctx_cnt", "first", "low_cnt", "low_ctx")) for b in triples.by_middle(triples.with_totals)(iter(table.to_batches(size))) for r in b.to_pylist()]
                firsts = [r for r in got if r[4]]
                assert sorted((r[:4] for r in got), key=repr) == sorted([(code(2, 3, 4), None, 2, 2), (code(5, 3, 4), None, 1, 1), (code(2, 1, 4), "x", 2, 2), (code(2, 1, 4), "y", 1, 1), (code(2, 6, 0), None, 1, 0)], key=repr)
                assert sorted(r[1:2] + r[5:] for r in firsts if r[1]) == [("x", 2, 2), ("y", 1, 1)] and [r[5:] for r in firsts if not r[1]] == [(3, 3)]


def test_no_sequences(spark):
    none = spark.createDataFrame([], "model string, toks array<string>")
    assert triples.probs(none).count() == 0 and triples.backoffs(none).count() == 0


def shuffled(spark, run):
    """Records that ``run`` writes to shuffles."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for at, n in stages().items() if at not in before)


@pytest.mark.parametrize("name", ["katz_backoff_3", "katz_probs_3"])
def test_grams_are_shuffled_once(spark, tmp_path, name):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(1000)]
    spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = shuffled(spark, lambda: catalogue.QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save())
    assert 30_000 <= rows < 2 * 33_000
