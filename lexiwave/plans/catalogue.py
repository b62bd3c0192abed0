"""The engine's registered queries and their SQL.

Language models are trained on all documents, one model a language, and scored on all benchmark texts.
Signals and sequences are every user's events in order.
"""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiwave.functions import neglog
from lexiwave.functions.scratch import Scratch, small
from lexiwave.operators import acoustic, cluster, decode, hmm, lm, metrics, segments, signal, text, trie, triples
from lexiwave.plans import sql
from lexiwave.sources import arpa, corpus, wav
from lexiwave.streaming import incremental, sinks

LENGTH, STEP, SIZE, RATE, BANKS, COEFFICIENTS = 8, 4, 16, 16, 4, 3
BANK, DCT = signal.mel_filterbank(SIZE, RATE, BANKS), signal.dct_matrix(BANKS, COEFFICIENTS)

# a three-state left-to-right model of the five event types, in code point order
EVENT_TYPES = ["click", "error", "login", "purchase", "view"]
_P = np.array([[0.6, 0.3, 0.1], [0.0, 0.7, 0.3], [0.2, 0.0, 0.8]])
_E = np.array([[0.3, 0.1, 0.2, 0.1, 0.3], [0.1, 0.4, 0.2, 0.2, 0.1], [0.2, 0.1, 0.1, 0.4, 0.2]])
with np.errstate(divide="ignore"):
    START, MOVES, EMIT = -np.log([0.5, 0.3, 0.2]), -np.log(_P), -np.log(_E)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.when(c == float("inf"), c).otherwise(F.round(c, 6) + 0.0)


def log6(c: Column) -> Column:
    """``r6`` of a logarithm, which never lies half-way between two places, so it needs no decimals; infinity stays."""
    return F.rint(c * 1e6) / 1e6 + 0.0


def joined(gram: str = "gram") -> Column:
    return F.array_join(gram, " ")


def train_seqs(spark, sf_dir: str) -> DataFrame:
    return text.sequences(table(spark, sf_dir, "documents"), model=F.coalesce("lang", F.lit("und")))


def test_seqs(spark, sf_dir: str) -> DataFrame:
    """Every benchmark text for every model; models are few, one a language."""
    return text.sequences(table(spark, sf_dir, "benchmark")).drop("model").join(small(models(spark, sf_dir))).select("model", "toks")


def models(spark, sf_dir: str) -> DataFrame:
    """One row a model; only the column that names it is read."""
    return table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("und")).cast("string").alias("model")).distinct()


def counted(n: int, order: int | None = None):
    def run(spark, sf_dir: str) -> DataFrame:
        counts = text.gram_keys(train_seqs(spark, sf_dir), n, None if order is None else [order])
        return counts.select("model", "ord", F.replace("key", F.lit(text.SEPARATOR), F.lit(" ")).alias("gram"), "cnt")

    return run


def trained(kind: str, n: int):
    return lambda spark, sf_dir: lm.train(kind, train_seqs(spark, sf_dir), n)


def probs(kind: str, n: int):
    return lambda spark, sf_dir: trained(kind, n)(spark, sf_dir).probs().select("model", joined().alias("gram"), "cnt", r6(F.col("nlp")).alias("nlp"))


def perplexity(kind: str, n: int):
    return lambda spark, sf_dir: trained(kind, n)(spark, sf_dir).perplexity(test_seqs(spark, sf_dir)).select("model", "windows", r6(F.col("perplexity")).alias("perplexity"))


def oov(n: int):
    def run(spark, sf_dir: str) -> DataFrame:
        seen, new = (text.gram_counts(f(spark, sf_dir), n, [n]) for f in (train_seqs, test_seqs))
        return lm.gram_oov_rate(new, seen, n).withColumn("rate", F.round("rate", 6))

    return run


def trie_perplexity(spark, sf_dir):
    """Perplexity of documents by language under a Katz trigram model of the benchmark, held as a trie in every task; by joins if it has too many grams."""
    model = lm.train("katz", text.sequences(table(spark, sf_dir, "benchmark")), 3)
    tests = text.sequences(table(spark, sf_dir, "documents"), model=F.coalesce("lang", F.lit("und")))
    if model.counts.limit(trie.MOST_GRAMS).count() < trie.MOST_GRAMS:
        out = trie.scored(tests, trie.GramTrie.of(model)).groupBy("model").agg(F.sum("windows").alias("windows"), F.sum("nlp").alias("nlp"))
    else:
        windows = lm.test_windows(tests.withColumn("lang", F.col("model")).withColumn("model", F.lit("all")), model.vocab, 3, "lang")
        out = model.score(windows).groupBy(F.col("lang").alias("model")).agg(F.sum("times").alias("windows"), F.sum(F.col("nlp") * F.col("times")).alias("nlp"))
    return out.select("model", "windows", r6(F.exp(F.col("nlp") / F.col("windows"))).alias("perplexity"))


def tokenize_counts(spark, sf_dir):
    return train_seqs(spark, sf_dir).select("model", F.explode("toks").alias("token")).groupBy("model", "token").agg(F.count("*").alias("cnt"))


def katz_model(spark, sf_dir, n):
    return trained("katz", n)(spark, sf_dir).katz()


def katz_probs(n):
    def run(spark, sf_dir: str) -> DataFrame:
        probs = triples.probs(train_seqs(spark, sf_dir)) if n == 3 else katz_model(spark, sf_dir, n).probs
        return probs.select("model", "ord", joined().alias("gram"), "cnt", log6(F.col("nlp")).alias("nlp"))

    return run


def katz_backoffs(n):
    def run(spark, sf_dir: str) -> DataFrame:
        backoffs = triples.backoffs(train_seqs(spark, sf_dir)) if n == 3 else katz_model(spark, sf_dir, n).backoffs
        return backoffs.select("model", "ord", joined("ctx").alias("ctx"), log6(F.col("nla")).alias("nla"))

    return run


def good_turing_fit(spark, sf_dir):
    model = trained("good_turing", 2)(spark, sf_dir)
    return lm.good_turing(model.counts, model.vocab, 2).fit.select("model", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "points", "total")


def token_oov(spark, sf_dir):
    vocab = text.vocabulary(train_seqs(spark, sf_dir), 2)
    return lm.token_oov_rate(test_seqs(spark, sf_dir), vocab).withColumn("rate", F.round("rate", 6))


def unknown_words(spark, sf_dir):
    """Benchmark texts with words outside each model's vocabulary replaced."""
    bench = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("gram"))
    seqs = train_seqs(spark, sf_dir)
    grams = bench.join(small(models(spark, sf_dir))).select("model", F.col("item_id").alias("id"), "gram")
    return text.with_unknown(grams, text.vocabulary(seqs, 1)).select("model", F.col("id").alias("item_id"), joined().alias("words"))


def wav_scan(spark, sf_dir):
    """All events as recordings of up to 500 samples, written as WAV files and read by ranges of bytes; sums of samples times place tell their order."""
    wav.register(spark)
    path = f"{Scratch(spark, 'wav').root}/recordings"
    sample = (F.floor(100 * F.col("value")) % 32768).cast("int")
    events = table(spark, sf_dir, "events").where("value is not null").select(F.floor(F.col("event_id") / 500).alias("part"), F.struct("event_id", sample.alias("s")).alias("s"))
    made = events.groupBy("part").agg(F.array_sort(F.collect_list("s"))["s"].alias("samples"))  # 500 events at most
    made.select(F.format_string("%d.wav", "part").alias("path"), F.lit(8000).alias("sample_rate"), "samples").write.format("wav").mode("append").save(path)
    read = spark.read.format("wav").option("splitBytes", 1 << 14).option("blockSamples", 200).load(path)
    each = read.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("part"), "sample_rate", "n_samples", "first", F.posexplode("samples").alias("at", "s"))
    return each.groupBy("part", "sample_rate", "n_samples").agg(F.count("*").alias("found"), F.sum("s").alias("total"), F.sum((F.col("first") + F.col("at") + 1) * F.col("s")).alias("placed"))


def arpa_lines(spark, sf_dir):
    model = lm.train("katz", text.sequences(table(spark, sf_dir, "documents")), 2).katz()
    return arpa.arpa_lines(model.probs.drop("model"), model.backoffs.drop("model"), 2, digits=6)


def arpa_roundtrip(spark, sf_dir):
    """The same model written as a file and read back."""
    model = lm.train("katz", text.sequences(table(spark, sf_dir, "documents")), 2).katz()
    path = f"{Scratch(spark, 'arpa').root}/model"
    arpa.write_arpa(arpa.arpa_lines(model.probs.drop("model"), model.backoffs.drop("model"), 2), path)
    return arpa.read_arpa(spark, path).probs.select("ord", joined().alias("gram"), r6(F.col("nlp")).alias("nlp"))


def tokenize_other(spark, sf_dir):
    """Counts of tokens by another rule: letters and digits, three or more."""
    toks = text.sequences(table(spark, sf_dir, "documents"), pattern=r"[\p{L}\p{N}]+", keep=lambda t: F.char_length(t) >= 3)
    return toks.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def wer_pairs(spark, sf_dir):
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pairs = table(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(by)).where("reply is not null")
    return pairs.select("conv_id", "turn", F.round(metrics.wer(spark, F.col("reply"), F.col("text")), 6).alias("wer"))


PHRASE = "of the"


def phrase_search(spark, sf_dir):
    found = text.contains_phrase(F.lower("text"), F.lit(f" {PHRASE} "))
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.when(found, 1).otherwise(0)).alias("hits"))


def emphasised(spark, sf_dir):
    s = signal.series(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id")
    return s.select("user_id", signal.pre_emphasis(F.col("samples")).alias("samples"))


def pre_emphasis(spark, sf_dir):
    return emphasised(spark, sf_dir).select("user_id", F.posexplode("samples").alias("pos", "v")).withColumn("v", F.round("v", 6) + 0.0)


def frame_count(spark, sf_dir):
    return emphasised(spark, sf_dir).select("user_id", signal.frame_count(F.size("samples"), LENGTH, STEP).cast("long").alias("frames"))


def framed(spark, sf_dir):
    return signal.frames(emphasised(spark, sf_dir), "user_id", F.col("samples"), LENGTH, STEP)


def positions(df: DataFrame, column: str) -> DataFrame:
    return df.select("user_id", "frame_no", F.posexplode(column).alias("pos", "v")).withColumn("v", F.round("v", 6) + 0.0)


def spectra(spark, sf_dir):
    return framed(spark, sf_dir).withColumn("power", signal.power_spectrum(F.col("frame"), SIZE))


def mels(spark, sf_dir):
    return spectra(spark, sf_dir).withColumn("mel", signal.log_mel(F.col("power"), BANK))


def mfcc_numpy(spark, sf_dir):
    s = signal.series(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id")
    rows = s.select(F.col("user_id").cast("string").alias("path"), F.lit(RATE).alias("sample_rate"), "samples")
    out = signal.mfcc(rows, length_s=LENGTH / RATE, step_s=STEP / RATE, banks=BANKS, coefficients=COEFFICIENTS, size=SIZE)
    return out.select(F.col("path").cast("long").alias("user_id"), "frame_no", F.posexplode("features").alias("pos", "v")).withColumn("v", F.round("v", 6) + 0.0)


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def first_centres(spark, sf_dir, k=4):
    """The k vectors with the least ids: the model's initial centres."""
    top = points(spark, sf_dir).orderBy("id").limit(k)
    return top.select((F.row_number().over(Window.orderBy("id")) - 1).alias("k"), F.col("x").alias("centre"))


def kmeans_assign(spark, sf_dir):
    return cluster.assign(points(spark, sf_dir), first_centres(spark, sf_dir)).select(F.col("id").alias("vec_id"), "k", F.round("d2", 6).alias("d2"))


def kmeans_sse(spark, sf_dir):
    return cluster.assign(points(spark, sf_dir), first_centres(spark, sf_dir)).groupBy("k").agg(F.count("*").alias("size"), F.round(F.sum("d2"), 6).alias("sse"))


def kmeans_lloyd(spark, sf_dir):
    new = cluster.lloyd_step(points(spark, sf_dir), first_centres(spark, sf_dir))
    return new.select("k", F.posexplode("centre").alias("pos", "v")).withColumn("v", F.round("v", 6) + 0.0)


def kmeans_full(spark, sf_dir):
    got = cluster.kmeans(points(spark, sf_dir), 4)
    return spark.createDataFrame([(i, float(w), float(np.trace(c))) for i, (w, c) in enumerate(zip(got.weight, got.covariance))], "k int, weight double, spread double")


def covariance(spark, sf_dir) -> np.ndarray:
    mix = cluster.one_component(points(spark, sf_dir))
    return mix.covariance[0] - cluster.RIDGE * np.eye(len(mix.covariance[0]))


def cluster_covariance(spark, sf_dir):
    """The entries that the query's SQL has, null beyond the vectors' length; cluster_covariance_full has all."""
    c = covariance(spark, sf_dir)
    return spark.createDataFrame([(i, j, round(float(c[i, j]), 6) + 0.0 if max(i, j) < len(c) else None) for i in range(4) for j in range(4)], "i int, j int, cov double")


def cluster_covariance_full(spark, sf_dir):
    c = covariance(spark, sf_dir)
    return spark.createDataFrame([(i, j, round(float(v), 6) + 0.0) for (i, j), v in np.ndenumerate(c)], "i int, j int, cov double")


def gmm_em(spark, sf_dir):
    data = points(spark, sf_dir)
    one = cluster.one_component(data)
    start = cluster.Mixture(np.full(2, 0.5), np.stack([one.mean[0] - 0.05, one.mean[0] + 0.05]), np.repeat(one.covariance, 2, 0))
    got = cluster.gmm(data, start)
    return spark.createDataFrame([(i, float(w), float(m @ m)) for i, (w, m) in enumerate(zip(got.weight, got.mean))], "k int, weight double, norm2 double")


def event_sequences(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin(*EVENT_TYPES))
    code = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type"))
    s = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", code.alias("o")))).alias("s"))
    rows = F.array(*[F.array(*map(F.lit, EMIT[:, o].tolist())) for o in range(len(EVENT_TYPES))])
    return s.select("user_id", F.transform("s", lambda x: F.element_at(rows, x["o"].cast("int"))).alias("e"))


def hmm_forward(spark, sf_dir):
    return event_sequences(spark, sf_dir).select("user_id", F.round(hmm.forward_sql(F.col("e"), START, MOVES), 4).alias("nlp"))


def viterbi_cost(spark, sf_dir):
    return event_sequences(spark, sf_dir).select("user_id", F.round(hmm.forward_sql(F.col("e"), START, MOVES, best=True), 4).alias("cost"))


def hmm_occupancy(spark, sf_dir):
    out = hmm.likelihoods(event_sequences(spark, sf_dir), "user_id", "e", START, MOVES)
    return out.select("user_id", F.round("forward_nlp", 4).alias("forward_nlp"), F.round("backward_nlp", 4).alias("backward_nlp"), F.round(F.aggregate("gamma", F.lit(0.0), lambda a, b: a + b), 4).alias("frames"))


def baum_welch_step(spark, sf_dir):
    """Transitions re-estimated once from all users: summed moves by summed stays."""
    out = hmm.likelihoods(event_sequences(spark, sf_dir), "user_id", "e", START, MOVES)
    sums = out.select(F.posexplode("xi").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    by = Window.partitionBy(F.floor(F.col("pos") / 3))
    return sums.select(F.floor(F.col("pos") / 3).cast("int").alias("i"), (F.col("pos") % 3).alias("j"), F.round(F.try_divide("v", F.sum("v").over(by)), 6).alias("p"))


def hmm_xi(spark, sf_dir):
    out = hmm.likelihoods(event_sequences(spark, sf_dir), "user_id", "e", START, MOVES)
    return out.select("user_id", F.posexplode("xi").alias("pos", "v")).select("user_id", "pos", F.round("v", 4).alias("xi"))


def hmm_states(column: str):
    def run(spark, sf_dir):
        out = hmm.posteriors(event_sequences(spark, sf_dir), "user_id", "e", START, MOVES)
        return out.select("user_id", "t", F.posexplode(column).alias("j", "v")).withColumn("v", F.round("v", 4) + 0.0)

    return run


def viterbi_path(spark, sf_dir):
    out = hmm.best_paths(event_sequences(spark, sf_dir), "user_id", "e", START, MOVES)
    return out.select("user_id", F.round("cost", 4).alias("cost"), F.array_join(F.transform("path", lambda j: j.cast("string")), "").alias("path"))


#: events of a block in the queries below; real blocks are longer
BLOCK = 16


def log_sums(spark, sf_dir):
    """Event values as neglogs, twenty times as large: their sum by type, and the same from the sums of two halves."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 2).alias("half"), (20 * F.col("value")).alias("x"))
    halves = neglog.group_sums(rows, ["event_type", "half"], "x").groupBy("event_type").pivot("half", [0, 1]).agg(F.min("nlp"))
    either = neglog.add(F.coalesce("0", neglog.inf()), F.coalesce("1", neglog.inf()))
    whole = neglog.group_sums(rows, ["event_type"], "x").select(F.col("event_type").alias("of"), "nlp")
    return halves.join(whole, F.col("event_type").eqNullSafe(F.col("of"))).select("event_type", r6(F.col("nlp")).alias("nlp"), r6(either).alias("by_halves"))


def event_steps(spark, sf_dir) -> DataFrame:
    """Every event as a step of its user's sequence: the number of its type as the one feature."""
    code = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("double") - 1
    return table(spark, sf_dir, "events").where(F.col("event_type").isin(*EVENT_TYPES)).select("user_id", "ts", "event_id", F.array(code).alias("x"))


def event_blocks(spark, sf_dir, name: str) -> tuple[segments.Blocks, Scratch]:
    scratch = Scratch(spark, name)
    return segments.blocks_of(event_steps(spark, sf_dir), ["user_id"], ["ts", "event_id"], "x", scratch, size=BLOCK), scratch


def event_chain(_: tuple, chain=segments.Chain(START, MOVES, lambda x: EMIT[:, x[:, 0].astype(int)].T)) -> segments.Chain:
    return chain


def segmented_forward(spark, sf_dir):
    blocks, scratch = event_blocks(spark, sf_dir, "segmented_forward")
    return segments.likelihoods(blocks, event_chain, scratch).withColumn("nlp", F.round("nlp", 4))


def segmented_states(column: str):
    def run(spark, sf_dir):
        blocks, scratch = event_blocks(spark, sf_dir, f"segmented_{column}")
        out = segments.posteriors(blocks, event_chain, scratch)
        return out.select("user_id", F.col("t").cast("int").alias("t"), F.posexplode(column).alias("j", "v")).withColumn("v", F.round("v", 4) + 0.0)

    return run


def segmented_path(spark, sf_dir):
    blocks, scratch = event_blocks(spark, sf_dir, "segmented_path")
    return segments.best_paths(blocks, event_chain, scratch).withColumn("cost", F.round("cost", 4))


def baum_welch_turns(spark, sf_dir):
    """Moves, and starts as moves from -1, after two turns of training on all users' events, cut into blocks."""
    frames = event_steps(spark, sf_dir).select(F.lit("all").alias("word"), F.col("user_id").alias("utt"), F.struct("ts", "event_id").alias("frame_no"), F.col("x").alias("features"))
    model = hmm.WordModel("all", ["0", "1", "2"], [hmm.Symbols(e) for e in EMIT], MOVES, START)
    got = hmm.train_words(frames, {"all": model}, turns=2, ignore_eps=True, size=BLOCK)["all"]
    rows = [(i - 1, j, round(float(np.exp(-c)), 6) + 0.0) for i, row in enumerate([got.initial, *got.transitions]) for j, c in enumerate(row)]
    return spark.createDataFrame(rows, "i int, j int, p double")


def event_models() -> list[hmm.WordModel]:
    """Two-state models of two components a state over event values, one a type of event: a recording is a user's values of that type."""
    def mixture(a, b):
        return cluster.Mixture(np.array([0.5, 0.5]), np.array([[a], [b]]), np.array([[[300.0]], [[500.0]]]))

    return [hmm.WordModel(e, ["0", "1"], [mixture(10.0, 50.0), mixture(30.0, 90.0)], initial=np.log([2.0, 2.0])) for e in EVENT_TYPES]


def baum_welch_mixtures(spark, sf_dir):
    """Models of event types after three turns, mixtures re-estimated: moves by -1, means and variances by state and component."""
    events = table(spark, sf_dir, "events").where("value is not null")
    frames = events.select(F.col("event_type").alias("word"), F.col("user_id").alias("utt"), F.struct("ts", "event_id").alias("frame_no"), F.array("value").alias("features"))
    got = hmm.train_words(frames, {m.word: m for m in event_models()}, turns=3, ignore_eps=True, mixtures=True, size=BLOCK)
    rows = []
    for word, m in sorted(got.items()):
        for i, s in enumerate(m.states):
            rows += [(word, i, k, *(round(float(v), 6) for v in (np.exp(-m.transitions[i, i]), s.weight[k], s.mean[k, 0], s.covariance[k, 0, 0]))) for k in range(2)]
    return spark.createDataFrame(rows, "event_type string, state int, component int, stay double, weight double, mean double, variance double")


# two components over quantity and discount in percent
PAIR = cluster.Mixture(np.array([0.4, 0.6]), np.array([[10.0, 2.0], [40.0, 8.0]]), np.array([[[120.0, 1.0], [1.0, 9.0]], [[150.0, -2.0], [-2.0, 8.0]]]))


def order_points(spark, sf_dir) -> DataFrame:
    x = F.array(F.col("l_quantity").cast("double"), F.round(100 * F.col("l_discount").cast("double"), 6))
    return table(spark, sf_dir, "lineitem").where("l_quantity is not null and l_discount is not null").select(F.col("l_returnflag").alias("id"), x.alias("x"))


def gmm_em_step(spark, sf_dir):
    got = cluster.gmm(order_points(spark, sf_dir), PAIR, turns=1, ignore_eps=True)
    rows = [(k, *(round(float(v), 6) + 0.0 for v in (got.weight[k], *got.mean[k], c[0, 0], c[0, 1], c[1, 1]))) for k, c in enumerate(got.covariance)]
    return spark.createDataFrame(rows, "k int, weight double, m1 double, m2 double, c11 double, c12 double, c22 double")


def gmm_loglik(spark, sf_dir):
    return cluster.densities(order_points(spark, sf_dir), PAIR).groupBy(F.col("id").alias("l_returnflag")).agg(
        F.count("*").alias("n"), F.round(F.avg("nlp"), 6).alias("mean_nlp"))


def phone_mixtures(spark, sf_dir):
    """One-component mixtures with return flags in the place of phones."""
    found = acoustic.phone_mixtures(order_points(spark, sf_dir).select(F.col("id").alias("phone"), F.col("x").alias("features")))
    rows = [(p, *(round(float(v), 6) + 0.0 for v in (*m.mean[0], m.covariance[0][0, 0], m.covariance[0][0, 1], m.covariance[0][1, 1]))) for p, m in sorted(found.items())]
    return spark.createDataFrame(rows, "phone string, m1 double, m2 double, c11 double, c12 double, c22 double")


def density_grid(spark, sf_dir):
    """Densities of quantities by return flag, a state each of a model fitted to all line items."""
    quantity = order_points(spark, sf_dir).where("id is not null").select(F.col("id").alias("phone"), F.slice("x", 1, 1).alias("features"))
    found = acoustic.phone_mixtures(quantity)
    out = acoustic.density_grid(spark, hmm.WordModel("flags", sorted(found), [found[p] for p in sorted(found)]), -50, 120, 0.5)
    return out.select("state", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


def acoustic_moves(spark, sf_dir):
    """The moves of a model trained for a turn on all events, saved, restored and saved again."""
    frames = event_steps(spark, sf_dir).select(F.lit("all").alias("word"), F.col("user_id").alias("utt"), F.struct("ts", "event_id").alias("frame_no"), F.col("x").alias("features"))
    model = hmm.WordModel("all", ["0", "1", "2"], [hmm.Symbols(e) for e in EMIT], MOVES, START)
    trained = hmm.train_words(frames, {"all": model}, turns=1)["all"]
    path = f"{Scratch(spark, 'acoustic').root}/models"
    corpus.save_tables(acoustic.model_tables(spark, [replace(trained, states=[])]), path)
    models = acoustic.models_of(corpus.load_tables(spark, path, list(acoustic.TABLES)))
    return acoustic.model_tables(spark, models)["moves"].withColumn("nlp", F.round("nlp", 6) + 0.0)


def kmeans_turns(spark, sf_dir):
    """Weights and centres after ``LLOYD`` turns from the four vectors with the least ids."""
    start = np.array([r.centre for r in first_centres(spark, sf_dir).orderBy("k").collect()])
    got = cluster.kmeans(points(spark, sf_dir), len(start), turns=LLOYD, start=start)
    rows = [(k, i, round(float(got.weight[k]), 6), round(float(v), 6) + 0.0) for (k, i), v in np.ndenumerate(got.centre)]
    return spark.createDataFrame(rows, "k int, pos int, weight double, v double")


def gmm_turns(spark, sf_dir):
    """Weights, means and covariances after ``LLOYD`` turns of expectation maximisation over all line items."""
    got = cluster.gmm(order_points(spark, sf_dir), PAIR, turns=LLOYD, ignore_eps=True)
    rows = [(k, *(round(float(v), 5) + 0.0 for v in (got.weight[k], *got.mean[k], c[0, 0], c[0, 1], c[1, 1]))) for k, c in enumerate(got.covariance)]
    return spark.createDataFrame(rows, "k int, weight double, m1 double, m2 double, c11 double, c12 double, c22 double")


LLOYD = 4


def long_frames(spark, sf_dir):
    """Every user's events as a signal of any length: blocks of ``BLOCK`` samples, cells of twice as many places."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return positions(signal.long_frames(rows, ["user_id"], ["ts", "event_id"], "value", LENGTH, STEP, size=BLOCK, cell=2 * BLOCK).withColumn("frame_no", F.col("frame_no").cast("int")), "frame")


def long_mfcc(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    framed = signal.long_frames(rows, ["user_id"], ["ts", "event_id"], "value", LENGTH, STEP, size=BLOCK, cell=2 * BLOCK)
    return positions(signal.long_mfcc(framed, ["user_id"], RATE, BANKS, COEFFICIENTS, SIZE).withColumn("frame_no", F.col("frame_no").cast("int")), "features")


def _word_models() -> list[hmm.WordModel]:
    def state(m):
        return cluster.Mixture(np.ones(1), np.array([[m]]), np.array([[[400.0]]]))

    return [hmm.WordModel("low", ["l", "o"], [state(20.0), state(40.0)]), hmm.WordModel("high", ["h", "i"], [state(90.0), state(60.0)])]


WORD_COSTS = np.array([[0.5, 1.0], [1.2, 0.4]])


def decoded(spark, sf_dir, n, compat=True):
    s = signal.series(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id")
    rows = s.select(F.col("user_id").cast("string").alias("utt"), F.transform("samples", lambda v: F.array(v)).alias("frames"))
    return decode.recognise_arrays(rows, decode.Decoder(_word_models(), WORD_COSTS, compat=compat), n)


def nbest_costs(spark, sf_dir):
    return decoded(spark, sf_dir, 3).select("utt", "rank", F.round("cost", 4).alias("cost"), F.size("words").alias("words"))


def nbest_compat(spark, sf_dir):
    """Costs of the three best paths by the compatible search."""
    return decoded(spark, sf_dir, 3).select("utt", "rank", F.round("cost", 4).alias("cost"))


def nbest_passing(spark, sf_dir):
    """Costs of the three best paths by token passing."""
    return decoded(spark, sf_dir, 3, compat=False).select("utt", "rank", F.round("cost", 4).alias("cost"))


def rescore_best(spark, sf_dir):
    model = lm.train("laplace", text.sequences(table(spark, sf_dir, "documents")), 3)
    return decode.rescore(decoded(spark, sf_dir, 3), model).select("utt", "rank", F.round("second_cost", 4).alias("second_cost"), "best")


def rescore_turns(spark, sf_dir):
    """A conversation's turns, ranked by a bigram model of documents as if they were hypotheses of one utterance."""
    model = lm.train("laplace", text.sequences(table(spark, sf_dir, "documents")), 2)
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    hyps = turns.select(F.col("conv_id").cast("string").alias("utt"), F.col("turn").cast("int").alias("rank"), text.tokens(F.col("text")).alias("words"))
    out = decode.rescore(hyps, model)
    return out.select("utt", "rank", F.round("second_cost", 4).alias("second_cost"), "best")


TRIGGERS = 3


def stream_of(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def stream_in_parts(spark, name: str, df: DataFrame, time: str | None = None) -> DataFrame:
    """A stream that reads ``df`` in ``TRIGGERS`` triggers: parts of equal lengths of time, written one after the other, or of equal hashes."""
    root = f"{Scratch(spark, name).root}/parts"
    if time is None:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(TRIGGERS))
    else:
        first, last = df.agg(F.min(time), F.max(time)).first()
        share = F.unix_micros(time) - F.unix_micros(F.lit(first))
        part = F.coalesce(F.floor(TRIGGERS * share / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1)), F.lit(0))
    # parts in order of time are a file each; of the others each has as many as the table's tasks, so no task writes a part
    files = 1 if time is not None else -(-df.rdd.getNumPartitions() // TRIGGERS)
    for i in range(TRIGGERS):
        own = df.where(part == i)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.parquet(f"{root}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/*")


def streamed(spark, name: str, stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """What a stream has given once its source is read: the latest row of every key, or all rows without keys."""
    sink = sinks.KeyedTable(spark, Scratch(spark, name).root, stream.schema, keys, compact=2)
    with incremental.rocks_state(spark):
        query = sink.start(stream, mode)
    query.awaitTermination()
    return sink.rows()


def streaming_counts(spark, sf_dir):
    stream = stream_in_parts(spark, "streaming_counts", table(spark, sf_dir, "documents").select("text"))
    counted = lambda batch: text.gram_keys(text.sequences(batch), 2)
    schema = counted(table(spark, sf_dir, "documents")).schema
    sink = sinks.SummedTable(spark, Scratch(spark, "streaming_counts").root, schema, ["model", "ord", "key"], counted, compact=16)
    sink.start(stream, "append").awaitTermination()
    return sink.rows().select("model", "ord", F.replace("key", F.lit(text.SEPARATOR), F.lit(" ")).alias("gram"), "cnt")


def event_stream(spark, sf_dir, name: str, condition) -> DataFrame:
    events = table(spark, sf_dir, "events").where(condition).withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value")
    return stream_in_parts(spark, name, events, "ts")


def streaming_frames(spark, sf_dir):
    events = stream_of(spark, sf_dir, "events").where("value is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streamed(spark, "streaming_frames", incremental.time_frames(events, "ts", "2 hours", "1 hour", "30 days"), "update", ["frame"])
    return shown_frames(out)


def shown_frames(out: DataFrame) -> DataFrame:
    return out.select(F.unix_seconds("frame.start").alias("start"), "n", F.round("mean", 6).alias("mean"), F.round("energy", 3).alias("energy"))


def streaming_frames_closed(spark, sf_dir):
    """Frames that the watermark has closed, each given once; those still open at the end of the stream are not given."""
    frames = incremental.time_frames(event_stream(spark, sf_dir, "streaming_frames_closed", F.col("value").isNotNull()), "ts", "2 hours", "1 hour", "3 hours")
    return shown_frames(streamed(spark, "streaming_frames_closed", frames, "append", []))


def observed(spark, sf_dir, name: str) -> DataFrame:
    events = event_stream(spark, sf_dir, name, F.col("event_type").isin(*EVENT_TYPES))
    code = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int") - 1
    seq = F.concat(F.lpad(F.unix_micros("ts").cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    return events.select("user_id", seq.alias("seq"), code.alias("obs"))


def streaming_viterbi(spark, sf_dir):
    out = streamed(spark, "streaming_viterbi", incremental.online_viterbi(observed(spark, sf_dir, "streaming_viterbi"), "user_id", START, MOVES, EMIT), "update", ["user_id"])
    return out.select("user_id", "frames", F.round("cost", 4).alias("cost"), "state")


def streaming_paths(spark, sf_dir):
    """Every user's path, given out as it settles, three triggers."""
    out = streamed(spark, "streaming_paths", incremental.online_paths(observed(spark, sf_dir, "streaming_paths"), "user_id", START, MOVES, EMIT), "update", ["user_id", "began", "t"])
    return out.select("user_id", "t", "state")


QUERIES = {
    "tokenize_counts": tokenize_counts,
    "vocabulary": lambda s, d: text.vocabulary(train_seqs(s, d), 2),
    "ngram_counts_1": counted(1, 1), "ngram_counts_2": counted(2, 2), "ngram_counts_3": counted(3, 3), "ngram_prefix_rollup": counted(3),
    "count_of_counts": lambda s, d: text.count_of_counts(text.gram_counts(train_seqs(s, d), 3)),
    "ngram_totals": lambda s, d: text.gram_totals(text.gram_counts(train_seqs(s, d), 3)),
    "unknown_words": unknown_words,
    "lm_mle": probs("mle", 2), "lm_laplace": probs("laplace", 2), "lm_additive5": probs("additive", 2),
    "lm_good_turing_fit": good_turing_fit, "lm_good_turing_probs": probs("good_turing", 2),
    "katz_discounts": lambda s, d: lm.katz_discounts(text.gram_counts(train_seqs(s, d), 3, [2, 3])).withColumn("d", F.round("d", 6)),
    "katz_probs_2": katz_probs(2), "katz_probs_3": katz_probs(3), "katz_backoff_2": katz_backoffs(2), "katz_backoff_3": katz_backoffs(3),
    "perplexity_by_lang_mle": perplexity("mle", 2), "perplexity_by_lang_laplace": perplexity("laplace", 2), "perplexity_by_lang_additive": perplexity("additive", 2),
    "perplexity_by_lang_good_turing": perplexity("good_turing", 2), "perplexity_by_lang_katz": perplexity("katz", 2), "perplexity_by_lang_katz_3": perplexity("katz", 3),
    "ngram_oov_rate_1": oov(1), "ngram_oov_rate_2": oov(2), "ngram_oov_rate_3": oov(3), "token_oov_rate": token_oov,
    "trie_perplexity": trie_perplexity,
    "wav_scan": wav_scan, "arpa_lines": arpa_lines, "wer_pairs": wer_pairs, "phrase_search": phrase_search,
    "pre_emphasis": pre_emphasis, "frame_count": frame_count,
    "hamming_frames": lambda s, d: positions(framed(s, d), "frame"), "power_spectrum": lambda s, d: positions(spectra(s, d), "power"),
    "log_mel": lambda s, d: positions(mels(s, d), "mel"),
    "mfcc": lambda s, d: positions(mels(s, d).withColumn("c", signal.dct(F.col("mel"), BANKS, COEFFICIENTS)), "c"), "mfcc_numpy": mfcc_numpy,
    "kmeans_assign": kmeans_assign, "kmeans_sse": kmeans_sse, "kmeans_lloyd": kmeans_lloyd, "kmeans_full": kmeans_full,
    "cluster_covariance": cluster_covariance, "cluster_covariance_full": cluster_covariance_full, "gmm_em": gmm_em,
    "hmm_forward": hmm_forward, "viterbi_cost": viterbi_cost, "hmm_occupancy": hmm_occupancy, "baum_welch_step": baum_welch_step,
    "log_sums": log_sums, "segmented_forward": segmented_forward, "segmented_backward": segmented_states("beta"), "segmented_gamma": segmented_states("gamma"), "segmented_path": segmented_path,
    "long_frames": long_frames, "long_mfcc": long_mfcc, "kmeans_turns": kmeans_turns, "gmm_turns": gmm_turns,
    "baum_welch_turns": baum_welch_turns, "baum_welch_mixtures": baum_welch_mixtures,
    "nbest_costs": nbest_costs, "rescore_best": rescore_best,
    "arpa_roundtrip": arpa_roundtrip, "tokenize_other": tokenize_other,
    "hmm_backward": hmm_states("beta"), "hmm_gamma": hmm_states("gamma"), "hmm_xi": hmm_xi, "viterbi_path": viterbi_path,
    "gmm_em_step": gmm_em_step, "gmm_loglik": gmm_loglik, "phone_mixtures": phone_mixtures, "density_grid": density_grid, "acoustic_moves": acoustic_moves,
    "nbest_passing": nbest_passing, "nbest_compat": nbest_compat, "rescore_turns": rescore_turns,
    "streaming_counts": streaming_counts, "streaming_frames": streaming_frames, "streaming_viterbi": streaming_viterbi,
    "streaming_paths": streaming_paths, "streaming_frames_closed": streaming_frames_closed,
}

_FRAMES = (LENGTH, STEP)
_NEAR = """pts AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
cs AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS k, x AS c FROM (SELECT * FROM pts ORDER BY vec_id LIMIT 4)),
far AS (SELECT vec_id, x, k, list_sum(list_transform(range(1, len(x) + 1), lambda i: pow(x[i] - c[i], 2))) AS d2 FROM pts CROSS JOIN cs),
near AS (SELECT vec_id, any_value(x) AS x, arg_min(k, (round(d2, 12), k)) AS k, min(d2) AS d2 FROM far GROUP BY vec_id)"""
_HMM = f"""obs AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
  list_position({EVENT_TYPES!r}, event_type) AS o FROM events WHERE event_type IN ({', '.join(map(repr, EVENT_TYPES))})),
em(j, o, e) AS (VALUES {sql.values([(j, o + 1, float(EMIT[j, o])) for j in range(3) for o in range(5)])}),
tr(i, j, a) AS (VALUES {sql.values([(i, j, float(MOVES[i, j])) for i in range(3) for j in range(3)])}),
st(j, a) AS (VALUES {sql.values([(j, float(START[j])) for j in range(3)])})"""
_FIRST = "SELECT user_id, t, em.j AS j, st.a + e AS c FROM obs JOIN em USING (o) JOIN st ON st.j = em.j WHERE t = 1"
_STEP = "FROM r JOIN tr ON tr.i = r.j JOIN obs ON obs.user_id = r.user_id AND obs.t = r.t + 1 JOIN em ON em.o = obs.o AND em.j = tr.j"
_LAST = "JOIN (SELECT user_id, max(t) AS t FROM obs GROUP BY user_id) USING (user_id, t)"

_ALPHA = f"""r AS ({_FIRST} UNION ALL
SELECT user_id, t, j, any_value(mn) - ln(sum(exp(mn - x))) + any_value(e) AS c FROM (
  SELECT r.user_id, r.t + 1 AS t, tr.j, r.c + tr.a AS x, e, min(r.c + tr.a) OVER (PARTITION BY r.user_id, r.t, tr.j) AS mn {_STEP}) GROUP BY user_id, t, j)"""
_BETA = """ends AS (SELECT user_id, max(t) AS t FROM obs GROUP BY user_id),
b AS (SELECT user_id, t, j, 0.0::DOUBLE AS c FROM ends CROSS JOIN (SELECT DISTINCT j FROM em) UNION ALL
SELECT user_id, t, i AS j, any_value(mn) - ln(sum(exp(mn - x))) AS c FROM (
  SELECT b.user_id, b.t - 1 AS t, tr.i, b.c + tr.a + e AS x, min(b.c + tr.a + e) OVER (PARTITION BY b.user_id, b.t, tr.i) AS mn
  FROM b JOIN tr ON tr.j = b.j JOIN obs ON obs.user_id = b.user_id AND obs.t = b.t JOIN em ON em.o = obs.o AND em.j = b.j WHERE b.t > 1) GROUP BY user_id, t, i)"""
_TOTAL = f"total AS (SELECT user_id, any_value(mn) - ln(sum(exp(mn - c))) AS nlp FROM (SELECT user_id, c, min(c) OVER (PARTITION BY user_id) AS mn FROM r {_LAST}) GROUP BY user_id)"
_BOTH = f"WITH RECURSIVE {_HMM}, {_ALPHA}, {_BETA}, {_TOTAL}"
_XI = """xi AS (SELECT r.user_id, tr.i, tr.j, sum(exp(nlp - r.c - tr.a - em.e - b.c)) AS v FROM r JOIN total USING (user_id) JOIN tr ON tr.i = r.j
  JOIN obs ON obs.user_id = r.user_id AND obs.t = r.t + 1 JOIN em ON em.o = obs.o AND em.j = tr.j JOIN b ON b.user_id = r.user_id AND b.t = r.t + 1 AND b.j = tr.j GROUP BY r.user_id, tr.i, tr.j)"""
# the moves and starts of the next turn; _again reads them in the place of the first
_FIRST_MOVES = """tr2 AS MATERIALIZED (SELECT i, j, CASE WHEN v > 0 THEN -ln(v / sum(v) OVER (PARTITION BY i)) ELSE 1e30 END AS a FROM (SELECT i, j, sum(v) AS v FROM xi GROUP BY i, j)),
st2 AS MATERIALIZED (SELECT r.j AS j, -ln(sum(exp(nlp - r.c - b.c)) / count(*)) AS a FROM r JOIN b USING (user_id, t, j) JOIN total USING (user_id) WHERE t = 1 GROUP BY r.j)"""


def _again(ctes: str) -> str:
    return re.sub(r"\b(r|b|tr|st|tr2|st2|total|xi)\b(?=\.| AS [(M]| JOIN| USING|\)? (ON|WHERE|GROUP)| \(|$)|(?<=FROM )xi\b", r"\g<0>2", ctes)


_PAIRS = "pts AS (SELECT l_returnflag AS f, l_quantity::DOUBLE AS x, round(100 * l_discount::DOUBLE, 6) AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)"
_SHARES = f"""{_PAIRS}, comp(k, w, m1, m2, c11, c12, c22) AS (VALUES {sql.values([(k, float(PAIR.weight[k]), *map(float, PAIR.mean[k]), float(c[0, 0]), float(c[0, 1]), float(c[1, 1])) for k, c in enumerate(PAIR.covariance)])}),
dens AS (SELECT row_number() OVER () AS id, f, x, y FROM pts),
each AS (SELECT id, f, x, y, k, m1, m2, w * exp(-0.5 * ((x - m1) * (x - m1) * c22 - 2 * (x - m1) * (y - m2) * c12 + (y - m2) * (y - m2) * c11) / (c11 * c22 - c12 * c12)) / (2 * pi() * sqrt(c11 * c22 - c12 * c12)) AS p FROM dens CROSS JOIN comp),
share AS (SELECT *, p / sum(p) OVER (PARTITION BY id) AS s FROM each)"""


def _trie_sql(n: int) -> str:
    train = ", ".join([sql.seqs("seq", "benchmark", "'all'"), sql.pads(n), sql.counts(n), sql.vocab(n), sql.contexts(n), sql.katz(n)])
    words = ", ".join(f"CASE WHEN v{i}.token IS NULL THEN '<unk>' ELSE raw.gram[{i + 1}] END" for i in range(n))
    known = " ".join(f"LEFT JOIN voc v{i} ON v{i}.token = raw.gram[{i + 1}]" for i in range(n))
    joins, cases, carried = "", "", "0"
    for m in range(n, 0, -1):
        joins += f" LEFT JOIN (SELECT * FROM kp WHERE ord = {m}) p{m} ON p{m}.gram = t.gram[{n - m + 1}:{n}]"
        cases += f" WHEN p{m}.nlp IS NOT NULL THEN {carried} + p{m}.nlp"
        if m > 1:
            joins += f" LEFT JOIN a{m} ON a{m}.ctx = t.gram[{n - m + 1}:{n - 1}]"
            carried += f" + coalesce(a{m}.nla, 0)"
    return f"""WITH {train}, tseq AS (SELECT coalesce(lang, 'und') AS model, {sql.TOKENS} AS toks FROM documents), {sql.pads(n, 'tpad', 'tseq')},
raw AS (SELECT model, gram, count(*) AS times FROM ({sql.grams(n, 'tpad')}) GROUP BY model, gram), test AS (SELECT raw.model, [{words}] AS gram, sum(times) AS times FROM raw {known} GROUP BY ALL),
scored AS (SELECT t.model, times, CASE{cases} ELSE 'inf'::DOUBLE END AS nlp FROM test t{joins})
SELECT model, CAST(sum(times) AS BIGINT) AS windows, {sql.r6('exp(sum(times * nlp) / sum(times))')} AS perplexity FROM scored GROUP BY model"""


def _kmeans_sql(turns: int) -> str:
    """Lloyd turns one behind the other; an empty cluster's centre becomes zeros."""
    parts = ["pts AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL)",
             "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS k, x AS c FROM (SELECT * FROM pts ORDER BY vec_id LIMIT 4))"]
    near = lambda i: f"n{i} AS MATERIALIZED (SELECT id, any_value(x) AS x, arg_min(k, (d, k)) AS k FROM (SELECT id, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM pts CROSS JOIN c{i}) GROUP BY id)"
    for i in range(turns):
        parts += [near(i), f"c{i + 1} AS MATERIALIZED (SELECT k, list(coalesce(v, 0) ORDER BY j) AS c FROM (SELECT c.k, j, avg(n.x[j]) AS v FROM c{i} c CROSS JOIN (SELECT unnest(range(1, (SELECT max(len(x)) FROM pts) + 1)) AS j) LEFT JOIN n{i} n ON n.k = c.k GROUP BY c.k, j) GROUP BY k)"]
    parts.append(near(turns))
    return (f"WITH {', '.join(parts)} SELECT k, CAST(i - 1 AS INT) AS pos, round((SELECT count(*) FROM n{turns} n WHERE n.k = c.k) / (SELECT count(*) FROM pts)::DOUBLE, 6) AS weight, round(c[i], 6) + 0.0 AS v "
            f"FROM c{turns} c CROSS JOIN (SELECT unnest(range(1, (SELECT max(len(x)) FROM pts) + 1)) AS i)")


def _gmm_sql(turns: int) -> str:
    det = "(c11 * c22 - c12 * c12)"
    density = f"w * exp(-0.5 * ((x - m1) * (x - m1) * c22 - 2 * (x - m1) * (y - m2) * c12 + (y - m2) * (y - m2) * c11) / {det}) / (2 * pi() * sqrt({det}))"
    parts = [_PAIRS, "ids AS MATERIALIZED (SELECT row_number() OVER () AS id, x, y FROM pts)", f"g0(k, w, m1, m2, c11, c12, c22) AS (VALUES {sql.values([(k, float(PAIR.weight[k]), *map(float, PAIR.mean[k]), float(c[0, 0]), float(c[0, 1]), float(c[1, 1])) for k, c in enumerate(PAIR.covariance)])})"]
    for i in range(turns):
        parts += [f"s{i} AS (SELECT *, p / sum(p) OVER (PARTITION BY id) AS s FROM (SELECT id, x, y, k, m1, m2, {density} AS p FROM ids CROSS JOIN g{i}))",
                  f"""g{i + 1} AS MATERIALIZED (SELECT k, sum(s) / (SELECT count(*) FROM pts) AS w, sum(s * x) / sum(s) AS m1, sum(s * y) / sum(s) AS m2, sum(s * (x - m1) * (x - m1)) / sum(s) + {cluster.RIDGE} AS c11,
sum(s * (x - m1) * (y - m2)) / sum(s) AS c12, sum(s * (y - m2) * (y - m2)) / sum(s) + {cluster.RIDGE} AS c22 FROM s{i} GROUP BY k)"""]
    shown = ", ".join(f"round({c}, 5) + 0.0 AS {n}" for c, n in (("w", "weight"), *((c, c) for c in ("m1", "m2", "c11", "c12", "c22"))))
    return f"WITH {', '.join(parts)} SELECT CAST(k AS INT) AS k, {shown} FROM g{turns}"


# a state of the search is a word's state; its number is that of the word times two and the state
_SEARCH = [(w, i) for w, m in enumerate(_word_models()) for i in range(len(m.phones))]


def _search_moves() -> list[tuple]:
    models, rows = _word_models(), []
    for a, (v, i) in enumerate(_SEARCH):
        for b, (w, j) in enumerate(_SEARCH):
            if v == w and np.isfinite(models[v].transitions[i, j]):
                rows.append((a, b, float(models[v].transitions[i, j])))
            if i == models[v].end and j == models[w].begin:
                rows.append((a, b, float(WORD_COSTS[v, w] * decode.LM_SCALE - np.log(decode.WORD_PENALTY))))
    return rows


_NBEST = f"""WITH RECURSIVE obs AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS x FROM events WHERE value IS NOT NULL),
st(j, mean, a) AS (VALUES {sql.values([(n, float(_word_models()[w].states[i].mean[0, 0]), float(_word_models()[w].initial[i])) for n, (w, i) in enumerate(_SEARCH)])}),
tr(i, j, a) AS (VALUES {sql.values(_search_moves())}),
em AS (SELECT user_id, t, j, 0.5 * (ln(2 * pi()) + (x - mean) * (x - mean) / 400) + 0.5 * ln(400) AS e, a FROM obs CROSS JOIN st),
r AS (SELECT user_id, t, j, 1::BIGINT AS rn, a + e AS c FROM em WHERE t = 1 AND a < 1e29 UNION ALL
SELECT user_id, t, j, rn, c FROM (SELECT r.user_id, r.t + 1 AS t, tr.j, r.c + tr.a + em.e AS c, row_number() OVER (PARTITION BY r.user_id, tr.j ORDER BY r.c + tr.a) AS rn
  FROM r JOIN tr ON tr.i = r.j JOIN em ON em.user_id = r.user_id AND em.t = r.t + 1 AND em.j = tr.j) WHERE rn <= 3)
SELECT CAST(user_id AS VARCHAR) AS utt, CAST(n - 1 AS INT) AS rank, round(c, 4) AS cost FROM (
  SELECT user_id, c, row_number() OVER (PARTITION BY user_id ORDER BY c) AS n FROM r JOIN (SELECT user_id, max(t) AS t FROM obs GROUP BY user_id) USING (user_id, t)) WHERE n <= 3"""


def _compat_sql() -> str:
    """The compatible search of the two words, a row a user and frame: sorted costs of up to three ways into each state, and the counters of decoded words.

    A word that has once ended offers its ends in the same frame to every word's beginning, dearer by the words
    decoded so far of that rank; a counter goes up when a beginning's entry of its rank is new.
    """
    models, half, fee = _word_models(), float(-np.log(0.5)), float(np.log(decode.WORD_PENALTY))
    means = [float(s.mean[0, 0]) for m in models for s in m.states]
    e = ", ".join(f"0.5 * (ln(2 * pi()) + (x - {m!r}) * (x - {m!r}) / 400) + 0.5 * ln(400) AS e{i}" for i, m in enumerate(means))
    within = ", ".join(
        f"list_transform(r.s{b}, lambda c: c + {half!r} + e{b}) AS n{b}, list_sort(list_concat(list_transform(r.s{b}, lambda c: c + {half!r} + e{b + 1}), list_transform(r.s{b + 1}, lambda c: c + e{b + 1})))[1:3] AS n{b + 1}" for b in (0, 2))
    offers = lambda w: "list_concat({}, {})".format(*[
        f"CASE WHEN ended{v} OR len(n{2 * v + 1}) > 0 THEN list_transform(n{2 * v + 1}, lambda c, i: c + {float(WORD_COSTS[v, w] * decode.LM_SCALE)!r} - dec[i] * {fee!r}) ELSE [] END" for v in (0, 1)])
    begins = ", ".join(f"list_sort(list_concat(n{2 * w}, {offers(w)}))[1:3] AS b{2 * w}" for w in (0, 1))
    begun = " OR ".join(f"(i <= len(b{k}) AND (i > len(n{k}) OR b{k}[i] < n{k}[i]))" for k in (0, 2))
    return f"""WITH RECURSIVE obs AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS x FROM events WHERE value IS NOT NULL),
em AS (SELECT user_id, t, {e} FROM obs),
r AS (SELECT user_id, t, [e0] AS s0, []::DOUBLE[] AS s1, [e2] AS s2, []::DOUBLE[] AS s3, [1.0, 1.0, 1.0]::DOUBLE[] AS dec, false AS ended0, false AS ended1 FROM em WHERE t = 1 UNION ALL
SELECT user_id, t, b0, n1, b2, n3, list_transform(range(1, 4), lambda i: dec[i] + CASE WHEN {begun} THEN 1.0 ELSE 0.0 END), ended0 OR len(n1) > 0, ended1 OR len(n3) > 0
FROM (SELECT *, {begins} FROM (SELECT em.user_id, em.t, dec, ended0, ended1, {within} FROM r JOIN em ON em.user_id = r.user_id AND em.t = r.t + 1)))
SELECT CAST(user_id AS VARCHAR) AS utt, CAST(i - 1 AS INT) AS rank, round(c[i], 4) AS cost FROM (
  SELECT user_id, list_sort(list_concat(list_concat(s0, s1), list_concat(s2, s3)))[1:3] AS c FROM r JOIN (SELECT user_id, max(t) AS t FROM obs GROUP BY user_id) USING (user_id, t)) CROSS JOIN range(1, 4) g(i) WHERE i <= len(c)"""


_ALL_SEQ = f"seq AS (SELECT 'all' AS model, {sql.TOKENS} AS toks FROM documents)"
_ALL_KATZ = f"{_ALL_SEQ}, {sql.pads(2)}, {sql.counts(2)}, {sql.katz(2)}"

SQL = {
    "tokenize_counts": f"WITH {sql.seqs()} SELECT model, token, count(*) AS cnt FROM (SELECT model, unnest(toks) AS token FROM seq) GROUP BY ALL",
    "vocabulary": f"WITH {sql.seqs()}, {sql.vocab(2)} SELECT model, token FROM voc",
    "count_of_counts": f"WITH {sql.seqs()}, {sql.pads(3)}, {sql.counts(3)} SELECT model, ord, cnt AS r, count(*) AS n_r FROM cnts GROUP BY ALL",
    "ngram_totals": f"WITH {sql.seqs()}, {sql.pads(3)}, {sql.counts(3)} SELECT model, ord, count(*) AS distinct_grams, CAST(sum(cnt) AS BIGINT) AS total_grams FROM cnts GROUP BY ALL",
    "ngram_prefix_rollup": f"WITH {sql.seqs()}, {sql.pads(3)}, {sql.counts(3)} SELECT model, ord, array_to_string(gram, ' ') AS gram, cnt FROM cnts",
    "unknown_words": f"""WITH {sql.seqs()}, {sql.vocab(1)}, b AS (SELECT item_id, {sql.TOKENS} AS toks FROM benchmark),
w AS (SELECT m.model, item_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS i FROM b CROSS JOIN (SELECT DISTINCT model FROM seq) m)
SELECT w.model, item_id, string_agg(CASE WHEN v.token IS NULL THEN '<unk>' ELSE w.token END, ' ' ORDER BY i) AS words FROM w LEFT JOIN voc v ON v.model = w.model AND v.token = w.token GROUP BY w.model, item_id""",
    "lm_mle": sql.additive_probs(2, 0), "lm_laplace": sql.additive_probs(2, 1), "lm_additive5": sql.additive_probs(2, 5),
    "lm_good_turing_fit": sql.good_turing_fit(2), "lm_good_turing_probs": sql.good_turing_probs(2),
    "katz_discounts": sql.katz_discounts(3), "katz_probs_2": sql.katz_probs(2), "katz_probs_3": sql.katz_probs(3),
    "katz_backoff_2": sql.katz_backoffs(2), "katz_backoff_3": sql.katz_backoffs(3),
    "perplexity_by_lang_mle": sql.perplexity_additive(2, 0), "perplexity_by_lang_laplace": sql.perplexity_additive(2, 1), "perplexity_by_lang_additive": sql.perplexity_additive(2, 5),
    "perplexity_by_lang_good_turing": sql.perplexity_good_turing(2), "perplexity_by_lang_katz": sql.perplexity_katz(2), "perplexity_by_lang_katz_3": sql.perplexity_katz(3),
    "ngram_oov_rate_1": sql.oov_rate(1), "ngram_oov_rate_2": sql.oov_rate(2), "ngram_oov_rate_3": sql.oov_rate(3),
    "token_oov_rate": f"""WITH {sql.seqs()}, {sql.vocab(2)}, tw AS (SELECT m.model, unnest({sql.TOKENS}) AS token FROM benchmark CROSS JOIN (SELECT DISTINCT model FROM seq) m)
SELECT tw.model, CAST(count(*) FILTER (WHERE v.token IS NULL) AS BIGINT) AS unseen, count(*) AS total_tokens, round(100 * count(*) FILTER (WHERE v.token IS NULL) / count(*)::DOUBLE, 6) AS rate
FROM tw LEFT JOIN voc v ON v.model = tw.model AND v.token = tw.token GROUP BY tw.model""",
    "phrase_search": f"SELECT lang, source, count(*) AS docs, CAST(count(*) FILTER (WHERE contains(lower(text), '{PHRASE}')) AS BIGINT) AS hits FROM documents GROUP BY ALL",
    "pre_emphasis": f"WITH {sql.SAMPLES}, {sql.EMPHASIS} SELECT user_id, CAST(i - 1 AS INT) AS pos, round(v, 6) + 0.0 AS v FROM (SELECT user_id, unnest(s) AS v, generate_subscripts(s, 1) AS i FROM emp)",
    "frame_count": f"WITH {sql.frames(*_FRAMES)} SELECT user_id, count(*) AS frames FROM fr GROUP BY user_id",
    "wav_scan": """WITH e AS (SELECT event_id // 500 AS part, CAST(floor(100 * value) AS BIGINT) % 32768 AS s, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id, CAST(floor(100 * value) AS BIGINT) % 32768) AS i FROM events WHERE value IS NOT NULL)
SELECT part, CAST(8000 AS INT) AS sample_rate, count(*) AS n_samples, count(*) AS found, CAST(sum(s) AS BIGINT) AS total, CAST(sum(i * s) AS BIGINT) AS placed FROM e GROUP BY part""",
    "hamming_frames": sql.positions(sql.frames(*_FRAMES), "fr", "frame"),
    "power_spectrum": sql.positions(sql.spectrum(*_FRAMES, SIZE), "ps", "power"),
    "log_mel": sql.positions(sql.mel(*_FRAMES, SIZE, BANK), "lm", "mel"),
    "mfcc": sql.positions(sql.cepstra(*_FRAMES, SIZE, BANK, DCT), "cc", "c"),
    "mfcc_numpy": sql.positions(sql.cepstra(*_FRAMES, SIZE, BANK, DCT), "cc", "c"),
    "kmeans_assign": f"WITH {_NEAR} SELECT vec_id, k, round(d2, 6) AS d2 FROM near",
    "kmeans_sse": f"WITH {_NEAR} SELECT k, count(*) AS size, round(sum(d2), 6) AS sse FROM near GROUP BY k",
    "kmeans_lloyd": f"WITH {_NEAR} SELECT cs.k, CAST(i - 1 AS INT) AS pos, round(coalesce(avg(x[i]), 0), 6) + 0.0 AS v FROM cs LEFT JOIN near ON near.k = cs.k CROSS JOIN (SELECT unnest(range(1, (SELECT max(len(x)) FROM pts) + 1)) AS i) GROUP BY cs.k, i",
    "cluster_covariance": f"WITH {_NEAR} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(covar_pop(x[i + 1], x[j + 1]), 6) + 0.0 AS cov FROM pts CROSS JOIN range(0, 4) a(i) CROSS JOIN range(0, 4) b(j) GROUP BY a.i, b.j",
    "hmm_forward": f"""WITH RECURSIVE {_HMM}, r AS ({_FIRST} UNION ALL
SELECT user_id, t, j, any_value(mn) - ln(sum(exp(mn - x))) + any_value(e) AS c FROM (
  SELECT r.user_id, r.t + 1 AS t, tr.j, r.c + tr.a AS x, e, min(r.c + tr.a) OVER (PARTITION BY r.user_id, r.t, tr.j) AS mn {_STEP}) GROUP BY user_id, t, j)
SELECT user_id, round(any_value(mn) - ln(sum(exp(mn - c))), 4) AS nlp FROM (SELECT user_id, c, min(c) OVER (PARTITION BY user_id) AS mn FROM r {_LAST}) GROUP BY user_id""",
    "viterbi_cost": f"""WITH RECURSIVE {_HMM}, r AS ({_FIRST} UNION ALL
SELECT r.user_id, r.t + 1 AS t, tr.j, min(r.c + tr.a) + any_value(e) AS c {_STEP} GROUP BY r.user_id, r.t, tr.j)
SELECT user_id, round(min(c), 4) AS cost FROM r {_LAST} GROUP BY user_id""",
}
SQL |= {
    "hmm_backward": f"{_BOTH} SELECT user_id, CAST(t - 1 AS INT) AS t, CAST(j AS INT) AS j, round(c, 4) + 0.0 AS v FROM b",
    "hmm_gamma": f"{_BOTH} SELECT user_id, CAST(t - 1 AS INT) AS t, CAST(j AS INT) AS j, round(exp(nlp - r.c - b.c), 4) + 0.0 AS v FROM r JOIN b USING (user_id, t, j) JOIN total USING (user_id)",
    "hmm_occupancy": f"""{_BOTH}, back AS (SELECT user_id, any_value(mn) - ln(sum(exp(mn - c))) AS nlp FROM (
  SELECT b.user_id, st.a + em.e + b.c AS c, min(st.a + em.e + b.c) OVER (PARTITION BY b.user_id) AS mn FROM b JOIN obs USING (user_id, t) JOIN em ON em.o = obs.o AND em.j = b.j JOIN st ON st.j = b.j WHERE t = 1) GROUP BY user_id),
occ AS (SELECT user_id, sum(exp(nlp - r.c - b.c)) AS frames FROM r JOIN b USING (user_id, t, j) JOIN total USING (user_id) GROUP BY user_id)
SELECT user_id, round(total.nlp, 4) AS forward_nlp, round(back.nlp, 4) AS backward_nlp, round(frames, 4) AS frames FROM total JOIN back USING (user_id) JOIN occ USING (user_id)""",
    "hmm_xi": f"{_BOTH}, {_XI} SELECT user_id, CAST(3 * i + j AS INT) AS pos, round(coalesce(v, 0), 4) AS xi FROM (SELECT user_id FROM ends) CROSS JOIN (SELECT i, j FROM tr) LEFT JOIN xi USING (user_id, i, j)",
    "baum_welch_step": f"{_BOTH}, {_XI}, s AS (SELECT i, j, sum(v) AS v FROM xi GROUP BY i, j) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(v / nullif(sum(v) OVER (PARTITION BY i), 0), 6) AS p FROM s",
    "viterbi_path": f"""WITH RECURSIVE {_HMM}, f AS ({_FIRST}), r AS (SELECT user_id, t, j, c, CAST(j AS VARCHAR) AS p FROM f UNION ALL
SELECT r.user_id, r.t + 1 AS t, tr.j, min(r.c + tr.a) + any_value(e) AS c, arg_min(r.p, (r.c + tr.a, tr.i)) || CAST(tr.j AS VARCHAR) AS p {_STEP} GROUP BY r.user_id, r.t, tr.j)
SELECT user_id, round(min(c), 4) AS cost, arg_min(p, (c, j)) AS path FROM r {_LAST} GROUP BY user_id""",
    "gmm_em_step": f"""WITH {_SHARES} SELECT CAST(k AS INT) AS k, round(sum(s) / (SELECT count(*) FROM pts), 6) + 0.0 AS weight, round(sum(s * x) / sum(s), 6) + 0.0 AS m1, round(sum(s * y) / sum(s), 6) + 0.0 AS m2,
round(sum(s * (x - m1) * (x - m1)) / sum(s) + {cluster.RIDGE}, 6) + 0.0 AS c11, round(sum(s * (x - m1) * (y - m2)) / sum(s), 6) + 0.0 AS c12, round(sum(s * (y - m2) * (y - m2)) / sum(s) + {cluster.RIDGE}, 6) + 0.0 AS c22 FROM share GROUP BY k""",
    "gmm_loglik": f"WITH {_SHARES}, one AS (SELECT id, any_value(f) AS f, -ln(sum(p)) AS nlp FROM each GROUP BY id) SELECT f AS l_returnflag, count(*) AS n, round(avg(nlp), 6) AS mean_nlp FROM one GROUP BY f",
    "phone_mixtures": f"""WITH {_PAIRS} SELECT f AS phone, round(avg(x), 6) + 0.0 AS m1, round(avg(y), 6) + 0.0 AS m2, round(covar_pop(x, x) + {cluster.RIDGE}, 6) + 0.0 AS c11,
round(covar_pop(x, y), 6) + 0.0 AS c12, round(covar_pop(y, y) + {cluster.RIDGE}, 6) + 0.0 AS c22 FROM pts WHERE f IS NOT NULL GROUP BY f""",
    "density_grid": f"""WITH {_PAIRS}, m AS (SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS state, avg(x) AS mean, var_pop(x) + {cluster.RIDGE} AS v FROM pts WHERE f IS NOT NULL GROUP BY f)
SELECT state, CAST(-50 + 0.5 * i AS DOUBLE) AS x, round(exp(-0.5 * pow(-50 + 0.5 * i - mean, 2) / v) / sqrt(2 * pi() * v), 8) AS density FROM m CROSS JOIN range(0, 341) g(i)""",
    "acoustic_moves": f"{_BOTH}, {_XI}, s AS (SELECT i, j, sum(v) AS v FROM xi GROUP BY i, j) SELECT 'all' AS word, CAST(i AS INT) AS i, CAST(j AS INT) AS j, nlp FROM (SELECT i, j, v, round(-ln(v / sum(v) OVER (PARTITION BY i)), 6) + 0.0 AS nlp FROM s WHERE v > 0)",
    "cluster_covariance_full": "WITH pts AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL), e AS (SELECT row_number() OVER () AS id, x FROM pts), "
    "u AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e) SELECT CAST(a.i - 1 AS INT) AS i, CAST(b.i - 1 AS INT) AS j, round(covar_pop(a.v, b.v), 6) + 0.0 AS cov FROM u a JOIN u b ON a.id = b.id GROUP BY a.i, b.i",
    "nbest_passing": _NBEST, "nbest_compat": _compat_sql(),
    "rescore_turns": f"""WITH {_ALL_SEQ}, {sql.pads(2)}, {sql.counts_of(2)}, {sql.vocab(2)}, {sql.contexts(2)}, h AS (SELECT conv_id, turn, {sql.TOKENS} AS toks FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn)),
hp AS (SELECT conv_id, turn, list_concat(list_concat(['<s>'], toks), ['</s>']) AS p FROM h), g AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(p)), lambda i: p[i:i + 1])) AS gram FROM hp),
sc AS (SELECT conv_id, turn, sum(-ln((coalesce(cnt, 0) + 1) / (coalesce(ctx_cnt, 0) + v)::DOUBLE)) AS c FROM g LEFT JOIN cnts ON cnts.gram = g.gram LEFT JOIN ctxs ON ctx = g.gram[1:1] CROSS JOIN vsize GROUP BY conv_id, turn)
SELECT CAST(conv_id AS VARCHAR) AS utt, CAST(turn AS INT) AS rank, round(c, 4) AS second_cost, row_number() OVER (PARTITION BY conv_id ORDER BY c, turn) = 1 AS best FROM sc""",
    "streaming_counts": f"WITH {_ALL_SEQ}, {sql.pads(2)}, {sql.counts(2)} SELECT model, ord, array_to_string(gram, ' ') AS gram, cnt FROM cnts",
    "streaming_frames": """WITH e AS (SELECT CAST(floor(epoch_us(ts) / 1000000 / 3600) AS BIGINT) * 3600 AS hour, value FROM events WHERE value IS NOT NULL)
SELECT hour - d AS start, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value * value), 3) AS energy FROM e CROSS JOIN (VALUES (0), (3600)) w(d) GROUP BY hour - d""",
    "streaming_frames_closed": """WITH e AS (SELECT CAST(floor(epoch_us(ts) / 1000000 / 3600) AS BIGINT) * 3600 AS hour, value FROM events WHERE value IS NOT NULL),
w AS (SELECT floor(max(epoch_us(ts)) / 1000) / 1000 - 3 * 3600 AS mark FROM events WHERE value IS NOT NULL)
SELECT hour - d AS start, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value * value), 3) AS energy FROM e CROSS JOIN (VALUES (0), (3600)) v(d) CROSS JOIN w GROUP BY hour - d, mark HAVING hour - d + 7200 <= mark""",
    "streaming_viterbi": f"""WITH RECURSIVE {_HMM}, r AS ({_FIRST} UNION ALL SELECT r.user_id, r.t + 1 AS t, tr.j, min(r.c + tr.a) + any_value(e) AS c {_STEP} GROUP BY r.user_id, r.t, tr.j)
SELECT user_id, any_value(t) AS frames, round(min(c), 4) AS cost, CAST(arg_min(j, (c, j)) AS INT) AS state FROM r {_LAST} GROUP BY user_id""",
    "tokenize_other": r"SELECT token, count(*) AS cnt FROM (SELECT unnest(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)), lambda x: x NOT IN ('<s>', '</s>') AND length(x) >= 3)) AS token FROM documents) GROUP BY token",
    "arpa_roundtrip": f"WITH {_ALL_KATZ} SELECT CAST(ord AS INT) AS ord, array_to_string(gram, ' ') AS gram, {sql.r6('nlp')} AS nlp FROM kp",
    "arpa_lines": f"""WITH {_ALL_KATZ}, body AS (SELECT CAST(ord AS INT) AS section, 0 AS last, '!' || (CASE WHEN key = '<unk>' THEN '0' ELSE '1' END) || key AS "at",
  printf('%.6f', nlp + 0.0) || chr(9) || key || CASE WHEN ord < 2 THEN chr(9) || printf('%.6f', coalesce(nla, 0) + 0.0) ELSE '' END AS text
  FROM (SELECT ord, gram, array_to_string(gram, ' ') AS key, nlp FROM kp) k LEFT JOIN a2 ON k.ord = 1 AND a2.ctx = k.gram)
SELECT section, last, "at", text FROM body UNION ALL SELECT 0, 0, printf('%03d', ord), 'ngram ' || ord || '=' || count(*) FROM kp GROUP BY ord
UNION ALL SELECT * FROM (VALUES (0, 0, '', '\\data\\'), (1, 0, '', '\\1-grams:'), (2, 0, '', '\\2-grams:'), (0, 1, '~', ' '), (1, 1, '~', ' '), (2, 1, '~', ' '), (3, 0, '', '\\end\\')) f""",
    "wer_pairs": """WITH RECURSIVE p AS (SELECT conv_id, turn, string_split(coalesce(next, ''), ' ') AS a, string_split(coalesce(text, ''), ' ') AS b, row_number() OVER () AS id FROM (
  SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next FROM conversations) WHERE next IS NOT NULL),
d AS (SELECT id, 0::BIGINT AS i, range(0, len(b) + 1) AS v FROM p UNION ALL
SELECT id, i, list_transform(range(1, len(m) + 1), lambda j: list_min(list_transform(m[1:j], lambda x, k: x - k)) + j) AS v FROM (
  SELECT d.id, d.i + 1 AS i, list_concat([d.i + 1], list_transform(range(1, len(b) + 1), lambda j: least(d.v[j + 1] + 1, d.v[j] + CASE WHEN b[j] = a[d.i + 1] THEN 0 ELSE 1 END))) AS m
  FROM d JOIN p ON p.id = d.id WHERE d.i < len(a)))
SELECT conv_id, turn, round(v[len(v)] / len(b)::DOUBLE, 6) AS wer FROM p JOIN d ON d.id = p.id AND d.i = len(a)""",
}
SQL |= {
    "segmented_forward": SQL["hmm_forward"], "segmented_backward": SQL["hmm_backward"], "segmented_gamma": SQL["hmm_gamma"],
    "segmented_path": f"SELECT user_id, CAST(i - 1 AS BIGINT) AS t, CAST(path[i] AS BIGINT) AS state, cost FROM ({SQL['viterbi_path']}) CROSS JOIN range(1, 1000000) g(i) WHERE i <= length(path)",
    "long_frames": SQL["hamming_frames"], "long_mfcc": SQL["mfcc_numpy"], "kmeans_turns": _kmeans_sql(LLOYD), "gmm_turns": _gmm_sql(LLOYD),
    "log_sums": """WITH e AS (SELECT event_type, 20 * value AS x, min(20 * value) OVER (PARTITION BY event_type) AS low FROM events WHERE value IS NOT NULL), s AS (SELECT event_type, any_value(low) - ln(sum(exp(low - x))) AS v FROM e GROUP BY event_type)
SELECT event_type, round(v, 6) + 0.0 AS nlp, round(v, 6) + 0.0 AS by_halves FROM s""",
    "trie_perplexity": _trie_sql(3),
    "streaming_paths": f"SELECT user_id, CAST(i - 1 AS BIGINT) AS t, CAST(path[i] AS INT) AS state FROM ({SQL['viterbi_path']}) CROSS JOIN range(1, 1000000) g(i) WHERE i <= length(path)",
    "baum_welch_turns": f"""{_BOTH}, {_XI}, {_FIRST_MOVES}, {_again(_ALPHA)}, {_again(_BETA.partition("b AS (")[1] + _BETA.partition("b AS (")[2])}, {_again(_TOTAL)}, {_again(_XI)}, {_again(_FIRST_MOVES).replace("tr22", "tr3").replace("st22", "st3")}
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN a > 1e29 THEN 0.0 ELSE round(exp(-a), 6) + 0.0 END AS p FROM (SELECT i, j, a FROM tr3 UNION ALL SELECT -1, j, a FROM st3)""",
}
for _n in (1, 2, 3):
    SQL[f"ngram_counts_{_n}"] = f"WITH {sql.seqs()}, {sql.pads(_n)}, {sql.counts(_n)} SELECT model, ord, array_to_string(gram, ' ') AS gram, cnt FROM cnts WHERE ord = {_n}"
