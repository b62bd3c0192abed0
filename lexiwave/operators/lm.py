"""N-gram language models as tables: maximum likelihood, additive, Good-Turing and Katz back-off.

Probabilities are negative natural logs (``nlp``). All functions work for many models at once, told apart
by ``model``. Context counts are sums over continuations, which no valid context lacks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiwave.functions.neglog import clamp, inf, neglog, ratio
from lexiwave.functions.scratch import Scratch, small
from lexiwave.operators.text import END, SEPARATOR, START, UNKNOWN, context, count_of_counts, counted_vocabulary, gram_counts, gram_key, padded, vocabulary, windows

UNSEEN = 1e-9
#: grams of a context that one task may hold
WINDOW_ROWS = 1_000_000
#: contexts of a test that are sent to every executor; more are joined
TEST_CONTEXTS = 200_000


def vocabulary_size(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("model").agg(F.count("*").alias("v"))


def context_totals(counts: DataFrame, n: int) -> DataFrame:
    """(model, ctx, ctx_cnt) of order n."""
    return counts.where(F.col("ord") == n).groupBy("model", context(F.col("gram")).alias("ctx")).agg(F.sum("cnt").alias("ctx_cnt"))


def over_contexts(grams: DataFrame, words: int, **sums: Column) -> DataFrame:
    """``grams`` with aggregates over their contexts added, sorted and joined by one string a context.

    A context has at most as many grams as there are ``words``. Up to ``WINDOW_ROWS`` a window takes them. Of a
    larger vocabulary, contexts with more grams are found by an aggregate, summed before the shuffle, and
    joined to theirs, so no task holds one; they are one in ``WINDOW_ROWS`` grams at most.
    """
    keyed = grams.withColumn("ctx_key", F.array_join(context(F.col("gram")), " "))

    def by_window(some: DataFrame) -> DataFrame:
        by = Window.partitionBy("model", "ctx_key")
        return some.withColumns({name: c.over(by) for name, c in sums.items()}).drop("ctx_key")

    if words <= WINDOW_ROWS:
        return by_window(keyed)
    found = keyed.groupBy("model", "ctx_key").agg(F.count("*").alias("ctx_grams"), *[c.alias(name) for name, c in sums.items()])
    large = keyed.join(small(found.where(F.col("ctx_grams") > WINDOW_ROWS)), ["model", "ctx_key"], "left")
    rest = by_window(large.where("ctx_grams is null").drop("ctx_grams", *sums))
    return rest.unionByName(large.where("ctx_grams is not null").select(*rest.columns))


def with_context_totals(grams: DataFrame, words: int) -> DataFrame:
    """``grams`` with ctx_cnt, the sum over its context."""
    return over_contexts(grams, words, ctx_cnt=F.sum("cnt"))


def additive(counts: DataFrame, vocab: DataFrame, n: int, extra: float) -> DataFrame:
    """(model, gram, cnt, nlp) of the observed grams: (cnt + extra) / (context + extra * v).

    ``extra`` 0 is maximum likelihood, 1 Laplace.
    """
    if extra < 0:
        raise ValueError("the addition must not be negative")
    return (
        with_context_totals(counts.where(F.col("ord") == n), vocab.count()).join(small(vocabulary_size(vocab)), "model")
        .select("model", "gram", "cnt", neglog(ratio(F.col("cnt") + extra, F.col("ctx_cnt") + extra * F.col("v"))).alias("nlp"))
    )


def test_windows(seqs: DataFrame, vocab: DataFrame, n: int, *also: str) -> DataFrame:
    """(model, gram, times) of held-out sequences: every window of order n up to the end mark, unknown words replaced; apart by the columns ``also``.

    Distinct grams are looked up once and weighed by how often they occur.
    """
    of = ["model", *also]
    p = padded(F.col("toks"), n) if n > 1 else F.concat(F.col("toks"), F.array(F.lit(END)))
    raw = seqs.select(*of, p.alias("p")).select(*of, F.explode(windows(F.col("p"), n)).alias("gram")).groupBy(*of, "gram").agg(F.count("*").alias("times"))
    word = raw.select(*of, "gram", "times", *[F.element_at("gram", i + 1).alias(f"w{i}") for i in range(n)])
    for i in range(n):
        known = vocab.select(F.col("model"), F.col("token").alias(f"w{i}"), F.lit(True).alias(f"k{i}"))
        word = word.join(known, ["model", f"w{i}"], "left").withColumn(f"w{i}", F.when(F.col(f"k{i}"), F.col(f"w{i}")).otherwise(UNKNOWN))
    return word.groupBy(*of, F.array(*[F.col(f"w{i}") for i in range(n)]).alias("gram")).agg(F.sum("times").alias("times"))


def perplexity(scored: DataFrame) -> DataFrame:
    """(model, windows, perplexity) of (model, times, nlp)."""
    return scored.groupBy("model").agg(
        F.sum("times").alias("windows"), F.exp(F.sum(F.col("times") * F.col("nlp")) / F.sum("times")).alias("perplexity"))


def score_additive(test: DataFrame, counts: DataFrame, vocab: DataFrame, n: int, extra: float) -> DataFrame:
    """``test`` with nlp under the additive model of order n."""
    grams = counts.where(F.col("ord") == n)
    asked = Scratch(test.sparkSession, "asked").save(test.select("model", context(F.col("gram")).alias("ctx")).distinct(), "contexts")
    if asked.limit(TEST_CONTEXTS + 1).count() <= TEST_CONTEXTS:  # so few that only their grams are shuffled
        grams = grams.withColumn("ctx", context(F.col("gram"))).join(F.broadcast(asked), ["model", "ctx"], "left_semi")
    top = grams.select("model", "gram", "cnt")
    return (
        test.withColumn("ctx", context(F.col("gram"))).join(top, ["model", "gram"], "left").join(context_totals(grams, n), ["model", "ctx"], "left")
        .join(small(vocabulary_size(vocab)), "model")
        .withColumn("nlp", neglog(ratio(F.coalesce("cnt", F.lit(0)) + extra, F.coalesce("ctx_cnt", F.lit(0)) + extra * F.col("v"))))
        .drop("ctx", "cnt", "ctx_cnt", "v")
    )


@dataclass
class GoodTuring:
    """Fit: (model, slope, intercept, points, total, p0). Contexts: (model, ctx, z). Probs: (model, gram, cnt, nlp)."""

    fit: DataFrame
    contexts: DataFrame
    probs: DataFrame


def good_turing(counts: DataFrame, vocab: DataFrame, n: int) -> GoodTuring:
    """Simple Good-Turing of order n, made to sum to one over the vocabulary in every context.

    Z_r averages N_r over the gap to its neighbours; ln Z is fitted by a line in ln r (one point alone is
    fitted by the shortest line through it). The normaliser of a context is its observed sum plus the mass
    of one unseen gram for every other word, so no vocabulary is crossed with contexts.
    """
    spectrum = count_of_counts(counts.where(F.col("ord") == n))
    by_r = Window.partitionBy("model").orderBy("r")
    q, t = F.coalesce(F.lag("r").over(by_r), F.lit(0)), F.lead("r").over(by_r)
    z = spectrum.withColumn("q", q).withColumn("t", t).select(
        "model", "r", "n_r", F.ln("r").alias("x"),
        F.ln(F.when(F.col("t").isNull(), F.col("n_r") / (F.col("r") - F.col("q"))).otherwise(F.col("n_r") / (0.5 * (F.col("t") - F.col("q"))))).alias("y"))
    lone = F.max(F.col("y") / (F.col("x") * F.col("x") + 1))
    fit = z.groupBy("model").agg(
        F.coalesce(F.regr_slope("y", "x"), lone * F.max("x")).alias("slope"), F.coalesce(F.regr_intercept("y", "x"), lone).alias("intercept"),
        F.count("*").alias("points"), F.sum(F.col("r") * F.col("n_r")).alias("total"),
    ).withColumn("p0", F.exp(F.col("intercept")) / F.col("total"))
    lnz = lambda r: F.col("slope") * F.ln(r) + F.col("intercept")
    r = F.col("cnt").cast("double")
    raw = (
        counts.where(F.col("ord") == n).withColumn("ctx", context(F.col("gram"))).join(small(fit), "model")
        .withColumn("p", F.exp(F.ln(r + 1) + lnz(r + 1) - lnz(r) - F.ln("total")))
    )
    sizes, mass = small(vocabulary_size(vocab)), lambda seen, words, p0: seen + (F.col("v") - words) * p0
    contexts = (
        raw.groupBy("model", "ctx").agg(F.sum("p").alias("seen"), F.count("*").alias("words"), F.max("p0").alias("p0"))
        .join(sizes, "model").select("model", "ctx", mass(F.col("seen"), F.col("words"), F.col("p0")).alias("z"))
    )
    summed = over_contexts(raw, vocab.count(), seen=F.sum("p"), kinds=F.count("*")).join(sizes, "model")
    z = mass(F.col("seen"), F.col("kinds"), F.col("p0"))
    probs = summed.select("model", "gram", "cnt", neglog(F.col("p") / z).alias("nlp"))
    return GoodTuring(fit, contexts, probs)


def score_good_turing(test: DataFrame, model: GoodTuring, vocab: DataFrame) -> DataFrame:
    """``test`` with nlp: the gram's, or an unseen gram's share of its context, or 1 / v in an unseen context."""
    return (
        test.withColumn("ctx", context(F.col("gram"))).join(model.probs.select("model", "gram", F.col("nlp").alias("own")), ["model", "gram"], "left")
        .join(model.contexts, ["model", "ctx"], "left").join(small(model.fit.select("model", "p0")), "model").join(small(vocabulary_size(vocab)), "model")
        .withColumn("nlp", F.coalesce("own", F.when(F.col("z").isNotNull(), neglog(F.col("p0") / F.col("z"))), F.ln(F.col("v").cast("double"))))
        .drop("ctx", "own", "z", "p0", "v")
    )


@dataclass
class Katz:
    """Discounts: (model, ord, r, d). Probs: (model, ord, gram, cnt, nlp). Backoffs: (model, ord, ctx, nla)."""

    n: int
    reserved: float
    discounts: DataFrame
    probs: DataFrame
    backoffs: DataFrame


def katz_discounts(counts: DataFrame, k: int = 5) -> DataFrame:
    """(model, ord, r, d) for orders above 1 and r up to k.

    Counts of counts are written down, so grams are counted once.
    """
    return discounts_of(Scratch(counts.sparkSession, "spectrum").save(count_of_counts(counts.where("ord > 1")), "spectrum"), k)


def discounts_of(spectrum: DataFrame, k: int = 5) -> DataFrame:
    """(model, ord, r, d) from (model, ord, r, n_r), of which counts up to k + 1 and the largest are used.

    A count that is missing is 0 up to the order's largest and 1e-9 above it. Where the formula divides by zero there is no discount.
    """
    top = spectrum.groupBy("model", "ord").agg(F.max("r").alias("top"))
    grid = top.withColumn("r", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k + 1).cast("long"))))
    full = grid.join(spectrum, ["model", "ord", "r"], "left").withColumn(
        "n_r", F.when(F.col("r") <= F.col("top"), F.coalesce("n_r", F.lit(0)).cast("double")).otherwise(UNSEEN))
    by_r = Window.partitionBy("model", "ord").orderBy("r")
    whole = Window.partitionBy("model", "ord")
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("n_r"))).over(whole)
    cut = ratio((k + 1) * at(k + 1), at(1))
    best = ratio((F.col("r") + 1) * F.lead("n_r").over(by_r), F.col("n_r") * F.col("r"))
    named = full.withColumn("cut", cut).withColumn("share", best)
    d = F.try_divide(F.col("share") - F.col("cut"), 1 - F.col("cut"))
    return named.where(F.col("r") <= k).select("model", "ord", "r", F.coalesce(clamp(d), F.lit(1.0)).alias("d"))


def katz(counts: DataFrame, n: int, k: int = 5, reserved: float = 0.01, contexts: DataFrame | None = None) -> Katz:
    """Katz back-off of order n: discounted observed grams and the weights of backing off from contexts.

    With ``contexts``, rows of (model, ord, ctx), tables of orders above 1 hold only grams and weights of
    these; a context's own tail must be among them too, as in ``test_contexts``.
    """
    if k < 1 or not 0 < reserved < 1:
        raise ValueError("k is 1 or more, and the reserved probability is between 0 and 1")
    scratch = Scratch(counts.sparkSession, "katz")
    discounts = scratch.save(katz_discounts(counts, k), "discounts")
    sent, total = small(discounts), counts.where("ord = 1").groupBy("model").agg(F.sum("cnt").alias("total"))
    if contexts is not None:
        contexts = scratch.save(contexts.select("model", "ord", gram_key("ctx").alias("ctx")), "contexts")
    ones = counts.where("ord = 1").join(small(total), "model").select(
        "model", "ord", "gram", "cnt", ((1 - reserved) * F.col("cnt") / F.col("total")).alias("p"))
    parts, backoffs = [ones], None
    for m in range(2, n + 1):
        key = gram_key("gram")
        grams = counts.where(F.col("ord") == m).select("model", "ord", key.alias("key"), F.substring_index(key, SEPARATOR, m - 1).alias("ctx"), "cnt")
        if contexts is not None:
            grams = grams.join(small(contexts.where(F.col("ord") == m).select("model", "ctx"), TEST_CONTEXTS), ["model", "ctx"], "left_semi")
        cut = grams.join(sent.withColumnRenamed("r", "cnt"), ["model", "ord", "cnt"], "left").withColumn("cut", F.coalesce("d", F.lit(1.0)) * F.col("cnt"))
        # a row a context, summed before the shuffle: a gram is joined to it, never gathered with its like
        sums = cut.groupBy("model", "ctx").agg(F.sum("cnt").alias("ctx_cnt"), F.sum("cut").alias("hi"))
        if contexts is not None:
            sums = small(scratch.save(sums, f"sums{m}"), TEST_CONTEXTS)
        whole = cut.join(sums.select("model", "ctx", "ctx_cnt"), ["model", "ctx"]).select("model", "ord", F.split("key", SEPARATOR).alias("gram"), "cnt", (F.col("cut") / F.col("ctx_cnt")).alias("p"))
        parts.append(whole)
        low = parts[m - 2].select("model", gram_key("gram").alias("low"), F.col("p").alias("low_p"))
        tails = grams.select("model", "ctx", F.substring_index("key", SEPARATOR, 1 - m).alias("low")).join(low, ["model", "low"])
        lows = tails.groupBy("model", "ctx").agg(F.sum("low_p").alias("lo"))
        own = sums.join(lows, ["model", "ctx"], "left").select(
            "model", F.lit(m).alias("ord"), F.split("ctx", SEPARATOR).alias("ctx"),
            neglog(clamp(1 - F.col("hi") / F.col("ctx_cnt")) / clamp(1 - F.coalesce("lo", F.lit(0.0)))).alias("nla"))
        backoffs = own if backoffs is None else backoffs.unionByName(own)
    probs = parts[0]
    for part in parts[1:]:
        probs = probs.unionByName(part)
    unknown = counts.select("model").distinct().select(
        "model", F.lit(1).alias("ord"), F.array(F.lit(UNKNOWN)).alias("gram"), F.lit(0).cast("long").alias("cnt"), F.lit(float(reserved)).alias("p"))
    probs = probs.where(~((F.col("ord") == 1) & (F.col("gram")[0] == UNKNOWN))).unionByName(unknown).withColumn("nlp", neglog(F.col("p"))).drop("p")
    if backoffs is None:
        backoffs = probs.limit(0).select("model", "ord", F.col("gram").alias("ctx"), F.col("nlp").alias("nla"))
    return Katz(n, reserved, discounts, probs, backoffs)


def test_contexts(test: DataFrame, n: int) -> DataFrame:
    """(model, ord, ctx) of everything that scoring ``test`` backs off through."""
    out = None
    for m in range(2, n + 1):
        own = test.select("model", F.lit(m).alias("ord"), F.slice("gram", n - m + 1, m - 1).alias("ctx"))
        out = own if out is None else out.unionByName(own)
    return test.select("model", F.lit(1).alias("ord"), F.col("gram").alias("ctx")).limit(0) if out is None else out.distinct()


def score_katz(test: DataFrame, model: Katz) -> DataFrame:
    """``test`` with nlp by backing off: n left joins from the longest order to the shortest."""
    now, answer, carried = test, F.lit(None).cast("double"), F.lit(0.0)
    for m in range(model.n, 0, -1):
        tail = F.slice(F.col("gram"), model.n - m + 1, m)
        own = model.probs.where(F.col("ord") == m).select("model", F.col("gram").alias(f"g{m}"), F.col("nlp").alias(f"p{m}"))
        now = now.withColumn(f"g{m}", tail).join(own, ["model", f"g{m}"], "left")
        answer = F.coalesce(answer, carried + F.col(f"p{m}"))
        if m > 1:
            weight = model.backoffs.where(F.col("ord") == m).select("model", F.col("ctx").alias(f"c{m}"), F.col("nla").alias(f"a{m}"))
            now = now.withColumn(f"c{m}", context(tail)).join(weight, ["model", f"c{m}"], "left")
            carried = carried + F.coalesce(F.col(f"a{m}"), F.lit(0.0))
    return now.withColumn("nlp", F.coalesce(answer, inf())).select(*test.columns, "nlp")


def gram_oov_rate(test_counts: DataFrame, train_counts: DataFrame, n: int) -> DataFrame:
    """(model, unseen, distinct_grams, rate): percent of the distinct order-n test grams not in training."""
    test = test_counts.where(F.col("ord") == n).select("model", "gram")
    train = train_counts.where(F.col("ord") == n).select("model", "gram", F.lit(1).alias("seen"))
    joined = test.join(train, ["model", "gram"], "left")
    return joined.groupBy("model").agg(
        F.sum(F.when(F.col("seen").isNull(), 1).otherwise(0)).alias("unseen"), F.count("*").alias("distinct_grams"),
    ).withColumn("rate", 100 * ratio(F.col("unseen"), F.col("distinct_grams")))


def token_oov_rate(test: DataFrame, vocab: DataFrame) -> DataFrame:
    """(model, unseen, total_tokens, rate): percent of test token occurrences outside the vocabulary."""
    words = test.select("model", F.explode("toks").alias("token")).groupBy("model", "token").agg(F.count("*").alias("times"))
    joined = words.join(vocab.withColumn("known", F.lit(1)), ["model", "token"], "left")
    return joined.groupBy("model").agg(
        F.sum(F.when(F.col("known").isNull(), F.col("times")).otherwise(0)).alias("unseen"), F.sum("times").alias("total_tokens"),
    ).withColumn("rate", 100 * ratio(F.col("unseen"), F.col("total_tokens")))


MODELS = ("mle", "laplace", "additive", "good_turing", "katz")


@dataclass
class LanguageModel:
    """One of ``MODELS`` trained on sequences, with the tables scoring needs.

    ``restored`` is a Katz model read back from a file in place of counts.
    """

    kind: str
    n: int
    counts: DataFrame | None
    vocab: DataFrame
    addition: float = 5
    k: int = 5
    reserved: float = 0.01
    restored: Katz | None = None

    def katz(self, test: DataFrame | None = None) -> Katz:
        if self.restored is not None:
            return self.restored
        return katz(self.counts, self.n, self.k, self.reserved, None if test is None else test_contexts(test, self.n))

    def score(self, test: DataFrame) -> DataFrame:
        if self.kind == "good_turing":
            return score_good_turing(test, good_turing(self.counts, self.vocab, self.n), self.vocab)
        if self.kind == "katz":
            return score_katz(test, self.katz(test))
        return score_additive(test, self.counts, self.vocab, self.n, {"mle": 0, "laplace": 1}.get(self.kind, self.addition))

    def probs(self) -> DataFrame:
        if self.kind == "good_turing":
            return good_turing(self.counts, self.vocab, self.n).probs
        if self.kind == "katz":
            return self.katz().probs
        return additive(self.counts, self.vocab, self.n, {"mle": 0, "laplace": 1}.get(self.kind, self.addition))

    def perplexity(self, seqs: DataFrame) -> DataFrame:
        return perplexity(self.score(test_windows(seqs, self.vocab, self.n)))

    def oov_rate(self, seqs: DataFrame) -> DataFrame:
        seen = self.counts if self.restored is None else self.restored.probs
        return gram_oov_rate(gram_counts(seqs, self.n, [self.n]), seen, self.n)


def train(kind: str, seqs: DataFrame, n: int, addition: float = 5, k: int = 5, reserved: float = 0.01) -> LanguageModel:
    """Factory of language models. Counts and vocabulary are written once, counts by order; all tables are made from them."""
    if kind not in MODELS:
        raise ValueError(f"unknown language model {kind!r}; one of {', '.join(MODELS)}")
    if n < 1:
        raise ValueError("the order is 1 or more")
    if kind == "additive" and addition <= 0:
        raise ValueError("the addition is above 0")
    if kind == "katz" and (k < 1 or not 0 < reserved < 1):
        raise ValueError("k is 1 or more, and the reserved probability is between 0 and 1")
    scratch = Scratch(seqs.sparkSession, "lm")
    # an order is written from the one above it, so words are shuffled once
    counts = gram_counts(seqs, n, None if kind == "katz" else [n], lambda level, m: scratch.save(level, f"counts{m}", compression="zstd"))
    if n > 1 and kind == "katz":
        ones = counts.where("ord = 1").select("model", F.col("gram")[0].alias("token"))
        vocab = ones.unionByName(ones.where(F.col("token") == END).select("model", F.explode(F.array(*map(F.lit, [START, UNKNOWN]))).alias("token"))).distinct()
    else:
        vocab = vocabulary(seqs, n) if n == 1 else counted_vocabulary(counts, n)
    return LanguageModel(kind, n, counts, scratch.save(vocab, "vocabulary"), addition, k, reserved)


def restored(model: Katz) -> LanguageModel:
    """A Katz model read from a file as a language model; its unigrams are its vocabulary."""
    words = model.probs.where("ord = 1").select("model", F.col("gram")[0].alias("token")).distinct()
    return LanguageModel("katz", model.n, None, words, reserved=model.reserved, restored=model)
