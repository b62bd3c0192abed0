"""Katz trigram tables from one shuffle of words.

Every word of a corpus stands once between two others, so a row is a word with both neighbours. Rows are dealt
by the word in the middle: the grams of a context, the counts of its last two words and of the middle word
are then in one task, and no gram is shuffled again to be joined. What back-off weights need of a
context's grams are numbers of them by count, so these are written and grams are not.

Frequent words are numbers on the way, three in one long; others go as strings. Which are which is
looked up in some of the sequences and changes no result. A word with more than a share of all would make one
task long: its rows are dealt by the word behind it too, and sums over its contexts are added up after.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiwave.functions.neglog import clamp, neglog
from lexiwave.functions.scratch import Scratch, small
from lexiwave.functions.shipping import ship
from lexiwave.operators import lm
from lexiwave.operators.text import END, START, UNKNOWN, padded

#: words and models that are numbers; at most 2 ** 17 - 2 and 2 ** 12 - 1
WORDS, MODELS = 120_000, 4_000
#: sequences that are looked up for them
LOOKED_UP = 5_000
#: a word with more than one of so many, or more than so many rows, is dealt by the word behind it
SHARE, GROUP = 200, 3_000_000
#: words, and rows of whole middle words, that a kernel takes at once, and rows that it gives
PIECE, CHUNK, GIVEN = 2_000_000, 400_000, 65_536

# a long holds a model's number, from 1, and three words': 0 is none, 1 one that is a string
BITS = 17
NONE, STRING, FIRST = 0, 1, 2
WORD = (1 << BITS) - 1
MODEL, LEFT, MIDDLE, RIGHT = ((1 << 12) - 1) << 3 * BITS, WORD << 2 * BITS, WORD << BITS, WORD

ROW = "g long, m string, r1 string, r2 string, r3 string, cnt long"


@dataclass
class Book:
    """Numbers of words, the most frequent first, and of models; the first ``heavy`` words are dealt by the word behind them."""

    words: list[str]
    models: list[str]
    heavy: int

    @classmethod
    def of(cls, seqs: DataFrame) -> "Book":
        n = seqs.count()
        share = max(1.0, n / LOOKED_UP)
        some = seqs.where(F.rand(1) < 1 / share) if share > 1 else seqs  # a filter goes before the words are cut
        words = some.select(F.explode(padded(F.col("toks"), 3)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        found = words.orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
        models = [r.model for r in some.groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(MODELS).collect()]
        counts = found["n"].to_numpy()
        return cls(found["word"].to_pylist(), models, int(((counts * SHARE > counts.sum()) | (counts * share > GROUP)).sum()))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row, sent to every executor."""
        row = pa.table({"words": pa.array([self.words], pa.list_(pa.string())), "models": pa.array([self.models], pa.list_(pa.string()))})
        return F.broadcast(spark.createDataFrame(row, "words array<string>, models array<string>"))


def coded(book: Book) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel from (model, toks) to ``ROW``: equal rows of a piece are one."""
    names, marks = book.models, [START, END]
    words = pa.array(book.words, pa.string())

    def number(values: pa.Array, known: pa.Array, first: int, other: int) -> np.ndarray:
        at = pc.index_in(values, value_set=known)
        return np.where(at.is_null().to_numpy(False), other, pc.fill_null(at, 0).to_numpy(False).astype(np.int64) + first)

    def piece(model: pa.Array, sizes: np.ndarray, toks: pa.Array) -> pa.Table:
        values = pa.concat_arrays([toks, pa.array(marks, pa.string())])
        number_of = number(values, words, FIRST, STRING)
        whole = sizes + 3
        ends = np.cumsum(whole)
        starts, of = ends - whole, np.repeat(np.arange(len(sizes)), sizes)
        at = np.full(ends[-1], len(toks))  # a start mark
        at[ends - 1] = len(toks) + 1
        at[np.arange(len(toks)) + 3 * of + 2] = np.arange(len(toks))
        c2 = number_of[at]
        before, behind = np.roll(at, 1), np.roll(at, -1)
        c1, c3 = np.roll(c2, 1), np.roll(c2, -1)
        c1[starts], c3[ends - 1] = NONE, NONE
        of_model = number(model, pa.array(names, pa.string()), 1, 0)
        g = (np.repeat(of_model, whole) << 3 * BITS) | (c1 << 2 * BITS) | (c2 << BITS) | c3
        plain = (c1 != STRING) & (c2 != STRING) & (c3 != STRING) & np.repeat(of_model > 0, whole)
        keys, times = np.unique(g[plain], return_counts=True)
        rest = ~plain
        text = lambda c, where: values.take(pa.array(where[rest], mask=c[rest] != STRING))
        rare = np.repeat(np.arange(len(sizes)), whole)[rest]
        strings = pa.table({
            "g": g[rest], "m": model.take(pa.array(rare, mask=of_model[rare] > 0)), "r1": text(c1, before), "r2": text(c2, at), "r3": text(c3, behind),
        }).group_by(["g", "m", "r1", "r2", "r3"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["g", "m", "r1", "r2", "r3", "cnt"])
        none = pa.nulls(len(keys), pa.string())
        return pa.concat_tables([pa.table({"g": keys, "m": none, "r1": none, "r2": none, "r3": none, "cnt": times.astype(np.int64)}), strings.cast(pa.schema(
            [("g", pa.int64()), *[(c, pa.string()) for c in ("m", "r1", "r2", "r3")], ("cnt", pa.int64())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, toks = batch.column(0).cast(pa.string()), batch.column(1)
            ends = np.cumsum(pc.list_value_length(toks).to_numpy(False))
            first = 0
            while first < len(model):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + PIECE, "right")))
                some = toks.slice(first, last - first)
                yield from piece(model.slice(first, last - first), np.diff(ends[first:last], prepend=before), some.flatten().cast(pa.string())).to_batches(GIVEN)
                first = last

    return run


@dataclass
class Grams:
    """Different rows of whole middle words. ``at`` is one of the rows taken; ``of`` numbers middle words in order, ``w1`` and ``w3`` the others within these rows."""

    at: np.ndarray
    of: np.ndarray
    w1: np.ndarray
    w3: np.ndarray
    cnt: np.ndarray
    goes_on: np.ndarray
    low_cnt: np.ndarray
    low_first: np.ndarray

    def by_context(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of contexts and where each begins."""
        order = np.lexsort((self.w1, self.of))
        return order, _begins(self.of[order], self.w1[order])


def _begins(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def grams_of(rows: pa.Table) -> Grams:
    g, cnt = rows["g"].to_numpy(), rows["cnt"].to_numpy()

    def local(right: int, name: str) -> np.ndarray:
        ids = pc.fill_null(rows[name].combine_chunks().dictionary_encode().indices, -1).to_numpy(False).astype(np.int64)
        return np.where(ids < 0, (g >> right) & WORD, ids + WORD + 1)

    w1, w2, w3 = local(2 * BITS, "r1"), local(BITS, "r2"), local(0, "r3")
    middle = np.unique(local(3 * BITS, "m") * (int(w2.max()) + 1) + w2, return_inverse=True)[1]
    size = [int(x.max()) + 1 for x in (middle, w3, w1)]
    if size[0] * size[1] * size[2] < 1 << 63:
        order = np.argsort((middle * size[1] + w3) * size[2] + w1)
    else:
        order = np.lexsort((w1, w3, middle))
    of, w1, w3 = middle[order], w1[order], w3[order]
    at = _begins(of, w3, w1)
    cnt = np.add.reduceat(cnt[order], at)
    of, w1, w3 = of[at], w1[at], w3[at]
    low = _begins(of, w3)
    first = np.zeros(len(at), bool)
    first[low] = True
    return Grams(order[at], of, w1, w3, cnt, w3 != NONE, np.repeat(np.add.reduceat(cnt, low), np.diff(low, append=len(at))), first & (w3 != NONE))


def by_middle(work: Callable[[pa.Table, Grams], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel that gives ``work`` the rows of whole middle words, of as many as make ``CHUNK`` rows. They come sorted by ``key``, which a word has one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, CHUNK
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < most:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows["key"].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                some = rows.slice(0, whole)
                yield from work(some, grams_of(some)).to_batches(GIVEN)
                held, n = rows.slice(whole).combine_chunks().to_batches(), n - whole
            most = CHUNK if whole else 2 * n  # a key's rows are looked at again when they have doubled
        if n:
            rows = pa.Table.from_batches(held)
            yield from work(rows, grams_of(rows)).to_batches(GIVEN)

    return run


def _taken(rows: pa.Table, at: np.ndarray, mask: int, *strings: str) -> dict[str, pa.Array]:
    return {"g": rows["g"].to_numpy()[at] & mask} | {c: rows[c].combine_chunks().take(pa.array(at)) for c in strings}


def _sums_by(of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by sorted numbers, a sum a value."""
    begins = _begins(of)
    return np.repeat(np.add.reduceat(values, begins), np.diff(begins, append=len(of)))


TRIPLE = ROW + ", ctx_cnt long, first boolean, low_cnt long, low_ctx long"


def with_totals(rows: pa.Table, grams: Grams) -> pa.Table:
    """``TRIPLE``: grams with how often their context goes on, as far as these rows know. ``first`` is one of each pair of the word and the next, and has how often this pair and the word with any next are found."""
    order, begins = grams.by_context()
    on = np.where(grams.goes_on, grams.cnt, 0)
    ctx = np.empty(len(on), np.int64)
    ctx[order] = np.repeat(np.add.reduceat(on[order], begins), np.diff(begins, append=len(on)))
    return pa.table(_taken(rows, grams.at, -1, "m", "r1", "r2", "r3") | {
        "cnt": grams.cnt, "ctx_cnt": ctx, "first": grams.low_first,
        "low_cnt": pa.array(grams.low_cnt, mask=~grams.low_first), "low_ctx": pa.array(_sums_by(grams.of, on), mask=~grams.low_first)})


def context_row(k: int) -> dict[str, str]:
    """Numbers of a context: how often it is found and goes on, its grams found 1 to k + 1 times and the counts of those found more than k times, and the same of their lower grams."""
    return {f"n{r}": "int" for r in range(1, k + 2)} | {f"low{r}": "int" for r in range(1, k + 1)} | {"all": "long", "ctx_cnt": "long", "more": "long", "low_more": "long"}


def contexts(k: int) -> Callable[[pa.Table, Grams], pa.Table]:
    """(g, m, r1, r2), ``context_row``, the largest count, and how often the middle word goes on and is found, as far as these rows know."""

    def work(rows: pa.Table, grams: Grams) -> pa.Table:
        order, begins = grams.by_context()
        on = np.where(grams.goes_on, grams.cnt, 0)
        # rows without a word before are of no gram
        is_gram = grams.goes_on & (grams.w1 != NONE)
        cnt, low = np.where(is_gram, grams.cnt, 0)[order], np.where(is_gram, grams.low_cnt, 0)[order]

        def sums(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, begins, dtype=np.int32 if values.dtype == bool else np.int64)

        first = order[begins]
        out = _taken(rows, grams.at[first], MODEL | LEFT | MIDDLE, "m", "r1", "r2")
        out |= {f"n{r}": sums(cnt == r) for r in range(1, k + 2)}
        out |= {f"low{r}": sums(low == r) for r in range(1, k + 1)}
        out |= {"all": sums(grams.cnt[order]), "ctx_cnt": sums(on[order]), "more": sums(np.where(cnt > k, cnt, 0)), "low_more": sums(np.where(low > k, low, 0))}
        out |= {"top": np.maximum.reduceat(cnt, begins), "low_ctx": _sums_by(grams.of, on)[first], "middle": _sums_by(grams.of, grams.cnt)[first]}
        return pa.table(out)

    return work


def _numbers(g: Column, right: int) -> Column:
    return F.shiftright(g, right).bitwiseAND(F.lit(WORD))


def _masked(*parts: int) -> Column:
    return F.col("g").bitwiseAND(F.lit(sum(parts)))


def _left() -> Column:
    return _numbers(F.col("g"), 2 * BITS)


def _middle() -> Column:
    return _numbers(F.col("g"), BITS)


def _right() -> Column:
    return _numbers(F.col("g"), 0)


def _gram() -> Column:
    """Whether a word stands between two others."""
    return (_left() != NONE) & (_right() != NONE)


def _model() -> Column:
    return F.coalesce("m", F.get("models", (F.shiftright("g", 3 * BITS) - 1).cast("int")))


def _word(number: Column, string: str) -> Column:
    return F.coalesce(string, F.get("words", (number - FIRST).cast("int")))


def _heavy(book: Book) -> Column:
    return _middle().between(FIRST, FIRST + book.heavy - 1)


def triples(seqs: DataFrame, book: Book, work: Callable[[pa.Table, Grams], pa.Table], kinds: str) -> DataFrame:
    """What ``work`` makes of words and their neighbours, dealt by the word."""
    ship(seqs.sparkSession)
    rows = seqs.where("model is not null").select("model", "toks").mapInArrow(coded(book), ROW)
    middle = [_masked(MODEL, MIDDLE), F.col("m"), F.col("r2")]
    part = F.pmod(F.hash(*middle, *[F.when(_heavy(book), c) for c in (_right(), F.col("r3"))]), F.lit(1 << 16))
    # one long, for rows are sorted by it without a look at them
    key = F.when(F.col("m").isNull() & F.col("r2").isNull(), middle[0]).otherwise(F.xxhash64(*middle))
    dealt = rows.withColumn("part", part).repartition("part").drop("part").withColumn("key", key)
    return dealt.sortWithinPartitions("key").mapInArrow(by_middle(work), kinds)


def _named(rows: DataFrame, table: DataFrame, **columns: Column) -> DataFrame:
    """Rows with words and models in place of their numbers."""
    return rows.crossJoin(table).select(_model().alias("model"), *[c.alias(name) for name, c in columns.items()])


def _joined(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Each of ``rows`` with its one of ``other``; null is a value."""
    there = other.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in other.columns if c not in on])
    return rows.join(there, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]).drop(*[f"__{c}" for c in on])


def probs(seqs: DataFrame, k: int = 5, reserved: float = 0.01) -> DataFrame:
    """(model, ord, gram, cnt, nlp), the grams of the Katz trigram model of each ``model`` of ``seqs``."""
    spark = seqs.sparkSession
    scratch, book = Scratch(spark, "triples"), Book.of(seqs)
    table, heavy = book.table(spark), _heavy(book)
    rows = scratch.save(triples(seqs, book, with_totals, TRIPLE), "triples", compression="zstd")

    own = rows.where(_gram()).select(_masked(MODEL).alias("g"), "m", F.lit(3).alias("ord"), F.col("cnt").alias("r"))
    low = rows.where("first").select(_masked(MODEL).alias("g"), "m", F.lit(2).alias("ord"), F.col("low_cnt").alias("r"))
    spectrum = own.unionByName(low).groupBy("g", "m", "ord", "r").agg(F.count("*").alias("n_r"))
    sent = small(scratch.save(lm.discounts_of(scratch.save(_named(spectrum, table, ord=F.col("ord"), r=F.col("r"), n_r=F.col("n_r")), "spectrum"), k), "discounts"))

    w1, w2, w3 = _word(_left(), "r1"), _word(_middle(), "r2"), _word(_right(), "r3")

    def discounted(rows: DataFrame, order: int, *words: Column) -> DataFrame:
        named = _named(rows, table, ord=F.lit(order), gram=F.array(*words), cnt=F.col("cnt"), ctx_cnt=F.col("ctx_cnt"))
        cut = named.join(sent.withColumnRenamed("r", "cnt"), ["model", "ord", "cnt"], "left")
        return cut.select("model", "ord", "gram", "cnt", neglog(F.coalesce("d", F.lit(1.0)) * F.col("cnt") / F.col("ctx_cnt")).alias("nlp"))

    def of_parts(rows: DataFrame, own: Column, *on: str) -> DataFrame:
        """Sums over the contexts of heavy words are of some parts each."""
        many = rows.where(heavy).drop("ctx_cnt").withColumn("own", own)
        return _joined(many, small(many.groupBy("own", *on).agg(F.sum("cnt").alias("ctx_cnt"))), ["own", *on])

    grams = rows.where(_gram()).select("g", "m", "r1", "r2", "r3", "cnt", "ctx_cnt")
    lows = rows.where("first").select("g", "m", "r2", "r3", F.col("low_cnt").alias("cnt"), F.col("low_ctx").alias("ctx_cnt"))
    if book.heavy:
        three = discounted(grams.where(~heavy), 3, w1, w2, w3).unionByName(discounted(of_parts(grams, _masked(MODEL, LEFT, MIDDLE), "m", "r1"), 3, w1, w2, w3))
        two = discounted(lows.where(~heavy), 2, w2, w3).unionByName(discounted(of_parts(lows, _masked(MODEL, MIDDLE), "m"), 2, w2, w3))
    else:
        three, two = discounted(grams, 3, w1, w2, w3), discounted(lows, 2, w2, w3)
    one = scratch.save(_named(
        rows.select(_masked(MODEL, MIDDLE).alias("g"), "m", "r2", "cnt").groupBy("g", "m", "r2").agg(F.sum("cnt").alias("cnt")), table, word=w2, cnt=F.col("cnt")), "words")
    total = small(one.groupBy("model").agg(F.sum("cnt").alias("total")))
    ones = one.where(F.col("word") != UNKNOWN).join(total, "model").select(
        "model", F.lit(1).alias("ord"), F.array("word").alias("gram"), "cnt", neglog((1 - reserved) * F.col("cnt") / F.col("total")).alias("nlp"))
    unknown = total.select("model", F.lit(1).alias("ord"), F.array(F.lit(UNKNOWN)).alias("gram"), F.lit(0).cast("long").alias("cnt"), neglog(F.lit(float(reserved))).alias("nlp"))
    return three.unionByName(two).unionByName(ones).unionByName(unknown)


def backoffs(seqs: DataFrame, k: int = 5, reserved: float = 0.01) -> DataFrame:
    """(model, ord, ctx, nla), the back-off weights of the Katz trigram model of each ``model`` of ``seqs``."""
    spark = seqs.sparkSession
    scratch, book = Scratch(spark, "triples"), Book.of(seqs)
    table, heavy = book.table(spark), _heavy(book)
    sums = context_row(k)
    kinds = ", ".join(f"{c} {kind}" for c, kind in ({c: "string" for c in ("m", "r1", "r2")} | sums | {c: "long" for c in ("top", "low_ctx", "middle")}).items())
    rows = scratch.save(triples(seqs, book, contexts(k), f"g long, {kinds}"), "contexts", compression="zstd")
    if book.heavy:
        many = scratch.save(rows.where(heavy).groupBy("g", "m", "r1", "r2").agg(*[F.sum(c).cast(kind).alias(c) for c, kind in sums.items()], F.max("top").alias("top")), "heavy", compression="zstd")
        many = many.withColumn("own", _masked(MODEL, MIDDLE))
        totals = small(many.groupBy("own", "m").agg(F.sum("ctx_cnt").alias("low_ctx"), F.sum("all").alias("middle")))
        rows = rows.where(~heavy).unionByName(_joined(many, totals, ["own", "m"]).select(*rows.columns))
    pairs = rows.where(_left() != NONE)

    of_model = rows.select("*", _masked(MODEL).alias("own")).groupBy("own", "m")
    most = of_model.agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in range(1, k + 2)], F.max("top").alias("top"), F.sum("all").alias("total"))
    models = scratch.save(_named(most.withColumnRenamed("own", "g"), table, **{c: F.col(c) for c in most.columns[2:]}), "models")
    few = [F.struct(F.lit(r).cast("long").alias("r"), F.col(f"n{r}").alias("n_r")) for r in range(1, k + 2)]
    own = models.where("top > 0").select("model", F.lit(3).alias("ord"), F.explode(F.array(*few, F.struct(F.greatest("top", F.lit(k + 2)).alias("r"), F.lit(1).cast("long").alias("n_r")))).alias("s"), "top")
    own = own.select("model", "ord", "s.r", "s.n_r", "top").where("n_r > 0 and r <= top").drop("top")
    low = pairs.select(_masked(MODEL).alias("g"), "m", F.col("all").alias("r")).groupBy("g", "m", "r").agg(F.count("*").alias("n_r"))
    low = _named(low, table, ord=F.lit(2), r=F.col("r"), n_r=F.col("n_r"))
    found = lm.discounts_of(scratch.save(own.unionByName(low), "spectrum"), k)
    # a row a model
    at = [F.max(F.when((F.col("ord") == m) & (F.col("r") == r), F.col("d"))).alias(f"d{m}_{r}") for m in (2, 3) for r in range(1, k + 1)]
    sent = small(scratch.save(models.select("model", "total").join(found.groupBy("model").agg(*at), "model", "left"), "discounts"))

    def mass(order: int, name: str, rest: str) -> Column:
        """Discounted counts of grams, summed from their numbers by count."""
        return sum((F.coalesce(f"d{order}_{r}", F.lit(1.0)) * r * F.col(f"{name}{r}") for r in range(1, k + 1)), F.col(rest).cast("double"))

    def weight(hi: Column, lo: Column) -> Column:
        return neglog(clamp(1 - hi) / clamp(1 - lo)).alias("nla")

    columns = [c for c in rows.columns if c not in ("g", "m", "r1", "r2", "top", "all", "middle")]
    three = _named(pairs.where("ctx_cnt > 0"), table, ctx=F.array(_word(_left(), "r1"), _word(_middle(), "r2")), **{c: F.col(c) for c in columns}).join(sent, "model")
    three = three.select("model", F.lit(3).alias("ord"), "ctx", weight(mass(3, "n", "more") / F.col("ctx_cnt"), mass(2, "low", "low_more") / F.col("low_ctx")))
    again = {f"n{r}": F.count(F.when(F.col("all") == r, 1)) for r in range(1, k + 1)} | {
        "more": F.coalesce(F.sum(F.when(F.col("all") > k, F.col("all"))), F.lit(0)), "ctx_cnt": F.sum("all"), "low": F.sum("middle")}
    before = pairs.select(_masked(MODEL, LEFT).alias("g"), "m", "r1", "all", "middle").groupBy("g", "m", "r1").agg(*[c.alias(name) for name, c in again.items()])
    two = _named(before, table, ctx=F.array(_word(_left(), "r1")), **{c: F.col(c) for c in again}).join(sent, "model")
    return three.unionByName(two.select("model", F.lit(2).alias("ord"), "ctx", weight(mass(2, "n", "more") / F.col("ctx_cnt"), (1 - reserved) * F.col("low") / F.col("total"))))
