"""Tokens, n-gram windows and their counts.

A corpus is a table of token sequences, one row each, with a ``model`` column that tells language models
apart. Gram tables have one row a distinct gram: model, ord, gram (array), cnt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a token, and the tokens with a meaning of their own.
TOKEN = r"[\p{L}<>/.]+"
START, END, UNKNOWN, SILENCE = "<s>", "</s>", "<unk>", "<sil>"
#: stands between the words of a gram's key; no token holds it
SEPARATOR = "\x01"


def tokens(text: Column, pattern: str = TOKEN, keep: Callable[[Column], Column] | None = None) -> Column:
    """Lower-case runs of token characters; the text's own start and end marks are dropped, null is empty.

    ``pattern`` says what a token is (U+0001 is in none), and ``keep``, a function of a token's column, which of them count.
    """
    text = F.coalesce(text, F.lit(""))
    if pattern != TOKEN:
        text = F.replace(text, F.lit(SEPARATOR), F.lit(" "))
    if pattern.startswith("[") and pattern.endswith("]+") and pattern.count("[") == 1:
        # runs of the class: all else becomes one space, and the text is changed and cut as a whole
        line = F.lower(F.trim(F.regexp_replace(text, "[^" + pattern[1:], " ")))
        found = F.when(line == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(line, " "))
        marked = F.contains(line, F.lit(START)) | F.contains(line, F.lit(END))
        found = F.when(marked, F.filter(found, lambda t: ~t.isin(START, END))).otherwise(found)
    else:
        found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower), lambda t: ~t.isin(START, END))
    return found if keep is None else F.filter(found, keep)


def sequences(
    df: DataFrame, text: str = "text", model: Column | None = None, pattern: str = TOKEN, keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(model, toks) of every row."""
    return df.select((F.lit("all") if model is None else model).cast("string").alias("model"), tokens(F.col(text), pattern, keep).alias("toks"))


def padded(toks: Column, n: int) -> Column:
    """n - 1 start marks, the tokens, an end mark; for n = 1 the tokens alone."""
    if n == 1:
        return toks
    return F.concat(F.array_repeat(F.lit(START), n - 1), toks, F.array(F.lit(END)))


def windows(seq: Column, width: int) -> Column:
    """All runs of ``width`` neighbours of an array."""
    last = F.size(seq) - width + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(seq, i, width))).otherwise(
        F.expr("cast(array() as array<array<string>>)"))


def gram_rows(seqs: DataFrame, n: int) -> DataFrame:
    """(model, ord, gram) of every gram of orders 1 to n, a row an occurrence."""
    def of_order(m: int) -> Column:
        return F.transform(windows(F.col("p"), m), lambda g: F.struct(F.lit(m).alias("ord"), g.alias("gram")))

    each = [of_order(m) for m in range(1, n + 1)]
    return seqs.select("model", padded(F.col("toks"), n).alias("p")).select("model", F.explode(F.concat(*each)).alias("g")).select("model", "g.ord", "g.gram")


def gram_key(gram: Column) -> Column:
    """A gram's words as one string, which is shorter to shuffle and quicker to compare than an array."""
    return F.array_join(gram, SEPARATOR)


def key_words(key: Column) -> Column:
    """How many words a key has."""
    return F.octet_length(key) - F.octet_length(F.replace(key, F.lit(SEPARATOR), F.lit(""))) + 1


def gram_keys(seqs: DataFrame, n: int, orders: Iterable[int] | None = None, keep: Callable[[DataFrame, int], DataFrame] = lambda level, m: level) -> DataFrame:
    """(model, ord, key, cnt) of the orders asked for, 1 to n by default, in sequences padded for order n.

    Words are exploded once, each with those behind it (fewer at the end), without their sequence, and summed
    before the shuffle. Lower orders are sums of the higher one's rows, which ``keep(rows, order)`` may write
    down. All orders read one shuffle of the highest: the order's filter names the count, so it stays behind
    the sums and each order has the same plan below them.
    """
    asked = sorted(set(range(1, n + 1) if orders is None else orders))
    if not asked or asked[0] < 1 or asked[-1] > n:
        raise ValueError(f"orders are from 1 to {n}")
    words = [f"w{i}" for i in range(1, asked[-1] + 1)]
    padded_ = seqs.select("model", padded(F.col("toks"), n).alias("p"))
    zipped = F.arrays_zip(*[(F.col("p") if i == 0 else F.slice("p", i + 1, F.size("p"))).alias(w) for i, w in enumerate(words)])
    each = padded_.select("model", F.explode(zipped).alias("g")).select("model", F.concat_ws(SEPARATOR, *[F.col(f"g.{w}") for w in words]).alias("key"))
    level, out = keep(each.groupBy("model", "key").agg(F.count("*").alias("cnt")), asked[-1]), None
    for m in reversed(asked):
        if m < asked[-1]:
            level = keep(level.groupBy("model", F.substring_index("key", SEPARATOR, m).alias("key")).agg(F.sum("cnt").alias("cnt")), m)
        whole = F.least(F.col("cnt"), key_words(F.col("key")).cast("long") - (m - 1)) >= 1
        own = level.where(whole).select("model", F.lit(m).alias("ord"), "key", "cnt")
        out = own if out is None else out.unionByName(own)
    return out


def gram_counts(seqs: DataFrame, n: int, orders: Iterable[int] | None = None, keep: Callable[[DataFrame, int], DataFrame] = lambda level, m: level) -> DataFrame:
    """``gram_keys`` with grams as arrays: (model, ord, gram, cnt)."""
    return gram_keys(seqs, n, orders, keep).select("model", "ord", F.split("key", SEPARATOR).alias("gram"), "cnt")


def context(gram: Column) -> Column:
    return F.slice(gram, 1, F.size(gram) - 1)


def suffix(gram: Column) -> Column:
    return F.slice(gram, 2, F.size(gram) - 1)


def count_of_counts(counts: DataFrame) -> DataFrame:
    """(model, ord, r, n_r): how many grams of an order occur r times."""
    return counts.groupBy("model", "ord", F.col("cnt").alias("r")).agg(F.count("*").alias("n_r"))


def gram_totals(counts: DataFrame) -> DataFrame:
    """(model, ord, distinct_grams, total_grams)."""
    return counts.groupBy("model", "ord").agg(F.count("*").alias("distinct_grams"), F.sum("cnt").alias("total_grams"))


def vocabulary(seqs: DataFrame, n: int) -> DataFrame:
    """(model, token) with the marks that models of order n have."""
    marks = [UNKNOWN] if n == 1 else [START, END, UNKNOWN]
    words = seqs.select("model", F.explode("toks").alias("token"))
    extra = seqs.select("model").distinct().select("model", F.explode(F.array(*map(F.lit, marks))).alias("token"))
    return words.unionByName(extra).distinct()


def counted_vocabulary(counts: DataFrame, n: int) -> DataFrame:
    """The same from counts of an order n above 1: every word ends a padded window, and every model has one."""
    ends = counts.where(F.col("ord") == n).select("model", F.element_at("gram", -1).alias("token")).distinct()
    marks = ends.select("model").distinct().select("model", F.explode(F.array(*map(F.lit, [START, END, UNKNOWN]))).alias("token"))
    return ends.unionByName(marks).distinct()


def with_unknown(grams: DataFrame, vocab: DataFrame, models: list[str] | None = None) -> DataFrame:
    """(model, id, gram) with tokens outside the model's vocabulary replaced by ``<unk>``.

    Token by token, so a vocabulary of any size is joined and never collected.
    """
    placed = grams.select("model", "id", F.posexplode("gram").alias("pos", "token"))
    known = vocab.withColumn("known", F.lit(True))
    marked = placed.join(known, ["model", "token"], "left").withColumn("token", F.when(F.col("known"), F.col("token")).otherwise(UNKNOWN))
    return marked.groupBy("model", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("gram"))


def dropped_grams(counts: DataFrame) -> DataFrame:
    """Grams whose word follows an end mark, which no model counts; empty for counts made here."""
    return counts.where((F.size("gram") > 1) & (F.element_at("gram", -2) == END))


def search_phrase(phrase: str) -> str:
    """A phrase to search for, trimmed and in lower case; an empty one is an error."""
    found = phrase.strip().lower()
    if not found:
        raise ValueError("there is nothing to search for")
    return found


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a text holds a phrase, trimmed and in lower case; the empty phrase is everywhere."""
    return F.contains(text, F.lower(F.trim(phrase)))
