"""Secret scans by sliding-window entropy, in DataFrame operations only.

Three fixed kinds are found by pattern. Besides them, every run of base64-like characters that no
pattern covered is a candidate: a window slides over it and the entropy of the characters in the window
is kept up to date from character counts, one character in and one out a step. A candidate with a window
above its character class's threshold is a secret unless the allow-list knows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds' patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: bits a character, over a window of 20: hexadecimal characters only, or more
HEX_BITS, BASE64_BITS = 3.0, 3.6
#: what looks random and is not secret: words, single repeated signs, placeholders, counters and alphabets
ALLOW = (
    r"^[A-Za-z]+$|^[A-Z]?[a-z]+([-_/=+][A-Za-z]?[a-z]+)*$|^[0-9-]+$|(?i)example|placeholder|changeme|your[-_]|"
    r"0123456789|abcdefgh|(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)


def _bits(n: Column) -> Column:
    """n * log2(n), with 0 for 0."""
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def most_entropy(run: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a character, of any ``window`` consecutive characters of ``run``.

    A shorter run is one window of its own length; an empty one has 0. A step changes the counts of at
    most two characters (places in ``ALPHABET``; all others share one), and the sum of n log n with them.
    """
    code = lambda c: F.instr(F.lit(ALPHABET), c) + 1
    chars, none = F.split(run, ""), F.lit(0)
    # each step gets the character that enters and the one that leaves, so nothing is looked up by place
    behind = F.concat(F.array_repeat(F.lit(None).cast("string"), window), chars)
    steps = F.transform(
        F.arrays_zip(chars.alias("enters"), F.slice(behind, 1, F.size(chars)).alias("leaves")),
        lambda x: F.struct(code(x["enters"]).alias("enters"), F.coalesce(code(x["leaves"]), none).alias("leaves")),
    )
    start = F.struct(
        F.array_repeat(none, len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), none.alias("at"),
    )

    def step(s: Column, x: Column) -> Column:
        into, out = x["enters"], x["leaves"]
        n_in = F.element_at(s["n"], into)
        n_out = F.element_at(s["n"], F.greatest(out, F.lit(1)))
        change = F.when(out == into, F.lit(0.0)).otherwise(
            _bits(n_in + 1) - _bits(n_in) + F.when(out > 0, _bits(n_out - 1) - _bits(n_out)).otherwise(F.lit(0.0))
        )
        counts = F.transform(s["n"], lambda x, i: x + F.when(i + 1 == into, 1).otherwise(0) - F.when(i + 1 == out, 1).otherwise(0))
        total = s["sum"] + change
        # windows that are not full yet count only at the end of a run shorter than a window
        bits = F.when(s["at"] + 1 >= window, F.log2(F.lit(float(window))) - total / window).otherwise(F.lit(0.0))
        return F.struct(counts.alias("n"), total.alias("sum"), F.greatest(s["best"], bits).alias("best"), (s["at"] + 1).alias("at"))

    def finish(s: Column) -> Column:
        size = s["at"].cast("double")
        return F.when(s["at"] < window, F.log2(size) - s["sum"] / size).otherwise(s["best"])

    return F.when(F.length(run) == 0, F.lit(0.0)).otherwise(F.aggregate(steps, start, step, finish))


SPAN = "struct<start: int, rank: int, end: int, value: string>"


def _once(value: Column, of) -> Column:
    """``of(value)``, with ``value`` made once however often it is used."""
    return F.transform(F.array(value), of)[0]


def _blocks(items: Column) -> Column:
    """An array in blocks of about the root of its size; an empty one is one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int"))), lambda i: F.slice(items, i * n + 1, n))


def _matches(text: Column, rank: int, pattern: str, least: int, group: int) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches whose ``group`` has ``least`` code points.

    A match starts behind the pieces and matches before it. Starts are summed within blocks of matches, and
    blocks are moved by sums over blocks, so no array is copied once a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    empty, none = F.expr(f"cast(array() as array<{SPAN}>)"), F.expr("cast(array() as array<int>)")

    def place(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + F.char_length(x["found"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(span)).alias("spans"))

    def move(s: Column, b: Column) -> Column:
        return F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before"))

    def whole(placed: Column) -> Column:
        before = F.aggregate(placed, F.struct(F.lit(0).alias("at"), none.alias("before")), move)["before"]
        moved = F.zip_with(placed, before, lambda b, o: F.transform(b["spans"], lambda x: F.struct(
            (x["start"] + o).alias("start"), x["rank"].alias("rank"), (x["end"] + o).alias("end"), x["value"].alias("value"))))
        return F.filter(F.flatten(moved), lambda x: F.char_length(x["value"]) >= least)

    items = F.arrays_zip(found.alias("found"), values.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    placed = F.transform(_once(items, _blocks), lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), empty.alias("spans")), place))
    return F.when(text.rlike(pattern), _once(placed, whole)).otherwise(empty)


def scan_secrets(docs: DataFrame, text_col: str = "text", hex_bits: float = HEX_BITS, base64_bits: float = BASE64_BITS) -> DataFrame:
    """``docs`` with ``ss_base`` and ``ss_spans``, sorted arrays of struct(start, rank, end, value) by row.

    Ranks 0 to 3 are ``KINDS``: assign, access and hex by their patterns (``ss_base``), and entropy, for
    candidates by the method that no base span touches. Offsets are code points, end exclusive. Null and
    empty texts have empty arrays, and so has an empty table no rows. Rows are independent: repeated ones
    give equal results, and other columns pass through. Spans that start together stand in order of rank
    and end. A very long text of n matches takes time in proportion to its length and n times the root of n.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    # runs are greedy, so a least length inside the pattern drops the same matches as a filter behind it
    base = F.array_sort(F.concat(
        _matches(t, 0, ASSIGN, ASSIGN_LEAST, 2),
        _matches(t, 1, ACCESS[:-1] + f"{{{ACCESS_LEAST - 4},}}", ACCESS_LEAST, 0),
        _matches(t, 2, HEX[:-1] + f"{{{HEX_LEAST},}}", HEX_LEAST, 0),
    ))
    meets = lambda b, c: (b["start"] < c["end"]) & (c["start"] < b["end"])
    # base spans are in blocks by start, of which a candidate looks into those that it meets
    reach = lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("spans"))
    blocks = F.transform(_once(F.col("ss_base"), _blocks), reach)
    touches = lambda blocks, c: F.coalesce(F.exists(blocks, lambda b: meets(b, c) & F.exists(b["spans"], lambda x: meets(x, c))), F.lit(False))
    least = lambda v: F.when(v.rlike("^[0-9a-fA-F]+$"), hex_bits).otherwise(base64_bits)
    secret = lambda blocks, c: ~c["value"].rlike(ALLOW) & ~touches(blocks, c) & (most_entropy(c["value"]) > least(c["value"]))
    found = _once(blocks, lambda blocks: F.filter(_matches(t, 3, CANDIDATE, WINDOW, 0), lambda c: secret(blocks, c)))
    return docs.withColumn("ss_base", base).withColumn("ss_spans", F.array_sort(F.concat(F.col("ss_base"), found)))


KINDS = ("assign", "access", "hex", "entropy")


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda rank: F.size(F.filter("ss_base", lambda s: s["rank"] == rank)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(_joined(F.col("ss_base")), "utf-8"), 256).alias("base_sha256"), _joined(F.col("ss_spans")).alias("spans"),
    )
