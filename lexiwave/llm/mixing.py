"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, ``target / source words``.
Its whole part is taken at once. The fractional parts are rounded together: two documents meet,
copy mass moves from one to the other until one of the two fractions is 0 or 1, and the other one
meets the next document. A move keeps the pair's expected *words* and, over the random choice of
direction, each document's expected copies. Large documents meet first, so the residual at the end is
mostly a short one, and a source misses its target by at most half of that document.

The meetings form a reduction tree. Documents are hashed into blocks of bounded size; each block is
folded to one residual document, the residuals are blocked again by a coarser hash prefix, and so on
until each source has one residual, which is rounded to the nearer whole. A hot source only has more blocks.

Equal rows (one id, source and size) are one unit of the tree but not one mass: of n rows with the fraction
p, the whole part of n * p get a copy more, and what is left is the fraction of a single row. So a unit
moves one document's words, however often it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiwave.functions.scratch import Scratch
from lexiwave.llm.skew import heavy_keys, spread_join

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null counts as empty."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, n_units, target) from (source, size) rows.

    Sources in code point order, null last, weigh ``weights`` in turn. A target stops at ``cap`` times
    its source's size and the excess is shared again by weight, which is filling water to one level:
    ``target = min(cap * size, level * weight)``. Sorted by the level at which each source fills up,
    the level is found with running sums over the table of sources, which may be as long as the web has hosts.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_units"))
    ranked = _ordered(per_source, scratch, "ranked", [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("w", weight).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    by_level = [F.col("limit") / F.col("w"), F.col("source").asc_nulls_first()]
    filled = _ordered(weighed.drop("rank"), scratch, "filled", by_level, {"below": F.col("limit"), "w_below": F.col("w")})
    whole = filled.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    # the level with all earlier sources full; the first source that this does not fill fixes it
    level = (F.col("all_size") - F.col("below")) / (F.col("all_w") - F.col("w_below"))
    staged = filled.join(F.broadcast(whole)).withColumn("stage_level", level)  # one row
    fits = F.col("stage_level") * F.col("w") <= F.col("limit")
    final = staged.agg(F.min(F.when(fits, F.struct(F.col("limit") / F.col("w"), F.col("stage_level").alias("level"))))["level"].alias("final"))
    return staged.join(F.broadcast(final)).select(  # one row
        "source", "source_size", "n_units",
        F.least(F.col("limit"), F.coalesce("final", F.lit(float("inf"))) * F.col("w")).alias("target"),
    )


def _ordered(df: DataFrame, scratch: Scratch, name: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums, in the given order, of all rows before each.

    Rows are sorted in ranges, one a partition; sums run within ranges, and only the ranges' totals, a row
    a partition, go through one task.
    """
    pieces = df.repartitionByRange(*order).withColumn("piece", F.spark_partition_id())
    pieces = scratch.save(pieces, name)
    total = pieces.groupBy("piece").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(F.col("piece").alias("of"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_0") for k in sums])
    within = Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = pieces.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(k) for k, c in sums.items()])
    joined = own.join(offset, F.col("piece") == F.col("of"))
    return joined.select(*df.columns, *[(F.col(k) + F.col(f"{k}_0")).alias(k) for k in sums])


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items: Column, seed: int) -> Column:
    """Fold an ordered array of units into struct(rest, done): one residual unit and the decided ones."""

    def meet(state: Column, x: Column) -> Column:
        r = state["rest"]
        give_r = r["size"] * (1 - r["p"])  # words that r can still take
        give_x = x["size"] * (1 - x["p"])
        has_r, has_x = r["size"] * r["p"], x["size"] * x["p"]
        up, down = F.least(give_r, has_x), F.least(has_r, give_x)  # words moved x -> r, or r -> x
        rise = _uniform(r["h"], x["h"], F.lit(seed)) * (up + down) <= down
        # who of the two ends at 0 or 1, and the fraction left to the other
        r_full, x_empty = rise & (give_r <= has_x), rise & (give_r > has_x)
        r_empty = ~rise & (has_r <= give_x)
        rest_x = F.when(r_full, x["p"] - give_r / x["size"]).otherwise(x["p"] + has_r / x["size"])
        rest_r = F.when(x_empty, r["p"] + has_x / r["size"]).otherwise(r["p"] - give_x / r["size"])
        ends = r_full | r_empty
        fraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(ends, rest_x).otherwise(rest_r)))
        decided = F.struct(
            F.when(ends, r["unit"]).otherwise(x["unit"]).alias("unit"),
            F.when(r_full | (~ends & ~x_empty), 1).otherwise(0).alias("extra"),
        )
        rest = F.when(ends, x).otherwise(r).withField("p", fraction)
        return F.struct(rest.alias("rest"), F.concat(state["done"], F.array(decided)).alias("done"))

    nothing = F.expr(
        "cast(array() as array<struct<unit: struct<id: bigint, source: string, size: bigint>, extra: int>>)"
    )
    return F.aggregate(
        F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))),
        F.struct(items[0].alias("rest"), nothing.alias("done")),
        meet,
    )


def _allotted(
    docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], cap: float, seed: int, block: int,
) -> DataFrame:
    """One row a unit of equal rows: id, source, size, rows, source_size, target, base, more; ``more`` of its rows have base + 1 copies, the rest base."""
    sizes = scratch.save(
        docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ).groupBy("id", "source", "size").agg(F.count("*").alias("rows")),
        "sizes",
    )
    whole = sizes.select("source", (F.col("size") * F.col("rows")).alias("size"))
    targets = scratch.save(source_targets(whole, scratch, weights, cap), "targets")
    most = targets.agg(F.max("n_units")).first()[0] or 0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        sizes.alias("u").join(F.broadcast(targets).alias("t") if _few(targets) else targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
        .select("u.id", "u.source", "u.size", "rows", "source_size", "target", F.floor(expected).alias("base"), (expected - F.floor(expected)).alias("fraction"),
                F.xxhash64("u.id", "u.size", F.lit(seed)).alias("h"), F.ceil(F.col("n_units") / block).cast("long").alias("blocks"))
        .withColumn("mass", F.when(F.col("size") > 0, F.col("rows") * F.col("fraction")).otherwise(F.lit(0.0)))
        .withColumn("sure", F.floor("mass"))
    )
    unit = F.struct("id", "source", "size")
    item = F.struct((-F.col("size").cast("double")).alias("order"), "h", unit.alias("unit"), F.col("size").cast("double").alias("size"), (F.col("mass") - F.col("sure")).alias("p"))
    open_units = units.where("mass > sure").select(F.pmod("h", "blocks").alias("slot"), "source", item.alias("item"))  # arrays sort by this, large ones first
    decided, level = [], 0
    while True:
        folded = open_units.groupBy("source", "slot").agg(F.array_sort(F.collect_list("item")).alias("items"))
        step = scratch.save(folded.select("source", "slot", _fold(F.col("items"), seed + level).alias("f")), f"level{level}")
        decided.append(step.select(F.explode("f.done").alias("d")).select("d.unit", "d.extra"))
        level += 1
        if block ** level >= max(most, 1):
            break
        open_units = step.select(F.floor(F.col("slot") / block).alias("slot"), "source", F.col("f.rest").alias("item"))
    last = step.select("f.rest").where(F.col("rest").isNotNull())
    decided.append(last.select("rest.unit", (F.col("rest.p") >= 0.5).cast("int").alias("extra")))
    extra = decided[0]
    for part in decided[1:]:
        extra = extra.unionByName(part)
    extra = extra.select(F.col("unit.id").alias("x_id"), F.col("unit.source").alias("x_source"), F.col("unit.size").alias("x_size"), "extra")
    same = F.col("id").eqNullSafe(F.col("x_id")) & F.col("source").eqNullSafe(F.col("x_source")) & (F.col("size") == F.col("x_size"))
    return units.join(extra, same, "left").select(
        "id", "source", "size", "rows", "source_size", "target", "base", (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("long").alias("more"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """Copies of each document so that every source's words come within half a document of its target.

    Returns one row per input row: id, source, size, source_size, target, copies, taken. Null text has
    size 0. Rows equal in id, source and size share their copies as evenly as whole copies go, null ids too.
    Documents of size 0 take the whole part of the expected copies; they add no words. A null source is a
    source, ranked last. An empty table gives an empty result. Documents of equal size meet in the order of
    a hash; a very long text only has a large size. Other columns are ignored, so none can clash.
    """
    units = _allotted(docs, Scratch(docs.sparkSession, "mixing"), id_col, text_col, source_col, weights, cap, seed, block)
    numbered = units.withColumn("row_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = (F.col("base") + (F.col("row_no") <= F.col("more")).cast("int")).cast("long")
    return numbered.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def _few(targets: DataFrame) -> bool:
    """Whether the table of sources is small enough to send to every executor."""
    return targets.count() <= 10_000


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their copies; those with none go. Columns stay as they were, whatever their names.

    Null texts have no words and take the whole part of the expected copies; null ids and sources are values
    like others; rows equal in id, source and size share their copies as evenly as whole copies go, in an order
    of no meaning; an empty table stays empty; a very long text is one row like others.
    """
    scratch = Scratch(spark, "mixing_stage")
    units = scratch.save(_allotted(docs, scratch, "doc_id", "text", "source", (5, 2, 1), 3.0, 0, BLOCK), "units")
    key = lambda i, s: [F.xxhash64(i.isNull(), i, s.isNull(), s, F.lit(0)), F.coalesce(i, F.lit(0)), F.coalesce(s, F.lit(""))]
    keys = ["k_hash", "k_id", "k_source", "k_size"]
    row_id, row_source = F.col("row.doc_id").cast("long"), F.col("row.source").cast("string")
    keyed = docs.select(F.struct("*").alias("row"), word_count(F.col("text")).alias("k_size"))
    keyed = keyed.select("row", "k_size", *[c.alias(k) for k, c in zip(keys, key(row_id, row_source))])
    allotted = units.select(*[c.alias(k) for k, c in zip(keys, key(F.col("id"), F.col("source")))], F.col("size").alias("k_size"), "rows", "base", "more")
    heavy = scratch.save(heavy_keys(allotted, keys, "rows"), "heavy")
    joined = spread_join(keyed.withColumn("place", F.monotonically_increasing_id()), allotted, keys, heavy, F.col("place"))
    take = lambda df, copies: df.select("row", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    single = joined.where((F.col("rows") == 1) & (F.col("base") + F.col("more") > 0))
    several = joined.where("rows > 1 and base + more > 0")
    out = take(single, F.col("base") + F.col("more"))
    if units.where("rows > 1").limit(1).count():
        numbered = _numbered(several, scratch, keys)
        copies = F.col("base") + (F.col("row_no") <= F.col("more")).cast("int")
        out = out.unionByName(take(numbered.where(copies > 0), copies))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _numbered(rows: DataFrame, scratch: Scratch, keys: list[str]) -> DataFrame:
    """``rows`` with ``row_no``, 1 to n among those of a key.

    Rows are written down in pieces; they are numbered within pieces, and only a key's numbers of rows a
    piece, not its rows, meet in one task.
    """
    pieces = scratch.save(rows.withColumn("piece", F.spark_partition_id()), "pieces")
    counts = pieces.groupBy(*keys, "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*keys, "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys, "piece").orderBy("place")
    return pieces.withColumn("within", F.row_number().over(within)).join(offset, [*keys, "piece"]).withColumn("row_no", F.col("within") + F.col("before"))
