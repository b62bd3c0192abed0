"""Vector code compression: product codebooks fitted by filtering Lloyd turns.

A vector's components become whole numbers, and the vector is cut into equal parts; each part's place in a
vector has a codebook of its own. In every turn each task builds a kd-tree a part over blocks of its
vectors. A node knows the box around its points, and their sum and number. From the root down, entries that
are nearer than the box's best candidate to no point of the box are struck out; once one entry is left, the
whole subtree is assigned by adding the node's sum and number. Only points of leaves with several entries
left are compared one by one, and only with those.

All of it is whole numbers in double precision below 2**53, so sums, distances and ties are exact, and the
result does not depend on blocks, tasks or order. Tasks send one row an entry; codebooks, whose size does
not grow with the table, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.scratch import Scratch, small
from lexiwave.functions.shipping import ship
from lexiwave.llm.skew import heavy_keys, spread_join

PARTS, ENTRIES, TURNS, SCALE = 4, 256, 4, 1024
#: vectors under one tree, and points under one leaf at most
TREE, LEAF = 8192, 32
_CELLS = 1 << 20


@dataclass
class Tree:
    """A kd-tree with halves of equal size: per level the first place of each node, its box, sum and number."""

    points: np.ndarray
    order: np.ndarray
    first: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> "Tree":
        """Nodes are halved along their widest side until they have at most ``leaf`` points."""
        n = len(points)
        order, edges = np.arange(n), np.array([0, n])
        out = cls(points, order, [], [], [], [])
        while True:
            mine = points[order]
            low, high = np.minimum.reduceat(mine, edges[:-1]), np.maximum.reduceat(mine, edges[:-1])
            out.first.append(edges)
            out.low.append(low)
            out.high.append(high)
            if np.diff(edges).max() <= leaf:
                break
            node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            side = (high - low).argmax(1)
            order = order[np.lexsort((mine[np.arange(n), side[node]], node))]
            edges = np.sort(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))
        out.points, out.order = points[order], order
        total = np.add.reduceat(out.points.astype(np.int64), edges[:-1])
        out.total = [total]
        for _ in out.first[1:]:
            total = total.reshape(-1, 2, total.shape[1]).sum(1)
            out.total.insert(0, total)
        return out


def _kept(book: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """``alive`` [nodes, entries] without the entries that lose to another one at every point of the node's box."""
    out = alive.copy()
    step = max(1, _CELLS // book.size)
    for i in range(0, len(low), step):
        lo, hi, now = low[i : i + step], high[i : i + step], alive[i : i + step]
        score = np.where(now, size - (lo + hi) @ book.T, np.inf)
        best = score.argmin(1)
        # how much farther than the best an entry is, at the corner of the box that lies farthest to its side
        ahead = score - score[np.arange(len(best)), best][:, None] - np.einsum("nkp,np->nk", np.abs(book[None] - book[best][:, None]), hi - lo)
        out[i : i + step] = now & ((ahead < 0) | ((ahead == 0) & (np.arange(len(book)) <= best[:, None])))
    return out


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point in the tree's order, sums [entries, p], numbers [entries]); of equal distances the least entry."""
    size = (book * book).sum(1)
    code = np.empty(len(tree.points), np.int64)
    sums, numbers = np.zeros((len(book), tree.points.shape[1]), np.int64), np.zeros(len(book), np.int64)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    for level, edges in enumerate(tree.first):
        alive = _kept(book, size, tree.low[level][nodes], tree.high[level][nodes], alive)
        one = alive.sum(1) == 1
        whole, entry = nodes[one], alive[one].argmax(1)
        np.add.at(sums, entry, tree.total[level][whole])
        np.add.at(numbers, entry, edges[whole + 1] - edges[whole])
        for node, e in zip(whole, entry):
            code[edges[node] : edges[node + 1]] = e
        nodes, alive = nodes[~one], alive[~one]
        if level + 1 < len(tree.first):
            nodes, alive = (2 * nodes[:, None] + np.arange(2)).ravel(), alive.repeat(2, axis=0)
    rest = []
    for node, row in zip(nodes, alive):
        a, b = edges[node], edges[node + 1]
        some = np.flatnonzero(row)
        code[a:b] = some[(size[some] - 2 * tree.points[a:b] @ book[some].T).argmin(1)]
        rest.append(np.arange(a, b))
    if rest:
        at = np.concatenate(rest)
        numbers += np.bincount(code[at], minlength=len(book))
        for j in range(sums.shape[1]):
            sums[:, j] += np.bincount(code[at], tree.points[at, j], len(book)).astype(np.int64)
    return code, sums, numbers


def _blocks(column: pa.Array, parts: int, tree: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, a matrix a part) of blocks of vectors, which all have one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    for i in range(0, len(x), tree):
        yield i, np.split(x[i : i + tree], parts, axis=1)


def _turn(vectors: DataFrame, books: list[np.ndarray], tree: int) -> list[np.ndarray]:
    """The codebooks after every part is assigned and every used entry replaced by the floor of its parts' mean."""
    p = books[0].shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, numbers = np.zeros((len(books), len(books[0]), p), np.int64), np.zeros((len(books), len(books[0])), np.int64)
        for batch in batches:
            for _, parts in _blocks(batch.column(0), len(books), tree):
                for k, (points, book) in enumerate(zip(parts, books)):
                    _, s, n = assign(Tree.build(points), book)
                    sums[k] += s
                    numbers[k] += n
        part, entry = np.nonzero(numbers)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(numbers[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    found = vectors.select("x").mapInArrow(work, "part long, entry long, n long, sums array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(p)])
    new = [b.copy() for b in books]
    for r in found.collect():  # a row an entry
        new[r.part][r.entry] = np.array(r[3:]) // r.n
    return new


def _whole(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, parts: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, label, x) of the vectors that count, as whole numbers and all of one length, and the length of a part."""
    fine = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v")).where(
        F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    p = max(1, -(-(fine.agg(F.max(F.size("v"))).first()[0] or 0) // parts))
    most = float(int(np.sqrt(2**53 / p) / 4))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(F.lit(scale) * c.cast("double"), F.lit(most)), F.lit(-most))).cast("int"))
    padded = F.concat(x, F.array_repeat(F.lit(0), F.lit(parts * p) - F.size("v")))
    return scratch.save(fine.select("id", "label", padded.alias("x")), "whole"), p


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, turns: int = TURNS, scale: int = SCALE, tree: int = TREE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """One row per vector, (id, label, code, error, label_error), and the codebooks [entries, p] of each part.

    Rows whose vector is null or holds null or non-finite components are dropped. A codebook starts as that
    part of the vectors with the ``entries`` smallest ids (of equal ids the least vector first, null ids
    last), fewer if there are fewer. ``code`` has two hex digits a part; ``error`` is the squared distance
    to what the code stands for; ``label_error`` is its sum over all rows of the label, nulls being one
    label. Ties go to the lower entry; repeated rows count each and get equal codes; an empty table gives an
    empty result and empty codebooks. A vector shorter than the longest, or not divisible into parts, is
    read as if zeros stood behind it; a very long one is one row's work. So that all is exact, a
    component times ``scale`` is held within sqrt(2**53 / p) / 4 of 0, which is 5.9 million for parts of 16.
    Other columns are ignored, so none can clash.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vector_codes")
    whole, p = _whole(vectors, id_col, vec_col, label_col, scale, parts, scratch)
    first = np.array([r.x for r in whole.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()], np.float64).reshape(-1, parts * p)
    books = np.split(first, parts, axis=1)
    if len(first):
        for _ in range(turns):
            books = _turn(whole, books, tree)
    schema = pa.schema([("code", pa.string()), ("error", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, cut in _blocks(batch.column(2), parts, tree):
                found, error = np.empty((len(cut[0]), parts), np.uint8), np.zeros(len(cut[0]), np.int64)
                for k, (points, book) in enumerate(zip(cut, books)):
                    over = Tree.build(points)
                    found[over.order, k] = assign(over, book)[0]
                    error += ((points - book[found[:, k]]) ** 2).sum(1).astype(np.int64)
                codes += [row.tobytes().hex() for row in found]
                errors.append(error)
            own = pa.RecordBatch.from_arrays([pa.array(codes, pa.string()), pa.array(np.concatenate(errors) if errors else [], pa.int64())], schema=schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own.columns], names=["id", "label", "code", "error"])

    kinds = {c: whole.schema[c].dataType.simpleString() for c in ("id", "label")}
    coded = scratch.save(whole.mapInArrow(work, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "coded")
    return _with_label_error(coded, scratch), books


def _with_label_error(coded: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels are summed before the shuffle; their sums are broadcast if counted to be few, else rows of frequent labels are dealt over many tasks."""
    keyed = coded.withColumn("key", F.when(F.col("label").isNotNull(), F.xxhash64("label")).otherwise(F.lit(0)))
    keyed = keyed.withColumn("none", F.col("label").isNull())
    sums = scratch.save(keyed.groupBy("key", "none", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")).drop("label"), "labels")
    keys = ["key", "none"]
    joined = spread_join(keyed, small(sums.drop("n")), keys, heavy_keys(sums, keys, "n"), F.col("id"))
    return joined.select("id", "label", "code", "error", "label_error")


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' components by part, entry and place, as decimal whole numbers joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _turn_sql(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT p.id, p.part, arg_min(e, (b.s - 2 * list_inner_product(p.x, b.x), e)) AS e FROM p JOIN b{i} b ON p.part = b.part GROUP BY p.id, p.part),
m{i} AS (SELECT part, e, list(v ORDER BY j) AS x FROM (SELECT a.part, a.e, j, floor(sum(p.x[j]) / count(*)) AS v FROM a{i} a JOIN p ON p.id = a.id AND p.part = a.part CROSS JOIN range(1, 1025) g(j) WHERE j <= len(p.x) GROUP BY a.part, a.e, j) GROUP BY part, e),
b{i + 1} AS MATERIALIZED (SELECT part, e, x, list_inner_product(x, x) AS s FROM (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.e = b.e))"""


#: for tables whose vectors have one length, a multiple of four
OP11_SQL = f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, CAST(part AS INT) AS part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM k CROSS JOIN range(0, 4) q(part)),
b0 AS MATERIALIZED (SELECT part, CAST(id - 1 AS INT) AS e, x, list_inner_product(x, x) AS s FROM p WHERE id <= 256),
{", ".join(_turn_sql(i) for i in range(TURNS))},
f AS MATERIALIZED (SELECT p.id, p.part, arg_min(e, (b.s - 2 * list_inner_product(p.x, b.x), e)) AS e, min(b.s - 2 * list_inner_product(p.x, b.x)) + any_value(list_inner_product(p.x, p.x)) AS d FROM p JOIN b{TURNS} b ON p.part = b.part GROUP BY p.id, p.part),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, e)) AS h FROM b{TURNS}),
c AS (SELECT id, string_agg(lower(printf('%02x', e)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN k USING (id) CROSS JOIN h"""
