import math

import numpy as np
import pytest

from lexiwave.llm import vector_codes
from lexiwave.llm.vector_codes import Tree, assign, compress_vectors


def plain(rows, parts, entries, turns):
    """Lloyd turns point by point, in Python's own whole numbers."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = parts * max(1, -(-max((len(r[1]) for r in fine), default=0) // parts))
    x = [[math.floor(1024 * c) for c in r[1]] + [0] * (width - len(r[1])) for r in fine]
    p = width // parts
    order = sorted(range(len(fine)), key=lambda i: (fine[i][0] is None, fine[i][0] or 0, x[i]))[:entries]
    books = [[x[i][k * p : k * p + p] for i in order] for k in range(parts)]

    def nearest(k, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(books[k]))

    def all_():
        return [[nearest(k, v[k * p : k * p + p]) for k in range(parts)] for v in x]

    for _ in range(turns):
        got = all_()
        for k in range(parts):
            for j in range(len(books[k])):
                mine = [v[k * p : k * p + p] for v, g in zip(x, got) if g[k][1] == j]
                if mine:
                    books[k][j] = [sum(c) // len(mine) for c in zip(*mine)]
    got = all_()
    error = [sum(d for d, _ in g) for g in got]
    label = {}
    for r, e in zip(fine, error):
        label[r[2]] = label.get(r[2], 0) + e
    return sorted(repr((r[0], r[2], "".join(f"{j:02x}" for _, j in g), e, label[r[2]])) for r, g, e in zip(fine, got, error)), books


def test_nodes_lose_no_nearest_entry():
    rng = np.random.default_rng(0)
    for n, p, k, spread in ((1, 2, 3, 9), (700, 2, 20, 8), (900, 5, 60, 40), (500, 1, 9, 4), (600, 3, 30, 2)):
        points = rng.integers(-spread, spread, (n, p)).astype(float)  # narrow ranges: many ties, and repeated points
        book = rng.integers(-spread, spread, (k, p)).astype(float)
        tree = Tree.build(points, leaf=4)
        code, sums, numbers = assign(tree, book)
        expect = ((tree.points[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (code == expect).all() and (points[tree.order] == tree.points).all()
        assert (numbers == np.bincount(expect, minlength=k)).all()
        assert all((sums[j] == tree.points[expect == j].sum(0)).all() for j in range(k))


def test_subtrees_are_assigned_whole(monkeypatch):
    rng = np.random.default_rng(1)
    centre = np.array([[0, 0], [10_000, 0], [0, 10_000.0]])
    points = np.repeat(centre, 400, 0) + rng.integers(-50, 50, (1200, 2))
    seen = []
    kept = vector_codes._kept
    monkeypatch.setattr(vector_codes, "_kept", lambda *a: seen.append(len(a[2])) or kept(*a))
    assign(Tree.build(points, leaf=4), centre)
    assert sum(seen) < 100  # of some 1,000 nodes


@pytest.mark.parametrize("tree,entries,turns", [(8192, 256, 4), (37, 7, 3)])
def test_against_plain_lloyd(spark, tree, entries, turns):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.3, 8)], int(i) % 3) for i in rng.permutation(300)]
    rows += [(7, rows[3][1], 1)] * 40 + [(None, rows[5][1], None), (900, None, 1), (901, [0.1, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("-inf")] * 8, 2)]
    rows += [(904, [], None), (905, [0.5] * 6, 2), (906, [2.0] * 8, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n long, code string")
    got, books = compress_vectors(df.repartition(5), entries=entries, turns=turns, tree=tree)
    expect, plain_books = plain(rows, 4, entries, turns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == expect
    assert [[[int(v) for v in e] for e in b] for b in books] == plain_books


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    none, books = compress_vectors(spark.createDataFrame([], schema))
    assert none.count() == 0 and [len(b) for b in books] == [0] * 4
    one = compress_vectors(spark.createDataFrame([(1, [-0.0001, 3e38, -3e38], None)], schema))[0].first()
    assert (one.code, one.error, one.label_error) == ("00000000", 0, 0)
    with pytest.raises(ValueError):
        compress_vectors(spark.createDataFrame([], schema), entries=257)


def test_many_labels(spark, monkeypatch):
    from lexiwave.llm import skew

    monkeypatch.setattr(skew, "PARTS", 3)
    monkeypatch.setattr(vector_codes, "small", lambda df: df)
    rows = [(i, [i / 100, 0.0, 1.0, -i / 50], None if i % 2 else i) for i in range(60)]
    got = compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=5)[0].collect()
    of = {}
    for r in got:
        of[r.label] = of.get(r.label, 0) + r.error
    assert len(got) == 60 and all(r.label_error == of[r.label] for r in got)
