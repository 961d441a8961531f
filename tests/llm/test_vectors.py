"""Vector searches against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from syncsift.llm import exact_topk, hilbert_ann


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 24)).astype(np.float32) * 0.2
    x[300:420] = x[7]  # one very common vector
    x[500] = 2 * x[501]
    return x


@pytest.fixture(scope="module")
def rows(vectors):
    """Usable vectors of two lengths, rows that repeat an id, parallel vectors."""
    out = [(i, [float(y) for y in v]) for i, v in enumerate(vectors)]
    out += [(5050, [0.0] * 24), (50, [0.25] * 24), (50, [0.25] * 24), (5200, [1.0, 2.0]), (5201, [1.0, 2.5]), (5202, [-1.0, 0.0])]
    out += [(6000 + i, [0.5 * (i + 1)] * 3) for i in range(60)] + [(7000, [3.0] * 5)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    bad = [(5000, None), (5100, [float("nan")] + [1.0] * 23), (5150, [None] + [1.0] * 23), (5250, [float("inf")] * 24), (5300, []), (None, [1.0] * 24)]
    return spark.createDataFrame([(*r, 1, "q", 0.0) for r in rows + bad], "vec_id long, embedding array<float>, label int, id string, score double").repartition(3)


def brute(rows, score, k=5):
    """Each query row's best (score, id), by its id."""
    out = []
    for a, (q, x) in enumerate(rows):
        if q % 50 == 0:
            found = sorted((-score(x, y), i) for b, (i, y) in enumerate(rows) if b != a and len(y) == len(x))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_exact_topk(table, rows):
    ints = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows]
    got = exact_topk.digest(table).collect()
    assert sorted(map(tuple, got)) == brute(ints, lambda x, y: int(x @ y))
    assert exact_topk.digest(table.where("vec_id < 0")).count() == 0
    assert exact_topk.digest(table.where("vec_id in (0, 1, 2)")).count() == 2


def test_exact_topk_sql(table):
    import duckdb

    c = duckdb.connect()
    c.register("embeddings", table.toArrow())
    assert sorted(map(tuple, exact_topk.digest(table).collect())) == sorted(c.sql(exact_topk.ORACLE).fetchall())


def test_exact_topk_of_large_components(spark):
    rng = np.random.default_rng(1)
    x = [(i, [float(y) for y in v]) for i, v in enumerate(rng.integers(-(1 << 45), 1 << 45, (120, 6)))]
    x += [(200 + i, [float(y) for y in v]) for i, v in enumerate(rng.integers(-(1 << 21), 1 << 21, (90, 7)))]
    x += [(300 + 50 * i, [s * 1e300, 1.0]) for i, s in enumerate((1, -1, 2, 0.5, 0))]
    got = exact_topk.top_k(exact_topk.vector_rows(spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(2), "vec_id", "embedding", False), F.col("id") % 50 == 0)
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    dot = lambda a, b: sum(int(256 * p) * int(256 * q) for p, q in zip(a, b, strict=True))
    want = [(q, r, i, clip(s)) for q, r, i, s in brute(x, dot)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_exact_topk_where_scaled_components_overflow(spark):
    rng = np.random.default_rng(2)
    x = [(i, [float(y) for y in v]) for i, v in enumerate(rng.normal(size=(60, 3)))]
    x += [(100 + 50 * i, v) for i, v in enumerate(([1e308, 1.0, 0.5], [-1.7e308, 0.0, 1e308], [7.2e305, 1e-300, -3.5], [1e308, 1e308, 1e308]))]
    got = exact_topk.top_k(exact_topk.vector_rows(spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(2), "vec_id", "embedding", False), F.col("id") % 50 == 0)
    whole = lambda p: math.floor(Fraction(p) * 256)
    want = brute(x, lambda a, b: sum(whole(p) * whole(q) for p, q in zip(a, b, strict=True)))
    assert sorted(map(tuple, got.collect())) == sorted((q, r, i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for q, r, i, s in want)


def test_exact_topk_in_blocks_of_a_few_rows(table):
    asked = exact_topk.top_k(exact_topk.vector_rows(table, "vec_id", "embedding", False), F.col("id") % 50 == 0, block_bytes=8000)
    assert asked.exceptAll(exact_topk.digest(table)).count() == 0 and asked.count() == exact_topk.digest(table).count()


def cosine(x, y):
    x, y = np.array(x, np.longdouble), np.array(y, np.longdouble)
    return float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()))


@pytest.mark.parametrize("whole_rows", [100, 4096])
def test_hilbert_recall(table, rows, whole_rows):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if any(v)]
    want = brute(usable, cosine)
    found = hilbert_ann.neighbours(exact_topk.vector_rows(table, "vec_id", "embedding", True), F.col("id") % 50 == 0, whole_rows=whole_rows)
    got = sorted(tuple(r)[:4] for r in found.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    if whole_rows > 2000:
        assert [g[:3] for g in got] == [w[:3] for w in want]
    near = lambda rows: {q: [s for p, _, _, s in rows if p == q] for q, *_ in rows}
    g, w = near(got), near(want)
    assert np.mean([sum(s >= min(w[q]) - 1e-9 for s in g[q]) / len(w[q]) for q in w]) >= 0.9
    assert [i for q, _, i, _ in got if q == 350] == [7, 300, 301, 302, 303]  # ties by id in the common vector
    assert [i for q, _, i, _ in got if q == 6000] == [6001, 6002, 6003, 6004, 6005]  # and of parallel vectors
    assert all(round(s, 12) == round(cosine(dict(usable)[q], dict(usable)[i]), 12) for q, _, i, s in got if q % 100 == 0 and 50 not in (q, i))


def test_hilbert_dense_points(spark):
    """A third of the points in a ball that is one range of each curve: many blocks, and the neighbours are found."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8))
    x[:1000] = x[0] + rng.normal(size=(1000, 8)) * 1e-5
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    table = exact_topk.vector_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vec_id", "embedding", True)
    found = hilbert_ann.neighbours(table, F.col("id") % 50 == 0, block_rows=200)
    got, want = {}, {}
    for into, some in ((got, map(tuple, found.collect())), (want, brute([(i, np.array(v)) for i, v in rows], cosine))):
        for q, _, i, _ in some:
            into.setdefault(q, set()).add(i)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(got[q] & want[q]) / 5 for q in want]) >= 0.9
    points = hilbert_ann.written(hilbert_ann.grouped(table, 6))
    placed, _, _ = hilbert_ann.fitted(points, 2, 4, 9, 64, 512, 4096, 3)
    parts = hilbert_ann.measured_parts(points, placed, 4, 16, 200)
    assert 1 <= len(parts) <= 2 * 3000 // 200 and max(parts.values()) >= 5 and all(n == 8 for n, _ in parts)


def test_hilbert_recall_of_small_tables_by_curves(spark, vectors):
    for n in (513, 700):
        rows = [(i, [float(y) for y in v]) for i, v in enumerate(vectors[-n:])]
        table = exact_topk.vector_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2), "vec_id", "embedding", True)
        got = {(q, i) for q, _, i, _ in hilbert_ann.neighbours(table, F.col("id") % 10 == 0).collect()}
        exact = {(a, i) for a, x in rows if a % 10 == 0 for _, i in sorted((-cosine(np.float32(x), np.float32(y)), b) for b, y in rows if b != a)[:5]}
        assert len(got) == len(exact) and len(got & exact) / len(exact) >= 0.9


def test_hilbert_small_tables(spark, vectors):
    for n in (0, 1, 2, 3, 6, 9):
        rows = [(50 * i, [float(y) for y in v]) for i, v in enumerate(vectors[:n])]
        got = hilbert_ann.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert got.count() == n * min(5, max(0, n - 1))


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_ann.hilbert_keys(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
