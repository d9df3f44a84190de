"""Top-k and near-duplicate vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from halyard.llm import vectors


def frame(spark, rows, of="double"):
    return spark.createDataFrame(rows, f"vec_id long, vector array<{of}>").withColumn("score", F.lit(1)).repartition(3)


ODD = [(900, None), (901, []), (902, [None] * 8), (903, [float("nan")] + [0.0] * 7), (904, [float("inf")] * 8), (None, [1.0] * 8), (905, [1.0] * 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, monkeypatch, seed):
    monkeypatch.setattr(vectors, "CANDIDATES", 90)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (250, 8)).astype(float)
    x[40:60] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD
    df = frame(spark, rows)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.top_k(df.where("vec_id % 10 = 0"), df, 20).where("query_id < 900").collect())
    assert got == sorted(brute.top(list(range(250)), x, range(0, 250, 10)))


def test_top_k_small(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 1.0])])
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.top_k(df, df, 20).collect())
    assert got == [(1, 1, 2, 1), (1, 2, 2, 0), (2, 1, 1, 0)]
    assert vectors.top_k(df.limit(0), df, 3).collect() == [] and vectors.top_k(df, df.limit(0), 3).collect() == []


def test_threshold_stops_early():
    rng = np.random.default_rng(5)
    x = np.zeros((5000, 4))
    x[:, 0] = rng.integers(0, 50, 5000)
    x[7] = [1000, 0, 0, 0]
    best, score, scored = vectors.threshold_top(np.array([[1.0, 0, 0, 0]]), x, 1)
    assert best[0, 0] == 7 and score[0, 0] == 1000 and scored < 1000


def linked(x, cosine=0.9):
    norm = np.linalg.norm(x, axis=1)
    s = x @ x.T / np.where(norm == 0, 1, norm)[:, None] / np.where(norm == 0, 1, norm)[None]
    s[norm == 0] = -1
    s[:, norm == 0] = -1
    np.fill_diagonal(s, -1)
    return s >= cosine


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 32))
    for i in range(100, 300):
        x[i] = x[i % 17] + 0.1 * rng.standard_normal(32)
    x[300:340] = x[5]
    x[350] = 0
    x[351] = 2 * x[352]
    ids = rng.permutation(500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + ODD, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).repartition(4)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    near = linked(x)
    found = sum(got[int(ids[i])]["n_links"] for i in range(500))
    assert 0.95 * near.sum() <= found <= near.sum()
    order = np.argsort(ids)
    roots = brute.components(500, [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near))])
    assert sum(got[i]["component_id"] == roots[i] for i in range(500)) >= 490
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 903, 904, int(ids[350])))
    assert got[None]["n_links"] == 0 and len(order) == 500
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_at_the_limit(spark):
    """Pairs of a cosine just over 0.9, the hardest that count."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9005
    b = c * a + np.sqrt(1 - c * c) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.93 * 3000


def test_near_duplicates_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("scale", [1e4, 1e6, 1e8])
def test_scores_are_exact(scale):
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((400, 16)) * scale)
    x[100:130] = x[5]
    best, score, _ = vectors.threshold_top(x[:20], x, 10)
    whole = x.astype(np.int64).astype(object)
    exact = whole[:20] @ whole.T
    for i in range(20):
        want = sorted((-int(s), j) for j, s in enumerate(exact[i]))[:10]
        assert [(-s, j) for j, s in zip(best[i].tolist(), score[i].tolist())] == want


def test_known_bound_saves_reading():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 50, (5000, 4)).astype(float)
    best, score, all_ = vectors.threshold_top(np.ones((1, 4)), x, 5)
    again, same, fewer = vectors.threshold_top(np.ones((1, 4)), x, 5, score[:, -1])
    assert fewer <= all_ < 5000 and (again == best).all() and (same == score).all()
    nothing, _, none = vectors.threshold_top(np.ones((1, 4)), x, 5, np.array([1000]))
    assert none == 0 and (nothing == -1).all()


def test_projections_of_any_number_of_rows():
    for rows in (0, 1, 500, 10**6, 10**8, 10**11, 10**13):
        p = vectors.Projections(rows)
        assert p.groups >= 1 and 0 < p.least <= p.count
        assert 1 - (1 - (1 - np.sqrt(0.2 * 2 / np.pi) / p.cell) ** p.each) ** p.groups >= vectors.RECALL


@pytest.mark.parametrize("rows", [1000, 4000])
def test_recall_of_planted_pairs(spark, monkeypatch, rows):
    """At two numbers of rows, with cells of few rows."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 60)
    rng = np.random.default_rng(rows)
    a = rng.standard_normal((rows, 32))
    b = a[:300] + 0.35 * rng.standard_normal((300, 32))
    x = np.concatenate([a, b])
    near = linked(x).sum()
    got = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert near > 100 and 0.9 * near <= got.agg(F.sum("n_links")).first()[0] <= near
