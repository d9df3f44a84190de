"""Search, codes, sparse vectors and fusion against numpy."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.functions import codes, sparse, vector
from halyard.operators import hybrid, product, search
from halyard.plans.estimate import Strategy

N, D = 300, 24


@pytest.fixture(scope="module")
def matrix():
    x = np.random.default_rng(42).standard_normal((N, D)).astype(np.float32)
    x[7] = 0
    x[11] = x[12]
    return x


@pytest.fixture(scope="module")
def vectors(spark, matrix):
    rows = [(i, row.tolist(), ["gpu", "cpu", "memory"][i % 3], i % 100) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, category string, price long").repartition(3).cache()


def distances(metric, x, q):
    x, q = x.astype(float), np.asarray(q, dtype=float)
    dot = x @ q
    if metric == "dot":
        return dot
    if metric == "dot_distance":
        return 1 - dot
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
        return np.where(size == 0, 0, dot / np.where(size == 0, 1, size))
    if metric == "hamming_float":
        return ((x != 0) != (q != 0)).sum(axis=1)
    square = ((x - q) ** 2).sum(axis=1)
    return square if metric == "l2_squared" else np.sqrt(square)


def best(score, k, largest):
    return sorted(range(len(score)), key=lambda i: (-score[i] if largest else score[i], i))[:k]


@pytest.mark.parametrize("metric", vector.METRICS)
def test_exact(vectors, matrix, metric):
    q = matrix[3].tolist()
    score = distances(metric, matrix, q)
    found = search.knn(vectors, q, 15, metric).collect()
    want = best(score, 15, vector.METRICS[metric].similarity)
    assert [r["id"] for r in found] == want
    assert np.allclose([r["score"] for r in found], score[want], atol=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot", "hamming_float"])
@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_batch(spark, vectors, matrix, metric, bytes_, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", bytes_)
    monkeypatch.setattr(search, "BLOCK", 64)
    queries = vectors.where("id < 5").select(F.col("id").alias("qid"), "embedding")
    found = {}
    for r in search.knn_batch(vectors, queries, 6, metric, exclude_self=True).collect():
        found.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    for q in range(5):
        score = distances(metric, matrix, matrix[q])
        want = [i for i in best(np.round(score, 9), 7, vector.METRICS[metric].similarity) if i != q][:6]
        got = sorted(found[q])
        assert np.allclose([s for _, _, s in got], score[want], atol=1e-6)
        if metric in ("cosine", "dot"):
            assert [i for _, i, _ in got] == want


def test_empty_and_wrong_input(spark, vectors):
    none = vectors.limit(0)
    assert search.knn(none, [0.0] * D, 5).collect() == []
    assert search.knn(vectors, [0.0] * (D + 1), 5).collect() == []
    assert search.knn(vectors, [0.0] * D, N + 50).count() == N
    with pytest.raises(search.SearchError):
        search.knn(vectors, [0.0] * D, 0)
    with pytest.raises(search.SearchError):
        search.knn(vectors, [float("nan")] * D, 1)
    with pytest.raises(search.SearchError):
        search.knn(vectors, [0.0], 1, dimensions=D)
    assert search.knn_batch(vectors, none.select(F.col("id").alias("qid"), "embedding"), 3).collect() == []


def test_pairs(vectors, matrix):
    x = matrix.astype(float)
    norm = np.linalg.norm(x, axis=1)
    s = x @ x.T / np.where(norm == 0, 1, norm)[:, None] / np.where(norm == 0, 1, norm)[None, :]
    want = {(i, j) for i, j in zip(*np.nonzero(s > 0.5)) if i < j}
    for block in (64, 4096):
        assert {(r["id1"], r["id2"]) for r in search.pairs_above(vectors, 0.5, block=block).collect()} == want


def test_filtered(vectors, matrix):
    q = matrix[0].tolist()
    found = search.filtered_search(vectors, q, 10, 'category = "gpu" AND price < 50')
    score = distances("l2", matrix, q)
    keep = [i for i in range(N) if i % 3 == 0 and i % 100 < 50]
    assert [r["id"] for r in found.rows.collect()] == sorted(keep, key=lambda i: (score[i], i))[:10]
    assert found.complete and found.vectors_evaluated == len(keep) and found.observed_selectivity == len(keep) / N
    assert search.filtered_search(vectors, q, 10, "price > 5 AND price < 5").complete
    assert not search.filtered_search(vectors, q, 10, "price = 5 AND category = \"cpu\"").complete
    near = best(score, 30, False)
    post = search.filtered_search(vectors, q, 10, 'category = "gpu"', strategy=Strategy("post"))
    passing = [i for i in near if i % 3 == 0]
    assert [r["id"] for r in post.rows.collect()] == passing[:10] and post.vectors_evaluated == 30 and post.strategy == "post"
    assert post.complete == (len(passing) >= 10) and post.observed_selectivity == len(passing) / 30
    hybrid_ = search.filtered_search(vectors, q, 10, "price = 5", strategy=Strategy("hybrid"))
    assert [r["id"] for r in hybrid_.rows.collect()] == [i for i in best(score, 100, False) if i % 100 == 5][:10]
    assert not hybrid_.complete and hybrid_.vectors_evaluated == 100
    assert search.filtered_search(vectors, q, 10, "price > 5 AND price < 5", strategy=Strategy("post")).complete
    assert search.count(vectors, "price < 50") == sum(i % 100 < 50 for i in range(N))


def test_boosts(vectors, matrix):
    q = matrix[0].tolist()
    score = distances("l2", matrix, q)
    factor = np.array([max(-1, min(0.99, 0.4 * (i % 3 == 0) + 3 * (i % 100 == 5) - 2 * (i % 100 == 6))) for i in range(N)])
    boosts = [search.Boost("category", "gpu", 0.4), search.Boost("price", 5.0, 3), search.Boost("price", 6, -2), search.Boost("nowhere", 1, 1), search.Boost("category", 5, 1)]
    assert [r["id"] for r in search.boosted(vectors, q, 12, boosts).collect()] == best(score * (1 - factor), 12, False)
    assert [r["id"] for r in search.boosted(vectors, q, 12, []).collect()] == best(score, 12, False)
    pool = best(score, 50, False)
    assert {r["id"] for r in search.boosted(vectors, q, 12, boosts, candidate_pool=0).collect()} <= set(pool)
    with pytest.raises(search.SearchError):
        search.Boost("a", 1, float("inf"))


def test_sign_codes(vectors, matrix):
    q = matrix[3].tolist()
    ham = ((matrix > 0) != (matrix[3] > 0)).sum(axis=1)
    assert [r["id"] for r in search.code_knn(vectors, q, 10).collect()] == best(ham, 10, False)
    low = vectors.withColumn("code", codes.sign_bytes(F.col("embedding"), D)).where("id = 5").first()["code"]
    assert bytes(low) == np.packbits(matrix[5] > 0, bitorder="little").tobytes()
    rows = vectors.withColumn("code", codes.sign_bytes(F.col("embedding"), D, first_highest=True))
    code = np.packbits(matrix[3] > 0).tobytes()
    assert bytes(rows.where("id = 3").first()["code"]) == code
    assert [(r["id"], r["score"]) for r in search.binary_knn(rows, code, 10).collect()] == [(i, ham[i]) for i in best(ham, 10, False)]
    assert search.binary_knn(rows, code, 0).collect() == []


def test_rescored_recall(vectors, matrix):
    hits = 0
    for q in range(20, 30):
        near = set(best(distances("l2", matrix, matrix[q]), 10, False))
        hits += len(near & {r["id"] for r in search.rescored_knn(vectors, matrix[q].tolist(), 10, 15).collect()})
    assert hits >= 90


def test_scalar_codes(vectors, matrix):
    low, high = codes.train_scalar(vectors)
    assert (low, high) == (pytest.approx(matrix.min()), pytest.approx(matrix.max()))
    back = codes.scalar_decode(codes.scalar_encode(F.col("embedding"), low, high), low, high)
    worst = vectors.select(F.max(F.array_max(F.zip_with(vector.doubles(F.col("embedding")), back, lambda a, b: F.abs(a - b))))).first()[0]
    assert worst <= (high - low) / 255 / 2 + 1e-6
    assert codes.train_scalar(vectors.limit(0)) == (0.0, 1.0)
    assert search.scalar_knn(vectors, matrix[9].tolist(), 1, low, high).first()["id"] == 9
    flat = vectors.limit(1).select(codes.scalar_encode(F.col("embedding"), 1.0, 1.0).alias("c")).first()["c"]
    assert set(flat) == {0}


def test_product_codes(vectors, matrix):
    book = product.train(vectors, subquantizers=6, ksub=16, iterations=8)
    assert (book.subquantizers, book.ksub, book.dimensions) == (6, 16, D)
    encoded = product.encode(vectors, book).cache()
    assert encoded.count() == N
    got = {r["id"]: r["code"] for r in encoded.collect()}
    near = book.codes(matrix.astype(float))
    assert all(got[i] == near[i].tolist() for i in range(N))
    q = matrix[4].tolist()
    sums = book.table(q)[np.arange(6), near].sum(axis=1)
    found = product.product_knn(encoded, book, q, 10).collect()
    assert [r["id"] for r in found] == best(sums, 10, False)
    exact = set(best(distances("l2", matrix, q), 10, False))
    assert len(exact & {r["id"] for r in product.product_knn(encoded, book, q, 60).collect()}) >= 5
    for wrong in ({"subquantizers": 5}, {"ksub": 1}, {"ksub": 257}):
        with pytest.raises(search.SearchError):
            product.train(vectors, **wrong)


def test_sparse(spark):
    rows = spark.createDataFrame([(1, [(5, 2.0), (1, 1.0)], [(1, 3.0)]), (2, [(4, 0.0)], [(9, 1.0)])], "id long, a array<struct<index:long,value:double>>, b array<struct<index:long,value:double>>")
    v = rows.select("id", sparse.from_pairs(F.col("a"), 10).alias("a"), sparse.from_pairs(F.col("b"), 10).alias("b"))
    one, two = v.select(sparse.dot(F.col("a"), F.col("b")).alias("dot"), sparse.norm(F.col("a")).alias("norm"), sparse.cosine(F.col("a"), F.col("b")).alias("cosine"), sparse.get(F.col("a"), 5).alias("at"), sparse.nnz(F.col("a")).alias("nnz"), sparse.valid(F.col("a")).alias("valid"), sparse.normalized(F.col("a")).alias("unit")).orderBy(F.desc("nnz")).collect()
    assert one["dot"] == 3 and one["norm"] == pytest.approx(5**0.5) and one["at"] == 2 and one["valid"]
    assert one["cosine"] == pytest.approx(1 / 5**0.5)
    assert two["cosine"] == 0 and two["unit"] is None and two["at"] == 0
    bad = spark.createDataFrame([([2, 1], [1.0, 1.0], 5), ([1, 1], [1.0, 1.0], 5), ([5], [1.0], 5), ([], [], 5), ([1], [float("nan")], 5), ([1], [1.0, 2.0], 5)], sparse.TYPE.removeprefix("struct<").removesuffix(">").replace(":", " ").replace("array<bigint>", "array<bigint>"))
    assert not any(r[0] for r in bad.select(sparse.valid(F.struct("indices", "values", "dim"))).collect())
    postings = sparse.to_postings(v, "a")
    assert sorted(map(tuple, postings.collect())) == [(1, 1, 1.0), (1, 5, 2.0), (2, 4, 0.0)]
    assert sparse.from_postings(postings, 10).where("id = 1").first()["sparse"]["indices"] == [1, 5]
    asked = spark.createDataFrame([(0, 1, 2.0), (0, 4, 1.0)], "qid long, term long, weight double")
    assert [(r["id"], r["score"]) for r in search.sparse_knn(postings, asked, 5).collect()] == [(1, 2.0)]
    assert search.sparse_knn(postings, asked, 0).collect() == []


def sparse_tables(spark, seed=3, n=90, terms=40):
    rng = np.random.default_rng(seed)
    m = rng.integers(0, 4, (n, terms)) * (rng.random((n, terms)) < rng.random(terms) ** 2)
    m[7] = m[3]  # equal rows tie
    rows = [(i, f"t{t}", float(m[i, t])) for i in range(n) for t in range(terms) if m[i, t]]
    postings = spark.createDataFrame([*rows, (5, None, 1.0), (5, "t1", None), (6, "t1", float("nan"))], "id long, term string, weight double").repartition(3)
    asked = spark.createDataFrame([r for r in rows if r[0] % 9 == 0] + [(900, "none", 1.0)], "qid long, term string, weight double")
    return m, postings, asked


@pytest.mark.parametrize("together", [1 << 20, 20])
def test_sparse_batch(spark, monkeypatch, together):
    """Queries sent to every task and in pairs of blocks, in few and many blocks of rows."""
    monkeypatch.setattr(search, "SPARSE_POSTINGS", together)
    monkeypatch.setattr(search, "CELLS", 64)
    monkeypatch.setattr(search, "SPARSE_ROWS", 50)
    monkeypatch.setattr(search, "HEAVY", 0.3)
    m, postings, asked = sparse_tables(spark)
    found = {}
    for r in search.sparse_knn(postings, asked, 5).collect():
        found.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    want = {}
    for q in range(0, 90, 9):
        dots = m @ m[q]
        if dots.any():
            want[q] = [(k + 1, i, float(dots[i])) for k, i in enumerate(i for i in best(dots, 5, True) if dots[i] > 0)]
    assert {q: sorted(x) for q, x in found.items()} == want


@pytest.mark.parametrize("together", [1 << 20, 20])
def test_sparse_above(spark, monkeypatch, together):
    monkeypatch.setattr(search, "SPARSE_POSTINGS", together)
    m, postings, asked = sparse_tables(spark)
    m, postings = m.astype(float), postings.where("term IS NOT NULL")
    size = np.sqrt((m * m).sum(axis=1))
    with np.errstate(invalid="ignore"):
        cosine = (m @ m.T) / np.outer(size, size)
    found = {(r["qid"], r["id"]): r["score"] for r in search.sparse_above(postings, asked, 0.5).collect()}
    assert found == pytest.approx({(q, i): cosine[q, i] for q in range(0, 90, 9) for i in range(90) if cosine[q, i] > 0.5})
    with pytest.raises(search.SearchError):
        search.sparse_above(postings, asked, -0.1)


def test_no_row_for_a_shared_term(spark):
    """A frequent term makes no rows: nothing is joined, and a task sends k rows a query."""
    _, postings, asked = sparse_tables(spark)
    for found in (search.sparse_knn(postings, asked, 5), search.sparse_above(postings, asked, 0.5)):
        assert "Join" not in found._jdf.queryExecution().toString()


def test_batch_ranks_by_places(spark):
    """Scores that are equal at the places asked for go by id; equal vectors always do."""
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0000002, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.5])], "id long, embedding array<double>")
    asked = rows.where("id = 0").selectExpr("id AS qid", "embedding")
    ids = lambda **k: [r["id"] for r in search.knn_batch(rows, asked, 3, "l2", exclude_self=True, **k).orderBy("rank").collect()]
    assert ids() == [3, 2, 1]
    assert ids(places=6) == [3, 1, 2]
    rng = np.random.default_rng(5)
    one = rng.normal(size=64).tolist()
    same = spark.createDataFrame([(i, one if i % 3 else rng.normal(size=64).tolist()) for i in range(700)], "id long, embedding array<double>").repartition(3)
    asked = same.where("id IN (1, 2)").selectExpr("id AS qid", "embedding")
    got = search.knn_batch(same, asked, 20, "cosine").orderBy("qid", "rank").collect()
    assert [r["id"] for r in got] == [i for i in range(30) if i % 3][:20] * 2


def test_fusion_ranks_by_nine_places(spark):
    frame = lambda rows: spark.createDataFrame([(0, i, s, r + 1) for r, (i, s) in enumerate(rows)], "qid long, id long, score double, rank int")
    dense = frame([(8, 1.0), (2, 0.5 + 1e-12), (1, 0.5), (9, 0.0)])
    found = hybrid.linear(dense, frame([(8, 1.0)]), 0.5).orderBy("rank").collect()
    assert [r["id"] for r in found] == [8, 1, 2, 9]


lists = st.lists(st.integers(0, 12), unique=True, max_size=8)


@settings(max_examples=15, deadline=None)
@given(lists, lists, st.integers(0, 6))
def test_rrf(spark, dense, sparse_, n):
    frame = lambda ids: spark.createDataFrame([(0, i, float(-r), r + 1) for r, i in enumerate(ids)], "qid long, id long, score double, rank int")
    want = {}
    for ids in (dense, sparse_):
        for r, i in enumerate(ids):
            want[i] = want.get(i, 0) + 1 / (60 + r + 1)
    order = sorted(want, key=lambda i: (-want[i], i))[:n]
    found = hybrid.rrf(frame(dense), frame(sparse_), n).orderBy("rank").collect()
    assert [r["id"] for r in found] == order
    assert np.allclose([r["score"] for r in found], [want[i] for i in order])


def test_linear_fusion(spark):
    frame = lambda rows: spark.createDataFrame([(0, i, s, r + 1) for r, (i, s) in enumerate(rows)], "qid long, id long, score double, rank int")
    found = {r["id"]: r["score"] for r in hybrid.linear(frame([(1, 0.9), (2, 0.5), (3, 0.1)]), frame([(3, 7.0), (4, 7.0)]), 0.25).collect()}
    assert found == pytest.approx({1: 0.25, 2: 0.125, 3: 0.75, 4: 0.75})
    with pytest.raises(search.SearchError):
        hybrid.linear(frame([(1, 1.0)]), frame([(1, 1.0)]), 1.5)


def test_unit_scores(spark):
    rows = spark.createDataFrame([(0.0,), (2.5,), (float("inf"),), (float("nan"),), (None,)], "d double")
    got = [tuple(r) for r in rows.select(*[vector.to_unit_score(m, F.col("d")) for m in ("cosine", "l2", "dot")]).collect()]
    assert got[0] == (1, 1, 0.5) and got[1][0] == 0 and got[2:] == [(0, 0, 0)] * 3


def test_sparse_texts(spark, monkeypatch):
    """Texts give the rows of their postings, repeated, null and odd ones too, and no row a term."""
    words = ["alpha", "beta", "gamma", "delta", "Beta", "GAMMA", "x1y2", "ÀÉK", "", "12"]
    rows = [(None if i % 41 == 0 else i % 150, None if i % 37 == 0 else " ".join(words[(i * j + j * j) % 10] for j in range(i % 23))) for i in range(400)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    postings = texts.select("id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("term <> ''").groupBy("id", "term").agg(F.count("*").cast("double").alias("weight"))
    query = postings.where("id % 10 = 0").withColumnRenamed("id", "qid")
    want = sorted(map(tuple, search.sparse_knn(postings, query, 7).collect()))
    assert len(want) > 50
    found = search.sparse_knn(texts, query, 7, texts=True)
    assert sorted(map(tuple, found.collect())) == want
    assert "Generate explode" not in found.select("id")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(search, "SPARSE_POSTINGS", 20)
    assert sorted(map(tuple, search.sparse_knn(texts, query, 7, texts=True).collect())) == want
    assert search.sparse_knn(texts, query, 0, texts=True).count() == 0


def test_sparse_terms_are_looked_up_together(monkeypatch):
    """Every lookup builds a table of all terms, so there is one for all that is held, not one a batch."""
    queries = search.SparseQueries(pa.table({"qid": [1, 1, 2], "term": ["a", "b", "b"], "weight": [1.0, 2.0, 3.0]}))
    batches = [pa.RecordBatch.from_pydict({"id": [i, i, i + 1], "term": ["a", "c", "b"], "weight": [1.0, 1.0, 2.0]}) for i in range(0, 80, 2)]
    calls, real = [], pc.index_in
    monkeypatch.setattr(search.pc, "index_in", lambda *a, **b: calls.append(1) or real(*a, **b))
    for most in (1 << 18, 30):
        calls.clear()
        monkeypatch.setattr(search, "SPARSE_ROWS", most)
        found = [(ids, scores) for ids, _, scores in queries.blocks(iter(batches))]
        assert np.concatenate([f[0] for f in found]).tolist() == list(range(80))
        assert np.hstack([f[1] for f in found]).tolist() == [[1.0, 4.0] * 40, [0.0, 6.0] * 40]
        assert len(calls) <= 5
