"""Registered queries of the search engine and the same in SQL.

Every query runs over whole tables. Result scores are rounded to six places,
as sums of doubles depend on their order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import codes, sparse, vector
from halyard.operators import hybrid, metadata, product, search
from halyard.operators.collection import Collection
from halyard.plans import Filter, evaluate, keep
from halyard.plans.estimate import Strategy, exact_share

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: A batch asks with every row whose id this divides; K nearest are wanted.
EVERY, K = 100, 10


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vector(spark: SparkSession, d: str, id_: int = 0) -> list[float]:
    row = table(spark, d, "embeddings").where(F.col("vec_id") == id_).select("embedding").first()
    return [float(x) for x in row["embedding"]]


def asked(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where(F.col("id") % EVERY == 0).withColumnRenamed("id", "qid")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with metadata: category, price, active, tags, and a rating that
    every seventh row lacks."""
    e = table(spark, d, "embeddings")
    tag = lambda n: F.concat(F.lit("t"), F.expr(f"(label + {n}) % 10").cast("string"))
    return e.select(
        F.col("vec_id").alias("id"),
        "embedding",
        F.element_at(F.array(F.lit("gpu"), F.lit("cpu"), F.lit("memory")), F.expr("label % 3 + 1").cast("int")).alias("category"),
        F.expr("(vec_id * 37) % 1000").alias("price"),
        (F.col("vec_id") % 2 == 0).alias("active"),
        F.array(tag(0), tag(3)).alias("tags"),
        F.when(F.col("vec_id") % 7 != 0, (F.col("vec_id") % 50) / 10.0).alias("rating"),
    )


ITEMS = """items AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v, ['gpu', 'cpu', 'memory'][label % 3 + 1] AS category,
    (vec_id * 37) % 1000 AS price, vec_id % 2 = 0 AS active,
    ['t' || (label % 10), 't' || ((label + 3) % 10)] AS tags,
    CASE WHEN vec_id % 7 <> 0 THEN (vec_id % 50) / 10.0::DOUBLE END AS rating
  FROM embeddings)"""
E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
Q0 = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in (names or ("score",)) else F.col(c) for c in df.columns])


# Exact search.

_EXACT = {
    "dot": ("list_inner_product(v, qv)", "DESC"),
    "cosine": ("list_cosine_similarity(v, qv)", "DESC"),
    "l2": ("list_distance(v, qv)", "ASC"),
    "l2_squared": ("list_sum(list_transform(list_zip(v, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", "ASC"),
    "dot_distance": ("1 - list_inner_product(v, qv)", "ASC"),
    "hamming_float": ("list_sum(list_transform(list_zip(v, qv), lambda p: ((p[1] <> 0) <> (p[2] <> 0))::BIGINT))", "ASC"),
}


def _exact(metric: str) -> Query:
    return lambda spark, d: search.knn(vectors(spark, d), query_vector(spark, d), K, metric).select("id", F.round(F.col("score").cast("double"), 6).alias("score"))


for _m, (_expr, _order) in _EXACT.items():
    register(f"knn_{_m}", f"WITH {E}, {Q0} SELECT id, round(({_expr})::DOUBLE, 6) AS score FROM e, q ORDER BY ({_expr}) {_order}, id LIMIT {K}")(_exact(_m))

_BATCH = """WITH {E}, pairs AS (
  SELECT a.id AS qid, b.id, {expr} AS s FROM e a, e b WHERE a.id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s {order}, id) AS rank FROM pairs)
SELECT qid, id, round(s, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= {k}"""


@register("knn_batch_cosine", _BATCH.format(E=E, expr="list_cosine_similarity(b.v, a.v)", order="DESC", every=EVERY, k=K))
def knn_batch_cosine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.knn_batch(vectors(spark, d), asked(spark, d), K, "cosine")).select("qid", "id", "score", "rank")


@register("knn_batch_dot", _BATCH.format(E=E, expr="list_inner_product(b.v, a.v)", order="DESC", every=EVERY, k=K))
def knn_batch_dot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.knn_batch(vectors(spark, d), asked(spark, d), K, "dot")).select("qid", "id", "score", "rank")


@register("knn_pairs_threshold", f"WITH {E} SELECT a.id AS id1, b.id AS id2, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.id < b.id AND list_cosine_similarity(a.v, b.v) > 0.4")
def knn_pairs_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.pairs_above(vectors(spark, d), 0.4))


@register("vector_norms", f"WITH {E} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(sqrt(list_inner_product(v, v)), 6) > 0 AS usable FROM e")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"), vector.finite(F.col("embedding")).alias("usable"))


@register("point_lookup", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id = 17")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return Collection.create(table(spark, d, "embeddings"), 64, id_column="vec_id").get(17).select(F.col("vec_id").alias("id"), "label")


@register("unit_scores", f"WITH {E}, {Q0}, s AS (SELECT id, 1 - list_inner_product(v, qv) AS x, list_distance(v, qv) AS y FROM e, q) SELECT id, round(greatest(0.0, least(1.0, 1 - x)), 6) AS cosine, round(1 / (1 + y), 6) AS l2, round(1 / (1 + exp(x)), 6) AS dot FROM s")
def unit_scores(spark: SparkSession, d: str) -> DataFrame:
    q = vector.lit_vector(query_vector(spark, d))
    v = F.col("embedding")
    scores = {"cosine": vector.dot_distance(v, q), "l2": vector.l2(v, q), "dot": vector.dot_distance(v, q)}
    return vectors(spark, d).select("id", *[F.round(vector.to_unit_score(m, x), 6).alias(m) for m, x in scores.items()])


# Filters.


def _filtered(source: str, columns: list[str], text: str | Filter, sql: str, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = items(spark, d) if source == "items" else table(spark, d, source)
        return keep(rows, text).select(*columns)

    prefix = f"WITH {ITEMS} " if source == "items" else ""
    register(name, f"{prefix}SELECT {', '.join(columns)} FROM {source} WHERE {sql}")(run)


_PART, _ITEM = ["p_partkey", "p_name", "p_size", "p_retailprice"], ["id", "category", "price"]
_filtered("part", _PART, "p_size = 15", "p_size = 15", "filter_eq")
_filtered("part", _PART, "p_size != 15", "p_size <> 15", "filter_ne")
_filtered("part", _PART, "p_retailprice < 950.5", "p_retailprice < 950.5", "filter_lt")
_filtered("part", _PART, "p_size <= 10", "p_size <= 10", "filter_le")
_filtered("part", _PART, "p_retailprice > 950", "p_retailprice > 950", "filter_gt")
_filtered("orders", ["o_orderkey", "o_totalprice"], "o_totalprice >= 300000", "o_totalprice >= 300000", "filter_ge")
_filtered("part", _PART, "p_size BETWEEN 5 AND 20", "p_size BETWEEN 5 AND 20", "filter_between")
_filtered("part", _PART, 'p_type CONTAINS "STEEL" OR p_name CONTAINS "a"', "contains(p_type, 'STEEL') OR contains(p_name, 'a')", "filter_contains")
_filtered("part", _PART, 'p_brand STARTS_WITH "Brand#1"', "starts_with(p_brand, 'Brand#1')", "filter_starts_with")
_filtered("part", _PART, 'p_brand ENDS_WITH "3"', "ends_with(p_brand, '3')", "filter_ends_with")
_filtered("pages", ["page_id", "url"], 'url LIKE "http%_1%"', "url LIKE 'http%_1%'", "filter_like")
_filtered("part", _PART, "p_size IN [1, 2, 3.0, 50]", "p_size IN (1, 2, 3, 50)", "filter_in")
_filtered("part", _PART, 'p_brand NOT IN ["Brand#11", "Brand#22"]', "p_brand NOT IN ('Brand#11', 'Brand#22')", "filter_not_in")
_filtered("items", _ITEM, 'tags ANY ["t1", "t5"]', "list_has_any(tags, ['t1', 't5'])", "filter_any")
_filtered("items", _ITEM, 'tags ALL ["t1", "t4"]', "list_has_all(tags, ['t1', 't4'])", "filter_all")
_filtered("items", _ITEM, 'tags NONE ["t1", "t5"]', "NOT list_has_any(tags, ['t1', 't5'])", "filter_none")
_filtered("items", _ITEM, "rating IS NULL", "rating IS NULL", "filter_item_is_null")
_filtered("items", _ITEM, 'category = "gpu" AND NOT (price < 200 OR active = false) AND rating BETWEEN 1 AND 4.5', "category = 'gpu' AND price >= 200 AND active AND rating BETWEEN 1 AND 4.5", "filter_and_or_not")
_filtered("part", _PART, "p_partkey > p_retailprice OR p_size = p_partkey", "p_partkey > p_retailprice OR p_size = p_partkey", "filter_field_against_field")
_filtered("items", _ITEM, "category > 5", "false", "filter_string_by_size")
_filtered("items", _ITEM, 'price != "x" AND (price >= 500 && price <= 500 || price = 37)', "price IN (500, 37)", "filter_other_types")
# A missing rating is an error: what is right of it is not looked at, and NOT does not turn it round.
_filtered("items", _ITEM, "rating > 3 OR active = true", "CASE WHEN rating IS NULL THEN false ELSE rating > 3 OR active END", "filter_error_or")
_filtered("items", _ITEM, "active = true OR rating > 3", "active OR coalesce(rating > 3, false)", "filter_or_error")
_filtered("items", _ITEM, "NOT (rating > 3 AND active = true)", "CASE WHEN rating IS NULL THEN false ELSE NOT (rating > 3 AND active) END", "filter_error_not")

_LABELLED = "labelled AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id", "left")


@register("filter_is_null", f"WITH {_LABELLED} SELECT doc_id, lang FROM labelled WHERE quality IS NULL AND n_chars > 500")
def filter_is_null(spark: SparkSession, d: str) -> DataFrame:
    return keep(labelled(spark, d), "quality IS NULL AND n_chars > 500").select("doc_id", "lang")


@register("filter_is_not_null", f"WITH {_LABELLED} SELECT doc_id, quality FROM labelled WHERE toxic IS NOT NULL AND (quality = 1 OR lang = 'en')")
def filter_is_not_null(spark: SparkSession, d: str) -> DataFrame:
    return keep(labelled(spark, d), 'toxic IS NOT NULL AND (quality = 1 OR lang = "en")').select("doc_id", "quality")


@register("filter_error_algebra", f"WITH {ITEMS} SELECT id, CASE WHEN rating IS NULL THEN NULL WHEN rating > 3 THEN active ELSE false END AS both, CASE WHEN rating IS NULL THEN NULL WHEN rating > 3 THEN true ELSE active END AS either, CASE WHEN active THEN true ELSE rating > 3 END AS turned FROM items")
def filter_error_algebra(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d)
    texts = {"both": "rating > 3 AND active = true", "either": "rating > 3 OR active = true", "turned": "active = true OR rating > 3"}
    return rows.select("id", *[evaluate(rows, t).alias(n) for n, t in texts.items()])


@register("filter_dynamic_props", "SELECT event_id FROM events WHERE TRY_CAST(json_extract(props, '$.k') AS DOUBLE) >= 50 AND event_type <> 'click'")
def filter_dynamic_props(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("dynamic", F.try_parse_json("props"))
    return keep(rows, 'k >= 50 AND event_type != "click"', dynamic="dynamic").select("event_id")


# Filtered and boosted search.


@register("filtered_knn", f"WITH {ITEMS}, {Q0} SELECT id, round(list_distance(v, qv), 6) AS score FROM items, q WHERE category = 'gpu' ORDER BY list_distance(v, qv), id LIMIT {K}")
def filtered_knn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.knn(items(spark, d), query_vector(spark, d), K, "l2", 'category = "gpu"'))


@register("filtered_knn_compound", f"WITH {ITEMS}, {Q0} SELECT id, round(list_cosine_similarity(v, qv), 6) AS score, category, price FROM items, q WHERE category IN ('gpu', 'cpu') AND price BETWEEN 100 AND 800 AND active AND rating >= 1 ORDER BY list_cosine_similarity(v, qv) DESC, id LIMIT {K}")
def filtered_knn_compound(spark: SparkSession, d: str) -> DataFrame:
    where = Filter.is_in("category", ["gpu", "cpu"]) & Filter.between("price", 100, 800) & Filter.eq("active", True) & Filter.ge("rating", 1)
    return rounded(search.knn(items(spark, d), query_vector(spark, d), K, "cosine", where, include=["category", "price"]))


@register("filtered_knn_batch", f"WITH {ITEMS}, pairs AS (SELECT a.id AS qid, b.id, list_distance(b.v, a.v) AS s FROM items a, items b WHERE a.id % {EVERY} = 0 AND b.price < 500 AND b.active), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6), id) AS rank FROM pairs WHERE qid <> id) SELECT qid, id, round(s, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= {K}")
def filtered_knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.knn_batch(items(spark, d), asked(spark, d), K, "l2", "price < 500 AND active = true", exclude_self=True, places=6)).select("qid", "id", "score", "rank")


_NEAR = "near AS (SELECT id, category, active, list_distance(v, qv) AS s, row_number() OVER (ORDER BY list_distance(v, qv), id) AS r FROM items, q)"


@register("filtered_search_post", f"WITH {ITEMS}, {Q0}, {_NEAR} SELECT id, round(s, 6) AS score FROM near WHERE r <= {3 * K} AND category = 'gpu' ORDER BY r LIMIT {K}")
def filtered_search_post(spark: SparkSession, d: str) -> DataFrame:
    found = search.filtered_search(items(spark, d), query_vector(spark, d), K, 'category = "gpu"', strategy=Strategy("post"))
    return rounded(found.rows)


@register("filtered_search_hybrid", f"WITH {ITEMS}, {Q0}, {_NEAR}, few AS (SELECT count_if(r <= {3 * K // 2} AND category = 'gpu') < {K} AS few FROM near) SELECT id, round(s, 6) AS score FROM near, few WHERE r <= CASE WHEN few THEN {10 * K} ELSE {3 * K // 2} END AND category = 'gpu' ORDER BY r LIMIT {K}")
def filtered_search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    found = search.filtered_search(items(spark, d), query_vector(spark, d), K, 'category = "gpu"', strategy=Strategy("hybrid"))
    return rounded(found.rows)


_REPORT = f"""WITH {ITEMS}, {Q0}, {_NEAR}, n AS (
  SELECT least(count(*), {3 * K}) AS post, CASE WHEN count_if(active AND r <= {3 * K // 2}) >= {K} THEN {3 * K // 2} ELSE least(count(*), {10 * K}) END AS hybrid,
    count(*) AS total, count_if(active) AS passed FROM near
), rows AS (
  SELECT 'pre' AS strategy, passed AS found, total AS of_, passed AS evaluated FROM n
  UNION ALL SELECT 'post', (SELECT count_if(active AND r <= post) FROM near), post, post FROM n
  UNION ALL SELECT 'hybrid', (SELECT count_if(active AND r <= hybrid) FROM near), hybrid, hybrid FROM n)
SELECT strategy, found >= {K} AS complete, round(found / of_, 6) AS observed_selectivity, evaluated::BIGINT AS vectors_evaluated FROM rows"""


@register("filtered_search_report", _REPORT)
def filtered_search_report(spark: SparkSession, d: str) -> DataFrame:
    rows, q = items(spark, d), query_vector(spark, d)
    found = [search.filtered_search(rows, q, K, "active = true", strategy=Strategy(s)) for s in ("pre", "post", "hybrid")]
    report = [(f.strategy, f.complete, round(f.observed_selectivity, 6), f.vectors_evaluated) for f in found]
    return spark.createDataFrame(report, "strategy string, complete boolean, observed_selectivity double, vectors_evaluated long")


@register("filtered_count", f"WITH {ITEMS} SELECT count(*) AS n FROM items WHERE category = 'cpu' AND price > 300")
def filtered_count(spark: SparkSession, d: str) -> DataFrame:
    return keep(items(spark, d), 'category = "cpu" AND price > 300').agg(F.count("*").alias("n"))


@register("boosted_knn", f"WITH {ITEMS}, {Q0}, s AS (SELECT id, list_distance(v, qv) AS distance, greatest(-1.0, least(0.99, (category = 'gpu')::INT * 0.3 + list_contains(tags, 't4')::INT * 0.2 + (price = 37)::INT * 2.0 - active::INT * 0.1))::DOUBLE AS b FROM items, q) SELECT id, round(distance, 6) AS distance, round(distance * (1 - b), 6) AS score FROM s ORDER BY distance * (1 - b), id LIMIT {K}")
def boosted_knn(spark: SparkSession, d: str) -> DataFrame:
    boosts = [search.Boost("category", "gpu", 0.3), search.Boost("tags", "t4", 0.2), search.Boost("price", 37.0, 2.0), search.Boost("active", True, -0.1)]
    return rounded(search.boosted(items(spark, d), query_vector(spark, d), K, boosts), "distance", "score")


@register("boosted_knn_pool", f"WITH {ITEMS}, {Q0}, s AS (SELECT id, category, list_distance(v, qv) AS distance FROM items, q ORDER BY distance, id LIMIT 50) SELECT id, round(distance, 6) AS distance, round(distance * CASE WHEN category = 'cpu' THEN 0.5 ELSE 1 END, 6) AS score FROM s ORDER BY distance * CASE WHEN category = 'cpu' THEN 0.5 ELSE 1 END, id LIMIT {K}")
def boosted_knn_pool(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.boosted(items(spark, d), query_vector(spark, d), K, [search.Boost("category", "cpu", 0.5)], candidate_pool=0), "distance", "score")


# Codes.

_HAM = "list_sum(list_transform(list_zip(v, qv), lambda p: ((p[1] > 0) <> (p[2] > 0))::BIGINT))"


@register("bq_knn", f"WITH {E}, {Q0} SELECT id, round(1 - {_HAM} / 64.0, 6) AS score FROM e, q ORDER BY {_HAM}, id LIMIT {K}")
def bq_knn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.code_knn(vectors(spark, d), query_vector(spark, d), K))


_L2SQ = _EXACT["l2_squared"][0]


@register("bq_rescored_knn", f"WITH {E}, {Q0}, c AS (SELECT id, v, qv FROM e, q ORDER BY {_HAM}, id LIMIT {5 * K}) SELECT id, round(1 / (1 + {_L2SQ}), 6) AS score FROM c ORDER BY {_L2SQ}, id LIMIT {K}")
def bq_rescored_knn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.rescored_knn(vectors(spark, d), query_vector(spark, d), K))


@register("bq_filtered_knn", f"WITH {ITEMS}, {Q0}, c AS (SELECT id, v, qv FROM items, q WHERE active ORDER BY {_HAM}, id LIMIT {3 * K}) SELECT id, round(1 / (1 + {_L2SQ}), 6) AS score FROM c ORDER BY {_L2SQ}, id LIMIT {K}")
def bq_filtered_knn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.rescored_knn(items(spark, d), query_vector(spark, d), K, 3, "active = true"))


@register("binary_knn", f"WITH {E}, {Q0} SELECT id, {_HAM}::BIGINT AS score FROM e, q ORDER BY {_HAM}, id LIMIT {K}")
def binary_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("id", codes.sign_bytes(F.col("embedding"), 64, first_highest=True).alias("code"))
    code = rows.where("id = 0").first()["code"]
    return search.binary_knn(rows, bytes(code), K)


@register("binary_filtered_knn", f"WITH {ITEMS}, {Q0} SELECT id, {_HAM}::BIGINT AS score FROM items, q WHERE active AND category = 'gpu' ORDER BY {_HAM}, id LIMIT {K}")
def binary_filtered_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = items(spark, d).withColumn("code", codes.sign_bytes(F.col("embedding"), 64, first_highest=True))
    code = rows.where("id = 0").first()["code"]
    return search.binary_knn(rows, bytes(code), K, 'active = true AND category = "gpu"')


_RANGE = "r AS (SELECT min(list_min(v)) AS lo, max(list_max(v)) AS hi FROM e)"
_CODE = "list_transform(v, lambda x: greatest(0, least(255, round((x - lo) * 255 / (hi - lo))::INT)))"


@register("sq8_encode", f"WITH {E}, {_RANGE}, c AS (SELECT id, {_CODE} AS code FROM e, r) SELECT id, list_sum(code)::BIGINT AS code_sum, code[1]::INT AS first_code FROM c")
def sq8_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    coded = rows.select("id", codes.scalar_encode(F.col("embedding"), *codes.train_scalar(rows)).alias("code"))
    return coded.select("id", F.aggregate("code", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"), F.get("code", F.lit(0)).alias("first_code"))


@register("sq8_roundtrip_error", f"WITH {E}, {_RANGE}, c AS (SELECT id, v, lo, hi, {_CODE} AS code FROM e, r) SELECT id, round(list_max(list_transform(list_zip(v, code), lambda p: abs(p[1] - (lo + p[2] * (hi - lo) / 255)))), 6) AS worst FROM c")
def sq8_roundtrip_error(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    low, high = codes.train_scalar(rows)
    back = codes.scalar_decode(codes.scalar_encode(F.col("embedding"), low, high), low, high)
    return rows.select("id", F.round(F.array_max(F.zip_with(vector.doubles(F.col("embedding")), back, lambda x, y: F.abs(x - y))), 6).alias("worst"))


@register("sq8_knn", f"WITH {E}, {Q0}, {_RANGE}, c AS (SELECT id, {_CODE} AS code, {_CODE.replace('(v,', '(qv,')} AS qcode FROM e, q, r), s AS (SELECT id, list_sum(list_transform(list_zip(code, qcode), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS score FROM c) SELECT id, score FROM s ORDER BY score, id LIMIT {K}")
def sq8_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return search.scalar_knn(rows, query_vector(spark, d), K, *codes.train_scalar(rows))


@register("sq8_dot", f"WITH {E}, {Q0}, {_RANGE}, c AS (SELECT id, {_CODE} AS code, {_CODE.replace('(v,', '(qv,')} AS qcode FROM e, q, r) SELECT id, list_sum(list_transform(list_zip(code, qcode), lambda p: p[1] * p[2]))::BIGINT AS score FROM c")
def sq8_dot(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    low, high = codes.train_scalar(rows)
    query = codes.scalar_encode(F.array(*[F.lit(x) for x in query_vector(spark, d)]), low, high)
    return rows.select("id", codes.scalar_dot(codes.scalar_encode(F.col("embedding"), low, high), query).cast("long").alias("score"))


@register("pq_knn")
def pq_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    book = product.train(rows)
    return rounded(product.product_knn(product.encode(rows, book), book, query_vector(spark, d), K))


# With a given codebook (the slices of 32 vectors) codes and scores have one result.
_BOOK = """slices AS (SELECT id, m::INT AS m, list_slice(v, m * 8 + 1, m * 8 + 8) AS s FROM e, range(8) t(m)),
book AS (SELECT m, id AS j, s AS c FROM slices WHERE id < 32),
near AS (SELECT x.id, x.m, j, c, row_number() OVER (PARTITION BY x.id, x.m ORDER BY list_distance(s, c), j) AS r FROM slices x JOIN book b ON x.m = b.m),
coded AS (SELECT id, m, j, c FROM near WHERE r = 1)"""


def given_book(spark: SparkSession, d: str) -> product.Codebook:
    rows = vectors(spark, d).where("id < 32").orderBy("id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    return product.Codebook(x.reshape(len(x), 8, -1).transpose(1, 0, 2).copy())


@register("pq_encode", f"WITH {E}, {_BOOK} SELECT id, string_agg(j::VARCHAR, ',' ORDER BY m) AS code FROM coded GROUP BY id")
def pq_encode(spark: SparkSession, d: str) -> DataFrame:
    coded = product.encode(vectors(spark, d), given_book(spark, d))
    return coded.select("id", F.array_join(F.transform("code", lambda c: c.cast("string")), ",").alias("code"))


@register("pq_scan", f"WITH {E}, {_BOOK}, scored AS (SELECT x.id, sum(list_distance(x.c, q.s) * list_distance(x.c, q.s)) AS s FROM coded x JOIN slices q ON q.id = 0 AND q.m = x.m GROUP BY x.id) SELECT id, round(s, 6) AS score FROM scored ORDER BY s, id LIMIT {K}")
def pq_scan(spark: SparkSession, d: str) -> DataFrame:
    book = given_book(spark, d)
    return rounded(product.product_knn(product.encode(vectors(spark, d), book), book, query_vector(spark, d), K))


# Sparse vectors: term counts of the documents.

_POSTINGS = r"""postings AS (
  SELECT id, term, count(*)::DOUBLE AS weight
  FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents)
  WHERE term <> '' GROUP BY id, term)"""
_ASKED_SPARSE = f"asked AS (SELECT id AS qid, term, weight FROM postings WHERE id % {EVERY} = 0)"
_DOTS = "dots AS (SELECT qid, id, sum(p.weight * a.weight) AS s FROM postings p JOIN asked a USING (term) GROUP BY qid, id)"


def terms(rows: DataFrame, id_column: str, name: str) -> DataFrame:
    # Texts are dealt by id once; neither the counts nor a search shuffle them again.
    words = rows.select(F.col(id_column).alias(name), "text").repartition(name).select(name, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("term <> ''")
    return words.groupBy(name, "term").agg(F.count("*").cast("double").alias("weight"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    return terms(table(spark, d, "documents"), "doc_id", "id")


def asked_sparse(spark: SparkSession, d: str) -> DataFrame:
    return terms(table(spark, d, "documents").where(F.col("doc_id") % EVERY == 0), "doc_id", "qid")


@register("sparse_dot_topk", f"WITH {_POSTINGS}, {_ASKED_SPARSE}, {_DOTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM dots WHERE s > 0) SELECT qid, id, s AS score, rank::INT AS rank FROM ranked WHERE rank <= {K}")
def sparse_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.sparse_knn(postings(spark, d), asked_sparse(spark, d), K)


@register("sparse_norms", f"WITH {_POSTINGS} SELECT id, count(*) AS nnz, round(sqrt(sum(weight * weight)), 6) AS norm FROM postings GROUP BY id")
def sparse_norms(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).groupBy("id").agg(F.count("*").alias("nnz"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))


@register("sparse_cosine", f"WITH {_POSTINGS}, {_ASKED_SPARSE}, {_DOTS}, n AS (SELECT id, sqrt(sum(weight * weight)) AS n FROM postings GROUP BY id), m AS (SELECT qid, sqrt(sum(weight * weight)) AS m FROM asked GROUP BY qid) SELECT qid, id, round(s / (n * m), 6) AS score FROM dots JOIN n USING (id) JOIN m USING (qid) WHERE s / (n * m) > 0.5")
def sparse_cosine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.sparse_above(postings(spark, d), asked_sparse(spark, d), 0.5).select("qid", "id", "score"))


@register("sparse_vector_ops", "WITH v AS (SELECT l_orderkey AS id, array_agg(DISTINCT l_linenumber) AS i FROM lineitem GROUP BY 1), w AS (SELECT l_orderkey AS id, sum(l_quantity * l_quantity) AS ss, sum(CASE WHEN l_linenumber = 2 THEN l_quantity ELSE 0 END) AS second, count(*) AS nnz FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) GROUP BY 1) SELECT id, nnz::INT AS nnz, round(sqrt(ss), 6) AS norm, second::DOUBLE AS second, true AS valid FROM w")
def sparse_vector_ops(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    pairs = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("index"), F.col("q").alias("value"))).alias("p"))
    v = pairs.select("id", sparse.from_pairs(F.col("p"), 1000).alias("v"))
    return v.select("id", sparse.nnz(F.col("v")).alias("nnz"), F.round(sparse.norm(F.col("v")), 6).alias("norm"), sparse.get(F.col("v"), 2).alias("second"), sparse.valid(F.col("v")).alias("valid"))


# Hybrid search: an item is the vector and the document of one id.

_LISTS = f"""{_POSTINGS}, {_ASKED_SPARSE}, {_DOTS}, {E},
dense_all AS (SELECT a.id AS qid, b.id, list_cosine_similarity(b.v, a.v) AS s FROM e a, e b WHERE a.id % {EVERY} = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM dense_all) WHERE rank <= 20),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM dots WHERE s > 0) WHERE rank <= 20)"""
_FUSED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM fused) SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= 10"


@register("hybrid_rrf", f"WITH {_LISTS}, fused AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, coalesce(1 / (60.0::DOUBLE + d.rank), 0) + coalesce(1 / (60.0::DOUBLE + s.rank), 0) AS score FROM dense d FULL JOIN sparse s ON d.qid = s.qid AND d.id = s.id), {_FUSED}")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = hybrid.hybrid_search(vectors(spark, d), texts, asked(spark, d), asked_sparse(spark, d), texts=True)
    return rounded(found.select("qid", "id", "score", "rank"))


_SCALED = "SELECT qid, id, CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS s FROM {} WINDOW w AS (PARTITION BY qid)"


@register("hybrid_linear", f"WITH {_LISTS}, d AS ({_SCALED.format('dense')}), s AS ({_SCALED.format('sparse')}), fused AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, 0.7 * coalesce(d.s, 0) + (1 - 0.7) * coalesce(s.s, 0) AS score FROM d FULL JOIN s ON d.qid = s.qid AND d.id = s.id), {_FUSED}")
def hybrid_linear(spark: SparkSession, d: str) -> DataFrame:
    found = hybrid.hybrid_search(vectors(spark, d), postings(spark, d), asked(spark, d), asked_sparse(spark, d), fusion="linear", alpha=0.7)
    return rounded(found.select("qid", "id", "score", "rank"))


@register("hybrid_dense_only", f"WITH {E}, dense_all AS (SELECT a.id AS qid, b.id, list_cosine_similarity(b.v, a.v) AS s FROM e a, e b WHERE a.id % {EVERY} = 0), dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM dense_all) SELECT qid, id, round(1 / (60.0::DOUBLE + rank), 6) AS score, rank::INT AS rank FROM dense WHERE rank <= 10")
def hybrid_dense_only(spark: SparkSession, d: str) -> DataFrame:
    found = hybrid.hybrid_search(vectors(spark, d), postings(spark, d), asked(spark, d), asked_sparse(spark, d), sparse_k=0)
    return rounded(found.select("qid", "id", "score", "rank"))


@register("selectivity_exact", f"WITH {ITEMS} SELECT count(*) AS total, count(*) FILTER (rating > 3 AND category = 'gpu') AS passed, count(*) FILTER (rating > 3 AND category = 'gpu') / count(*)::DOUBLE AS share FROM items")
def selectivity_exact(spark: SparkSession, d: str) -> DataFrame:
    return exact_share(items(spark, d), 'rating > 3 AND category = "gpu"')


# Maintenance. Ids begin at 1 in a collection; the tables' begin at 0.


def collection(spark: SparkSession, d: str) -> Collection:
    return Collection.create(items(spark, d).withColumn("id", F.col("id") + 1), 64, "cosine")


def _gone(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 11 = 0").select((F.col("vec_id") + 1).alias("id"))


@register("soft_delete_live", f"WITH {ITEMS} SELECT id + 1 AS id, category, price FROM items WHERE id % 11 <> 0")
def soft_delete_live(spark: SparkSession, d: str) -> DataFrame:
    return collection(spark, d).delete(_gone(spark, d)).live().select("id", "category", "price")


@register("soft_delete_knn", f"WITH {ITEMS}, {Q0} SELECT id + 1 AS id, round(list_cosine_similarity(v, qv), 6) AS score FROM items, q WHERE id % 11 <> 0 AND price < 900 ORDER BY list_cosine_similarity(v, qv) DESC, id LIMIT {K}")
def soft_delete_knn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(collection(spark, d).delete(_gone(spark, d)).search(query_vector(spark, d), K, "price < 900"))


@register("restore_live", "SELECT vec_id + 1 AS id FROM embeddings WHERE vec_id % 11 <> 0 OR vec_id % 2 = 0")
def restore_live(spark: SparkSession, d: str) -> DataFrame:
    gone = _gone(spark, d)
    return collection(spark, d).delete(gone).restore(gone.where("(id - 1) % 2 = 0")).live().select("id")


@register("compaction", "SELECT count(*) FILTER (vec_id % 11 <> 0) AS total, count(*) FILTER (vec_id % 11 <> 0) AS live, 0::BIGINT AS deleted, 0.0::DOUBLE AS tombstone_ratio FROM embeddings")
def compaction(spark: SparkSession, d: str) -> DataFrame:
    return collection(spark, d).delete(_gone(spark, d)).compact().stats().select("total", "live", "deleted", "tombstone_ratio")


@register("collection_stats", "SELECT count(*) AS total, count(*) FILTER (vec_id % 11 <> 0) AS live, count(*) FILTER (vec_id % 11 = 0) AS deleted, round(count(*) FILTER (vec_id % 11 = 0) / count(*)::DOUBLE, 6) AS tombstone_ratio, 64 AS dimensions, count(*) * 256 AS vector_bytes FROM embeddings")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(collection(spark, d).delete(_gone(spark, d)).stats(), "tombstone_ratio")


@register("batch_insert_dedupe", "WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS ord FROM events), b AS (SELECT user_id * 5 + 1 AS id, min(event_id) AS ord FROM e GROUP BY 1) SELECT id FROM b WHERE id > 0 AND id NOT IN (SELECT vec_id + 1 FROM embeddings)")
def batch_insert_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """A batch with an id per event: repeats and ids that exist are left out."""
    batch = table(spark, d, "events").select((F.col("user_id") * 5 + 1).alias("id"), F.col("event_id").alias("ordinal"), F.array_repeat(F.lit(0.125), 64).cast("array<float>").alias("embedding"))
    return collection(spark, d).batch_new(batch, "ordinal").select("id")


@register("batch_delete_report", "WITH w AS (SELECT user_id % 700 AS id FROM events), f AS (SELECT w.id, e.vec_id IS NULL AS invalid, e.vec_id % 11 = 0 AS gone FROM (SELECT DISTINCT id FROM w) w LEFT JOIN embeddings e ON w.id = e.vec_id + 1) SELECT (SELECT count(*) FROM w) AS total, count(*) AS unique, count(*) FILTER (NOT invalid AND NOT gone) AS deleted, count(*) FILTER (gone) AS already_deleted, count(*) FILTER (invalid) AS invalid FROM f")
def batch_delete_report(spark: SparkSession, d: str) -> DataFrame:
    return collection(spark, d).delete(_gone(spark, d)).delete_report(table(spark, d, "events").select((F.col("user_id") % 700).alias("id")))


@register("metadata_merge", f"WITH {ITEMS} SELECT i.id + 1 AS id, coalesce('s' || (l.quality), i.category) AS category, l.toxic AS toxic FROM items i LEFT JOIN labels l ON l.doc_id = i.id")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "labels").select((F.col("doc_id") + 1).alias("id"), F.concat(F.lit("s"), F.col("quality")).alias("category"), "toxic")
    return collection(spark, d).set_metadata(changes).live().select("id", "category", "toxic")


@register("metadata_key_counts", "WITH k AS (SELECT event_id AS id, unnest(json_keys(props)) AS key, props FROM events) SELECT id, count(*) AS keys FROM k WHERE json_type(props, '$.' || key) NOT IN ('NULL', 'OBJECT', 'ARRAY') GROUP BY id")
def metadata_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return metadata.key_counts(metadata.from_json(table(spark, d, "events"), "props", "event_id"))


@register("change_log_state", "WITH c AS (SELECT user_id AS id, ts, CASE WHEN event_type = 'click' THEN 'delete' ELSE 'insert' END AS op, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, op DESC, value DESC) AS n FROM c) SELECT id, value FROM r WHERE n = 1 AND op = 'insert'")
def change_log_state(spark: SparkSession, d: str) -> DataFrame:
    from halyard.streaming.ingest import current

    op = F.when(F.col("event_type") == "click", "delete").otherwise("insert")
    return current(table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", op.alias("op"), "value")).select("id", "value")


@register("change_log_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) FILTER (event_type <> 'click') AS inserts, count(*) FILTER (event_type = 'click') AS deletes FROM events GROUP BY 1")
def change_log_windows(spark: SparkSession, d: str) -> DataFrame:
    from halyard.streaming.ingest import windowed_counts

    op = F.when(F.col("event_type") == "click", "delete").otherwise("insert")
    counts = windowed_counts(table(spark, d, "events").select("ts", op.alias("op")), "1 day")
    return counts.select(F.col("window.start").alias("start"), "inserts", "deletes")

