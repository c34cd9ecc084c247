"""Vector search and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import search as S
from ..session import table
from . import query

E_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
E_DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
E_L2 = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
ONE = "embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def vectors_of(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark, d, i=0):
    return vectors_of(spark, d).where(F.col("id") == i).first()["vector"]


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


for _metric, _name, _sql in (("cosine", "cosine", E_COS), ("dot", "dot", E_DOT), ("euclidean", "l2", f"-{E_L2}")):

    @query(f"vec_topk_{_name}", f"SELECT e.vec_id AS id, round({_sql}, 6) AS score FROM {ONE} ORDER BY {_sql} DESC, e.vec_id LIMIT 10")
    def _top(spark, d, metric=_metric):
        return _rounded(S.top_k(vectors_of(spark, d), query_vector(spark, d), 10, metric).select("id", "score"), "score")


@query("vec_threshold", f"SELECT id, round(s, 6) AS score FROM (SELECT e.vec_id AS id, {E_COS} AS s FROM {ONE}) WHERE s >= 0.15 ORDER BY s DESC, id LIMIT 50")
def _threshold(spark, d):
    return _rounded(S.top_k(vectors_of(spark, d), query_vector(spark, d), 50, threshold=0.15).select("id", "score"), "score")


@query("vec_filtered", f"SELECT e.vec_id AS id, e.label, round({E_COS}, 6) AS score FROM {ONE} WHERE e.label = 3 ORDER BY {E_COS} DESC, e.vec_id LIMIT 10")
def _filtered(spark, d):
    return _rounded(S.top_k(vectors_of(spark, d), query_vector(spark, d), where=F.col("label") == 3).select("id", "label", "score"), "score")


@query("vec_range_cosine", f"SELECT id, round(1 - s, 6) AS distance FROM (SELECT e.vec_id AS id, {E_COS} AS s FROM {ONE}) WHERE 1 - s <= 0.8")
def _range_cos(spark, d):
    return _rounded(S.range_search(vectors_of(spark, d), query_vector(spark, d), 0.8, "cosine").select("id", "distance"), "distance")


@query("vec_range_l2", f"SELECT id, round(s, 6) AS distance FROM (SELECT e.vec_id AS id, {E_L2} AS s FROM {ONE}) WHERE s <= 1.25")
def _range_l2(spark, d):
    return _rounded(S.range_search(vectors_of(spark, d), query_vector(spark, d), 1.25, "euclidean").select("id", "distance"), "distance")


@query("vec_range_compat", f"SELECT id, round(CASE WHEN s <= 0 THEN -s ELSE 1 - s END, 6) AS distance FROM (SELECT e.vec_id AS id, {E_COS} AS s FROM {ONE}) WHERE CASE WHEN s <= 0 THEN -s ELSE 1 - s END <= 0.05")
def _range_compat(spark, d):
    return _rounded(S.range_search(vectors_of(spark, d), query_vector(spark, d), 0.05, "cosine", compat=True).select("id", "distance"), "distance")


@query("vec_batch_range", "SELECT q.vec_id AS query_id, e.vec_id AS id, round(" + E_COS + ", 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND 1 - " + E_COS + " <= 0.8")
def _batch_range(spark, d):
    rows = vectors_of(spark, d)
    return _rounded(S.batch_knn(rows.where("id % 20 = 0"), rows, metric="cosine", radius=0.8).select("query_id", "id", "score"), "score")


_KNN = "SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {s} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {s} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10"


@query("vec_batch_knn", _KNN.format(s=E_COS))
def _batch_knn(spark, d):
    rows = vectors_of(spark, d)
    return _rounded(S.batch_knn(rows.where("id % 20 = 0"), rows).withColumn("rank", F.col("rank").cast("bigint")), "score")


@query("vec_batch_knn_l2", _KNN.format(s=f"-{E_L2}"))
def _batch_knn_l2(spark, d):
    rows = vectors_of(spark, d)
    found = S.batch_knn(rows.where("id % 20 = 0"), rows, metric="euclidean").withColumn("rank", F.col("rank").cast("bigint"))
    # A vector's distance to itself is a rounding error of the matrix product.
    return _rounded(found.withColumn("score", F.when(F.abs("score") < 1e-6, -0.0).otherwise(F.col("score"))), "score")


_NEG = """WITH p AS (SELECT e.vec_id AS id, max({c}) AS s FROM embeddings e, embeddings q WHERE q.vec_id IN ({pos}) GROUP BY 1),
n AS (SELECT e.vec_id AS id, max({c}) AS s FROM embeddings e, embeddings q WHERE q.vec_id IN ({neg}) GROUP BY 1)
SELECT id, round(greatest(0, p.s) - {w} * greatest(0, n.s), 6) AS score FROM p JOIN n USING (id) ORDER BY greatest(0, p.s) - {w} * greatest(0, n.s) DESC, id LIMIT 20"""


@query("vec_negatives", _NEG.format(c=E_COS, pos="0, 1", neg="2, 3", w=0.7))
def _negatives(spark, d):
    v = [query_vector(spark, d, i) for i in range(4)]
    return _rounded(S.with_negatives(vectors_of(spark, d), v[:2], v[2:], 20, 0.7).select("id", "score"), "score")


@query("vec_recommend", _NEG.format(c=E_COS, pos="5, 6", neg="7", w=0.5))
def _recommend(spark, d):
    return _rounded(S.recommend(vectors_of(spark, d), [5, 6], [7], 20).select("id", "score"), "score")


_HALVES = """WITH f AS (SELECT vec_id, 'head' AS field, embedding[1:32]::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id, 'tail', embedding[33:64]::DOUBLE[] FROM embeddings),
s AS (SELECT e.vec_id AS entity_id, e.field, list_cosine_similarity(e.v, q.v) * CASE e.field WHEN 'head' THEN 1.0 ELSE 0.5 END AS score, row_number() OVER (PARTITION BY e.field ORDER BY list_cosine_similarity(e.v, q.v) DESC, e.vec_id) AS r FROM f e JOIN f q ON e.field = q.field AND q.vec_id = 0)
SELECT entity_id, round({a}(score), 6) AS score FROM s WHERE r <= 10 GROUP BY 1 ORDER BY {a}(score) DESC, 1 LIMIT 10"""

for _how, _agg in (("max", "max"), ("min", "min"), ("sum", "sum"), ("average", "avg")):

    @query(f"vec_multivector_{'avg' if _how == 'average' else _how}", _HALVES.format(a=_agg))
    def _multi(spark, d, how=_how):
        rows = vectors_of(spark, d)
        long = S.multi_vector_rows(rows.select(F.col("id").alias("entity_id"), F.create_map(F.lit("head"), F.slice("vector", 1, 32), F.lit("tail"), F.slice("vector", 33, 32)).alias("vectors")))
        q = query_vector(spark, d)
        return _rounded(S.multi_vector_search(long, {"head": q[:32], "tail": q[32:]}, 10, {"tail": 0.5}, how), "score")


@query("vec_anomalies", f"""WITH s AS (SELECT q.vec_id AS id, 1 - {E_COS} AS gap, row_number() OVER (PARTITION BY q.vec_id ORDER BY {E_COS} DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id)
SELECT id, round(avg(gap), 6) AS score FROM s WHERE r <= 5 GROUP BY 1""")
def _anomalies(spark, d):
    return _rounded(S.anomalies(vectors_of(spark, d)), "score")


@query("vec_centroid_by_label", "SELECT label, i - 1 AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, generate_series(1, 64) t(i) GROUP BY 1, 2")
def _centroids(spark, d):
    long = vectors_of(spark, d).select("label", F.posexplode("vector").alias("pos", "x"))
    return long.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("vec_normalize", "SELECT vec_id AS id, round(list_sum([x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding::DOUBLE[]]), 5) AS total FROM embeddings")
def _normalize(spark, d):
    return vectors_of(spark, d).select("id", F.round(F.aggregate(V.normalized(F.col("vector")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("vec_adapt_truncate", "SELECT vec_id AS id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[])), 6) AS first, 32::BIGINT AS dim FROM embeddings")
def _truncate(spark, d):
    v = V.adapt(F.col("vector"), 32, "truncate")
    return vectors_of(spark, d).select("id", F.round(F.get(v, F.lit(0)), 6).alias("first"), F.size(v).cast("bigint").alias("dim"))


@query("vec_adapt_pad", "SELECT vec_id AS id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, 0.0::DOUBLE AS last, 96::BIGINT AS dim FROM embeddings")
def _pad(spark, d):
    v = V.adapt(F.col("vector"), 96, "pad")
    return vectors_of(spark, d).select("id", F.round(F.get(v, F.lit(0)), 6).alias("first"), F.get(v, F.lit(95)).alias("last"), F.size(v).cast("bigint").alias("dim"))


@query("vec_stddev", "SELECT vec_id AS id, round((SELECT stddev_samp(x) FROM (SELECT unnest(embedding::DOUBLE[]) AS x)), 6) AS deviation FROM embeddings")
def _stddev(spark, d):
    return vectors_of(spark, d).select("id", F.round(V.stddev(F.col("vector")), 6).alias("deviation"))


@query("vec_validate", "SELECT count(*) AS valid FROM embeddings WHERE len(embedding) > 0")
def _valid(spark, d):
    return vectors_of(spark, d).where(V.is_valid(F.col("vector"))).agg(F.count("*").alias("valid"))


@query("acl_search", f"""SELECT e.vec_id AS id, e.label, round({E_COS}, 6) AS score FROM {ONE}
WHERE e.label = 0 OR list_has_any(['group:' || (e.label % 3)::VARCHAR, 'user:' || e.label::VARCHAR], ['group:1', 'user:5']) ORDER BY {E_COS} DESC, e.vec_id LIMIT 20""")
def _acl(spark, d):
    label = F.col("label").cast("string")
    acl = F.when(F.col("label") != 0, F.array(F.concat(F.lit("group:"), (F.col("label") % 3).cast("string")), F.concat(F.lit("user:"), label)))
    rows = vectors_of(spark, d).withColumn("acl", acl)
    return _rounded(S.top_k(rows, query_vector(spark, d), 20, where=S.acl_filter(["group:1", "user:5"])).select("id", "label", "score"), "score")
