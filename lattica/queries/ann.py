"""Indexes, quantization and geography."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import geo as P
from ..functions import vectors as V
from ..operators import ann as A
from ..operators import indexes as I
from ..operators import search as S
from ..session import shared_dir, table
from . import query
from .vectors import E_L2, ONE, query_vector, vectors_of


def _label_means(spark, d):
    """The labels' mean vectors as centroids."""
    long = vectors_of(spark, d).select("label", F.posexplode("vector").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = long.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("v")).orderBy("label").collect()
    return np.array([[x["m"] for x in r["v"]] for r in rows])


_C = """c AS (SELECT label AS centroid, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, generate_series(1, 64) t(i) GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT vec_id AS id, embedding, arg_min(centroid, list_distance(embedding::DOUBLE[], v)) AS centroid FROM embeddings, c GROUP BY 1, 2)"""


@query("ann_ivf_assign", f"WITH {_C} SELECT id, centroid::INTEGER AS centroid FROM a")
def _assign(spark, d):
    return A.assign(vectors_of(spark, d), _label_means(spark, d)).select("id", "centroid")


@query("ann_ivf_search", f"""WITH {_C}, p AS (SELECT centroid FROM c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_distance(q.embedding::DOUBLE[], v) LIMIT 3)
SELECT id, round({E_L2}, 6) AS distance FROM a e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.centroid IN (SELECT centroid FROM p) ORDER BY {E_L2}, id LIMIT 10""")
def _ivf(spark, d):
    c = _label_means(spark, d)
    return A.ivf_search(A.assign(vectors_of(spark, d), c), c, query_vector(spark, d), 10, 3).select("id", F.round("distance", 6).alias("distance"))


@query("ann_ivf_stats", f"WITH {_C}, s AS (SELECT centroid, count(*) AS n FROM a GROUP BY 1) SELECT count(*) AS clusters, sum(n)::BIGINT AS vectors, min(n) AS least, max(n) AS most, avg(n) AS mean FROM s")
def _stats(spark, d):
    return A.cluster_stats(A.assign(vectors_of(spark, d), _label_means(spark, d)))


@query("ann_ivf_kmeans")
def _kmeans(spark, d):
    rows = vectors_of(spark, d)
    c = A.train_centroids(rows, 16)
    return A.ivf_search_many(A.assign(rows, c), c, rows.where("id % 20 = 0"), 10, 12)


def _folder(spark, name):
    return f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"


_indexes: dict = {}


def ivf_index(spark, d):
    """A stored IVF index, trained, written and read back once in an application."""
    known = ("ivf", spark.sparkContext.applicationId, d)
    if known not in _indexes:
        made = I.IvfIndex(spark, _folder(spark, "ivf"))
        made.train(vectors_of(spark, d), 16)
        made.add(vectors_of(spark, d))
        _indexes[known] = made.path
    return I.IvfIndex(spark, _indexes[known])


def graph_index(spark, d, cells=1):
    known = ("graph", cells, spark.sparkContext.applicationId, d)
    if known not in _indexes:
        made = I.GraphIndex(spark, _folder(spark, "graph"))
        rows = vectors_of(spark, d)
        made.set_centroids(A.train_centroids(rows, cells) if cells > 1 else np.zeros((1, 64)))
        made.build(rows)
        _indexes[known] = made.path
    return I.GraphIndex(spark, _indexes[known])


def _found(rows):
    return rows.select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("ann_ivf_stored")
def _ivf_stored(spark, d):
    return _found(ivf_index(spark, d).search_many(vectors_of(spark, d).where("id % 20 = 0"), 10, 12))


_ALL_NEAR = f"SELECT id, round(s, 6) AS distance FROM (SELECT e.vec_id AS id, {E_L2} AS s FROM {ONE} WHERE e.vec_id % 7 <> 1) ORDER BY s, id LIMIT 10"


@query("ann_ivf_changes", _ALL_NEAR)
def _ivf_changes(spark, d):
    """Rows are added in two batches, some are deleted, the index is compacted and opened again; all cells are probed, so the answer is exact."""
    rows = vectors_of(spark, d)
    made = I.IvfIndex(spark, _folder(spark, "ivf"))
    made.train(rows, 8)
    made.add(rows.where("id % 2 = 0")).add(rows.where("id % 2 = 1"))
    made.delete(rows.where("id % 7 = 1"))
    whole = made.compacted(_folder(spark, "ivf"))
    return I.IvfIndex(spark, whole.path).search(query_vector(spark, d), 10, 8).select("id", F.round("distance", 6).alias("distance"))


@query("ann_hnsw")
def _hnsw(spark, d):
    return _found(graph_index(spark, d).search_many(vectors_of(spark, d).where("id % 20 = 0"), 10, 1, 100))


@query("ann_hnsw_ivf")
def _hnsw_ivf(spark, d):
    return _found(graph_index(spark, d, 8).search_many(vectors_of(spark, d).where("id % 20 = 0"), 10, 6, 64))


@query("ann_hnsw_changes")
def _hnsw_changes(spark, d):
    """A graph index after rows were added and deleted: none of the deleted ones is found."""
    rows = vectors_of(spark, d)
    made = I.GraphIndex(spark, _folder(spark, "graph"))
    made.set_centroids(np.zeros((1, 64)))
    made.build(rows.where("id % 2 = 0")).add(rows.where("id % 2 = 1"))
    made.delete(rows.where("id % 7 = 1"))
    return _found(made.search_many(rows.where("id % 20 = 0"), 10, 1, 100))


@query("ann_hnsw_stats", "SELECT 1::BIGINT AS graphs, count(*) AS nodes, count(*) AS most FROM embeddings")
def _hnsw_stats(spark, d):
    return graph_index(spark, d).stats()


@query("ann_lsh")
def _lsh(spark, d):
    rows = vectors_of(spark, d)
    lsh = A.Lsh(64)
    return lsh.search(lsh.index(rows), rows.where("id % 20 = 0"), 10)


@query("ann_lsh_multiprobe")
def _lsh_probe(spark, d):
    rows = vectors_of(spark, d)
    lsh = A.Lsh(64, 12)
    return lsh.search(lsh.index(rows), rows.where("id % 20 = 0"), 10, flips=5)


def _two(spark, d):
    rows = vectors_of(spark, d)
    near = lambda i: rows.select("id", V.distance(F.col("vector"), query_vector(spark, d, i)).alias("distance")).orderBy("distance", "id").limit(10)
    return near(0), near(1)


_TWO = f"a AS (SELECT e.vec_id AS id, {E_L2} AS g FROM {ONE} ORDER BY 2, 1 LIMIT 10), b AS (SELECT e.vec_id AS id, {E_L2} AS g FROM {ONE.replace('vec_id = 0', 'vec_id = 1')} ORDER BY 2, 1 LIMIT 10), u AS (SELECT *, 0 AS n FROM a UNION ALL SELECT *, 1 FROM b), f AS (SELECT id, min(g) AS least, avg(g) AS mean, count(*) AS votes, avg(g) FILTER (n = 1) AS second, count(*) FILTER (n = 0) AS first FROM u GROUP BY 1)"
for _how, _sql in (
    ("merge", "SELECT id, round(least, 6) AS score FROM f ORDER BY least, id LIMIT 10"),
    ("rerank", "SELECT id, round(second, 6) AS score FROM f WHERE first > 0 ORDER BY second NULLS LAST, id LIMIT 10"),
    ("vote", "SELECT id, round(mean - 0.1 * votes, 6) AS score FROM f ORDER BY votes DESC, mean - 0.1 * votes, id LIMIT 10"),
    ("primary", "SELECT id, round(g, 6) AS score FROM a"),
    ("fill", "SELECT id, round(own, 6) AS score FROM (SELECT id, min(g) AS least, arg_min(g, n) AS own, count(*) FILTER (n = 0) AS first FROM (SELECT *, 0 AS n FROM (SELECT * FROM a ORDER BY g, id LIMIT 4) UNION ALL SELECT *, 1 FROM b) GROUP BY 1 ORDER BY first DESC, least, id LIMIT 10)"),
):

    @query(f"ann_multi_{_how}", f"WITH {_TWO} {_sql}")
    def _multi(spark, d, how=_how):
        a, b = _two(spark, d)
        a = a.orderBy("distance", "id").limit(4) if how == "fill" else a  # short of rows, so there is something to fill
        return A.combine(a, [b], how).select("id", F.round("score", 6).alias("score"))


_R = "r AS (SELECT i, min(embedding[i])::DOUBLE AS lo, max(embedding[i])::DOUBLE AS hi, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, generate_series(1, 64) t(i) GROUP BY 1)"


@query("quant_scalar_train", f"WITH {_R} SELECT (i - 1)::INTEGER AS pos, lo, CASE WHEN lo = hi THEN lo + 1e-6 ELSE hi END AS hi FROM r")
def _ranges(spark, d):
    return A.scalar_ranges(vectors_of(spark, d))


_CODE = "floor(greatest(least((embedding[i]::DOUBLE - lo) / (hi - lo), 1), 0) * 255)"


@query("quant_scalar", f"WITH {_R} SELECT vec_id AS id, sum({_CODE})::BIGINT AS total, max({_CODE})::INTEGER AS most FROM embeddings, r GROUP BY 1")
def _scalar(spark, d):
    rows = vectors_of(spark, d)
    coded = A.scalar_encode(rows, A.scalar_ranges(rows))
    return coded.select("id", F.aggregate("code", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max("code").alias("most"))


@query("quant_scalar_decode", f"WITH {_R} SELECT vec_id AS id, round(sum(lo + {_CODE} / 255 * (hi - lo)), 5) AS total FROM embeddings, r GROUP BY 1")
def _scalar_decode(spark, d):
    rows = vectors_of(spark, d)
    ranges = A.scalar_ranges(rows)
    decoded = A.scalar_decode(A.scalar_encode(rows, ranges), ranges)
    return decoded.select("id", F.round(F.aggregate("decoded", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("quant_binary", f"WITH {_R} SELECT vec_id AS id, count(*) FILTER (embedding[i]::DOUBLE > mean)::INTEGER AS ones FROM embeddings, r GROUP BY 1")
def _binary(spark, d):
    rows = vectors_of(spark, d)
    return A.binary_encode(rows, A.binary_thresholds(rows)).select("id", F.bit_count("code").alias("ones"))


@query("quant_hamming", f"WITH {_R}, b AS (SELECT vec_id AS id, i, embedding[i]::DOUBLE > mean AS bit FROM embeddings, r) SELECT x.id, count(*) FILTER (x.bit <> y.bit)::INTEGER AS distance FROM b x JOIN b y USING (i) WHERE y.id = 0 GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def _hamming(spark, d):
    rows = vectors_of(spark, d)
    coded = A.binary_encode(rows, A.binary_thresholds(rows))
    return A.binary_search(coded, coded.where("id = 0").first()["code"], 10).select("id", "distance")


@query("quant_pq")
def _pq(spark, d):
    rows = vectors_of(spark, d)
    pq = A.ProductQuantizer.train(rows, 4, 16)
    return pq.search(pq.encode(rows), query_vector(spark, d), 10).select("id", "distance")


@query("quant_projection")
def _projection(spark, d):
    return vectors_of(spark, d).select("id", A.project(F.col("vector"), A.random_projection(64, 8)).alias("projected"))


@query("ann_flat_range", f"SELECT id, round(g, 6) AS distance FROM (SELECT e.vec_id AS id, {E_L2} AS g FROM {ONE}) WHERE g <= 1.3")
def _flat(spark, d):
    return S.range_search(vectors_of(spark, d), query_vector(spark, d), 1.3).select("id", F.round("distance", 6).alias("distance"))


_POINTS = "p AS (SELECT c_custkey AS id, (c_custkey * 37 % 18000) / 100.0 - 90 AS lat, (c_custkey * 91 % 36000) / 100.0 - 180 AS lng FROM customer)"
_KM = "2 * 6371 * atan2(sqrt(pow(sin(radians(lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians(lat)) * pow(sin(radians(lng - {b}) / 2), 2)), sqrt(1 - (pow(sin(radians(lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians(lat)) * pow(sin(radians(lng - {b}) / 2), 2))))"


def points(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("id"), (key * 37 % 18000 / 100.0 - 90).alias("lat"), (key * 91 % 36000 / 100.0 - 180).alias("lng"))


@query("geo_radius", f"WITH {_POINTS}, k AS (SELECT id, {_KM.format(a=40.0, b=-75.0)} AS km FROM p) SELECT id, round(km / 1.60934, 4) AS distance FROM k WHERE km <= 2500 * 1.60934")
def _radius(spark, d):
    return P.radius_search(points(spark, d), 40.0, -75.0, 2500, "miles").select("id", F.round("distance", 4).alias("distance"))


@query("geo_radius_wrapped", f"WITH {_POINTS}, k AS (SELECT id, {_KM.format(a=-20.0, b=178.0)} AS km FROM p) SELECT id, round(km, 4) AS distance FROM k WHERE km <= 3000")
def _radius_wrapped(spark, d):
    return P.radius_search(points(spark, d), -20.0, 178.0, 3000).select("id", F.round("distance", 4).alias("distance"))


@query("geo_knn", f"WITH {_POINTS}, k AS (SELECT id, {_KM.format(a=50.8503, b=4.3517)} AS km FROM p) SELECT id, round(km, 4) AS distance FROM k ORDER BY km, id LIMIT 10")
def _geo_knn(spark, d):
    return P.nearest(points(spark, d), 50.8503, 4.3517, 10).select("id", F.round("distance", 4).alias("distance"))


@query("geo_bbox", f"WITH {_POINTS} SELECT id FROM p WHERE lat BETWEEN 20 AND 60 AND lng BETWEEN -100 AND -40")
def _bbox(spark, d):
    return P.in_box(points(spark, d), 20, -100, 60, -40).select("id")


@query("geo_polygon", f"WITH {_POINTS} SELECT id FROM p WHERE lat > 0 AND lng > 0 AND lat + lng < 80")
def _polygon(spark, d):
    # The triangle (0, 0), (0, 80), (80, 0), its sides moved off the grid of points by less than their spacing.
    return P.in_polygon(points(spark, d), [(0.001, 0.001), (0.001, 79.997), (79.997, 0.001)]).select("id")
