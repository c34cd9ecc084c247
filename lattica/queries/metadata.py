"""Filters, facets, aggregation and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import filters as M
from ..operators import search as S
from ..session import table
from . import query
from .vectors import E_COS, ONE, query_vector, vectors_of


def parts(spark, d):
    """Parts with their metadata as a map."""
    p = table(spark, d, "part")
    text = lambda c: F.col(c).cast("string")
    return p.select(F.col("p_partkey").alias("id"), F.create_map(F.lit("brand"), text("p_brand"), F.lit("type"), text("p_type"), F.lit("size"), text("p_size")).alias("metadata"))


def _filter_query(name, where, make):
    @query(name, f"SELECT p_partkey AS id FROM part WHERE {where}")
    def run(spark, d):
        return parts(spark, d).where(make(M.MetadataFilter()).build().column()).select("id")


_filter_query("filter_eq", "p_size = 10", lambda f: f.equal("size", 10))
_filter_query("filter_ne", "p_brand <> 'Brand#11'", lambda f: f.not_equal("brand", "Brand#11"))
_filter_query("filter_gt", "p_size > 40", lambda f: f.greater_than("size", 40))
_filter_query("filter_between", "p_size BETWEEN 10 AND 12", lambda f: f.between("size", 10, 12))
_filter_query("filter_in", "p_size IN (1, 2, 3)", lambda f: f.in_("size", 1, 2, 3))
_filter_query("filter_not_in", "p_size NOT IN (1, 2, 3)", lambda f: f.not_in("size", 1, 2, 3))
_filter_query("filter_like", "p_brand ILIKE 'brand#1%'", lambda f: f.like("brand", "brand#1%"))
_filter_query("filter_regex", "regexp_matches(p_brand, '#[12]3')", lambda f: f.regex("brand", "#[12]3"))
_filter_query("filter_and_or", "(p_size < 5 AND p_brand LIKE 'Brand#1%') OR p_size = 50", lambda f: f.less_than("size", 5).like("brand", "Brand#1%").or_(M.MetadataFilter().equal("size", 50)))


@query("filter_parsed_expr", "SELECT p_partkey AS id FROM part WHERE (p_size BETWEEN 5 AND 9 OR p_size = 50) AND NOT p_brand = 'Brand#11' AND p_size NOT IN (6, 7)")
def _parsed(spark, d):
    f = M.parse_filter("(size BETWEEN 5 AND 9 OR size:50) AND NOT brand = 'Brand#11' AND size NOT IN (6, 7)")
    return parts(spark, d).where(f.column()).select("id")


@query("filter_json", "SELECT event_id AS id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) >= 90")
def _json(spark, d):
    return table(spark, d, "events").where(M.Filter(">=", "k", 90).column(A.json_value("props"))).select(F.col("event_id").alias("id"))


@query("filter_post_missing", "SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
def _post(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = both.select(F.col("doc_id").alias("id"), F.create_map(F.lit("quality"), F.col("quality").cast("string")).alias("metadata"))
    return rows.where(M.Filter("!=", "quality", 1).column(flavour="post")).select("id")


@query("filter_equality_map", "SELECT p_partkey AS id FROM part WHERE p_size = 7 AND p_brand = 'Brand#23'")
def _equality(spark, d):
    return parts(spark, d).where(M.equality_filter({"size": 7, "brand": "Brand#23"})).select("id")


@query("filter_advanced_search", f"SELECT e.vec_id AS id, l.quality, round({E_COS}, 6) AS score FROM {ONE} JOIN labels l ON l.doc_id = e.vec_id WHERE l.quality = 1 AND l.toxic <> 1 AND e.label > 2 ORDER BY {E_COS} DESC, e.vec_id LIMIT 15")
def _advanced(spark, d):
    rows = vectors_of(spark, d).join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id")
    text = {c: F.col(c).cast("string") for c in ("quality", "toxic", "label")}
    pre = M.parse_filter("quality = 1 AND toxic != 1").column(text.__getitem__)
    found = S.scored(rows.where(pre), query_vector(spark, d)).where(M.parse_filter("label > 2").column(text.__getitem__, "post"))
    return found.orderBy(F.desc("score"), "id").limit(15).select("id", "quality", F.round("score", 6).alias("score"))


def _facet_query(name, where, **facets):
    @query(name, f"SELECT p_partkey AS id FROM part WHERE {where}")
    def run(spark, d):
        return parts(spark, d).where(M.facets_filter(facets, lambda k: F.element_at("metadata", k))).select("id")


_facet_query("facet_equals", "p_brand = 'Brand#12'", brand=M.Facet("equals", "Brand#12"))
_facet_query("facet_in", "p_size IN (4, 8)", size=M.Facet("in", [4, 8]))
_facet_query("facet_range", "p_size BETWEEN 20 AND 22", size=M.Facet("range", (20, 22)))
_facet_query("facet_contains", "contains(lower(p_type), 'omo')", type=M.Facet("contains", "OMO"))
_facet_query("facet_prefix", "starts_with(lower(p_type), 'promo')", type=M.Facet("prefix", "Promo"))
_facet_query("facet_exists", "p_type IS NOT NULL", type=M.Facet("exists"))
_facet_query("facet_nested", "(p_size < 3 OR p_size > 48) AND NOT p_brand = 'Brand#11'", size=M.Facet("or", parts=[M.Facet("range", (None, 2)), M.Facet("range", (49, None))]), brand=M.Facet("not", parts=[M.Facet("equals", "Brand#11")]))

_COUNTS = """WITH f AS (SELECT 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'size', p_size::VARCHAR FROM part),
c AS (SELECT field, value, count(*) AS count, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS r FROM f GROUP BY 1, 2)
SELECT field, value, count, sum(count) OVER (PARTITION BY field)::BIGINT AS total FROM c WHERE r <= 10"""


@query("facet_counts", _COUNTS)
def _facet_counts(spark, d):
    return A.facet_counts(table(spark, d, "part"), {"brand": F.col("p_brand"), "size": F.col("p_size")})


@query("facet_search", f"SELECT e.vec_id AS id, round({E_COS}, 6) AS score FROM {ONE} WHERE e.label IN (1, 2) ORDER BY {E_COS} DESC, e.vec_id LIMIT 5")
def _facet_search(spark, d):
    where = M.facets_filter({"label": M.Facet("in", [1, 2])}, lambda k: F.col(k).cast("string"))
    return S.top_k(vectors_of(spark, d), query_vector(spark, d), 5, where=where).select("id", F.round("score", 6).alias("score"))


@query("agg_count", "SELECT count(*) AS count FROM part WHERE p_brand = 'Brand#12'")
def _count(spark, d):
    return A.aggregate(table(spark, d, "part"), "count", filters=[(F.col("p_brand"), "Brand#12")])


for _kind in ("sum", "avg", "min", "max"):

    @query(f"agg_{_kind}", f"SELECT count(*) AS count, round({_kind}(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'")
    def _agg(spark, d, kind=_kind):
        found = A.aggregate(table(spark, d, "orders"), kind, F.col("o_totalprice"), filters=[(F.col("o_orderstatus"), "F")])
        return found.withColumn("value", F.round("value", 2))


@query("agg_group_by", "SELECT p_brand AS brand, p_size AS size, count(*) AS count FROM part GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25")
def _group_by(spark, d):
    return A.aggregate(table(spark, d, "part"), "count", by={"brand": F.col("p_brand"), "size": F.col("p_size")}, limit=25)


@query("agg_group_sum", "SELECT event_type, count(*) AS count, sum(json_extract_string(props, '$.k')::DOUBLE) AS value FROM events GROUP BY 1")
def _group_sum(spark, d):
    return A.aggregate(table(spark, d, "events"), "sum", A.json_value("props")("k"), by={"event_type": F.col("event_type")})


@query("agg_having", "SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS count, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2 HAVING o_orderstatus = 'O'")
def _having(spark, d):
    found = A.aggregate(table(spark, d, "orders"), "avg", F.col("o_totalprice"), {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}, having={"status": "O"})
    return found.withColumn("value", F.round("value", 2))


@query("document_info", "SELECT user_id AS doc_id, count(*) AS count, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def _document_info(spark, d):
    return A.document_info(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("created_at")))


@query("collection_stats", "SELECT label, count(*) AS count, sum(4 + 4 * len(embedding))::BIGINT AS bytes FROM embeddings GROUP BY 1")
def _collection_stats(spark, d):
    size = 4 + 4 * F.size("vector").cast("bigint")
    return vectors_of(spark, d).groupBy("label").agg(F.count("*").alias("count"), F.sum(size).alias("bytes"))


@query("store_stats", "SELECT count(*) AS count, sum(4 + 4 * len(embedding))::BIGINT AS bytes, NULL::TIMESTAMP AS last FROM embeddings")
def _store_stats(spark, d):
    return A.collection_stats(vectors_of(spark, d))


@query("list_documents", "SELECT DISTINCT user_id AS doc_id FROM events ORDER BY 1")
def _list_documents(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id")).distinct().orderBy("doc_id")


@query("dimension_analysis", "SELECT count(*) AS total, count(DISTINCT len(embedding)) AS sizes, mode(len(embedding))::BIGINT AS primary_dim, false AS needs_migration FROM embeddings")
def _dimensions(spark, d):
    return A.dimension_analysis(vectors_of(spark, d))
