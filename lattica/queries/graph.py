"""Graph queries over regions, nations, customers, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import table
from . import query
from .vectors import E_COS, query_vector, vectors_of

NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS node_type FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation
UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier)"""
EDGES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 1.0 AS weight FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.5 FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.8 FROM nation)"""
BOTH = "l AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"


def graph_nodes(spark, d):
    out = None
    for name, key, letter in (("region", "r_regionkey", "r"), ("nation", "n_nationkey", "n"), ("customer", "c_custkey", "c"), ("supplier", "s_suppkey", "s")):
        part = table(spark, d, name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(name).alias("node_type"))
        out = part if out is None else out.unionByName(part)
    return out


def graph_edges(spark, d):
    out = None
    for name, a, la, b, lb, w in (("customer", "c_custkey", "c", "c_nationkey", "n", 1.0), ("supplier", "s_suppkey", "s", "s_nationkey", "n", 0.5), ("nation", "n_nationkey", "n", "n_regionkey", "r", 0.8)):
        src, dst = F.concat(F.lit(la), F.col(a).cast("string")), F.concat(F.lit(lb), F.col(b).cast("string"))
        part = table(spark, d, name).select(F.concat_ws("-", src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(f"of_{name}").alias("edge_type"), F.lit(w).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


_ONE_HOP = {"out": "SELECT dst AS id FROM edges WHERE src = 'n3'", "in": "SELECT src AS id FROM edges WHERE dst = 'n3'", "both": "SELECT b AS id FROM l WHERE a = 'n3'"}
for _direction, _sql in _ONE_HOP.items():

    @query(f"graph_neighbors_{_direction}", f"WITH {NODES}, {EDGES}, {BOTH} SELECT DISTINCT id, node_type, 1::INTEGER AS depth FROM nodes JOIN ({_sql}) USING (id)")
    def _neighbors(spark, d, direction=_direction):
        return G.neighbors(graph_nodes(spark, d), graph_edges(spark, d), "n3", direction=direction)


_HOPS = "w AS (SELECT 'c1' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN l ON a = id WHERE depth < {n})"


@query("graph_khop", f"WITH RECURSIVE {NODES}, {EDGES}, {BOTH}, {_HOPS.format(n=3)} SELECT w.id, node_type, min(depth)::INTEGER AS depth FROM w JOIN nodes ON nodes.id = w.id GROUP BY 1, 2 HAVING min(depth) > 0")
def _khop(spark, d):
    return G.neighbors(graph_nodes(spark, d), graph_edges(spark, d), "c1", 3)


@query("graph_khop_types", f"WITH RECURSIVE {NODES}, {EDGES}, {BOTH}, {_HOPS.format(n=2)} SELECT w.id, node_type, min(depth)::INTEGER AS depth FROM w JOIN nodes ON nodes.id = w.id WHERE node_type = 'supplier' GROUP BY 1, 2 HAVING min(depth) > 0")
def _khop_types(spark, d):
    return G.neighbors(graph_nodes(spark, d), graph_edges(spark, d), "c1", 2, node_types=["supplier"])


@query("graph_connected", f"WITH RECURSIVE {EDGES}, {BOTH}, {_HOPS.format(n=4)} SELECT count(*) > 0 AS connected FROM w WHERE id = 's1'")
def _connected(spark, d):
    return G.is_connected(graph_edges(spark, d), "c1", "s1", 4)


@query("graph_shortest_path", "SELECT 'c1|n' || c_nationkey || '|r' || n_regionkey AS path, 2::INTEGER AS hops, 1.8::DOUBLE AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1")
def _path(spark, d):
    edges = graph_edges(spark, d)
    region = table(spark, d, "customer").where("c_custkey = 1").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return G.shortest_path(edges, "c1", f"r{region}").withColumn("path", F.array_join("path", "|"))


@query("graph_subgraph", f"WITH {EDGES}, k AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'r1' UNION ALL SELECT 's' || s_suppkey FROM supplier) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def _subgraph(spark, d):
    nodes = graph_nodes(spark, d)
    inside = table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    ids = inside.unionByName(nodes.where("node_type = 'supplier' OR id = 'r1'").select("id"))
    return G.subgraph(nodes, graph_edges(spark, d), ids)[1].select("src", "dst")


@query("graph_stats", f"WITH {NODES}, {EDGES}, n AS (SELECT count(*) AS n FROM nodes), e AS (SELECT count(*) AS e FROM edges) SELECT n AS nodes, e AS edges, round(2 * e / n, 6) AS average_degree, round(e / (n * (n - 1)), 8) AS density, (SELECT count(*) FROM region) AS components FROM n, e")
def _stats(spark, d):
    return G.statistics(graph_nodes(spark, d), graph_edges(spark, d)).withColumns({"average_degree": F.round("average_degree", 6), "density": F.round("density", 8)})


@query("graph_components", f"""WITH {NODES}, {EDGES}, region_of AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS r FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT id, min(id) OVER (PARTITION BY r) AS component FROM region_of""")
def _components(spark, d):
    return G.components(graph_nodes(spark, d), graph_edges(spark, d))


def _supply(spark, d):
    """Parts to suppliers by line items, both ways, without repeated edges."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight"))
    p, s = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    edges = lines.select(p.alias("src"), s.alias("dst"), "weight").unionByName(lines.select(s.alias("src"), p.alias("dst"), "weight"))
    return edges.select(F.col("src").alias("id")).distinct(), edges


_PR = ["WITH lines AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem), e AS (SELECT p AS src, s AS dst FROM lines UNION ALL SELECT s, p FROM lines)",
       "g AS (SELECT src, count(*) AS n FROM e GROUP BY 1), m AS (SELECT count(*) AS n FROM g), r0 AS (SELECT src AS id, 1.0::DOUBLE / m.n AS s FROM g, m)"]
for _i in range(1, 6):
    _PR.append(f"r{_i} AS (SELECT dst AS id, 0.15 / any_value(m.n) + 0.85 * sum(s / g.n) AS s FROM e JOIN r{_i - 1} ON r{_i - 1}.id = e.src JOIN g ON g.src = e.src, m GROUP BY 1)")


@query("graph_pagerank", ", ".join(_PR) + " SELECT id, round(s, 9) AS score FROM r5")
def _pagerank(spark, d):
    nodes, edges = _supply(spark, d)
    return G.pagerank(nodes, edges, 5).withColumn("score", F.round("score", 9))


@query("graph_communities")
def _communities(spark, d):
    return G.communities(graph_nodes(spark, d), graph_edges(spark, d), 4)


@query("graph_common_neighbors", f"WITH {EDGES}, {BOTH} SELECT x.a AS id, count(*) AS common FROM l x JOIN l y ON x.b = y.b WHERE y.a = 's1' AND x.a <> 's1' GROUP BY 1")
def _common(spark, d):
    return G.common_neighbors(graph_edges(spark, d), "s1")


def _vector_graph(spark, d):
    """Vectors as nodes; an edge leads from each to the next two ids of its label's cycle: 1 on and 7 on."""
    nodes = vectors_of(spark, d).select("id", "vector", F.col("label").cast("string").alias("node_type"))
    n = nodes.count()
    edges = nodes.select("id", F.explode(F.array(F.lit(1), F.lit(7))).alias("k")).select(
        F.concat_ws("-", F.col("id").cast("string"), F.col("k").cast("string")).alias("id"), F.col("id").alias("src"), ((F.col("id") + F.col("k")) % n).alias("dst"), F.lit("next").alias("edge_type"), F.when(F.col("k") == 1, 0.9).otherwise(0.4).alias("weight")
    )
    return nodes, edges


_VE = "n AS (SELECT count(*) AS n FROM embeddings), ve AS (SELECT vec_id AS src, (vec_id + k) % n AS dst, CASE k WHEN 1 THEN 0.9 ELSE 0.4 END AS w FROM embeddings, n, (VALUES (1), (7)) t(k)), vl AS (SELECT src AS a, dst AS b FROM ve UNION SELECT dst, src FROM ve)"


@query("graph_link_prediction", f"""WITH {_VE}, own AS (SELECT b FROM vl WHERE a = 0), deg AS (SELECT count(*) AS g FROM own), cn AS (SELECT x.a AS id, count(*) AS c FROM vl x JOIN own USING (b) WHERE x.a <> 0 GROUP BY 1),
s AS (SELECT e.vec_id AS id, {E_COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0 AND e.vec_id NOT IN (SELECT b FROM own)),
f AS (SELECT s.id, CASE WHEN c > 0 THEN (s + c / (g + 1.0)) / 2 ELSE s END AS score FROM s LEFT JOIN cn USING (id), deg) SELECT id, round(score, 6) AS score FROM f WHERE score > 0.15 ORDER BY score DESC, id LIMIT 10""")
def _links(spark, d):
    nodes, edges = _vector_graph(spark, d)
    return G.predict_edges(nodes, edges, 0, least=0.15).withColumn("score", F.round("score", 6))


@query("graph_hybrid", f"""WITH RECURSIVE {_VE}, v AS (SELECT e.vec_id AS id, {E_COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id = 5 ORDER BY s DESC, id LIMIT 10),
w AS (SELECT 0::BIGINT AS id, [0::BIGINT] AS path, 1.0::DOUBLE AS p, 0 AS depth UNION ALL SELECT dst, list_append(path, dst), p * ve.w, depth + 1 FROM w JOIN ve ON src = w.id WHERE depth < 3),
g AS (SELECT id, depth, p FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, path) = 1),
f AS (SELECT coalesce(v.id, g.id) AS id, CASE WHEN s IS NOT NULL THEN 0.5 * s + coalesce(0.3 / (depth + 1), 0) ELSE 0.3 / (depth + 1) + 0.2 * p END AS score FROM v FULL JOIN g ON v.id = g.id)
SELECT id, round(score, 6) AS score FROM f ORDER BY score DESC, id LIMIT 10""")
def _hybrid(spark, d):
    nodes, edges = _vector_graph(spark, d)
    return G.hybrid_search(nodes, edges, query_vector(spark, d, 5), 0).withColumn("score", F.round("score", 6))


@query("graph_vector_nearby", f"WITH {_VE}, k AS (SELECT 0::BIGINT AS id UNION SELECT b FROM vl WHERE a = 0) SELECT e.vec_id AS id, round({E_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 5 AND e.vec_id IN (SELECT id FROM k)")
def _nearby(spark, d):
    nodes, edges = _vector_graph(spark, d)
    return G.vector_search_nearby(nodes, edges, 0, query_vector(spark, d, 5)).withColumn("score", F.round("score", 6))


@query("graph_similar_nodes", f"SELECT e.vec_id AS id, round({E_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0 ORDER BY {E_COS} DESC, e.vec_id LIMIT 10")
def _similar(spark, d):
    return G.similar_nodes(_vector_graph(spark, d)[0], 0).withColumn("score", F.round("score", 6))
