import pytest
from pyspark.sql import functions as F

from lattica.functions import geo as P
from lattica.operators import graph as G


def graph(spark, names, pairs, weight=1.0):
    nodes = spark.createDataFrame([(n, "t") for n in names], "id string, node_type string")
    edges = spark.createDataFrame([(f"{a}{b}", a, b, "e", float(weight)) for a, b in pairs], "id string, src string, dst string, edge_type string, weight double")
    return nodes, edges


def test_pagerank(spark):
    pairs = [("hub", "node1"), ("hub", "node2"), ("hub", "node3"), ("node1", "auth"), ("node2", "auth"), ("node3", "auth"), ("node1", "node2")]
    nodes, edges = graph(spark, ["hub", "auth", "node1", "node2", "node3", "alone"], pairs)
    got = {r["id"]: r["score"] for r in G.pagerank(nodes, edges, 30).collect()}
    assert len(got) == 6 and max(got, key=got.get) == "auth"
    assert got["hub"] == got["alone"] == pytest.approx(0.15 / 6)
    assert got["node1"] == pytest.approx(0.15 / 6 + 0.85 * got["hub"] / 3)
    assert G.pagerank(nodes.limit(0), edges).count() == 0


def test_communities_and_components(spark):
    triangles = [(a, b) for group in ("ABC", "DEF") for a in group for b in group if a != b]
    nodes, edges = graph(spark, "ABCDEF", triangles)
    bridge = spark.createDataFrame([("cd", "C", "D", "e", 0.1)], edges.schema)
    got = {r["id"]: r["community"] for r in G.communities(nodes, edges.unionByName(bridge), 20).collect()}
    assert len({got[x] for x in "ABC"}) == 1 and len({got[x] for x in "DEF"}) == 1 and got["A"] != got["D"]
    assert {r["component"] for r in G.components(nodes, edges).collect()} == {"A", "D"}


def test_paths(spark):
    nodes, edges = graph(spark, "abcde", [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e")], 2)
    row = G.shortest_path(edges, "a", "e").first()
    assert row["path"] == ["a", "b", "c", "e"] and row["hops"] == 3 and row["weight"] == 6.0
    assert G.shortest_path(edges, "e", "a").count() == 0 and G.shortest_path(edges, "a", "a").first()["hops"] == 0
    assert G.is_connected(edges, "e", "a", 3).first()[0] and not G.is_connected(edges, "e", "a", 1).first()[0]
    assert {r["id"]: r["depth"] for r in G.neighbors(nodes, edges, "a", 2, "out").collect()} == {"b": 1, "d": 1, "c": 2}
    assert {r["id"] for r in G.subgraph(nodes, edges, nodes.where("id IN ('a', 'b', 'c')"))[1].collect()} == {"ab", "bc"}


CITIES = {"sf": (37.7749, -122.4194), "oakland": (37.8044, -122.2712), "berkeley": (37.8716, -122.2727), "sanjose": (37.3382, -121.8863), "sacramento": (38.5816, -121.4944), "la": (34.0522, -118.2437)}


@pytest.mark.parametrize("radius, unit, n", [(20, "km", 3), (12, "miles", 3), (15000, "meters", 2)])
def test_radius(spark, radius, unit, n):
    points = spark.createDataFrame([(k, *v) for k, v in CITIES.items()], "id string, lat double, lng double")
    got = P.radius_search(points, *CITIES["sf"], radius, unit).collect()
    assert len(got) == n and got[0]["id"] == "sf"


def test_box_polygon_and_bad_input(spark):
    points = spark.createDataFrame([(k, *v) for k, v in CITIES.items()], "id string, lat double, lng double")
    assert P.in_box(points, 34, -119, 35, -118).first()["id"] == "la"
    assert {r["id"] for r in P.in_polygon(points, [(37, -123), (37, -122), (38.5, -122), (38.5, -123)]).collect()} == {"sf", "oakland", "berkeley"}
    for bad in (lambda: P.in_box(points, 1, 1, 0, 0), lambda: P.in_polygon(points, [(0, 0), (1, 1)]), lambda: P.radius_search(points, 91, 0, 1)):
        with pytest.raises(ValueError):
            bad()
    assert points.where(P.is_valid(F.col("lat"), F.col("lng"))).count() == 6
