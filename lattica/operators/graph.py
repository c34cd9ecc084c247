"""Property graph: traversal and algorithms over ``nodes(id, ...)`` and ``edges(id, src, dst, edge_type, weight)``.

Traversals move a frontier of all sources together, one join per hop, without a node twice. Sums and minima are
pre-aggregated before every shuffle, so a hub costs a row per task; joins at a hub are split by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut

CUT_EVERY = 3


def clean_edges(edges: DataFrame) -> DataFrame:
    """Weight 0 or null counts as 1."""
    weight = F.col("weight").cast("double")
    return edges.withColumn("weight", F.when(weight.isNull() | (weight == 0), 1.0).otherwise(weight))


def steps(edges: DataFrame, direction: str = "both", edge_types: Sequence[str] = ()) -> DataFrame:
    """``a, b, weight``: a step from a to b along an edge of the wanted types."""
    kept = edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else edges
    out = kept.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    back = kept.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight")
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise ValueError(f"unknown direction {direction}")


def reach(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both", edge_types: Sequence[str] = ()) -> DataFrame:
    """``source, node, depth`` of all nodes within ``depth`` hops of each of ``starts(source)``, the sources themselves at depth 0."""
    links = steps(edges, direction, edge_types).select("a", "b").where("a <> b").distinct()
    seen = starts.select("source", F.col("source").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        new = frontier.join(links, frontier["node"] == links["a"]).select("source", F.col("b").alias("node")).distinct()
        new = new.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(hop))
        if hop % CUT_EVERY == 0 or hop == depth:
            new = cut(new)
            if not new.limit(1).count():
                break
        seen, frontier = seen.unionByName(new), new
    return seen


def neighbors(nodes: DataFrame, edges: DataFrame, start: object, depth: int = 1, direction: str = "both", edge_types: Sequence[str] = (), node_types: Sequence[str] = (), limit: int = 0) -> DataFrame:
    """Nodes within ``depth`` hops by depth and id; node types are asked after the limit."""
    starts = nodes.where(F.col("id") == start).select(F.col("id").alias("source"))
    found = reach(edges, starts, depth, direction, edge_types).where("depth > 0").select(F.col("node").alias("id"), "depth").orderBy("depth", "id")
    found = nodes.join(found.limit(limit) if limit > 0 else found, "id")
    return found.where(F.col("node_type").isin(*node_types)) if node_types else found


def walks(edges: DataFrame, start: object, depth: int, goal: object | None = None, direction: str = "out") -> DataFrame:
    """``node, path, weight, product, depth``: the first-found path by hops to every node; of equally long ones that of the least path."""
    links = steps(edges, direction).where("a <> b").groupBy("a", "b").agg(F.max("weight").alias("w"))
    first = links.select(F.lit(start).cast(dict(links.dtypes)["a"]).alias("node")).limit(1)
    frontier = cut(first.select("node", F.array("node").alias("path"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("product"), F.lit(0).alias("depth")))
    seen = frontier
    for hop in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["a"]).select(
            F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"), (F.col("product") * F.col("w")).alias("product")
        )
        best = step.groupBy("node").agg(F.min_by(F.struct("path", "weight", "product"), "path").alias("x"))
        new = best.join(seen.select("node"), "node", "left_anti").select("node", "x.path", "x.weight", "x.product", F.lit(hop).alias("depth"))
        frontier = cut(new)
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
        if goal is not None and frontier.where(F.col("node") == goal).limit(1).count():
            break
    return seen


def shortest_path(edges: DataFrame, start: object, goal: object, max_depth: int = 100) -> DataFrame:
    """One row (path, hops, weight) for the path of fewest hops along out-edges, or none."""
    found = walks(edges, start, 0 if start == goal else max_depth, goal).where(F.col("node") == goal)
    return found.select("path", F.col("depth").alias("hops"), "weight")


def is_connected(edges: DataFrame, a: object, b: object, max_depth: int = 6) -> DataFrame:
    """One row: whether b is within ``max_depth`` hops of a, whatever the edges' direction."""
    starts = edges.sparkSession.range(1).select(F.lit(a).alias("source"))
    found = reach(edges, starts, max_depth).where(F.col("node") == b)
    return found.agg((F.count("*") > 0).alias("connected"))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``ids(id)`` and the edges with both ends among them."""
    kept = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inside.select(*edges.columns)


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """``id, score``: (1 - d) / N + d * sum of score / out-degree over in-edges; multiple edges count; nothing is spread from nodes without out-edges."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    links = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(degree, "src").select("src", "dst", (F.col("m") / F.col("degree")).alias("share")))
    ids = cut(nodes.select("id"))  # every iteration reads it
    scores = ids.withColumn("score", F.lit(1.0 / n))
    for i in range(1, iterations + 1):
        flow = links.join(scores, links["src"] == scores["id"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("flow"))
        after = ids.join(flow, ids["id"] == flow["dst"], "left").select("id", ((1 - damping) / n + damping * F.coalesce("flow", F.lit(0.0))).alias("score"))
        if i % CUT_EVERY == 0 or i == iterations:
            after = cut(after)
            change = after.join(scores.withColumnRenamed("score", "old"), "id").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
            if change < tolerance:
                return after
        scores = after
    return scores


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: least id reachable without regard to direction, by hooking and pointer jumping."""
    links = steps(edges).select("a", "b").where("a <> b").distinct()
    labels = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = links.join(labels, links["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        hooked = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = hooked.select(F.col("id").alias("root"), F.col("component").alias("to"))
        after = cut(hooked.join(jump, hooked["component"] == jump["root"]).select("id", F.least("component", "to").alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        labels = after
        if not changed:
            return labels


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``id, community``: a node moves to the community of greatest summed weight among its neighbours' and its own, ties to the least label.

    All nodes of one half (by hash, in turn) move together, so two neighbours can't swap labels for ever.
    """
    links = cut(steps(clean_edges(edges)).where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("w")))
    labels = cut(nodes.select("id", F.col("id").alias("community")))
    still = 0
    for i in range(2 * rounds):
        votes = links.join(labels, links["b"] == labels["id"]).groupBy(F.col("a"), F.col("community").alias("label")).agg(F.sum("w").alias("w"))
        ranked = votes.join(labels.withColumnRenamed("community", "own"), votes["a"] == labels["id"]).select("a", F.struct(F.col("w"), (F.col("label") == F.col("own")).alias("same"), "label").alias("v"))
        # Greatest weight, then the own label, then the least one.
        top = ranked.groupBy("a").agg(F.max(F.struct("v.w", "v.same")).alias("t"))
        choice = ranked.join(top, "a").where((F.col("v.w") == F.col("t.w")) & (F.col("v.same") == F.col("t.same"))).groupBy("a").agg(F.min("v.label").alias("new"))
        moved = labels.join(choice, labels["id"] == choice["a"], "left")
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        after = cut(moved.select("id", F.when(turn, F.coalesce("new", "community")).otherwise(F.col("community")).alias("community")))
        changed = after.join(labels.withColumnRenamed("community", "old"), "id").where("community <> old").limit(1).count()
        labels = after
        still = 0 if changed else still + 1
        if still == 2:
            break
    return labels


def common_neighbors(edges: DataFrame, node: object) -> DataFrame:
    """``id, common``: distinct neighbours shared with ``node``, for every other node that shares any."""
    links = steps(edges).select("a", "b").where("a <> b").distinct()
    own = links.where(F.col("a") == node).select(F.col("b").alias("mid"))
    return links.join(own, links["b"] == own["mid"]).where(F.col("a") != node).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("common"))


def predict_edges(nodes: DataFrame, edges: DataFrame, node: object, k: int = 10, least: float = 0.5) -> DataFrame:
    """``id, score`` of nodes that aren't neighbours: cosine, or its mean with common / (degree + 1) where neighbours are shared; above ``least``, k best."""
    home = nodes.where(F.col("id") == node).select("vector").first()
    links = steps(edges).select("a", "b").where("a <> b").distinct()
    own = links.where(F.col("a") == node).select(F.col("b").alias("id"))
    degree = own.count()
    others = nodes.where(F.col("id") != node).join(own, "id", "left_anti").join(common_neighbors(edges, node), "id", "left")
    similar = V.cosine(F.col("vector"), home["vector"])
    score = F.when(F.coalesce("common", F.lit(0)) > 0, (similar + F.col("common") / (degree + 1.0)) / 2).otherwise(similar)
    return others.select("id", score.alias("score")).where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(k)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree 2 E / N, density E / (N (N - 1)), connected components."""
    n, e = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("e"))
    parts = components(nodes, edges).agg(F.countDistinct("component").alias("components"))
    one = n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(parts))  # single rows
    degree = F.when(F.col("n") > 0, 2 * F.col("e") / F.col("n")).otherwise(0.0)
    density = F.when(F.col("n") > 1, F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return one.select(F.col("n").alias("nodes"), F.col("e").alias("edges"), degree.alias("average_degree"), density.alias("density"), "components")


def hybrid_search(nodes: DataFrame, edges: DataFrame, query: Sequence[float], start: object, k: int = 10, depth: int = 3, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), node_filter: Column | None = None) -> DataFrame:
    """``id, score``: similarity and 1 / (distance + 1) by weights that sum to 1; nodes beyond the k most similar also count the product of their path's edge weights."""
    total = sum(weights)
    wv, wg, we = (w / total for w in weights)
    kept = nodes if node_filter is None else nodes.where(node_filter)
    near = kept.select("id", V.cosine(F.col("vector"), query).alias("similar")).orderBy(F.desc("similar"), "id").limit(k)
    far = walks(clean_edges(edges), start, depth).select(F.col("node").alias("id"), "depth", "product").join(kept.select("id"), "id", "left_semi")
    both = near.join(far, "id", "full_outer")
    graph = F.coalesce(wg / (F.col("depth") + 1), F.lit(0.0))
    score = F.when(F.col("similar").isNotNull(), wv * F.col("similar") + graph).otherwise(graph + we * F.col("product"))
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def vector_search_nearby(nodes: DataFrame, edges: DataFrame, start: object, query: Sequence[float], depth: int = 1, direction: str = "both") -> DataFrame:
    """``id, score`` of the start and its neighbourhood, by cosine."""
    starts = nodes.where(F.col("id") == start).select(F.col("id").alias("source"))
    inside = reach(edges, starts, depth, direction).select(F.col("node").alias("id"))
    return nodes.join(inside, "id", "left_semi").select("id", V.cosine(F.col("vector"), query).alias("score")).orderBy(F.desc("score"), "id")


def similar_nodes(nodes: DataFrame, node: object, k: int = 10, threshold: float = 0.0) -> DataFrame:
    home = nodes.where(F.col("id") == node).select("vector").first()["vector"]
    found = nodes.where(F.col("id") != node).select("id", V.cosine(F.col("vector"), home).alias("score"))
    return (found.where(F.col("score") >= threshold) if threshold > 0 else found).orderBy(F.desc("score"), "id").limit(k)
