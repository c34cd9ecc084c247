"""Stored indexes, the keyword grammar, tiles of many queries and incremental tables, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import indexes as I
from lattica.operators import keyword as K
from lattica.operators import search as S
from lattica.sources import formats as Fo
from lattica.streaming.streams import IncrementalTable


def vectors(spark, n=600, dim=24, seed=3):
    data = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return data, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, vector array<float>")


def nearest(data, i, k, gone=()):
    gaps = np.linalg.norm(data.astype(np.float64) - data[i].astype(np.float64), axis=1)
    return [j for j in np.argsort(gaps, kind="stable") if j not in gone][:k]


def recall(found, data, k=10, gone=()):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    return np.mean([len(ids & set(nearest(data, q, k, gone))) / k for q, ids in got.items()])


def test_graph_index(spark, tmp_path):
    data, rows = vectors(spark)
    index = I.GraphIndex(spark, str(tmp_path / "graph"))
    index.set_centroids(np.zeros((1, 24)))
    index.build(rows.where("id % 3 <> 0")).add(rows.where("id % 3 = 0"))
    asked = rows.where("id % 20 = 0")
    assert recall(index.search_many(asked, 10, 1, 100), data) >= 0.9
    index.delete(rows.where("id % 7 = 1"))
    again = I.GraphIndex(spark, index.path)  # opened from its folder
    gone = set(range(1, 600, 7))
    found = again.search_many(asked, 10, 1, 100)
    assert not gone & {r["id"] for r in found.collect()} and recall(found, data, 10, gone) >= 0.85
    whole = again.compacted(str(tmp_path / "whole"))
    assert whole.stats().first()["nodes"] == 600 - len(gone) and recall(whole.search_many(asked, 10, 1, 100), data, 10, gone) >= 0.9
    assert [r["id"] for r in whole.search(data[20].tolist(), 1).collect()] == [20]


def test_graph_stats_count_cells_not_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SHARD", 40)
    _, rows = vectors(spark, 120, 4)
    index = I.GraphIndex(spark, str(tmp_path / "graph"))
    index.set_centroids(np.zeros((1, 4)))
    index.build(rows.where("id < 100")).add(rows.where("id >= 100"))
    assert index.shards().count() > 2 and tuple(index.stats().first()) == (1, 120, 120)


def test_ivf_index(spark, tmp_path):
    data, rows = vectors(spark)
    index = I.IvfIndex(spark, str(tmp_path / "ivf"))
    index.train(rows, 8)
    index.add(rows.where("id < 300")).add(rows.where("id >= 300"))
    asked = rows.where("id % 20 = 0")
    assert recall(index.search_many(asked, 10, 8), data) == 1.0
    assert recall(index.search_many(asked, 10, 7), data) >= 0.9
    index.delete(rows.where("id = 20"))
    assert 20 not in {r["id"] for r in I.IvfIndex(spark, index.path).search(data[20].tolist(), 10, 8).collect()}
    plan = index.rows().where(F.col("centroid").isin(1, 2))._jdf.queryExecution().toString()
    assert "PartitionFilters: [centroid" in plan.replace("isnotnull(centroid#", "centroid#")


def test_cells_are_searched_by_matrix_products(spark, tmp_path, monkeypatch):
    """No join of single rows with queries; one broadcast and tiles answer like brute force within the cells, copies by id."""
    from lattica.operators import ann as A

    data, rows = vectors(spark, 300, 6)
    copies = spark.createDataFrame([(1000 + i, data[i % 3].tolist()) for i in range(90)], "id bigint, vector array<float>")
    rows = rows.unionByName(copies)
    known = np.array([r["vector"] for r in rows.orderBy("id").collect()], np.float64)
    ids = [*range(300), *range(1000, 1090)]
    centroids = np.random.default_rng(1).standard_normal((5, 6))
    cell = (((known[:, None] - centroids[None]) ** 2).sum(-1)).argmin(1)
    index = I.IvfIndex(spark, str(tmp_path / "ivf"))
    index.set_centroids(centroids)
    index.add(rows)
    for name, size in (("QUERY_TILE", 11), ("ROW_TILE", 30), ("NEAR_CELLS", 500)):
        monkeypatch.setattr(A, name, size)
    asked = rows.where("id % 4 = 0 and id < 1010")
    want = []
    for q in (i for i in ids if i % 4 == 0 and i < 1010):
        x = known[ids.index(q)]
        probed = np.argsort(((centroids - x) ** 2).sum(1), kind="stable")[:3]
        near = sorted((round(float(np.linalg.norm(v - x)), 9), i) for i, v, c in zip(ids, known, cell) if c in probed)[:7]
        want += [(q, i, d, rank) for rank, (d, i) in enumerate(near, 1)]
    for limit in (1000, 5):
        found = A.ivf_search_many(index.rows(), centroids, asked, 7, 3, query_limit=limit)
        assert sorted((r["query_id"], r["id"], round(r["distance"], 9), r["rank"]) for r in found.collect()) == sorted(want)
    for found in (A.ivf_search_many(index.rows(), centroids, asked, 7, 3), index.search_many(asked, 7, 3)):
        plan = found._jdf.queryExecution().toString()
        assert "Join" not in plan and "MapInArrow" in plan


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["ann_ivf_kmeans", "ann_ivf_stored", "ann_hnsw", "ann_hnsw_ivf", "ann_lsh"])
def test_registered_indexes_recall(spark, name):
    from lattica import catalog

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    data = np.array([r["embedding"] for r in rows])
    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert found.select("query_id").distinct().count() == len([r for r in rows if r["vec_id"] % 20 == 0]) and recall(found, data) >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_tiles_answer_like_one_broadcast(spark, metric, monkeypatch):
    data, rows = vectors(spark, 90, 6)
    rows = rows.unionByName(spark.createDataFrame([(1000, [1.0, 2.0]), (1001, None)], "id bigint, vector array<float>"))
    asked = rows.where("id < 90")
    monkeypatch.setattr(S, "QUERY_TILE", 25)
    monkeypatch.setattr(S, "ROW_TILE", 40)
    for options in ({"k": 7}, {"k": 7, "exclude_self": True}, {"radius": 1.0}):
        one, tiles = (sorted((r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in S.batch_knn(asked, rows, metric=metric, query_limit=n, **options).collect()) for n in (1000, 10))
        assert one and one == tiles


def test_keyword_index(spark, tmp_path):
    random.seed(4)
    words = ["alpha", "beta", "betas", "gamma", "delta", "eps"]
    docs = [(i, [random.choice(words) for _ in range(random.randrange(0, 9))]) for i in range(80)] + [(80, None)]
    index = K.KeywordIndex(spark, str(tmp_path / "index"))
    df = spark.createDataFrame(docs, "id bigint, tokens array<string>")
    index.add(df.where("id < 40")).add(df.where("id >= 40"))
    known = {i: t or [] for i, t in docs}
    has = lambda w: lambda t: w in t
    row = lambda *ws: lambda t: any(tuple(t[k : k + len(ws)]) == ws for k in range(len(t)))
    cases = {
        "alpha": has("alpha"), "alpha beta": lambda t: "alpha" in t and "beta" in t, "alpha OR gamma AND delta": lambda t: "alpha" in t or ("gamma" in t and "delta" in t),
        "(alpha OR gamma) delta": lambda t: ("alpha" in t or "gamma" in t) and "delta" in t, "alpha NOT beta": lambda t: "alpha" in t and "beta" not in t,
        "bet*": lambda t: any(w.startswith("bet") for w in t), '"alpha beta"': row("alpha", "beta"), '"alpha alpha gamma" OR eps': lambda t: row("alpha", "alpha", "gamma")(t) or "eps" in t,
        "missing": lambda t: False, "": lambda t: False,
    }
    for text, want in cases.items():
        found = {r["id"]: r["score"] for r in index.search(text).collect()}
        assert set(found) == {i for i, t in known.items() if want(t)}, text
        assert all(s > 0 for s in found.values())
    for text in ("(alpha", "alpha OR", '"', "alpha )", "NOT"):
        with pytest.raises(ValueError):
            K.parse(text)
    before = {r["id"]: r["score"] for r in index.search(K.any_of(["alpha", "eps"])).collect()}
    again = K.KeywordIndex(spark, index.path)
    again.delete(df.where("id % 2 = 0"))
    kept = K.KeywordIndex(spark, str(tmp_path / "other")).add(df.where("id % 2 = 1 "))
    # An index after deletions scores like one that never had the documents, but for those without any token.
    lost = sum(1 for i, t in known.items() if i % 2 == 0 and not t)
    scores = [{r["id"]: r["score"] for r in x.search(K.any_of(["alpha", "eps"])).collect()} for x in (again, again.compacted(str(tmp_path / "small")), kept)]
    assert scores[0] == scores[1] and set(scores[0]) == set(scores[2]) < set(before)
    assert again.sizes().first()["n_docs"] == kept.sizes().first()["n_docs"] + lost


def test_incremental_table_keeps_the_greatest_version(spark, tmp_path):
    path = str(tmp_path / "table")
    store = IncrementalTable(spark, path, parts=4)
    rows = [(k, v, f"{k}-{v}") for k in range(40) for v in (1, 2, 3)]
    random.Random(1).shuffle(rows)
    frame = lambda part: spark.createDataFrame(part, "id bigint, version bigint, text string")
    store.merge(frame([r for r in rows if r[1] == 2]), 0)
    store.merge(frame([r for r in rows if r[1] == 3 and r[0] < 10] + [(100, 1, "100-1")]), 1)
    late = frame([r for r in rows if r[1] == 1])
    store.merge(late, 2)
    store.merge(late, 2)  # sent again
    want = {k: 3 if k < 10 else 2 for k in range(40)} | {100: 1}
    for table in (store, IncrementalTable(spark, path, parts=4)):
        got = table.read().collect()
        assert {r["id"]: r["version"] for r in got} == want and len(got) == 41 and all(r["text"] == f"{r['id']}-{r['version']}" for r in got)
    assert {r["id"]: r["version"] for r in store.with_pending(frame([(5, 9, "5-9"), (6, 0, "6-0")])).collect()} == want | {5: 9}


@pytest.mark.parametrize("kind", ["graphml", "json"])
def test_graph_files_keep_vectors_and_properties(spark, kind):
    nodes = spark.createDataFrame([("a", "x < y", "t", [1.0, 2.5], {"k": 'v"&'}), ("b", None, "t", None, None)], "id string, content string, node_type string, vector array<float>, properties map<string,string>")
    edges = spark.createDataFrame([("e", "a", "b", "to", 0.5, {"p": "q"})], "id string, src string, dst string, edge_type string, weight double, properties map<string,string>")
    n, e = Fo.import_graph(spark, Fo.export_graph(nodes, edges, kind))
    got = {r["id"]: r for r in n.collect()}
    assert got["a"]["vector"] == [1.0, 2.5] and got["a"]["properties"] == {"k": 'v"&'} and got["b"]["vector"] is None
    assert e.first()["properties"] == {"p": "q"}


def test_product_codes_with_rescoring(spark):
    """Product codes name candidates, exact distances order them: recall of 0.9 at least."""
    from lattica.functions import vectors as V
    from lattica.operators.ann import ProductQuantizer

    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16)) * 2
    data = (centres[rng.integers(0, 20, 500)] + rng.standard_normal((500, 16)) * 0.6).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, vector array<float>")
    quantizer = ProductQuantizer.train(rows, 8, 16)
    coded = quantizer.encode(rows).cache()
    hits = 0
    for q in range(0, 500, 100):
        near = quantizer.search(coded, data[q].tolist(), 60, squared=True)
        best = near.withColumn("exact", V.distance(F.col("vector"), data[q].tolist())).orderBy("exact", "id").limit(10)
        hits += len({r["id"] for r in best.collect()} & set(nearest(data, q, 10)))
    assert hits / 50 >= 0.9
    stored = {(m, c): v for m, c, v in quantizer.rows()}
    books = np.array([[stored[m, c] for c in range(16)] for m in range(8)])
    assert ProductQuantizer(books).decode(coded.where("id = 3").first()["code"]) == quantizer.decode(coded.where("id = 3").first()["code"])


def test_random_projections_keep_neighbours(spark):
    """Texts of equal words have equal hashed vectors; a row's nearest by hashed signs is itself."""
    from lattica.operators.ann import Lsh

    data, rows = vectors(spark, 200, 16)
    lsh = Lsh(16, 6, 6)
    index = lsh.index(rows)
    assert index.count() == 1200 and index.groupBy("id").count().where("count <> 6").count() == 0
    found = lsh.search(index, rows.where("id % 20 = 0"), 5)
    assert recall(found, data, 5) == 1.0


@pytest.mark.parametrize("k", [1, 4, 12])
def test_determinantal_choice_against_plain_steps(k):
    """Every step takes the candidate of greatest K_ii less the sum of K_ij^2 / K_jj over the chosen ones, worked out anew."""
    from lattica.operators import rank as R

    rng = np.random.default_rng(k)
    data, scores = rng.standard_normal((12, 5)), rng.random(12) + 0.1
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    kernel = lambda i, j: scores[i] if i == j else float(unit[i] @ unit[j]) * np.sqrt(scores[i] * scores[j])
    chosen: list[int] = []
    while len(chosen) < k:
        gains = {i: kernel(i, i) - sum(kernel(i, j) ** 2 / kernel(j, j) for j in chosen) for i in range(12) if i not in chosen}
        best = max(gains, key=lambda i: (gains[i], -i))
        if gains[best] <= 0:
            break
        chosen.append(best)
    assert R.determinantal(scores, data, k) == (chosen if k < 12 else list(range(12)))
