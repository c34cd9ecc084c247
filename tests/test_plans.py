import pytest
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import ann as A
from lattica.operators import store as St
from lattica.plans import memory as M
from lattica.plans import rag as R
from lattica.plans import routing as Ro
from lattica.plans.tools import Toolbox
from lattica.sources import formats as Fo


def test_codecs():
    assert Fo.decode_vector(Fo.encode_vector([1.0, -2.5])) == [1.0, -2.5] and Fo.decode_vector(Fo.encode_vector([])) == []
    assert A.unpack_bits(A.pack_bits([1, 5, 7, 0, 3], 3), 3, 5) == [1, 5, 7, 0, 3]
    assert T.fnv1a64(b"") == 0xCBF29CE484222325 and T.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_store_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, St.upsert(old, new).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, St.insert_missing(old, new).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert [r["id"] for r in St.delete_where(old, F.col("v") == "a").collect()] == [2]


DOCS = [("d1", "Alice works at Acme on GraphRAG research.\n\nAcme ships a beta release for research tools."), ("d2", "Nothing to see here."), ("d3", None)]


def test_rag(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    chunks, nodes, edges = R.ingest(docs, R.RagOptions(chunk_words=12))
    assert {r["id"] for r in chunks.collect()} == {"chunk:d1:000", "chunk:d1:001", "chunk:d2:000"}
    assert {"entity:acme", "doc:d1", "doc:d3"} <= {r["id"] for r in nodes.collect()}
    assert {r["edge_type"] for r in edges.collect()} == {"has_chunk", "next", "mentions"}
    box = Toolbox(chunks, nodes, edges)
    assert len(box.definitions()) == 20
    found = box.call("search_graphrag_lexical", {"query": "Where does Alice work?", "entity_names": ["Acme"]}).collect()
    assert {r["doc_id"] for r in found} == {"d1"} and found[0]["rank"] == 1
    assert [r["id"] for r in box.call("search_chunks_by_entities", {"entity_names": ["Acme", "Alice"]}).collect()][0] == "chunk:d1:000"
    assert "d1/chunk:d1" in box.call("build_context", {"query": "acme research"}).first()["context"]
    with pytest.raises(ValueError):
        box.call("nothing", {})


def test_memory(spark):
    rows = [("m1", "b", "Ann likes tea because of taste", ["Ann"], [1.0, 0.0]), ("m2", "b", "Ann drinks green tea daily", ["Ann"], [0.0, 1.0]), ("m3", "c", "green hills everywhere", ["Bob"], [1.0, 0.0])]
    m = spark.createDataFrame(rows, "id string, bank_id string, content string, entities array<string>, vector array<float>")
    assert [r["id"] for r in M.recall(m, "b", 5, [1.0, 0.0], ["green"]).collect()] == ["m2", "m1"]
    found = {(r["kind"], r["subject"]): r["confidence"] for r in M.observe(m, M.Bank("b", skepticism=5)).collect()}
    assert found[("preference", "Ann")] == found[("causal", "Ann")] == pytest.approx(0.16) and ("generalization", "green") in found
    assert M.bucket("", "u", "s") == "memory:session:s:default"
    with pytest.raises(ValueError):
        M.bucket("user")


def test_parameters():
    schema = Ro.FunctionSchema("weather").with_parameter("city", Ro.Parameter(required=True)).with_parameter("days", Ro.Parameter("int", pattern=r"(\d+) days", default=1)).with_parameter("unit", Ro.Parameter(enum=["celsius", "kelvin"]))
    assert Ro.extract_parameters("weather for city Paris, 3 days in Celsius", schema) == ({"city": "paris", "days": 3, "unit": "celsius"}, [])
    assert Ro.extract_parameters("hello", schema) == ({"days": 1}, ["city"])
    assert Ro.FunctionSchema.from_json(schema.to_json()).parameters["city"].required


def test_lsh_recall(spark):
    import numpy as np

    x = np.random.default_rng(42).random((600, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    lsh = A.Lsh(32, 12, 8)
    got = lsh.search(lsh.index(df), df.where("id % 20 = 0"), 10, flips=5).groupBy("query_id").agg(F.collect_set("id").alias("ids")).collect()
    exact = {q: set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:10].tolist()) for q in range(0, 600, 20)}
    assert np.mean([len(exact[r["query_id"]] & set(r["ids"])) / 10 for r in got]) >= 0.9


@pytest.mark.parametrize("name", ["ann_lsh", "ann_lsh_multiprobe"])
def test_registered_lsh_recall(spark, name):
    import numpy as np

    from lattica import catalog

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    ids = [r["vec_id"] for r in rows]
    exact = {i: {ids[j] for j in np.argsort(((x - x[n]) ** 2).sum(1), kind="stable")[:10]} for n, i in enumerate(ids) if i % 20 == 0}
    assert set(got) == set(exact) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(exact[i] & set(v)) / 10 for i, v in got.items()]) >= 0.9


@pytest.mark.parametrize("flips", [0, 3])
def test_lsh_is_exact(spark, flips):
    import numpy as np

    random = np.random.default_rng(7)
    # Tight groups, whose queries are answered by their buckets, and scattered rows, whose queries aren't.
    x = np.concatenate([c + 1e-3 * random.standard_normal((20, 8)) for c in random.standard_normal((10, 8))] + [random.standard_normal((40, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    lsh = A.Lsh(8, 6, 4)
    queries = df.where("id % 5 = 0")
    got = {}
    for r in lsh.search(lsh.index(df), queries, 10, flips).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    gaps = {i: np.sqrt(((x - x[i]) ** 2).sum(1)) for i in range(0, len(x), 5)}
    assert got == {i: np.argsort(d, kind="stable")[:10].tolist() for i, d in gaps.items()}
    sure = [lsh.reach(x[i : i + 1], flips)[0][0] > np.sort(d)[9] for i, d in gaps.items()]
    assert any(sure) and not all(sure)


@pytest.mark.parametrize("block", [4, 1000])
def test_best_sparse_route_without_rows_of_pairs(spark, block, monkeypatch):
    """Blocks of utterances answer like the join of all pairs that share a term."""
    import random

    draw = random.Random(block)
    words = ["alpha"] * 20 + ["beta"] * 5 + [f"word{i}" for i in range(30)]
    text = lambda: " ".join(draw.choice(words) for _ in range(draw.randrange(0, 12)))
    routes = spark.createDataFrame([(i, f"r{i % 3}", text()) for i in range(30)] + [(30, "r0", None)], "id bigint, name string, text string")
    queries = spark.createDataFrame([(i, text()) for i in range(40)] + [(40, None), (41, "unknown")], "id bigint, text string")
    monkeypatch.setattr(Ro, "ROUTE_BLOCK", block)
    found = Ro.best_sparse(queries, routes)
    assert "sum((wa" not in found._jdf.queryExecution().toString()
    want = Ro.sparse_scores(queries, routes)
    got = {r["query_id"]: r for r in Ro._best(found, 0.3).collect()}
    best: dict = {}
    for r in want.collect():
        best.setdefault(r["query_id"], {})[r["name"]] = r["score"]
    best = {q: names for q, names in best.items() if max(names.values()) > 0}
    assert best and set(got) == set(best)
    for q, names in best.items():
        assert got[q]["score"] == pytest.approx(max(names.values())) and names[got[q]["name"]] == pytest.approx(max(names.values()))
