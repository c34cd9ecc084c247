import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import vectors as V
from lattica.operators import rank as R
from lattica.operators import search as S


def rows(spark, data, schema="id string, vector array<float>"):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("a, b, cosine, dot", [([1, 0, 0], [1, 0, 0], 1, 1), ([1, 0], [0, 1], 0, 0), ([1, 0], [-1, 0], -1, -1), ([1, 0], [1, 0, 0], 0, 0), ([0, 0], [1, 0], 0, 0)])
def test_similarities(spark, a, b, cosine, dot):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    got = df.select(V.cosine(F.col("a"), F.col("b")), V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), [float(x) for x in b]), V.dot(F.col("a"), [float(x) for x in b])).first()
    assert list(got) == pytest.approx([cosine, dot, cosine, dot], abs=1e-6)


def test_mismatched_distance_is_infinite(spark):
    df = spark.createDataFrame([([1.0],)], "a array<float>")
    assert df.select(V.negative_distance(F.col("a"), [1.0, 2.0])).first()[0] == float("-inf")


POINTS = {"origin": (0, 0, 0), "p1": (1, 0, 0), "p2": (0, 1, 0), "p3": (0, 0, 1), "p4": (1, 1, 0), "p5": (1, 0, 1), "p6": (0, 1, 1), "p7": (1, 1, 1), "far": (3, 3, 3)}


@pytest.mark.parametrize("radius, n", [(1.0, 4), (1.5, 7), (10, 9)])
def test_range_search(spark, radius, n):
    df = rows(spark, [(k, [float(x) for x in v]) for k, v in POINTS.items()])
    got = S.range_search(df, [0.0, 0.0, 0.0], radius).collect()
    assert len(got) == n and got[0]["id"] == "origin" and [r["distance"] for r in got] == sorted(r["distance"] for r in got)


def test_range_needs_radius(spark):
    with pytest.raises(ValueError):
        S.range_search(rows(spark, [("a", [1.0])]), [1.0], 0)


def test_acl(spark):
    df = spark.createDataFrame([("public", None), ("alice", ["user:alice"]), ("admin", ["group:admin"])], "id string, acl array<string>")
    seen = lambda *p: {r["id"] for r in df.where(S.acl_filter(p)).collect()}
    assert seen() == {"public"} and seen("user:alice") == {"public", "alice"} and seen("group:admin") == {"public", "admin"} and seen("user:bob") == {"public"}


def test_batch_knn_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0]), (901, None)], "id bigint, vector array<float>").repartition(5)
    got = S.batch_knn(df.where("id < 20"), df, 5).collect()
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    order = np.argsort(-(n[:20] @ n.T), axis=1, kind="stable")[:, :5]
    assert {(r["query_id"], r["rank"]): r["id"] for r in got} == {(q, k + 1): int(order[q, k]) for q in range(20) for k in range(5)}


def test_hybrid_rrf_top_is_in_both_legs(spark):
    v = spark.createDataFrame([("1", 1.0), ("2", 0.1), ("3", 0.0)], "id string, score double")
    t = spark.createDataFrame([("1", 3.0), ("3", 2.0)], "id string, score double")
    got = S.hybrid(v, t, 3).collect()
    assert got[0]["id"] == "1" and got[0]["score"] == pytest.approx(2 / 61)


def test_greedy_selections():
    rng = np.random.default_rng(2)
    v, s = rng.standard_normal((30, 4)), np.sort(rng.random(30))[::-1]
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    chosen = [0]
    while len(chosen) < 8:
        left = [i for i in range(30) if i not in chosen]
        chosen.append(max(left, key=lambda i: 0.5 * s[i] - 0.5 * max(0, max(n[i] @ n[j] for j in chosen))))
    assert R.mmr(s, v, 8, 0.5) == chosen
    far = R.spread(s, v, 30, 0.3)
    assert all(1 - n[a] @ n[b] >= 0.3 - 1e-12 for a in far for b in far if a != b) and far[0] == 0
    assert R.determinantal(s, v, 5)[0] == 0 and len(set(R.determinantal(s, v, 5))) <= 5


def test_packing_skips_what_is_too_long():
    assert R.pack([10, 50, 10, 10], ["a", "a", "a", "b"], 10, 35, 2) == [0, 2, 3]
    assert R.pack([100], ["a"], 3, 10, 1) == [0] and R.pack([], [], 3, 10, 1) == []


def test_adapt(spark):
    df = spark.createDataFrame([([3.0, -4.0, 1.0],)], "v array<float>")
    got = df.select(V.adapt(F.col("v"), 2, "truncate"), V.adapt(F.col("v"), 4, "pad"), V.truncate_by_importance(F.col("v"), 2), V.adapt(F.col("v"), 5)).first()
    assert got[0] == pytest.approx([0.6, -0.8]) and got[2] == pytest.approx([0.6, -0.8]) and len(got[1]) == 4 and got[1][3] == 0 and len(got[3]) == 5


def test_hashed_vectors_of_many_texts():
    import numpy as np

    from lattica.functions import text as T

    texts = ["Thing of, thing (of) it", None, "", " .,; ", "Äpfel äpfel x" * 3]
    assert (T.hashed_many(texts, 16) == np.stack([T.hashed_vector(t, 16) for t in texts])).all()
    assert T.hashed_many([], 16).shape == (0, 16)


def test_title_entities_of_whole_texts(spark):
    """Runs of capitalised words, letters beyond ASCII included in what bounds a word."""
    import re

    from lattica.functions import text as T

    texts = ["Große Straße in Zürich Mitte", "Alpha Beta2 and Alpha  Beta2", "naïve Élan Xavier", "", None, "A B Cd\nEf g", "«Paris» (Lyon) Nice_1 x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: r["x"] for r in rows.select("id", T.title_entities(F.col("text")).alias("x")).collect()}
    assert got == {i: list(dict.fromkeys(re.findall(r"\b([A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)*)\b", t or ""))) for i, t in enumerate(texts)}
