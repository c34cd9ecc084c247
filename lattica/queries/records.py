"""Records: documents, sessions, messages, banks, observations, batches, search by text, rerankers, routers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import ann as A
from ..operators import rank as Ra
from ..operators import records as Rc
from ..operators import search as S
from ..operators import store as St
from ..plans import memory as M
from ..plans import routing as Ro
from ..session import table
from . import query
from .graph import graph_edges, graph_nodes
from .plans import memories, messages, observed_sql
from .text import KEYWORDS, SET, documents
from .vectors import E_COS, ONE, query_vector, vectors_of


def _events(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), F.col("ts").alias("created_at"), F.create_map(F.lit("type"), F.col("event_type")).alias("metadata"))


def _collections(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"), F.lit(0).alias("dimensions"), F.timestamp_seconds(F.col("r_regionkey") * 60).alias("created_at"))


@query("get_by_doc", "SELECT event_id AS id FROM events WHERE user_id = 3 ORDER BY ts, event_id")
def _by_doc(spark, d):
    return Rc.get_by_doc(_events(spark, d), 3).select("id")


@query("get_by_type", "SELECT event_id AS id FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def _by_type(spark, d):
    rows = _events(spark, d)
    return St.of_type(rows, rows.agg(F.min(F.element_at("metadata", "type"))).first()[0]).select("id")


@query("doc_ids", "SELECT DISTINCT user_id AS doc_id FROM events WHERE user_id IS NOT NULL")
def _doc_ids(spark, d):
    return Rc.document_ids(_events(spark, d))


@query("delete_by_doc", "SELECT event_id AS id FROM events WHERE user_id NOT IN (1, 2, 3)")
def _delete_doc(spark, d):
    return St.delete_by_doc(_events(spark, d), [1, 2, 3]).select("id")


@query("clear_docs", "SELECT event_id AS id FROM events WHERE user_id <> 4")
def _clear(spark, d):
    rows = _events(spark, d)
    return Rc.clear(rows, [4]).select("id").unionByName(Rc.clear(rows).select("id"))


@query("collections_create", "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region UNION ALL SELECT 5, 'ATLANTIS'")
def _create_collection(spark, d):
    return St.create_collection(_collections(spark, d), "ATLANTIS", 64).select("id", "name")


@query("collections_list", "SELECT r_name AS name FROM region ORDER BY r_regionkey DESC")
def _list_collections(spark, d):
    return Rc.list_collections(_collections(spark, d)).select("name")


@query("documents_save", """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS title, epoch_us(TIMESTAMP '2020-01-01') AS created,
CASE WHEN doc_id % 3 = 0 THEN epoch_us(TIMESTAMP '2024-01-01') ELSE epoch_us(TIMESTAMP '2020-01-01') END AS updated FROM documents UNION ALL SELECT -1, 'first', epoch_us(TIMESTAMP '2024-01-01'), epoch_us(TIMESTAMP '2024-01-01')""")
def _documents_save(spark, d):
    then, now = (F.to_timestamp(F.lit(f"{y}-01-01 00:00:00")) for y in (2020, 2024))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.array("source").alias("acl"))
    new = docs.where("id % 3 = 0").withColumn("title", F.lit("new")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("first").alias("title"), F.array(F.lit("x")).alias("acl")))
    saved = Rc.save_documents(docs.withColumn("created_at", then).withColumn("updated_at", then), new, now)
    return saved.select("id", "title", F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"))


@query("documents_list", "SELECT doc_id AS id FROM documents WHERE source = (SELECT min(source) FROM documents) ORDER BY doc_id DESC LIMIT 20")
def _documents_list(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("author"), F.timestamp_seconds("doc_id").alias("created_at"))
    return St.list_documents(docs, docs.agg(F.min("author")).first()[0], 20).select("id")


def _sessions(spark, d):
    return messages(spark, d).groupBy(F.col("session_id").alias("id")).agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")).withColumn("user_id", F.col("id") % 3)


@query("sessions_add", "SELECT conv_id AS id, conv_id % 3 AS user_id FROM conversations GROUP BY 1 UNION ALL SELECT -5, 1")
def _sessions_add(spark, d):
    sessions = _sessions(spark, d)
    extra = spark.range(1).select(F.lit(-5).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("created_at"), F.lit(0).cast("bigint").alias("updated_at"), F.lit(1).cast("bigint").alias("user_id"))
    return Rc.add_sessions(sessions, extra.unionByName(sessions.limit(1).withColumn("user_id", F.lit(99).cast("bigint")))).select("id", "user_id")


@query("messages_add", "WITH s AS (SELECT conv_id AS id, max(turn) AS last, count(*) AS n FROM conversations GROUP BY 1) SELECT id, n + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS messages, last + CASE WHEN id % 2 = 0 THEN 100 ELSE 0 END AS updated_at FROM s")
def _messages_add(spark, d):
    old, sessions = messages(spark, d), _sessions(spark, d)
    new = sessions.where("id % 2 = 0").select((-F.col("id") - 1).alias("id"), F.col("id").alias("session_id"), (F.col("updated_at") + 100).alias("created_at"), F.lit("user").alias("role"), F.lit("more").alias("content"))
    lost = new.limit(1).withColumn("session_id", F.lit(-77).cast("bigint"))  # of no session
    rows, touched = Rc.add_messages(old, sessions, new.unionByName(lost))
    counts = rows.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"))
    return touched.join(counts, "id").select("id", "messages", "updated_at")


@query("messages_sessions", "SELECT conv_id * 1000000 + turn AS id, conv_id % 3 AS user_id FROM conversations")
def _messages_sessions(spark, d):
    return Rc.messages_with_sessions(messages(spark, d), _sessions(spark, d)).select("id", "user_id")


@query("chat_semantic", f"SELECT id, round(s, 6) AS score FROM (SELECT e.vec_id AS id, {E_COS} AS s, e.vec_id % 5 AS session_id, e.vec_id % 2 AS user_id FROM {ONE}) WHERE user_id = 1 AND session_id <> 2 ORDER BY s DESC, id LIMIT 10")
def _chat_semantic(spark, d):
    rows = vectors_of(spark, d).withColumn("session_id", F.col("id") % 5).withColumn("user_id", F.col("id") % 2)
    return M.chat_search(rows, query_vector(spark, d), user=1, exclude=2).select("id", F.round("score", 6).alias("score"))


def _banks(spark):
    return spark.createDataFrame([("b0", "first", 4, 3, 3), ("b1", "second", 2, 3, 3)], "id string, name string, skepticism int, literalism int, empathy int")


@query("banks_save", "SELECT * FROM (VALUES ('b0', 'first', 4, 3, 3), ('b1', 'changed', 1, 3, 3), ('b2', 'third', 3, 5, 3)) t(id, name, skepticism, literalism, empathy)")
def _banks_save(spark, d):
    new = spark.createDataFrame([("b1", "changed", 1, None, None), ("b2", "third", None, 5, 3)], "id string, name string, skepticism int, literalism int, empathy int")
    return Rc.list_banks(Rc.save_banks(_banks(spark), new))


@query("banks_delete", "SELECT 'b1' AS bank, count(*) AS memories FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE label % 2 = 1")
def _banks_delete(spark, d):
    banks, kept = Rc.delete_bank(_banks(spark), memories(spark, d), "b0")
    return banks.select(F.col("id").alias("bank")).join(kept.groupBy(F.col("bank_id").alias("bank")).agg(F.count("*").alias("memories")), "bank")


@query("observations_store", f"SELECT kind || ': ' || subject AS content, confidence FROM ({observed_sql('e.label % 2 = 0')})")
def _observations(spark, d):
    """What is observed in a bank is stored in it, twice the same, and read back."""
    rows = memories(spark, d)
    found = M.observe(rows.where("bank_id = 'b0'"), M.Bank("b0", skepticism=4))
    stored = Rc.save_observations(Rc.save_observations(rows, found, "b0"), found, "b0")
    return Rc.observations(stored, "b0").where("id LIKE 'observation:%'").select("content", F.round("confidence", 6).alias("confidence"))


@query("memory_retain", "WITH m AS (SELECT d.lang, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) SELECT 'entity:' || lower(x) AS id FROM (SELECT lang AS x FROM m UNION SELECT source FROM m) WHERE x IS NOT NULL GROUP BY 1")
def _retain(spark, d):
    rows = memories(spark, d)
    nodes = spark.createDataFrame([("entity:fr", "entity", "known")], "id string, node_type string, content string")
    kept, nodes = Rc.retain(rows.where("bank_id = 'b1'"), rows, nodes)
    return nodes.select("id")


@query("memory_facts", "SELECT count(*) AS memories FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def _facts(spark, d):
    rows = memories(spark, d)
    facts = rows.unionByName(rows.withColumn("id", F.lit(None).cast("string"))).unionByName(rows.withColumn("id", F.concat("id", F.lit("x"))).withColumn("vector", F.array().cast("array<float>")))
    return M.extracted(rows.where("bank_id = 'b0'"), facts).agg(F.count("*").alias("memories"))


@query("graph_batch", """SELECT 'nodes' AS kind, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + 1 - 2 AS n, 28::BIGINT AS succeeded, 1::BIGINT AS failed
UNION ALL SELECT 'edges', (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (3, 4) ) + (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (3, 4)) + (SELECT count(*) FROM supplier WHERE s_nationkey NOT IN (3, 4)) + 23, 28, 1""")
def _graph_batch(spark, d):
    """25 edges to a new node, one node without an id, two nodes dropped with their edges."""
    nodes, edges = graph_nodes(spark, d), graph_edges(spark, d)
    new = spark.createDataFrame([("x1", "extra"), (None, "extra")], "id string, node_type string")
    ties = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"))
    ties = ties.select(F.concat("src", F.lit("-x1")).alias("id"), "src", F.lit("x1").alias("dst"), F.lit("extra").alias("edge_type"), F.lit(1.0).alias("weight"))
    gone = spark.createDataFrame([("n3",), ("n4",)], "id string")
    nodes, edges, counts = Rc.change_graph(nodes, edges, Rc.GraphChange(nodes=new, edges=ties, gone_nodes=gone))
    both = nodes.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n")).unionByName(edges.agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))
    return both.crossJoin(F.broadcast(counts))  # a single row


@query("graph_nodes_get", "SELECT id FROM (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region) WHERE id IN ('n1', 'r2', 'n7')")
def _graph_get(spark, d):
    return St.fetch(graph_nodes(spark, d), spark.createDataFrame([("n1",), ("r2",), ("n7",), ("zz",), ("n1",)], "id string")).select("id")


@query("vec_mean", "SELECT label, round(list_sum(list(m * i ORDER BY i)), 4) AS weighted FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, generate_series(1, 64) t(i) GROUP BY 1, 2) GROUP BY 1")
def _mean(spark, d):
    found = Rc.mean_vector(vectors_of(spark, d), ["label"])
    return found.select("label", F.round(F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("weighted"))


@query("store_info", "SELECT 'embeddings' AS name, 64 AS dimensions, 'cosine' AS similarity, count(*) AS vectors FROM embeddings")
def _info(spark, d):
    rows = vectors_of(spark, d)
    Rc.check_query(rows, query_vector(spark, d))
    return Rc.info(rows, "embeddings")


@query("vec_distances", f"SELECT e.vec_id AS id, round(1 - {E_COS}, 6) AS cosine, round(-list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot FROM {ONE}")
def _distances(spark, d):
    q = query_vector(spark, d)
    return vectors_of(spark, d).select("id", F.round(1 - V.cosine(F.col("vector"), q), 6).alias("cosine"), F.round(-V.dot(F.col("vector"), q), 6).alias("dot"))


@query("multivector_entities", "SELECT vec_id // 2 AS entity_id, count(*) AS fields, sum(len(embedding))::BIGINT AS numbers FROM embeddings WHERE vec_id // 2 % 3 <> 0 GROUP BY 1")
def _entities(spark, d):
    """Entities with a vector a field are written, some deleted, the others put together again."""
    rows = vectors_of(spark, d).select(F.expr("id div 2").alias("entity_id"), F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("field"), "vector")
    kept = St.delete_where(rows, F.col("entity_id") % 3 == 0)
    back = S.multi_vector_entities(S.multi_vector_rows(S.multi_vector_entities(kept)))
    return back.select("entity_id", F.size("vectors").cast("bigint").alias("fields"), F.aggregate(F.map_values("vectors"), F.lit(0).cast("bigint"), lambda a, v: a + F.size(v)).alias("numbers"))


@query("lsh_stats", "SELECT 10 * count(*) AS rows FROM embeddings WHERE vec_id % 3 <> 0")
def _lsh_stats(spark, d):
    index = St.delete_where(A.Lsh(64).index(vectors_of(spark, d)), F.col("id") % 3 == 0)
    return A.bucket_stats(index).select(F.round(F.col("buckets") * F.col("mean")).cast("bigint").alias("rows"))


@query("text_unique_sorted", f"SELECT doc_id AS id, len(x) AS n, md5(array_to_string(x, ' ')) AS digest FROM (SELECT doc_id, list_sort(list_distinct({KEYWORDS})) AS x FROM documents)")
def _unique(spark, d):
    found = documents(spark, d).select("id", T.unique_sorted(T.keywords(F.col("text"))).alias("x"))
    return found.select("id", F.size("x").cast("bigint").alias("n"), F.md5(F.array_join("x", " ")).alias("digest"))


@query("text_vocabulary", f"SELECT count(DISTINCT term) AS terms FROM (SELECT unnest({SET}) AS term FROM documents)")
def _vocabulary(spark, d):
    counts = T.term_counts(documents(spark, d).select("id", T.token_set(F.col("text")).alias("tokens")))
    return T.document_frequencies(counts).agg(F.count("*").alias("terms"))


def _hash_rows(spark, d):
    """Embeddings of the texts by feature hashing, cached by text."""
    empty = spark.createDataFrame([], "text string, vector array<float>")
    rows, _ = Rc.embed_cached(documents(spark, d).withColumnRenamed("text", "content"), empty, T.hashed_vectors(64))
    return rows


@query("text_search_embedded")
def _text_search(spark, d):
    """Texts are inserted through the embedder and searched by a text through the same."""
    embed = T.hashed_vectors(64)
    none = spark.createDataFrame([], "id bigint, content string, vector array<float>, collection string")
    texts = documents(spark, d).where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumnRenamed("text", "content")
    rows = Rc.insert_texts(none, texts, embed, "docs")
    found = S.top_k(rows, Rc.check_query(rows, Rc.embedded(rows, "thing hation ner", embed)), 10, where=F.col("collection") == "docs")
    return found.select("id", F.round("score", 6).alias("score"))


@query("text_hybrid_embedded")
def _hybrid_embedded(spark, d):
    from ..operators import keyword as K
    from .text import keyword_index

    rows = _hash_rows(spark, d).where("vector IS NOT NULL")
    asked = Rc.embedded(rows, "thing ner", T.hashed_vectors(64))
    return S.hybrid(S.scored(rows, asked), keyword_index(spark, d).search(K.any_of(["thing", "ner"])), 10).select("id", F.round("score", 6).alias("score"))


@query("quick_add", "SELECT count(*) + 3 AS n, count(DISTINCT vec_id) + 3 AS ids FROM embeddings")
def _quick_add(spark, d):
    rows = vectors_of(spark, d).select(F.col("id").cast("string").alias("id"), "vector", F.lit("").alias("content"))
    more = Rc.add_vectors(rows, rows.limit(3).drop("id"))
    return more.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("rerank_search", f"WITH c AS (SELECT e.vec_id AS id, e.label, {E_COS} AS s FROM {ONE} ORDER BY s DESC, id LIMIT 50) SELECT id, round(s * (1 + label), 6) AS score FROM c WHERE s * (1 + label) >= 0.2 ORDER BY s * (1 + label) DESC, id LIMIT 10")
def _rerank_search(spark, d):
    """A custom reranker: each candidate's score by a function of its content."""
    rows = vectors_of(spark, d).withColumn("content", F.col("label").cast("string"))
    reranker = Ra.by_score(lambda content, score: score * (1 + content.cast("int")))
    return Ra.search_reranked(rows, query_vector(spark, d), "", reranker, 10, 0.2).select("id", F.round("score", 6).alias("score"))


@query("routes_change", f"WITH s AS (SELECT q.vec_id AS query_id, 'r' || e.label AS name, greatest(max({E_COS}), 0) AS score FROM embeddings q, embeddings e WHERE e.vec_id % 20 = 0 AND e.label <> 3 GROUP BY 1, 2) SELECT query_id, arg_min(name, -score) AS name FROM s GROUP BY 1")
def _routes(spark, d):
    """Routes are added in two batches, one is removed."""
    rows = vectors_of(spark, d).where("id % 20 = 0").withColumn("name", F.concat(F.lit("r"), F.col("label").cast("string")))
    routes = Ro.remove_route(Ro.add_routes(rows.where("label < 5"), rows.where("label >= 4")), "r3")
    return Ro.route_dense(vectors_of(spark, d), routes).select("query_id", "name")


@query("routes_list", "SELECT 'r' || label AS name, count(*) AS utterances FROM embeddings WHERE vec_id % 20 = 0 GROUP BY 1")
def _routes_list(spark, d):
    rows = vectors_of(spark, d).where("id % 20 = 0").withColumn("name", F.concat(F.lit("r"), F.col("label").cast("string")))
    return Ro.list_routes(rows)
