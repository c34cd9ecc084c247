"""Store changes, formats, retrieval, memory, routing and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..operators import store as St
from ..plans import memory as M
from ..plans import rag as R
from ..plans import routing as Ro
from ..session import cut, shared_dir, table
from ..sources import formats as Fo
from ..streaming import streams as X
from . import query
from .graph import graph_edges, graph_nodes
from .text import ROUTER, SET
from .vectors import E_COS, ONE, query_vector, vectors_of


def _shared(spark, name):
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"


def events(spark, d):
    return table(spark, d, "events")


def messages(spark, d):
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


@query("upsert_merge", "SELECT vec_id AS id, CASE WHEN vec_id % 20 = 0 THEN -1 ELSE label END::INTEGER AS label FROM embeddings UNION ALL SELECT 1000000 + vec_id, label FROM embeddings WHERE vec_id % 20 = 0")
def _upsert(spark, d):
    rows = vectors_of(spark, d).select("id", "label")
    changed = rows.where("id % 20 = 0")
    new = changed.withColumn("label", F.lit(-1)).unionByName(changed.withColumn("id", F.col("id") + 1000000))
    return St.upsert(rows, new)


@query("upsert_latest", "SELECT user_id AS id, arg_max(event_id, event_id) AS version FROM events GROUP BY 1")
def _latest(spark, d):
    return St.latest(events(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "event_type")).select("id", "version")


@query("skip_existing", "SELECT vec_id AS id, label FROM embeddings UNION ALL SELECT 1000000 + vec_id, -1 FROM embeddings")
def _skip(spark, d):
    rows = vectors_of(spark, d).select("id", "label")
    new = rows.withColumn("label", F.lit(-1))
    return St.insert_missing(rows, new.unionByName(new.withColumn("id", F.col("id") + 1000000)))


@query("delete_anti", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _delete(spark, d):
    gone = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("id"))
    return St.delete_ids(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), gone)


@query("delete_where", "SELECT event_id AS id FROM events WHERE NOT coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 50, false)")
def _delete_where(spark, d):
    return St.delete_where(events(spark, d), F.get_json_object("props", "$.k").try_cast("double") > 50).select(F.col("event_id").alias("id"))


@query("delete_cascade", "SELECT count(DISTINCT l_orderkey) AS orders, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def _cascade(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    _, left = St.cascade(orders, lines, orders.where("o_orderstatus = 'F'"), "o_orderkey", "l_orderkey")
    return left.agg(F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("lines"))


@query("fetch_ids", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _fetch(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return St.fetch(vectors_of(spark, d).select("id", "label"), ids)


@query("collections_join", "SELECT vec_id AS id, 'c' || label AS collection FROM embeddings WHERE label = 4")
def _collections(spark, d):
    rows = vectors_of(spark, d).select("id", F.col("label").alias("collection_id"))
    names = rows.select(F.col("collection_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("c"), F.col("id").cast("string")))
    return St.with_collections(St.in_collection(rows, names, "c4"), names).select("id", "collection")


@query("chat_history", "SELECT conv_id AS session_id, turn AS created_at, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def _history(spark, d):
    return St.history(messages(spark, d), 3).select("session_id", "created_at", "role")


@query("chat_triggers", "WITH m AS (SELECT conv_id AS session_id, turn, role, count(*) FILTER (role = 'user') OVER w AS n, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS size FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT session_id, n, size FROM m WHERE role = 'user' AND n % 2 = 0")
def _triggers(spark, d):
    return St.window_triggers(messages(spark, d), 2, 4).select("session_id", "n", F.size("ids").cast("bigint").alias("size"))


@query("chat_keyword", f"WITH t AS (SELECT conv_id * 1000000 + turn AS id, conv_id, list_distinct({SET}) AS tokens FROM conversations), u AS (SELECT * FROM t WHERE conv_id % 3 = 1 AND conv_id <> 1) SELECT id FROM u WHERE list_contains(tokens, 'thing')")
def _chat_keyword(spark, d):
    m = messages(spark, d)
    sessions = m.select("session_id").distinct().withColumn("user_id", F.col("session_id") % 3)
    return M.keyword_messages(m, sessions, ["thing"], 1, 1, 1 << 30).select("id")


@query("memory_ttl", "SELECT event_id AS id FROM events WHERE ts + to_seconds(CASE WHEN event_id % 2 = 0 THEN 86400 ELSE 864000 END) >= TIMESTAMP '2024-01-15'")
def _ttl(spark, d):
    rows = events(spark, d).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"))
    kept = M.alive(M.with_expiry(rows, F.when(F.col("id") % 2 == 0, 86400).otherwise(864000)), F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    return kept.select("id")


@query("memory_scope", "SELECT 'memory:user:' || user_id || ':default' AS bucket, count(*) AS memories FROM events GROUP BY 1")
def _scope(spark, d):
    parts = M.bucket("user", "{}").split("{}")
    name = F.concat(F.lit(parts[0]), F.col("user_id").cast("string"), F.lit(parts[1]))
    return events(spark, d).groupBy(name.alias("bucket")).agg(F.count("*").alias("memories"))


def memories(spark, d):
    """Embeddings with their documents' texts; the bank is the label's parity, the entities are the document's language and source."""
    docs = table(spark, d, "documents")
    rows = vectors_of(spark, d).join(docs, F.col("id") == F.col("doc_id"))
    kind = F.element_at(F.array(*(F.lit(k) for k, _ in M.SECTIONS)), (F.col("label") % 4 + 1).cast("int"))
    return rows.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("b"), (F.col("label") % 2).cast("string")).alias("bank_id"), kind.alias("type"), F.col("text").alias("content"), "vector", F.array("lang", "source").alias("entities"), F.lit(0.5).alias("confidence"), F.timestamp_seconds(F.col("id") * 3600).alias("created_at"))


_M = f"m AS (SELECT e.vec_id::VARCHAR AS id, {E_COS} AS s, d.lang, list_distinct({SET}) AS tokens FROM {ONE} JOIN documents d ON d.doc_id = e.vec_id WHERE e.label % 2 = 0)"


@query("recall_tempr", f"""WITH {_M}, a AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM m QUALIFY r <= 10), e AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM m WHERE lang = 'fr' QUALIFY r <= 10),
t AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM m WHERE id::BIGINT BETWEEN 24 AND 240 QUALIFY r <= 10), h AS (SELECT id, len(tokens) AS len, unnest(list_filter(tokens, lambda x: x IN ('thing', 'der'))) AS term FROM m), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(tokens)) AS al FROM m),
k AS (SELECT id, row_number() OVER (ORDER BY b DESC, id) AS r FROM (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / al))) AS b FROM h JOIN f USING (term), n GROUP BY 1) QUALIFY r <= 10),
u AS (SELECT * FROM a UNION ALL SELECT * FROM e UNION ALL SELECT * FROM t UNION ALL SELECT * FROM k)
SELECT id, round(sum(1 / (60.0 + r)), 6) AS score FROM u GROUP BY 1 ORDER BY sum(1 / (60.0 + r)) DESC, id LIMIT 10""")
def _recall(spark, d):
    from datetime import datetime, timezone

    span = (datetime(1970, 1, 2, tzinfo=timezone.utc), datetime(1970, 1, 11, tzinfo=timezone.utc))
    found = M.recall(memories(spark, d), "b0", 10, query_vector(spark, d), ["thing", "DER"], span, ["FR"])
    return found.withColumn("score", F.round("score", 6))


def observed_sql(where: str) -> str:
    """What is observed in the memories that meet a condition: kind, subject, memories, confidence."""
    mentions = lambda words: "regexp_matches(t, '" + "|".join(words) + "')"
    return f"""WITH m AS (SELECT d.lang, d.source, lower(coalesce(d.text, '')) AS t FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE {where}),
w AS (SELECT unnest(list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: strlen(w) > 4)) AS word FROM m), k AS (SELECT lang, source, {mentions(M.PREFERENCE_WORDS)} AS p, {mentions(M.CAUSE_WORDS)} AS c FROM m),
s AS (SELECT lang AS subject, p, c FROM k UNION ALL SELECT source, p, c FROM k WHERE source IS DISTINCT FROM lang), g AS (SELECT subject, count(*) AS n, bool_or(p) AS p, bool_or(c) AS c FROM s WHERE subject IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
top AS (SELECT word FROM w GROUP BY 1 HAVING count(*) >= 2 ORDER BY count(*) DESC, word LIMIT 1)
SELECT kind, subject, n AS memories, round(greatest(least(least(n / 10.0, 0.9) * 0.8, 1.0), 0.1), 6)::DOUBLE AS confidence FROM (SELECT 'preference' AS kind, subject, n FROM g WHERE p UNION ALL SELECT 'causal', subject, n FROM g WHERE c
  UNION ALL SELECT 'generalization', word, (SELECT count(*) FROM m) FROM top)"""


@query("observe_patterns", observed_sql("true"))
def _observe(spark, d):
    return M.observe(memories(spark, d), M.Bank("b", skepticism=4)).withColumn("confidence", F.round("confidence", 6))


@query("reflect_context", f"""WITH m AS (SELECT e.vec_id::VARCHAR AS id, {E_COS} AS s, e.label % 4 AS kind, d.text FROM {ONE} JOIN documents d ON d.doc_id = e.vec_id WHERE e.label % 2 = 0 ORDER BY s DESC, id LIMIT 10),
l AS (SELECT string_agg('- ' || text || ' (score: ' || printf('%.3f', s) || ')' || chr(10), '' ORDER BY s DESC, id) FILTER (kind = 0) AS w, string_agg('- ' || text || ' (confidence: 0.50)' || chr(10), '' ORDER BY s DESC, id) FILTER (kind = 2) AS o FROM m)
SELECT c AS context, length(c) // 4 AS tokens FROM (SELECT substring('# Relevant Memories for: what is known' || chr(10) || chr(10) || coalesce('## Facts' || chr(10) || w || chr(10), '') || coalesce('## Insights' || chr(10) || o || chr(10), ''), 1, 2000) AS c FROM l)""")
def _reflect(spark, d):
    rows = memories(spark, d)
    return M.reflect(M.recall(rows, "b0", 10, query_vector(spark, d)).join(rows, "id"), "what is known", 500)


@query("route_dense", f"WITH s AS (SELECT q.vec_id AS query_id, 'r' || e.label AS name, greatest(max({E_COS}), 0) AS score FROM embeddings q, embeddings e WHERE e.vec_id % 20 = 0 GROUP BY 1, 2) SELECT query_id, arg_min(name, -score) AS name, round(max(score), 6) AS score, max(score) >= 0.82 AS matched FROM s GROUP BY 1")
def _route(spark, d):
    rows = vectors_of(spark, d)
    routes = rows.where("id % 20 = 0").withColumn("name", F.concat(F.lit("r"), F.col("label").cast("string")))
    return Ro.route_dense(rows, routes).withColumn("score", F.round("score", 6))


_ROUTED = f"""WITH rt AS (SELECT item_id AS id, 'r' || item_id % 5 AS name, {ROUTER} AS tokens FROM benchmark), dt AS (SELECT doc_id AS id, {ROUTER} AS tokens FROM documents),
rf AS (SELECT id, name, term, count(*) AS tf FROM (SELECT id, name, unnest(tokens) AS term FROM rt) GROUP BY ALL), i AS (SELECT term, ln((SELECT count(*) FROM rt) / count(*)) AS idf FROM rf GROUP BY 1),
rw AS (SELECT id, name, term, tf * idf AS w FROM rf JOIN i USING (term)), dw AS (SELECT id, term, any_value(idf) * count(*) AS w FROM (SELECT id, unnest(tokens) AS term FROM dt) JOIN i USING (term) GROUP BY 1, 2),
rl AS (SELECT id, sqrt(sum(w * w)) AS l FROM rw GROUP BY 1), dl AS (SELECT id, sqrt(sum(w * w)) AS l FROM dw GROUP BY 1), p AS (SELECT dw.id AS q, rw.id AS r, any_value(name) AS name, sum(dw.w * rw.w) AS dot FROM dw JOIN rw USING (term) GROUP BY 1, 2),
s AS (SELECT q AS query_id, name, max(CASE WHEN dl.l * rl.l > 0 THEN dot / (dl.l * rl.l) ELSE 0 END) AS score FROM p JOIN dl ON dl.id = q JOIN rl ON rl.id = r GROUP BY 1, 2)
SELECT query_id, round(max(score), 6) AS score, max(score) >= 0.3 AS matched FROM s GROUP BY 1"""


@query("route_sparse", _ROUTED)
def _route_sparse(spark, d):
    bench = table(spark, d, "benchmark")
    routes = bench.select(F.col("item_id").alias("id"), F.concat(F.lit("r"), (F.col("item_id") % 5).cast("string")).alias("name"), "text")
    found = Ro.route_sparse(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), routes)
    return found.select("query_id", F.round("score", 6).alias("score"), "matched")  # names of equal scores hang on the last bits


@query("route_hybrid")
def _route_hybrid(spark, d):
    rows = cut(vectors_of(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id"))  # read four times
    routes = rows.where("id % 20 = 0").withColumn("name", F.concat(F.lit("r"), F.col("label").cast("string")))
    return Ro.route_hybrid(rows, routes)


@query("extract_params", r"""SELECT doc_id AS id, nullif(regexp_extract(lower(text), 'the\s+[:是]?\s*["'']?([^"''\s,。.!?]+)["'']?', 1), '') AS the,
CASE WHEN regexp_matches(text, '[0-9]') THEN TRY_CAST(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) WHEN regexp_matches(lower(text), 'n\s+[:是]?\s*["'']?([^"''\s,。.!?]+)["'']?') THEN NULL ELSE 0 END AS n FROM documents""")
def _extract(spark, d):
    schema = Ro.FunctionSchema("f").with_parameter("the", Ro.Parameter()).with_parameter("n", Ro.Parameter("int", pattern=r"(\d+)", default=0))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    got = Ro.extract_column(rows, schema)
    return got.select("id", F.element_at("parameters", "the").alias("the"), F.element_at("parameters", "n").try_cast("bigint").alias("n"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("rag_ingest_nodes")
def _nodes(spark, d):
    return R.ingest(_docs(spark, d))[1].groupBy("node_type").agg(F.count("*").alias("nodes"))


@query("rag_ingest_edges")
def _edges(spark, d):
    return R.ingest(_docs(spark, d))[2].groupBy("edge_type").agg(F.count("*").alias("edges"))


@query("rag_chunks", r"WITH p AS (SELECT doc_id, [list_filter(string_split_regex(x, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') FOR x IN string_split_regex(text, '[\n\r]+')] AS ps FROM documents) SELECT doc_id, coalesce(list_sum([greatest(ceil((len(w) - 120) / 120.0), 0)::BIGINT + 1 FOR w IN ps IF len(w) > 0]), 0)::BIGINT AS chunks FROM p")
def _chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.chunks(F.col("text"))).cast("bigint").alias("chunks"))


@query("rag_search")
def _search(spark, d):
    chunks, _, edges = R.ingest(_docs(spark, d))
    text = "Thing hation of the"
    return R.search(chunks, edges, text, R.lexical_seeds(chunks, text, 4), R.RagOptions(hops=1)).select("id", "doc_id", "score", "rank")


@query("io_jsonl_roundtrip", "SELECT vec_id::VARCHAR AS id, label::VARCHAR AS label, len(embedding)::BIGINT AS dim FROM embeddings")
def _jsonl(spark, d, kind="jsonl"):
    rows = vectors_of(spark, d).select(F.col("id").cast("string").alias("id"), "vector", F.lit("x, \"y\"").alias("content"), F.lit(None).cast("string").alias("doc_id"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    path = _shared(spark, kind)
    Fo.dump(rows, path, kind)
    return Fo.load(spark, path, kind).select("id", F.element_at("metadata", "label").alias("label"), F.size("vector").cast("bigint").alias("dim"))


for _kind in ("csv", "json", "parquet"):

    @query(f"io_{_kind}_roundtrip", "SELECT vec_id::VARCHAR AS id, label::VARCHAR AS label, len(embedding)::BIGINT AS dim FROM embeddings")
    def _io(spark, d, kind=_kind):
        return _jsonl(spark, d, kind)


for _kind in ("graphml", "gexf", "json"):

    @query(f"io_{_kind}_graph_roundtrip" if _kind == "json" else f"io_{_kind}_roundtrip", "SELECT 'n' || n_nationkey || '-r' || n_regionkey AS id, 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 0.8::DOUBLE AS weight FROM nation")
    def _graph_io(spark, d, kind=_kind):
        nodes = graph_nodes(spark, d).where("node_type IN ('nation', 'region')").withColumn("content", F.lit("a <b> & \"c\""))
        edges = graph_edges(spark, d).where("edge_type = 'of_nation'")
        return Fo.import_graph(spark, Fo.export_graph(nodes, edges, kind))[1].select("id", "src", "dst", "weight")


@query("metadata_codec", "SELECT vec_id AS id, label::VARCHAR AS label FROM embeddings")
def _codec(spark, d):
    text = Fo.encode_metadata(F.create_map(F.lit("label"), F.col("label").cast("string")))
    return vectors_of(spark, d).select("id", F.element_at(Fo.decode_metadata(text), "label").alias("label"))


def _collected(spark, stream, schema_of):
    """All rows of a stream, by way of a table in the shared folder."""
    path = _shared(spark, "stream")
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-c").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema_of).parquet(path)


@query("stream_topk", f"SELECT e.vec_id AS id, round({E_COS}, 6) AS score FROM {ONE} ORDER BY {E_COS} DESC, e.vec_id LIMIT 10")
def _stream_topk(spark, d):
    stream = X.file_stream(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    last = {}
    X.run_top_k(X.scored_stream(stream, query_vector(spark, d)), 10, lambda rows, i: last.update(rows=rows), checkpoint=_shared(spark, "topk")).awaitTermination()
    return last["rows"].select("id", F.round("score", 6).alias("score"))


@query("stream_scored", f"SELECT e.vec_id AS id, round({E_COS}, 6) AS score FROM {ONE} WHERE {E_COS} >= 0.2")
def _stream_scored(spark, d):
    stream = X.file_stream(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    scored = X.scored_stream(stream, query_vector(spark, d), 0.2).select("id", F.round("score", 6).alias("score"))
    return _collected(spark, scored, "id bigint, score double")


@query("stream_upsert_latest", "SELECT user_id AS id, max(event_id) AS version FROM events GROUP BY 1")
def _stream_upsert(spark, d):
    store = X.IncrementalTable(spark, _shared(spark, "table"))

    def each(batch, batch_id):
        store.merge(batch, batch_id)

    stream = X.file_stream(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"))
    stream.writeStream.foreachBatch(each).option("checkpointLocation", _shared(spark, "upsert")).trigger(availableNow=True).start().awaitTermination()
    return store.read()


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def _stream_dedup(spark, d):
    stream = X.file_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return _collected(spark, X.deduplicated(stream, "user_id", "at", "60 days").select("user_id"), "user_id bigint")


@query("stream_trigger_windows", "WITH m AS (SELECT conv_id AS session_id, turn, role, count(*) FILTER (role = 'user') OVER w AS n, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), ',') AS ids FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT session_id, n, ids FROM m WHERE role = 'user' AND n % 2 = 0")
def _stream_triggers(spark, d):
    stream = X.file_stream(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role")
    found = _collected(spark, X.trigger_stream(stream), "session_id bigint, n bigint, ids array<bigint>")
    return found.select("session_id", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("stream_merged", "SELECT vec_id AS id, 'a' AS source FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id, 'b' FROM embeddings WHERE label < 2")
def _stream_merged(spark, d):
    one = X.file_stream(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    legs = X.merge_streams(one.where("label < 3").select("id", F.lit("a").alias("source")), one.where("label < 2").select("id", F.lit("b").alias("source")))
    return _collected(spark, legs, "id bigint, source string")


@query("stream_windowed", "SELECT epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def _stream_windowed(spark, d):
    """Counts by day and type as a stream leaves them in a table in memory of its sink: windows are complete when it ends."""
    stream = X.file_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    last = {}
    counts = X.windowed_counts(stream, "at", "1 day", "event_type")
    each = lambda rows, i: last.update(rows=rows.select(F.unix_timestamp("window.start").alias("day"), "event_type", "count").collect()) if i == 0 else None  # noqa: E731  as many rows as days and types
    counts.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", _shared(spark, "windows")).trigger(availableNow=True).start().awaitTermination()
    return spark.createDataFrame(last["rows"], "day bigint, event_type string, count bigint")


@query("chunk_neighbours", "SELECT c.doc_id, c.turn AS idx, lag(turn) OVER w AS previous, lead(turn) OVER w AS following FROM (SELECT conv_id AS doc_id, turn FROM conversations) c WINDOW w AS (PARTITION BY doc_id ORDER BY turn)")
def _neighbours(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("turn").alias("id"))
    return R.neighbours_in_order(rows).select("doc_id", "idx", "previous", "following")


@query("stream_pending", "SELECT user_id AS id, max(event_id) AS version FROM events GROUP BY 1")
def _stream_pending(spark, d):
    """Three batches out of order, the last of them still pending."""
    store = X.IncrementalTable(spark, _shared(spark, "table"))
    rows = events(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("version"))
    store.merge(rows.where("version % 3 = 2"), 0)
    store.merge(rows.where("version % 3 = 0"), 1)
    return store.with_pending(rows.where("version % 3 = 1"))


@query("batch_hybrid_fusion", f"WITH a AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY {E_COS} DESC, e.vec_id) AS rank FROM {ONE} QUALIFY rank <= 10), b AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY {E_COS} DESC, e.vec_id) AS rank FROM {ONE.replace('vec_id = 0', 'vec_id = 1')} QUALIFY rank <= 10), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, round(sum(1 / (60.0 + rank)), 6) AS score FROM u GROUP BY 1")
def _fusion(spark, d):
    rows = vectors_of(spark, d)
    legs = [S.ranked(S.scored(rows, query_vector(spark, d, i)), 10) for i in (0, 1)]
    return S.rrf(legs).withColumn("score", F.round("score", 6))
