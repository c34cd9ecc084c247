"""Text functions, sparse encoders, keyword search, fusion and rerankers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import keyword as K
from ..operators import rank as R
from ..operators import search as S
from ..operators.keyword import KeywordIndex
from ..plans import rag as G
from ..session import shared_dir, table
from . import query
from .vectors import E_COS, ONE, query_vector, vectors_of

SPLIT = r"list_filter(string_split_regex({t}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
ROUTER = "list_filter(" + SPLIT.format(t="lower(text)") + ", lambda w: strlen(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.ROUTER_STOP_WORDS) + "], w))"
KEYWORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'), lambda w: strlen(w) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.KEYWORD_STOP_WORDS) + "], w))"
SET = "list_filter(list_transform(" + SPLIT.format(t="lower(text)") + r", lambda w: regexp_replace(w, '^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$', '', 'g')), lambda w: strlen(w) >= 2)"


def documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def tokenized(spark, d, name="documents", key="doc_id"):
    return table(spark, d, name).select(F.col(key).alias("id"), T.router_tokens(F.col("text")).alias("tokens"))


def _digest(items):
    return F.md5(F.array_join(F.sort_array(items), " "))


for _name, _sql, _f in (("text_tokens", ROUTER, T.router_tokens), ("text_keywords", f"list_distinct({KEYWORDS})", T.keywords), ("text_token_set", f"list_distinct({SET})", T.token_set)):

    @query(_name, f"SELECT doc_id AS id, len(x) AS n, md5(array_to_string(list_sort(x), ' ')) AS digest FROM (SELECT doc_id, {_sql} AS x FROM documents)")
    def _tokens(spark, d, f=_f):
        items = documents(spark, d).select("id", f(F.col("text")).alias("x"))
        return items.select("id", F.size("x").cast("bigint").alias("n"), _digest(F.col("x")).alias("digest"))


@query("text_snippet", r"""SELECT doc_id AS id, CASE WHEN length(t) <= 180 THEN t ELSE substring(t, 1, 177) || '...' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)""")
def _snippet(spark, d):
    return documents(spark, d).select("id", T.snippet(F.col("text")).alias("snippet"))


@query("text_chunk", "WITH p AS (SELECT doc_id, [" + SPLIT.format(t="x") + r" FOR x IN string_split_regex(text, '[\n\r]+') IF trim(x) <> ''] AS ps FROM documents), "
       "c AS (SELECT doc_id, flatten([[array_to_string(w[i * 15 + 1 : i * 15 + 20], ' ') FOR i IN range(greatest(ceil((len(w) - 20) / 15.0), 0)::BIGINT + 1)] FOR w IN ps IF len(w) > 0]) AS cs FROM p) "
       "SELECT doc_id AS id, len(cs) AS n, md5(array_to_string(cs, chr(10))) AS digest FROM c")  # fmt: skip
def _chunk(spark, d):
    cut = documents(spark, d).select("id", T.chunks(F.col("text"), 20, 5).alias("cs"))
    return cut.select("id", F.size("cs").cast("bigint").alias("n"), F.md5(F.array_join("cs", "\n")).alias("digest"))


@query("text_entities")
def _entities(spark, d):
    found = documents(spark, d).select("id", T.title_entities(F.col("text")).alias("x"))
    return found.select("id", F.size("x").cast("bigint").alias("n"), F.md5(F.array_join(F.sort_array("x"), "|")).alias("digest"))


@query("text_hashed_vector")
def _hashed(spark, d):
    return documents(spark, d).select("id", T.hashed_vectors(64)("text").alias("vector"))


@query("text_mock_embedding")
def _mock(spark, d):
    return documents(spark, d).select("id", T.mock_embedder(8)("text").alias("vector"))


_TF = f"WITH t AS (SELECT doc_id AS id, {ROUTER} AS tokens FROM documents), l AS (SELECT id, len(tokens) AS len, unnest(tokens) AS term FROM t), tf AS (SELECT id, len, term, count(*) AS tf FROM l GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_len FROM t)"
_BM25_W = "ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))"


@query("text_bm25_encode", f"{_TF} SELECT id, count(*) AS terms, round(sum({_BM25_W}), 4) AS total FROM tf JOIN df USING (term), n GROUP BY 1")
def _bm25(spark, d):
    return T.bm25_weights(tokenized(spark, d)).groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("total"))


for _name, _w, _sub in (("text_tfidf", "tf * ln(n_docs / df)", False), ("text_tfidf_sublinear", "(1 + ln(tf)) * ln(n_docs / df)", True)):

    @query(_name, f"{_TF} SELECT id, count(*) AS terms, round(sum({_w}), 4) AS total FROM tf JOIN df USING (term), n GROUP BY 1")
    def _tfidf(spark, d, sub=_sub):
        return T.tfidf_weights(tokenized(spark, d), sublinear=sub).groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("total"))


@query("text_top_terms", f"{_TF}, w AS (SELECT id, term, {_BM25_W} AS weight FROM tf JOIN df USING (term), n) SELECT id, rank, round(weight, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS rank FROM w) WHERE rank <= 3")
def _top_terms(spark, d):
    return T.top_terms(T.bm25_weights(tokenized(spark, d)), 3).select("id", F.col("rank").cast("bigint").alias("rank"), F.round("weight", 4).alias("weight"))


_TERMS = ["thing", "hation", "ner"]
_indexes: dict[tuple[str, str], KeywordIndex] = {}


def keyword_index(spark, d):
    """The index of the documents; built once in an application, as a store would keep it."""
    known = (spark.sparkContext.applicationId, d)
    if known not in _indexes:
        path = f"{shared_dir(spark)}/lattica/keywords-{uuid.uuid4().hex}"
        _indexes[known] = KeywordIndex(spark, path).add(tokenized(spark, d))
    return _indexes[known]


def _scored(found):
    return found.select("id", F.round("score", 6).alias("score"))


@query("text_bm25_search", f"{_TF} SELECT id, round(sum({_BM25_W}), 6) AS score FROM tf JOIN df USING (term), n WHERE term IN ('thing', 'hation', 'ner') GROUP BY 1")
def _bm25_search(spark, d):
    return _scored(keyword_index(spark, d).search(K.any_of(_TERMS)))


@query("text_bm25_scan", f"{_TF} SELECT id, round(sum({_BM25_W}), 6) AS score FROM tf JOIN df USING (term), n WHERE term IN ('thing', 'hation', 'ner') GROUP BY 1")
def _bm25_scan(spark, d):
    return _scored(T.bm25_search(tokenized(spark, d), _TERMS))


@query("text_bm25_search_all", f"{_TF} SELECT id, round(sum({_BM25_W}), 6) AS score FROM tf JOIN df USING (term), n WHERE term IN ('attion', 'thanedble') GROUP BY 1 HAVING count(*) = 2")
def _bm25_all(spark, d):
    return _scored(keyword_index(spark, d).search("attion AND thanedble"))


@query("text_query_grammar", f"""{_TF}, h AS (SELECT id, sum({_BM25_W}) AS score, list(term) AS terms FROM tf JOIN df USING (term), n WHERE term IN ('thing', 'hation', 'ner') GROUP BY 1)
SELECT id, round(score, 6) AS score FROM h WHERE (list_contains(terms, 'thing') OR list_contains(terms, 'hation')) AND NOT list_contains(terms, 'ner')""")
def _grammar(spark, d):
    return _scored(keyword_index(spark, d).search("(thing OR hation) NOT ner"))


_ONE_LEAF = f"{_TF}, p AS ({{rows}}), c AS (SELECT count(*) AS df FROM p) SELECT id, round({_BM25_W}, 6) AS score FROM p, c, n"


@query("text_prefix_search", _ONE_LEAF.format(rows="SELECT id, any_value(len) AS len, sum(tf) AS tf FROM tf WHERE starts_with(term, 'hatio') GROUP BY 1"))
def _prefix(spark, d):
    return _scored(keyword_index(spark, d).search("hatio*"))


@query("text_phrase_search", _ONE_LEAF.format(rows="SELECT id, len(tokens) AS len, len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'attion' AND tokens[i + 1] = 'thanedble')) AS tf FROM t WHERE tf > 0"))
def _phrase(spark, d):
    return _scored(keyword_index(spark, d).search('"attion thanedble"'))


@query("text_query_variants", f"{_TF} SELECT 'OR' AS form, id, round(sum({_BM25_W}), 6) AS score FROM tf JOIN df USING (term), n WHERE term IN ('thing', 'ner') GROUP BY ALL")
def _variants(spark, d):
    """The planner's forms of a question are tried in order; here the first that finds anything is the keywords by OR."""
    index = keyword_index(spark, d)
    words = " ".join(["thing", "of", "ner"])
    for form in T.search_variants(words):
        if " OR " in form:
            return index.search(form).select(F.lit("OR").alias("form"), "id", F.round("score", 6).alias("score"))
    raise AssertionError("the planner has no form by OR")


_SPARSE = _TF.replace("documents", "benchmark").replace("doc_id", "item_id")


@query("text_sparse_cosine", f"{_SPARSE}, w AS (SELECT id, term, tf * ln(n_docs / df) AS w FROM tf JOIN df USING (term), n), len AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1) "
       "SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w) / any_value(la.l * lb.l), 6) AS score FROM w a JOIN w b USING (term) JOIN len la ON la.id = a.id JOIN len lb ON lb.id = b.id GROUP BY 1, 2")  # fmt: skip
def _sparse(spark, d):
    w = T.tfidf_weights(tokenized(spark, d, "benchmark", "item_id"))
    found = T.sparse_similarity(w.withColumnRenamed("id", "a"), w.withColumnRenamed("id", "b"), "a", "b")
    return found.withColumn("score", F.round("score", 6))


_LEG = f"v AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT e.vec_id AS id, {E_COS} AS s FROM {ONE} JOIN documents d ON d.doc_id = e.vec_id) QUALIFY rank <= 10)"
_TEXT_LEG = f"k AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT id, sum({_BM25_W}) AS s FROM tf JOIN df USING (term), n WHERE term IN ('thing', 'hation', 'ner') GROUP BY 1) QUALIFY rank <= 30)"


def _vector_leg(spark, d):
    rows = vectors_of(spark, d).join(documents(spark, d), "id")
    return S.scored(rows, query_vector(spark, d))


@query("hybrid_rrf", f"{_TF}, {_LEG}, {_TEXT_LEG}, u AS (SELECT id, rank FROM v UNION ALL SELECT id, rank FROM k) SELECT id, round(sum(1 / (60.0 + rank)), 6) AS score FROM u GROUP BY 1 ORDER BY sum(1 / (60.0 + rank)) DESC, id LIMIT 10")
def _hybrid(spark, d):
    found = S.hybrid(_vector_leg(spark, d), keyword_index(spark, d).search(K.any_of(_TERMS)), 10)
    return found.withColumn("score", F.round("score", 6))


_CAND = f"c AS (SELECT e.vec_id AS id, d.text, {E_COS} AS score FROM {ONE} JOIN documents d ON d.doc_id = e.vec_id ORDER BY score DESC, id LIMIT 50)"


def _candidates(spark, d):
    return _vector_leg(spark, d).orderBy(F.desc("score"), "id").limit(50).withColumnRenamed("text", "content")


@query("rerank_keyword", f"WITH {_CAND} SELECT id, round(score * (1 + 0.1 * (contains(lower(text), 'thing')::INT + contains(lower(text), 'der ')::INT)), 6) AS score FROM c")
def _keyword(spark, d):
    return R.keyword_boost(_candidates(spark, d), ["thing", "DER "], 0.1).select("id", F.round("score", 6).alias("score"))


_OVERLAP = "(list_contains(w, 'the')::INT + list_contains(w, 'of')::INT + list_contains(w, 'der')::INT) / 3.0"


@query("rerank_rrf", f"WITH {_CAND}, o AS (SELECT id, score, {_OVERLAP} AS t FROM (SELECT *, {SPLIT.format(t='lower(text)')} AS w FROM c)), "
       "v AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS vr FROM o), r AS (SELECT *, row_number() OVER (ORDER BY t DESC, vr) AS tr FROM v) SELECT id, round(0.5 / (60 + vr) + 0.5 / (60 + tr), 6) AS score FROM r")  # fmt: skip
def _rrf(spark, d):
    return R.rrf_rerank(_candidates(spark, d), "the of der").select("id", F.round("score", 6).alias("score"))


@query("rerank_normalize", f"WITH {_CAND} SELECT id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score FROM c")
def _normalize(spark, d):
    return R.normalize(_candidates(spark, d)).select("id", F.round("score", 6).alias("score"))


@query("rerank_weighted", f"WITH {_CAND} SELECT id, round((0.7 * score + 0.3 * {_OVERLAP}), 6) AS score FROM (SELECT *, {SPLIT.format(t='lower(text)')} AS w FROM c)")
def _weighted(spark, d):
    c = _candidates(spark, d)
    text = c.withColumn("score", R.word_overlap(F.col("content"), "the of der"))
    return R.weighted_rerank([(c, 0.7), (text, 0.3)]).select("id", F.round("score", 6).alias("score"))


def _pool(spark, d):
    rows = vectors_of(spark, d)
    near = S.batch_knn(rows.where("id % 20 = 0"), rows, 60)
    return near.join(rows.select("id", "vector"), "id")


for _method, _options in (("mmr", {"weight": 0.5}), ("distance", {"least": 0.1}), ("dpp", {})):

    @query(f"diverse_{_method}")
    def _diverse(spark, d, method=_method, options=_options):
        return R.select_diverse(_pool(spark, d), 10, method, **options)


@query("diverse_random")
def _random(spark, d):
    return R.select_random(S.scored(vectors_of(spark, d), query_vector(spark, d)), 10).select("id", "score")


_ASK = "thing hation ner"


@query("text_hybrid_similarity", f"""{_TF}, i AS (SELECT term, ln(n_docs / df) AS idf FROM df, n), w AS (SELECT id, term, tf * idf AS w FROM tf JOIN i USING (term)), le AS (SELECT id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1),
q AS (SELECT term, idf AS w FROM i WHERE term IN ('thing', 'hation', 'ner')), ql AS (SELECT sqrt(sum(w * w)) AS l FROM q), p AS (SELECT w.id, sum(w.w * q.w) / any_value(le.l * ql.l) AS sparse FROM w JOIN q USING (term) JOIN le USING (id), ql GROUP BY 1)
SELECT d.id, round(0.7 * s + 0.3 * coalesce(sparse, 0), 6) AS score FROM (SELECT e.vec_id AS id, {E_COS} AS s FROM {ONE}) d JOIN t USING (id) LEFT JOIN p USING (id)""")
def _hybrid_similarity(spark, d):
    """Dense cosine and cosine of TF-IDF vectors of the texts, 0.7 to 0.3."""
    docs = tokenized(spark, d)
    asked = spark.range(1).select(F.lit(-1).cast("bigint").alias("q"), T.router_tokens(F.lit(_ASK)).alias("tokens"))
    # Weights of both by the documents' statistics; the query's terms are few, so only their postings meet it.
    own = T.tfidf_weights(docs)
    theirs = T.term_counts(asked, "q").join(T.idf(docs), "term").select("q", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    sparse = T.sparse_similarity(theirs, own, "q", "id").select("id", "score")
    dense = S.scored(vectors_of(spark, d), query_vector(spark, d)).select("id", F.col("score").alias("dense")).join(documents(spark, d).select("id"), "id")
    score = 0.7 * F.col("dense") + 0.3 * F.coalesce("score", F.lit(0.0))
    return dense.join(sparse, "id", "left").select("id", F.round(score, 6).alias("score"))


@query("knowledge_hits", f"""WITH t AS (SELECT doc_id AS id, {SET} AS tokens, source FROM documents), s AS (SELECT source, id, (list_contains(tokens, 'thing')::INT + list_contains(tokens, 'der')::INT) / 2.0 AS score FROM t)
SELECT source, max(score) AS score, count(*) AS chunks, arg_min(id, -score * 1000000 + id / 1000000.0) AS best FROM s WHERE score > 0 GROUP BY 1""")
def _knowledge(spark, d):
    tokens = T.token_set(F.col("text"))
    hit = lambda w: F.array_contains(tokens, w).cast("int")
    rows = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array(F.lit("all")).alias("entities"), ((hit("thing") + hit("der")) / 2).alias("score")).where("score > 0")
    found = G.knowledge_hits(rows, k=1000)
    return found.select(F.col("doc_id").alias("source"), "score", F.size("chunk_ids").cast("bigint").alias("chunks"), F.get("chunk_ids", F.lit(0)).alias("best"))
