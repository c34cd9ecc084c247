"""Tokenizers, chunks, entities, snippets and sparse weights as Column expressions and DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Stop words of the router's tokenizer.
ROUTER_STOP_WORDS = (
    "a an the and or but in on at to for of with by is are was were be been this that these those "
    "我 你 他 她 它 的 了 是 在 有 和 与 或 但 不"
).split()

#: Stop words of the keyword extraction.
KEYWORD_STOP_WORDS = (
    "a an and are as at be by does for from how in into is it of on or that the their there these this to was were what when where which who why with"
).split()

#: Fixed value: characters that are cut from the ends of a hashed token.
TOKEN_EDGES = " \t\r\n.,!?;:\"'()[]{}<>"

SPACE = r"[ \t\n\x0B\f\r]+"


def _strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def fields(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def router_tokens(text: Column) -> Column:
    """Lower-cased words of two bytes at least that are no stop words; punctuation stays."""
    return F.filter(fields(F.lower(text)), lambda w: (F.octet_length(w) > 1) & ~F.array_contains(_strings(ROUTER_STOP_WORDS), w))


def token_set(text: Column) -> Column:
    """Distinct lower-cased words, cut to their letters and digits at both ends, of two bytes at least."""
    cut = F.transform(fields(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))
    return F.array_distinct(F.filter(cut, lambda w: F.octet_length(w) >= 2))


def keywords(text: Column) -> Column:
    """Distinct runs of letters and digits in order, without stop words and single bytes."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.filter(parts, lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(_strings(KEYWORD_STOP_WORDS), w)))


def keyword_list(text: str) -> list[str]:
    """The same for one text on the driver."""
    found = re.split(r"[\W_]+", text.lower())
    return list(dict.fromkeys(w for w in found if len(w.encode()) >= 2 and w not in KEYWORD_STOP_WORDS))


def search_variants(query: str, extra_keywords: Sequence[str] = (), alternates: Sequence[str] = ()) -> list[str]:
    """Query forms to try, in order: the query, alternates, its keywords by OR, all keywords by OR, and those as prefixes."""
    own = keyword_list(query)
    every = list(dict.fromkeys([*keyword_list(" ".join(extra_keywords)), *own]))
    plain = lambda w: w if w.isascii() and w.isalnum() else f'"{w}"'
    forms = [query.strip(), *(a.strip() for a in alternates), " OR ".join(own), " OR ".join(map(plain, every)), " OR ".join(f"{plain(w)}*" for w in every)]
    return list(dict.fromkeys(f for f in forms if f))


def unique_sorted(values: Column) -> Column:
    """Distinct texts that aren't blank, sorted."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")))


def snippet(text: Column) -> Column:
    """White space collapsed; beyond 180 characters the first 177 and three dots."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(F.length(flat) <= 180, flat).otherwise(F.concat(F.substring(flat, 1, 177), F.lit("...")))


def chunks(text: Column, size: int = 120, overlap: int = 0) -> Column:
    """Chunks of ``size`` words at most, by paragraph; long paragraphs are cut by a window that moves ``size - overlap`` words."""
    step = size - overlap if size > overlap else size
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\n\r]+"), lambda p: F.trim(F.regexp_replace(p, SPACE, " ")) != "")

    def cut(words: Column) -> Column:
        count = F.greatest(F.ceil((F.size(words) - size) / step), F.lit(0)).cast("int") + 1
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))

    return F.flatten(F.transform(F.transform(paragraphs, fields), cut))


def title_entities(text: Column) -> Column:
    """Distinct runs of capitalised words, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)*)\b"), 1))


def has_title_entity(text: str) -> bool:
    return bool(re.search(r"\b[A-Z][a-z0-9]+\b", text))


def entity_id(name: Column) -> Column:
    """entity: and the name's letters and digits in lower case, with _ for blanks and hyphens."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[ \-_]", "_"), r"[^\p{L}\p{Nd}_]", "")
    plain = F.btrim(plain, F.lit("_"))
    return F.concat(F.lit("entity:"), F.when(plain == "", F.lit("entity")).otherwise(plain))


def document_node_id(doc: Column) -> Column:
    return F.concat(F.lit("doc:"), doc.cast("string"))


def chunk_node_id(doc: Column, index: Column) -> Column:
    return F.format_string("chunk:%s:%03d", doc.cast("string"), index)


def fnv1a64(data: bytes) -> int:
    """FNV-1a hash; offset and prime are its published constants."""
    h = 0xCBF29CE484222325
    for byte in data:
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hashed_vector(text: str | None, dim: int = 64) -> np.ndarray:
    out = np.zeros(dim, np.float32)
    for word in (text or "").lower().split():
        if word := word.strip(TOKEN_EDGES):
            out[fnv1a64(word.encode()) % dim] += 1
    if not out.any():
        out[0] = 1
    return out


def hashed_many(texts: Sequence[str | None], dim: int) -> np.ndarray:
    """Vectors of texts, a row each: every distinct word is hashed once, and words are counted by array operations."""
    words = [[w for w in map(lambda w: w.strip(TOKEN_EDGES), t.lower().split()) if w] if t else [] for t in texts]
    place = {w: fnv1a64(w.encode()) % dim for w in set().union(*words)}
    sizes = [len(w) for w in words]
    at = np.repeat(np.arange(len(words)) * dim, sizes) + np.fromiter((place[w] for ws in words for w in ws), np.int64, sum(sizes))
    out = np.bincount(at, minlength=len(words) * dim).astype(np.float32).reshape(len(words), dim)
    out[np.array(sizes, np.int64) == 0, 0] = 1
    return out


def hashed_vectors(dim: int = 64):
    """Arrow UDF: counts of a text's tokens by FNV-1a hash modulo ``dim``; the first unit vector for none."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(list(hashed_many(series.tolist(), dim)), dtype=object)

    return run


def mock_vector(text: str | None, dim: int) -> np.ndarray:
    """Deterministic vector of a text: a linear congruential generator started by the text's polynomial hash.

    Fixed values: the generator's constants.
    """
    h = 0
    for c in text or "":
        h = h * 31 + ord(c) & 0xFFFFFFFF
    out = np.empty(dim, np.float32)
    for i in range(dim):
        h = h * 1664525 + 1013904223 & 0xFFFFFFFF
        out[i] = (h - (1 << 32) if h >> 31 else h) / 0x7FFFFFFF * 2
    return out


def mock_embedder(dim: int = 64):
    """Arrow UDF form of ``mock_vector``; any function from series of texts to series of vectors can take its place."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            known: dict = {}
            yield series.map(lambda t: known[t] if t in known else known.setdefault(t, mock_vector(t, dim)))

    return run


# Sparse encoders. Terms come as an array column ``tokens``; results are long tables (id, term, weight).


def term_counts(docs: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """``key, term, tf``"""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: number of documents and mean number of tokens."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens)).alias("avg_len"))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25_weights(docs: DataFrame, corpus: DataFrame | None = None, key: str = "id", tokens: str = "tokens", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key, term, weight`` of ``docs`` by the statistics of ``corpus`` (the documents themselves if absent); a term that the corpus lacks has idf 1."""
    corpus = docs if corpus is None else corpus
    idf = document_frequencies(term_counts(corpus, key, tokens)).crossJoin(F.broadcast(corpus_size(corpus, tokens))).select("term", bm25_idf(F.col("n_docs"), F.col("df")).alias("idf"))
    long = docs.select(key, F.size(tokens).alias("len"), F.explode(tokens).alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    mean = F.broadcast(corpus_size(corpus, tokens).select("avg_len"))
    shape = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return long.join(idf, "term", "left").crossJoin(mean).select(key, "term", (F.coalesce("idf", F.lit(1.0)) * shape).alias("weight"))


def idf(corpus: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """``term, idf``: ln(N / df)."""
    return document_frequencies(term_counts(corpus, key, tokens)).crossJoin(F.broadcast(corpus_size(corpus, tokens))).select("term", F.log(F.col("n_docs") / F.col("df")).alias("idf"))


def tfidf_weights(docs: DataFrame, corpus: DataFrame | None = None, key: str = "id", tokens: str = "tokens", sublinear: bool = False) -> DataFrame:
    """Weights tf * ln(N / df), tf as 1 + ln(tf) if sublinear; terms that the corpus lacks are dropped."""
    corpus = docs if corpus is None else corpus
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    known = idf(corpus, "id" if "id" in corpus.columns else key, tokens)
    return term_counts(docs, key, tokens).join(known, "term").select(key, "term", (tf * F.col("idf")).alias("weight"))


def bm25_search(docs: DataFrame, terms: Sequence[str], key: str = "id", tokens: str = "tokens", require_all: bool = False, prefix: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key, score`` of the documents with any (or all) of the terms, given as whole tokens or prefixes.

    Only postings of the query's terms are made: each row keeps the tokens that match, so nothing but matches is grouped.
    """
    hits = lambda t: F.filter(tokens, (lambda w: F.startswith(w, F.lit(t))) if prefix else (lambda w: w == t))
    counts = F.array(*(F.size(hits(t)) for t in terms))
    rows = docs.select(key, F.size(tokens).alias("len"), counts.alias("tf"))
    stats = rows.agg(
        F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *(F.sum((F.get("tf", F.lit(i)) > 0).cast("int")).alias(f"df{i}") for i in range(len(terms)))
    )
    scored = rows.where(F.forall("tf", lambda n: n > 0) if require_all else F.exists("tf", lambda n: n > 0)).crossJoin(F.broadcast(stats))
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.get("tf", F.lit(i))
        total = total + F.when(tf > 0, bm25_idf(F.col("n_docs"), F.col(f"df{i}")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).otherwise(0.0)
    return scored.select(key, total.alias("score"))


def sparse_similarity(a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Cosine of all pairs of sparse vectors that share a term: ``a_key, b_key, score``. Terms meet by an equi-join."""
    length = lambda x, k: x.groupBy(k).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"norm_{k}"))
    products = a.select(a_key, "term", F.col("weight").alias("wa")).join(b.select(b_key, "term", F.col("weight").alias("wb")), "term")
    dots = products.groupBy(a_key, b_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    scale = F.col(f"norm_{a_key}") * F.col(f"norm_{b_key}")
    return dots.join(length(a, a_key), a_key).join(length(b, b_key), b_key).select(a_key, b_key, F.when(scale > 0, F.col("dot") / scale).otherwise(0.0).alias("score"))


def sparse_map(weights: DataFrame, key: str = "id") -> DataFrame:
    return weights.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "weight")))).alias("weights"))


def top_terms(weights: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k heaviest terms of each vector, ties by term."""
    from pyspark.sql import Window

    ranked = weights.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term")))
    return ranked.where(F.col("rank") <= k)
