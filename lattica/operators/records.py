"""Record kinds of a store: documents, sessions, messages, banks, observations, graph nodes and edges, and changes in batches.

Like ``store``, every operator takes the old DataFrame and returns the new one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import store as St


def get_by_doc(rows: DataFrame, doc: object, key: str = "id", created: str = "created_at") -> DataFrame:
    """Rows of a document, oldest first."""
    return rows.where(F.col("doc_id") == doc).orderBy(created, key)


def document_ids(rows: DataFrame) -> DataFrame:
    """Distinct document ids that are neither null nor empty, sorted."""
    return rows.select("doc_id").where(F.col("doc_id").isNotNull() & (F.col("doc_id").cast("string") != "")).distinct().orderBy("doc_id")


def clear(rows: DataFrame, docs: Sequence | None = None) -> DataFrame:
    """Rows without those of some documents; without any rows if none are named."""
    return rows.limit(0) if docs is None else St.delete_by_doc(rows, docs)


def save_documents(documents: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Documents after full overwrites: a new id gets ``created_at``, any gets ``updated_at``; metadata and ACL come as they are given."""
    now = F.current_timestamp() if now is None else now
    old = documents.select("id", F.col("created_at").alias("_c"))
    stamped = new.drop("created_at", "updated_at").join(old, "id", "left")
    stamped = stamped.withColumn("created_at", F.coalesce("_c", now)).withColumn("updated_at", now).drop("_c")
    return St.upsert(documents, stamped.select(*documents.columns))


def list_collections(collections: DataFrame) -> DataFrame:
    """Collections, newest first."""
    return collections.orderBy(F.desc("created_at"), "name")


def add_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions with new ones; a session that is there already stays as it is."""
    return St.insert_missing(sessions, new.dropDuplicates(["id"]))


def add_messages(messages: DataFrame, sessions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and sessions after appending messages of known sessions, each session touched at its last message."""
    known = new.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi").select(*new.columns)
    last = known.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("_last"))
    touched = sessions.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")
    return messages.unionByName(known, allowMissingColumns=True), touched.select(*sessions.columns)


def messages_with_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with their session's user."""
    return messages.join(sessions.select(F.col("id").alias("session_id"), "user_id"), "session_id")


def save_banks(banks: DataFrame, new: DataFrame) -> DataFrame:
    """Banks after creating some; traits outside 1 to 5 stop the job, absent ones are 3."""
    traits = ("skepticism", "literalism", "empathy")
    valid = {t: F.when(F.coalesce(F.col(t), F.lit(3)).between(1, 5), F.coalesce(F.col(t), F.lit(3))).otherwise(F.raise_error(F.lit(f"{t} must be between 1 and 5")).cast("int")) for t in traits}
    return St.upsert(banks, new.withColumns(valid).select(*banks.columns))


def list_banks(banks: DataFrame) -> DataFrame:
    return banks.orderBy("id")


def delete_bank(banks: DataFrame, memories: DataFrame, bank: object) -> tuple[DataFrame, DataFrame]:
    """Banks and memories without a bank and its memories."""
    return St.delete_where(banks, F.col("id") == bank), St.delete_where(memories, F.col("bank_id") == bank)


def save_observations(memories: DataFrame, found: DataFrame, bank: object, now: Column | None = None) -> DataFrame:
    """Memories with the observations of ``observe`` as memories of type observation; the same finding again replaces the old one."""
    key = F.concat_ws(":", F.lit("observation"), F.lit(bank).cast("string"), "kind", "subject")
    rows = found.select(
        key.alias("id"), F.lit(bank).alias("bank_id"), F.lit("observation").alias("type"), F.concat_ws(": ", "kind", "subject").alias("content"), "confidence",
        F.array("subject").alias("entities"), (F.current_timestamp() if now is None else now).alias("created_at"),
    )
    return St.upsert(memories, rows.select(*(c for c in rows.columns if c in memories.columns)))


def observations(memories: DataFrame, bank: object) -> DataFrame:
    """A bank's observations with what they were stored with, newest first."""
    return memories.where((F.col("bank_id") == bank) & (F.col("type") == "observation")).orderBy(F.desc("created_at"), "id")


def retain(memories: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Memories after saving some, and graph nodes with one for every entity they name."""
    kept = new.where(F.col("id").isNotNull())
    if nodes is not None:
        named = kept.select(F.explode("entities").alias("content")).where(F.trim("content") != "").distinct()
        found = named.select(F.concat(F.lit("entity:"), F.lower(F.trim("content"))).alias("id"), F.lit("entity").alias("node_type"), "content").dropDuplicates(["id"])
        nodes = St.insert_missing(nodes, found)
    return St.upsert(memories, kept.select(*memories.columns)), nodes


@dataclass(frozen=True)
class GraphChange:
    """Rows to write and ids to delete, of nodes and edges."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    gone_nodes: DataFrame | None = None
    gone_edges: DataFrame | None = None


def valid_node(row_vector: str | None = None) -> Column:
    ok = F.col("id").isNotNull() & (F.trim(F.col("id").cast("string")) != "")
    return ok if row_vector is None else ok & V.is_valid(F.col(row_vector))


def change_graph(nodes: DataFrame, edges: DataFrame, change: GraphChange) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and one row (succeeded, failed) after a mixed batch: node writes, edge writes, edge deletes, node deletes with their edges.

    A node needs an id, an edge an id and both ends. All tables come from the same inputs, so a caller that writes them together changes all or nothing.
    """
    counts = nodes.sparkSession.createDataFrame([(0, 0)], "succeeded bigint, failed bigint")

    def counted(rows: DataFrame, ok: Column) -> DataFrame:
        nonlocal counts
        good = F.coalesce(ok, F.lit(False))
        counts = counts.unionByName(rows.agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed")))
        return rows.where(good)

    if change.nodes is not None:
        nodes = St.upsert(nodes, counted(change.nodes, valid_node()).dropDuplicates(["id"]))
    if change.edges is not None:
        ends = nodes.select("id")
        rows = change.edges.join(ends.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ends.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
        good = counted(rows, valid_node() & F.col("_s") & F.col("_d")).drop("_s", "_d")
        edges = St.upsert(edges, good.dropDuplicates(["id"]).select(*edges.columns))
    if change.gone_edges is not None:
        edges = St.delete_ids(edges, counted(change.gone_edges, F.col("id").isNotNull()))
    if change.gone_nodes is not None:
        nodes, edges = drop_nodes(nodes, edges, counted(change.gone_nodes, F.col("id").isNotNull()))
    return nodes, edges, counts.agg(F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"))


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph without some nodes and the edges at them."""
    ids = gone.select("id").distinct()
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return St.delete_ids(nodes, gone), edges


def check_query(rows: DataFrame, query: Sequence[float], vector: str = "vector") -> Sequence[float]:
    """The query vector if it is valid and of the rows' size; a store without rows takes any."""
    if not query or any(x != x or x in (float("inf"), float("-inf")) for x in query):
        raise ValueError("a query vector needs finite numbers")
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if first and first[0] != len(query):
        raise ValueError(f"the query has {len(query)} dimensions, the rows {first[0]}")
    return query


def text_weight(asked: float, configured: float, has_similarity: bool) -> float:
    """Weight of text in a search: the one asked for, at most 1; else the configured one if texts can be compared; else 0."""
    return min(asked, 1.0) if asked > 0 else configured if has_similarity else 0.0


def mean_vector(rows: DataFrame, by: Sequence[str] = (), vector: str = "vector") -> DataFrame:
    """``by, vector``: element-wise mean; shorter vectors count as padded with zeros."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    long = rows.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    joined = long.join(sizes, [*by]) if by else long.crossJoin(F.broadcast(sizes))  # a single row
    means = joined.select(*by, F.struct("pos", (F.col("s") / F.col("_n")).alias("m")).alias("x"))
    return means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.m).alias("vector"))


def info(rows: DataFrame, name: str, dimensions: int = 0, similarity: str = "cosine", vector: str = "vector") -> DataFrame:
    """One row about a store: name, configured dimension (else the most frequent one), similarity, number of rows."""
    sizes = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.max_by("d", F.struct("n", (-F.col("d")).alias("less"))).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"))
    dims = F.when(F.lit(dimensions > 0), F.lit(dimensions)).otherwise(F.coalesce("d", F.lit(0)))
    return found.select(F.lit(name).alias("name"), dims.cast("int").alias("dimensions"), F.lit(similarity).alias("similarity"), "vectors")


def add_vectors(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with new ones, given without id: each gets a random UUID."""
    return rows.unionByName(new.withColumn("id", F.expr("uuid()")), allowMissingColumns=True)


Embedder = Callable[[Column], Column]


def insert_texts(rows: DataFrame, texts: DataFrame, embed: Embedder, collection: str | None = None) -> DataFrame:
    """Rows after saving ``texts(id, content, ...)`` with their embeddings; an empty text stops the job."""
    checked = F.when(F.trim("content") != "", F.col("content")).otherwise(F.raise_error(F.lit("a text is empty")).cast("string"))
    new = texts.withColumn("content", checked).withColumn("vector", embed(F.col("content")))
    new = new if collection is None else new.withColumn("collection", F.lit(collection))
    return St.upsert(rows, new.select(*(c for c in new.columns if c in rows.columns)))


def embedded(rows: DataFrame, text: str, embed: Embedder) -> list[float]:
    """The embedding of one text."""
    return rows.sparkSession.range(1).select(F.lit(text).alias("t")).select(embed(F.col("t")).alias("v")).first()["v"]


def embed_cached(rows: DataFrame, cache: DataFrame, embed: Embedder, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Rows with ``vector``, and the cache ``text, vector`` with what was new: every distinct text is embedded once and never again."""
    new = rows.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct().join(cache.select("text"), "text", "left_anti")
    cache = cache.unionByName(new.withColumn("vector", embed(F.col("text"))))
    return rows.join(cache.withColumnRenamed("text", text), text, "left"), cache
