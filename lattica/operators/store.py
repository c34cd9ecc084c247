"""Records on immutable tables: merge, delete, cascade, collections, documents, sessions and messages.

Every change takes the old DataFrame and returns the new one; a caller writes it where it belongs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The row of greatest version of each key, by a pre-aggregated maximum."""
    tie = F.xxhash64(*(F.to_json(c) if t.startswith(("map<", "struct<", "array<")) else F.col(c) for c, t in rows.dtypes))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(version), tie)).alias("row"))
    return best.select(*(F.col("row")[c].alias(c) for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` in place of those with the same key; keys in ``new`` are unique."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*new.columns), allowMissingColumns=True)


def delete_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; where it is unknown they stay."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def delete_by_doc(rows: DataFrame, docs: Sequence, key: str = "doc_id") -> DataFrame:
    return delete_where(rows, F.col(key).isin(*docs))


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those of ``gone``."""
    return delete_ids(parents, gone, key), children.join(gone.select(F.col(key).alias(child_key)).distinct(), child_key, "left_anti")


def fetch(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def of_type(rows: DataFrame, kind: str, metadata: str = "metadata", created: str = "created_at") -> DataFrame:
    return rows.where(F.element_at(metadata, "type") == kind).orderBy(created)


def with_collections(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """Rows with their collection's name; rows without a collection stay."""
    names = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection"))
    return rows.join(names, "collection_id", "left")


def in_collection(rows: DataFrame, collections: DataFrame, name: str) -> DataFrame:
    """Rows of a collection; an unknown name has none."""
    return rows.join(collections.where(F.col("name") == name).select(F.col("id").alias("collection_id")), "collection_id", "left_semi")


def create_collection(collections: DataFrame, name: str, dimensions: int = 0) -> DataFrame:
    if dimensions < 0:
        raise ValueError("dimensions must not be negative")
    if collections.where(F.col("name") == name).limit(1).count():
        raise ValueError(f"collection {name} exists")
    new = collections.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(name).alias("name"), F.lit(dimensions).alias("dimensions"), F.current_timestamp().alias("created_at"))
    return collections.unionByName(new, allowMissingColumns=True)


def list_documents(documents: DataFrame, author: str | None = None, limit: int = 0) -> DataFrame:
    """Documents of an author, newest first; a limit of 0 gives none."""
    return (documents.where(F.col("author") == author) if author else documents).orderBy(F.desc("created_at"), "id").limit(limit)


def history(messages: DataFrame, n: int, session: str = "session_id", order: str = "created_at", key: str = "id") -> DataFrame:
    """The newest n messages of every session, in chronological order."""
    newest = Window.partitionBy(session).orderBy(F.desc(order), F.desc(key))
    return messages.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r").orderBy(session, order, key)


def window_triggers(messages: DataFrame, every: int = 2, window: int = 6, role: str | None = "user", session: str = "session_id", order: str = "created_at", key: str = "id") -> DataFrame:
    """``session, n, ids``: at every ``every``-th message of the role, the last ``window`` messages of the session up to it."""
    line = Window.partitionBy(session).orderBy(order, key)
    counts = F.col("role") == role if role else F.lit(True)
    seen = messages.withColumn("n", F.sum(counts.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("ids", F.collect_list(key).over(line.rowsBetween(1 - window, 0)))
    return seen.where(counts & (F.col("n") % every == 0)).select(session, "n", "ids")
