"""Aggregation over metadata, facet counts and statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import compare

KINDS = ("count", "sum", "avg", "min", "max")


def number(value: Column) -> Column:
    """The value as a number; null if it isn't one."""
    return value.cast("string").try_cast("double")


def aggregate(
    rows: DataFrame, kind: str, value: Column | None = None, by: Mapping[str, Column] | None = None, filters: Sequence[tuple[Column, Any]] = (),
    having: Mapping[str, Any] | None = None, order_by: str = "count", limit: int = 0,
) -> DataFrame:
    """Columns of ``by``, ``count`` and, but for count, ``value``. Sums without rows are 0. Groups come in descending order of ``order_by``."""
    if kind not in KINDS:
        raise ValueError(f"unknown aggregation {kind}")
    if kind != "count" and value is None:
        raise ValueError(f"{kind} needs a field")
    if by is not None and not by:
        raise ValueError("grouping needs keys")
    kept = rows.where(reduce(and_, (F.coalesce(compare(c, "=", v), F.lit(False)) for c, v in filters))) if filters else rows
    measures = []
    if kind == "count":
        measures.append(F.count("*").alias("count"))
    else:
        kept = kept.where(value.isNotNull())
        x = number(value)
        found = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind](x)
        measures += [F.count("*").alias("count"), (F.coalesce(found, F.lit(0.0)) if kind == "sum" else found).alias("value")]
    if by is None:
        return kept.agg(*measures)
    out = kept.groupBy(*(c.alias(n) for n, c in by.items())).agg(*measures)
    for name, wanted in (having or {}).items():
        out = out.where(F.col(name) == wanted)
    out = out.orderBy(F.desc(order_by), *by)
    return out.limit(limit) if limit > 0 else out


def facet_counts(rows: DataFrame, fields: Mapping[str, Column], limit: int = 10) -> DataFrame:
    """``field, value, count, total`` of each field's most frequent values (ties by value); all fields in one pass. Total: of the values shown."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items())))
    counts = rows.select(pairs.alias("f")).select("f.field", "f.value").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("count"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))).where(F.col("r") <= limit)
    return top.withColumn("total", F.sum("count").over(Window.partitionBy("field"))).drop("r")


def document_info(chunks: DataFrame, key: str = "doc_id", created: str = "created_at") -> DataFrame:
    some = chunks.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return some.groupBy(key).agg(F.count("*").alias("count"), F.min(created).alias("first"), F.max(created).alias("last"))


def collection_stats(rows: DataFrame, vector: str = "vector", created: Column | None = None) -> DataFrame:
    """Rows, bytes of their vectors (4 for the length and 4 per component) and latest creation."""
    size = F.coalesce(F.sum(4 + 4 * F.size(vector).cast("bigint")), F.lit(0))
    return rows.agg(F.count("*").alias("count"), size.alias("bytes"), F.max(F.lit(None).cast("timestamp") if created is None else created).alias("last"))


def dimension_analysis(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: vectors, distinct sizes, most frequent size (ties: the least) and whether a migration is due (below 80 % of one size)."""
    sizes = rows.groupBy(F.size(vector).cast("bigint").alias("dim")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("sizes"), F.max(F.struct("n", (-F.col("dim")).alias("d"))).alias("top"))
    due = (F.col("sizes") > 1) & (F.col("top.n") < 0.8 * F.col("total"))
    return found.select("total", "sizes", (-F.col("top.d")).alias("primary_dim"), F.coalesce(due, F.lit(False)).alias("needs_migration"))


def json_value(column: str) -> Callable[[str], Column]:
    """Values of a JSON text column by key; null for bad or empty JSON."""
    return lambda key: F.get_json_object(F.col(column), f"$.{key}")
