"""Vector search: exact top-k, range, negatives, several vectors per entity, hybrid fusion.

A single query is a literal: score and top-k are one pass that keeps k rows per task. Up to ``QUERY_LIMIT`` queries,
which are counted first, go to all tasks: one scan, matrix products, and k rows per query and task are shuffled. More
queries meet the rows in tiles: a grid of blocks of queries and blocks of rows, dealt by an equi-join of tile numbers,
with k rows per query and tile left for the last merge. The plan is of the same size for any number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import vectors as V

DEFAULT_K = 10
QUERY_LIMIT = 8192  # of queries that are broadcast
QUERY_TILE, ROW_TILE = 4096, 65536  # rows of a tile, on average
SCORE_CELLS = 8_000_000  # numbers of a score matrix


def scored(rows: DataFrame, query: Sequence[float], metric: str = "cosine", vector: str = "vector", score: str = "score") -> DataFrame:
    return rows.withColumn(score, V.SIMILARITIES[metric](F.col(vector), query))


def top_k(rows: DataFrame, query: Sequence[float], k: int = DEFAULT_K, metric: str = "cosine", threshold: float = 0.0, where: Column | None = None, vector: str = "vector", key: str = "id") -> DataFrame:
    """The k rows of highest score (10 for k <= 0), ties by key; rows below a positive threshold are left out before."""
    found = scored(rows if where is None else rows.where(where), query, metric, vector)
    if threshold > 0:
        found = found.where(F.col("score") >= threshold)
    return found.orderBy(F.desc("score"), key).limit(k if k > 0 else DEFAULT_K)


def range_search(rows: DataFrame, query: Sequence[float], radius: float, metric: str = "euclidean", k: int = 0, vector: str = "vector", key: str = "id", compat: bool = False) -> DataFrame:
    """Rows within a distance, nearest first. ``compat``: the distance is -score where score <= 0, else 1 - score."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    found = scored(rows, query, metric, vector)
    if compat:
        gap = F.when(F.col("score") <= 0, -F.col("score")).otherwise(1 - F.col("score"))
    else:
        gap = 1 - F.col("score") if metric == "cosine" else -F.col("score")
    found = found.withColumn("distance", gap).where(F.col("distance") <= radius).orderBy("distance", key)
    return found.limit(k) if k > 0 else found


def score_matrix(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    products = queries @ rows.T
    if metric == "dot":
        return products
    q2, r2 = (queries**2).sum(1), (rows**2).sum(1)
    if metric == "euclidean":
        return -np.sqrt(np.maximum(q2[:, None] + r2[None, :] - 2 * products, 0))
    scale = np.sqrt(q2)[:, None] * np.sqrt(r2)[None, :]
    return np.divide(products, scale, out=np.zeros_like(products), where=scale > 0)


def _matrix(names: pa.Array, lists: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows whose vector has this size (None: the first row's)."""
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if size is None:
        size = int(sizes.max()) if len(sizes) else 0
    keep = np.flatnonzero(sizes == size)
    flat = lists.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False)
    return names.to_numpy(zero_copy_only=False)[keep].astype(np.int64), flat.astype(np.float64).reshape(len(keep), size)


class _Best:
    """The k best rows of each query among those seen, or all pairs within a radius."""

    names = ["query_id", "id", "score"]

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int, metric: str, exclude_self: bool, radius: float | None) -> None:
        self.own, self.q, self.k, self.metric, self.exclude_self, self.radius = own, q, k, metric, exclude_self, radius
        self.score, self.id = np.full((len(own), 0), -np.inf), np.zeros((len(own), 0), np.int64)

    def see(self, names: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORE_CELLS // max(len(self.own), 1))
        for at in range(0, len(names), step):
            s = score_matrix(self.q, data[at : at + step], self.metric)
            part = np.broadcast_to(names[at : at + step], s.shape)
            if self.exclude_self:
                s = np.where(part == self.own[:, None], -np.inf, s)
            if self.radius is not None:
                i, j = np.nonzero((1 - s if self.metric == "cosine" else -s) <= self.radius)
                yield pa.RecordBatch.from_arrays([pa.array(self.own[i]), pa.array(names[at : at + step][j]), pa.array(s[i, j])], self.names)
                continue
            if s.shape[1] > 4 * self.k:  # all that can be among the k best, ties included
                least = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1 : self.k]
                some = np.flatnonzero((s >= least).any(axis=0))
                s, part = s[:, some], part[:, some]
            all_score, all_id = np.concatenate([self.score, s], 1), np.concatenate([self.id, part], 1)
            order = np.lexsort((all_id, -all_score), axis=1)[:, : self.k]
            self.score, self.id = np.take_along_axis(all_score, order, 1), np.take_along_axis(all_id, order, 1)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.radius is None and self.score.shape[1]:
            i, j = np.nonzero(self.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(self.own[i]), pa.array(self.id[i, j]), pa.array(self.score[i, j])], self.names)


def batch_knn(queries: DataFrame, rows: DataFrame, k: int = DEFAULT_K, metric: str = "cosine", key: str = "id", vector: str = "vector", exclude_self: bool = False, radius: float | None = None, query_limit: int = QUERY_LIMIT) -> DataFrame:
    """``query_id, id, score, rank`` of the k best rows of every query, or of all rows within a radius.

    Keys are integers. Rows whose vector has another size than the queries' are no candidates.
    """
    schema = StructType([StructField("query_id", LongType()), StructField("id", LongType()), StructField("score", DoubleType())])
    q = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    r = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    head = q.limit(query_limit + 1).toArrow()  # bounded
    if head.num_rows <= query_limit:
        lists = head.column(1).combine_chunks()
        sent = rows.sparkSession.sparkContext.broadcast(_matrix(head.column(0).combine_chunks(), pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists, None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, matrix = sent.value
            best = _Best(own, matrix, k, metric, exclude_self, radius)
            for batch in batches:
                yield from best.see(*_matrix(batch.column(0), batch.column(1), matrix.shape[1]))
            yield from best.found()

        result = r.mapInArrow(run, schema)
    else:
        # Every query goes to one tile of each block of rows, every row to one tile of each block of queries.
        across, down = (max(1, -(-df.count() // size)) for df, size in ((q, QUERY_TILE), (r, ROW_TILE)))
        tile = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = q.select("id", "v", tile(across, 1).alias("tx"), every(down).alias("ty"))
        right = r.select("id", "v", tile(down, 2).alias("ty"), every(across).alias("tx"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            flat = lambda t: [x.combine_chunks() if x.num_chunks != 1 else x.chunk(0) for x in (t.column("id"), t.column("v"))]
            best_of = []
            if a.num_rows and b.num_rows:
                own, matrix = _matrix(*flat(a), None)
                best = _Best(own, matrix, k, metric, exclude_self, radius)
                best_of = [*best.see(*_matrix(*flat(b), matrix.shape[1])), *best.found()]
            return pa.Table.from_batches(best_of, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

        result = left.groupBy("tx", "ty").cogroup(right.groupBy("tx", "ty")).applyInArrow(meet, schema)
    ranked = result.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked if radius is not None else ranked.where(F.col("rank") <= k)


def with_negatives(rows: DataFrame, positives: Sequence[Sequence[float]], negatives: Sequence[Sequence[float]], k: int = 0, weight: float = 0.5, metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """Score: greatest similarity to the positives, at least 0, less ``weight`` times that to the negatives."""
    similar = V.SIMILARITIES[metric]
    most = lambda group: F.greatest(F.lit(0.0), F.lit(0.0), *(similar(F.col(vector), g) for g in group))
    found = rows.withColumn("score", most(positives) - weight * most(negatives)).orderBy(F.desc("score"), key)
    return found.limit(k) if k > 0 else found


def recommend(rows: DataFrame, positive_ids: Sequence, negative_ids: Sequence = (), k: int = 0, metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """Negative-example search by example ids; the examples themselves stay in the result."""
    wanted = rows.where(F.col(key).isin(*positive_ids, *negative_ids)).select(key, vector).collect()  # as many rows as the caller named
    by_id = {r[0]: r[1] for r in wanted}
    pick = lambda ids: [by_id[i] for i in ids if i in by_id]
    return with_negatives(rows, pick(positive_ids), pick(negative_ids), k, 0.5, metric, vector, key)


def anomalies(rows: DataFrame, k: int = 0, neighbours: int = 5, key: str = "id", vector: str = "vector") -> DataFrame:
    """Mean cosine distance to the nearest others, greatest first."""
    near = batch_knn(rows, rows, neighbours, "cosine", key, vector, exclude_self=True)
    found = near.groupBy(F.col("query_id").alias("id")).agg(F.avg(1 - F.col("score")).alias("score")).orderBy(F.desc("score"), "id")
    return found.limit(k) if k > 0 else found


def acl_filter(principals: Sequence[str], acl: str = "acl") -> Column:
    """Rows without a list are public; others need a shared principal."""
    return F.col(acl).isNull() | F.arrays_overlap(F.col(acl), F.array(*(F.lit(p) for p in principals)).cast("array<string>"))


def multi_vector_rows(entities: DataFrame, key: str = "entity_id", vectors: str = "vectors") -> DataFrame:
    """Long form of entities with a map from field to vector: ``id`` is entity___field."""
    long = entities.select(key, F.explode(vectors).alias("field", "vector"))
    return long.withColumn("id", F.concat_ws("___", F.col(key).cast("string"), "field"))


def multi_vector_entities(rows: DataFrame, key: str = "entity_id") -> DataFrame:
    return rows.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "vector")))).alias("vectors"))


def multi_vector_search(rows: DataFrame, queries: dict[str, Sequence[float]], k: int = DEFAULT_K, weights: dict[str, float] | None = None, how: str = "max", metric: str = "cosine", key: str = "entity_id") -> DataFrame:
    """``rows(entity_id, field, vector)``: k best rows of each field, weighted, combined per entity (max, min, sum, average, weighted)."""
    weights = weights or {}
    legs = None
    for field, query in queries.items():
        leg = scored(rows.where(F.col("field") == field), query, metric).orderBy(F.desc("score"), key).limit(k)
        leg = leg.select(key, (F.col("score") * weights.get(field, 1.0)).alias("score"))
        legs = leg if legs is None else legs.unionByName(leg)
    combine = {"max": F.max, "min": F.min, "sum": F.sum, "average": F.avg, "weighted": F.avg}[how]
    return legs.groupBy(key).agg(combine("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def rrf(legs: Sequence[DataFrame], k: float = 60.0, key: str = "id") -> DataFrame:
    """Reciprocal rank fusion of DataFrames with ``key`` and ``rank``."""
    united = legs[0].select(key, "rank")
    for leg in legs[1:]:
        united = united.unionByName(leg.select(key, "rank"))
    return united.groupBy(key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def ranked(rows: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k rows of highest ``score`` with their rank; the window sees k rows."""
    best = rows.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def hybrid(vector_rows: DataFrame, text_rows: DataFrame, k: int = DEFAULT_K, rrf_k: float = 60.0, key: str = "id") -> DataFrame:
    """Fusion of scored vector rows (k best) and scored text rows (3 k best); filters belong to both before."""
    fused = rrf([ranked(vector_rows, k, key), ranked(text_rows, 3 * k, key)], rrf_k, key)
    return fused.orderBy(F.desc("score"), key).limit(k)
