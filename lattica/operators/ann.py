"""Approximate search and quantization: IVF, LSH, scalar, binary and product codes, combination of indexes.

An index is a DataFrame that can be written and pruned: IVF by centroid, LSH by table and hash. ``indexes`` has the
stored forms, with graphs inside the cells.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors as V
from ..session import cut
from .search import QUERY_LIMIT, QUERY_TILE, ROW_TILE, _matrix, batch_knn

NEAR_CELLS = 2_000_000  # numbers of a matrix of distances


def train_centroids(rows: DataFrame, k: int = 100, vector: str = "vector", seed: int = 42, iterations: int = 20, cosine: bool = False) -> np.ndarray:
    """k-means centroids, k-means|| start, seeded."""
    data = rows.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, maxIter=iterations, seed=seed, initMode="k-means||", distanceMeasure="cosine" if cosine else "euclidean").fit(data)
    return np.array(model.clusterCenters())


def assign(rows: DataFrame, centroids: np.ndarray, vector: str = "vector", column: str = "centroid") -> DataFrame:
    """Rows with their nearest centroid's number (ties: the least). The table is what an IVF index stores, partitioned by that column."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def nearest(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = sent.value
        for values in series:
            x = np.array(values.tolist(), np.float64).reshape(len(values), -1)
            yield pd.Series(np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, axis=1).astype(np.int32))

    return rows.withColumn(column, nearest(F.col(vector)))


def probes(query: Sequence[float], centroids: np.ndarray, n: int = 10) -> list[int]:
    gaps = ((centroids - np.array(query, np.float64)[None, :]) ** 2).sum(1)
    return np.argsort(gaps, kind="stable")[:n].tolist()


def ivf_search(index: DataFrame, centroids: np.ndarray, query: Sequence[float], k: int = 10, n_probe: int = 10, vector: str = "vector", key: str = "id") -> DataFrame:
    """Exact distances within the nearest clusters; an index partitioned by centroid reads only those."""
    inside = index.where(F.col("centroid").isin(probes(query, centroids, n_probe)))
    return inside.withColumn("distance", V.distance(F.col(vector), query)).orderBy("distance", key).limit(k)


class _Near:
    """The k nearest rows of each query among those seen, by exact distances, ties by key.

    Matrix products leave out what is surely farther than the k nearest; distances of the rest are sums of squared differences.
    """

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int) -> None:
        self.own, self.q, self.k, self.squares = own, q, k, (q**2).sum(1)
        self.far = np.full(len(own), np.inf)  # squared distance beyond which a row is not among the k nearest
        self.at, self.gap, self.id = np.zeros(0, np.int64), np.zeros(0), own[:0]

    def see(self, names: np.ndarray, data: np.ndarray, who: np.ndarray) -> None:
        """Rows, and the queries that ask for them."""
        step = max(1, NEAR_CELLS // max(len(who), 1))
        for lo in range(0, len(names) if len(who) else 0, step):
            x, ids = data[lo : lo + step], names[lo : lo + step]
            squares = (x**2).sum(1)
            s = squares[None, :] - 2 * (self.q[who] @ x.T)
            slack = 1e-12 * (self.squares[who] + squares.max())  # more than rounding can be off
            bound = self.far[who] - self.squares[who]
            if len(x) > self.k and np.isinf(bound).any():
                bound = np.minimum(bound, np.partition(s, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero(s <= (bound + 2 * slack)[:, None])
            at, gap, found = [self.at], [self.gap], [self.id]
            for part in range(0, len(i), 65536):
                w, r = who[i[part : part + 65536]], j[part : part + 65536]
                d = self.q[w] - x[r]
                at.append(w)
                gap.append(np.einsum("ij,ij->i", d, d))
                found.append(ids[r])
            at, gap, found = map(np.concatenate, (at, gap, found))
            order = np.lexsort((found, gap, at))
            at, gap, found = at[order], gap[order], found[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            self.far[at[place == self.k - 1]] = gap[place == self.k - 1]
            kept = place < self.k
            self.at, self.gap, self.id = at[kept], gap[kept], found[kept]

    def found(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if len(self.at):
            yield pa.RecordBatch.from_arrays([pa.array(self.own[self.at], schema.types[0]), pa.array(self.id, schema.types[1]), pa.array(np.sqrt(self.gap))], schema=schema)


def _sized(lists: pa.Array, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and vectors of the rows whose vector has this size."""
    return _matrix(pa.array(np.arange(len(lists))), lists, size)


def ivf_search_many(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, n_probe: int = 10, key: str = "id", vector: str = "vector", query_limit: int = QUERY_LIMIT) -> DataFrame:
    """``query_id, id, distance, rank``: queries meet the rows of the cells they probe, by matrix products.

    Up to ``query_limit`` queries, which are counted first, go to all tasks: one scan, and k rows per query and task are
    shuffled. More meet each cell in a grid of tiles by an equi-join.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"))
    r = index.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col("centroid").cast("int").alias("cell"))
    made = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("id", r.schema["id"].dataType), StructField("distance", DoubleType())])
    shape = to_arrow_schema(made)
    one = lambda column: column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    plain = lambda column: column.to_numpy(zero_copy_only=False)

    def nearest_cells(matrix: np.ndarray) -> np.ndarray:
        return np.argsort((centroids**2).sum(1)[None, :] - 2 * matrix @ centroids.T, axis=1, kind="stable")[:, :n_probe]

    head = q.limit(query_limit + 1).toArrow()  # bounded
    if head.num_rows <= query_limit:
        rows, matrix = _sized(one(head.column(1)), None)
        own = plain(one(head.column(0)))[rows]
        cells = nearest_cells(matrix) if len(own) else np.zeros((0, 1), np.int64)
        asking = {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}
        sent = spark.sparkContext.broadcast((own, matrix, asking))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, matrix, asking = sent.value
            best = _Near(own, matrix, k)
            for batch in batches:
                rows, data = _sized(batch.column(1), matrix.shape[1])
                names, cell = plain(batch.column(0))[rows], plain(batch.column(2))[rows]
                for c in np.unique(cell).tolist():
                    best.see(names[cell == c], data[cell == c], asking[c])
            yield from best.found(shape)

        found = r.where(F.col("cell").isin(*asking)).mapInArrow(run, made)
    else:

        @F.pandas_udf("array<int>")
        def probed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in series:
                yield pd.Series(nearest_cells(np.array(values.tolist(), np.float64).reshape(len(values), -1)).astype(np.int32).tolist())

        asked = q.select("query_id", "q", F.explode(probed("q")).alias("cell"))
        tiles = lambda df, size: dict(df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int")).collect())  # noqa: E731  a number per cell
        across, down = tiles(asked, QUERY_TILE), tiles(r, ROW_TILE)
        many = lambda of: F.get(F.array(*(F.lit(of.get(c, 0)) for c in range(len(centroids)))), F.col("cell"))
        tile = lambda name, of, salt: F.pmod(F.xxhash64(name, F.lit(salt)), many(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), many(of) - 1))
        both = [c for c in across if c in down]
        left = asked.where(F.col("cell").isin(*both)).withColumn("tx", tile("query_id", across, 1)).select("*", every(down).alias("ty"))
        right = r.where(F.col("cell").isin(*both)).withColumn("ty", tile("id", down, 2)).select("*", every(across).alias("tx"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            best_of = []
            if a.num_rows and b.num_rows:
                rows, matrix = _sized(one(a.column("q")), None)
                best = _Near(plain(one(a.column("query_id")))[rows], matrix, k)
                rows, data = _sized(one(b.column("v")), matrix.shape[1])
                best.see(plain(one(b.column("id")))[rows], data, np.arange(len(matrix)))
                best_of = [*best.found(shape)]
            return pa.Table.from_batches(best_of, shape)

        found = left.groupBy("cell", "tx", "ty").cogroup(right.groupBy("cell", "tx", "ty")).applyInArrow(meet, made)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k).withColumnRenamed("id", key)


def cluster_stats(index: DataFrame) -> DataFrame:
    sizes = index.groupBy("centroid").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.sum("n").alias("vectors"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


@dataclass(frozen=True)
class Lsh:
    """Sign hashes of seeded Gaussian hyperplanes: ``tables`` hashes of ``bits`` bits."""

    dim: int
    tables: int = 10
    bits: int = 8
    seed: int = 42

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.tables, self.bits, self.dim))

    def _keys(self, x: np.ndarray, flips: int = 0) -> np.ndarray:
        """Bucket keys (table << bits | hash) of rows; with ``flips``, also those with one of the least certain bits flipped."""
        projected = np.einsum("nd,tbd->ntb", x, self.planes())
        hashes = ((projected > 0) << np.arange(self.bits)).sum(-1)
        tables = np.arange(self.tables) << self.bits
        keys = [hashes | tables]
        for i in range(min(flips, self.bits)):
            bit = np.argsort(np.abs(projected), axis=-1)[..., i]
            keys.append((hashes ^ (1 << bit)) | tables)
        return np.concatenate(keys, axis=1)

    def index(self, rows: DataFrame, key: str = "id", vector: str = "vector", flips: int = 0) -> DataFrame:
        """``key, vector, bucket``: a row per table (and flip)."""

        @F.pandas_udf("array<bigint>")
        def keys(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in series:
                yield pd.Series(self._keys(np.array(values.tolist(), np.float64).reshape(len(values), -1), flips).tolist())

        return rows.select(key, vector, F.explode(keys(vector)).alias("bucket"))

    def reach(self, x: np.ndarray, flips: int = 0) -> tuple[np.ndarray, list[list[int]]]:
        """For each query the distance within which all rows are sure to lie in some table's probed buckets, and these buckets.

        A row beyond a hyperplane is no nearer than that plane. A flip covers a table's nearest plane.
        """
        planes = self.planes()
        gaps = np.sort(np.abs(np.einsum("nd,tbd->ntb", x, planes)) / np.linalg.norm(planes, axis=-1), axis=-1)
        nearest = gaps[..., min(flips, 1)] if flips < 1 or self.bits > 1 else np.full(gaps.shape[:2], np.inf)
        best, at = nearest.argmax(-1), np.arange(len(x))
        keys = self._keys(x, min(flips, 1)).reshape(len(x), -1, self.tables)
        return nearest[at, best] * (1 - 1e-9), keys[at, :, best].tolist()

    def search(self, index: DataFrame, queries: DataFrame, k: int = 10, flips: int = 0, key: str = "id", vector: str = "vector") -> DataFrame:
        """``query_id, id, distance, rank``: the k nearest rows by exact Euclidean distance.

        The buckets of a query's table of farthest reach answer it if they have k rows within that reach (no other table
        adds one); the other queries are short of candidates and go on to exact search.
        """

        @F.pandas_udf("reach double, buckets array<bigint>")
        def probed(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for values in series:
                reach, buckets = self.reach(np.array(values.tolist(), np.float64).reshape(len(values), -1), flips)
                yield pd.DataFrame({"reach": reach, "buckets": buckets})

        q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q"), probed(vector).alias("p")).select("query_id", "q", "p.reach", F.explode("p.buckets").alias("bucket"))
        pairs = index.join(q, "bucket").select("query_id", key, V.distance(F.col(vector), F.col("q")).alias("distance"), "reach")
        inside = pairs.where("distance < reach").drop("reach").distinct()
        ranked = Window.partitionBy("query_id").orderBy("distance", key)
        sure = inside.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        sure = cut(sure.withColumn("found", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("found") == k).drop("found"))
        short = queries.join(sure.select(F.col("query_id").alias(key)).distinct(), key, "left_anti")
        rows = index.where(F.col("bucket") < 1 << self.bits).select(key, vector).dropDuplicates([key])
        near = batch_knn(short, rows, k, "euclidean", key, vector).select("query_id", F.col("id").alias(key))
        near = near.join(rows, key).join(short.select(F.col(key).alias("query_id"), F.col(vector).alias("q")), "query_id")
        near = near.select("query_id", key, V.distance(F.col(vector), F.col("q")).alias("distance")).withColumn("rank", F.row_number().over(ranked))
        return sure.unionByName(near)


def bucket_stats(index: DataFrame) -> DataFrame:
    sizes = index.groupBy("bucket").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("buckets"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def scalar_ranges(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """``pos, lo, hi`` of every dimension; equal ends are set 1e-6 apart."""
    long = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    return long.withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1e-6).otherwise(F.col("hi")))


def _per_position(ranges: DataFrame, name: str) -> list[float]:
    return [r[0] for r in ranges.orderBy("pos").select(name).collect()]  # one number per dimension


def scalar_encode(rows: DataFrame, ranges: DataFrame, bits: int = 8, vector: str = "vector", column: str = "code") -> DataFrame:
    """Components clamped to their range and truncated to ``bits`` bits."""
    lo, hi = V.literal(_per_position(ranges, "lo")), V.literal(_per_position(ranges, "hi"))
    top = (1 << bits) - 1
    unit = lambda x, i: (x.cast("double") - F.get(lo, i)) / (F.get(hi, i) - F.get(lo, i))
    return rows.withColumn(column, F.transform(vector, lambda x, i: F.floor(F.least(F.greatest(unit(x, i), F.lit(0.0)), F.lit(1.0)) * top).cast("int")))


def scalar_decode(rows: DataFrame, ranges: DataFrame, bits: int = 8, code: str = "code", column: str = "decoded") -> DataFrame:
    lo, hi = V.literal(_per_position(ranges, "lo")), V.literal(_per_position(ranges, "hi"))
    top = float((1 << bits) - 1)
    return rows.withColumn(column, F.transform(code, lambda c, i: F.get(lo, i) + c / top * (F.get(hi, i) - F.get(lo, i))))


def pack_bits(codes: Sequence[int], bits: int) -> bytes:
    """Codes of ``bits`` bits each, least significant bit first."""
    total = sum(c << bits * i for i, c in enumerate(codes))
    return total.to_bytes((len(codes) * bits + 7) // 8, "little")


def unpack_bits(data: bytes, bits: int, n: int) -> list[int]:
    total = int.from_bytes(data, "little")
    return [total >> bits * i & (1 << bits) - 1 for i in range(n)]


def binary_thresholds(rows: DataFrame, vector: str = "vector") -> list[float]:
    long = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return _per_position(long, "mean")


def binary_encode(rows: DataFrame, thresholds: Sequence[float], vector: str = "vector", column: str = "code") -> DataFrame:
    """Bit i is set where component i exceeds its threshold; 64 components to a number."""
    words = []
    for start in range(0, len(thresholds), 64):
        word = F.lit(0).cast("bigint")
        for i, t in enumerate(thresholds[start : start + 64]):
            word = word.bitwiseOR(F.when(F.get(F.col(vector), F.lit(start + i)).cast("double") > t, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        words.append(word)
    return rows.withColumn(column, words[0] if len(words) == 1 else F.array(*words))


def binary_search(rows: DataFrame, code: int, k: int = 10, column: str = "code", key: str = "id") -> DataFrame:
    return rows.withColumn("distance", V.hamming(F.col(column), code)).orderBy("distance", key).limit(k)


def random_projection(dim: int, out: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((out, dim)) / np.sqrt(dim)


def project(v: Column, matrix: np.ndarray) -> Column:
    return F.transform(F.array(*(V.literal(row.tolist()) for row in matrix)), lambda row: V.dot(v, row))


@dataclass(frozen=True)
class ProductQuantizer:
    """``books[m]`` has the centroids of subspace m."""

    books: np.ndarray

    @classmethod
    def train(cls, rows: DataFrame, parts: int = 8, k: int = 16, vector: str = "vector", seed: int = 42) -> ProductQuantizer:
        dim = len(rows.select(vector).first()[0])
        if dim % parts:
            raise ValueError("the dimension is no multiple of the parts")
        step = dim // parts
        cuts = [rows.select(F.slice(vector, m * step + 1, step).alias("v")) for m in range(parts)]
        return cls(np.stack([train_centroids(c, k, "v", seed + m) for m, c in enumerate(cuts)]))

    def encode(self, rows: DataFrame, vector: str = "vector", column: str = "code") -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(self.books)

        @F.pandas_udf("array<int>")
        def codes(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            books = sent.value
            for values in series:
                x = np.array(values.tolist(), np.float64).reshape(len(values), len(books), -1)
                yield pd.Series(np.stack([np.argmin(((x[:, m, None, :] - b[None]) ** 2).sum(-1), 1) for m, b in enumerate(books)], 1).astype(np.int32).tolist())

        return rows.withColumn(column, codes(F.col(vector)))

    def decode(self, codes: Sequence[int]) -> list[float]:
        return np.concatenate([self.books[m, c] for m, c in enumerate(codes)]).tolist()

    def search(self, coded: DataFrame, query: Sequence[float], k: int = 10, column: str = "code", key: str = "id", squared: bool = False) -> DataFrame:
        """Asymmetric distances from a table per query: the sum of the subspaces' distances, or the root of their squares' sum."""
        q = np.array(query, np.float64).reshape(len(self.books), 1, -1)
        squares = ((self.books - q) ** 2).sum(-1)
        table = F.array(*(V.literal((row if squared else np.sqrt(row)).tolist()) for row in squares))
        total = F.aggregate(F.transform(column, lambda c, m: F.get(F.get(table, m), c)), F.lit(0.0), lambda a, x: a + x)
        return coded.withColumn("distance", F.sqrt(total) if squared else total).orderBy("distance", key).limit(k)

    def rows(self) -> list[tuple[int, int, list[float]]]:
        """Codebook rows (part, code, centroid) to store."""
        return [(m, c, self.books[m, c].tolist()) for m, c in itertools.product(range(self.books.shape[0]), range(self.books.shape[1]))]


def combine(primary: DataFrame, others: Sequence[DataFrame], how: str = "merge", k: int = 10, key: str = "id") -> DataFrame:
    """Results ``key, distance`` of several indexes: primary, merge (least distance), rerank (mean of the others'; unseen last), vote (count, then mean less 0.1 a vote), fill."""
    if how == "primary":
        out = primary.select(key, F.col("distance").alias("score"))
        return out.orderBy("score", key).limit(k)
    united = primary.select(key, "distance", F.lit(0).alias("n"))
    for n, other in enumerate(others, 1):
        united = united.unionByName(other.select(key, "distance", F.lit(n).alias("n")))
    found = united.groupBy(key).agg(
        F.min("distance").alias("least"), F.avg("distance").alias("mean"), F.count("*").alias("votes"), F.avg(F.when(F.col("n") > 0, F.col("distance"))).alias("second"),
        F.count_if(F.col("n") == 0).alias("first"), F.min_by("distance", "n").alias("own"),
    )
    if how == "merge":
        return found.select(key, F.col("least").alias("score")).orderBy("score", key).limit(k)
    if how == "rerank":
        return found.where("first > 0").select(key, F.col("second").alias("score")).orderBy(F.col("score").asc_nulls_last(), key).limit(k)
    if how == "vote":
        score = F.col("mean") - 0.1 * F.col("votes")
        return found.orderBy(F.desc("votes"), score, key).limit(k).select(key, score.alias("score"))
    if how == "fill":  # the first index's results, then the others' up to k, by distance
        chosen = found.orderBy(F.desc("first"), "least", key).limit(k)
        return chosen.select(key, F.col("own").alias("score")).orderBy("score", key)
    raise ValueError(f"unknown combination {how}")
