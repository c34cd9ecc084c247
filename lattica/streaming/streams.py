"""Streams of vectors and messages on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import vectors as V
from ..operators.store import latest


def scored_stream(vectors: DataFrame, query: Sequence[float], threshold: float = 0.0, metric: str = "cosine", vector: str = "vector") -> DataFrame:
    """A stream of vectors with their score against a query."""
    out = vectors.withColumn("score", V.SIMILARITIES[metric](F.col(vector), query))
    return out.where(F.col("score") >= threshold) if threshold > 0 else out


def run_top_k(scored: DataFrame, k: int, sink: Callable[[DataFrame, int], None], key: str = "id", good_enough: float | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Keep the k best rows of a stream, each key once with its best score; ``sink`` gets them after every batch.

    State is k rows. The query stops itself once the k-th score exceeds ``good_enough``.
    """
    best: dict[str, DataFrame] = {}
    handle: dict[str, StreamingQuery] = {}

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(key, "score")
        merged = rows.unionByName(best["rows"]) if "rows" in best else rows
        top = merged.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k).collect()  # k rows
        best["rows"] = batch.sparkSession.createDataFrame(top, rows.schema)
        sink(best["rows"], batch_id)
        if good_enough is not None and len(top) == k and top[-1]["score"] > good_enough and "query" in handle:
            handle["query"].stop()

    writer = scored.writeStream.foreachBatch(each).trigger(availableNow=True)
    handle["query"] = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    return handle["query"]


def merge_streams(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def deduplicated(stream: DataFrame, key: str, event_time: str, late: str = "1 hour") -> DataFrame:
    """First row of each key; state for keys is dropped behind the watermark."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, event_time: str, length: str, by: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, length), by).agg(F.count("*").alias("count"))


class IncrementalTable:
    """A Parquet table that a stream is merged into batch by batch, in parts by a hash of the key.

    A batch rewrites the parts that its keys are in and no others, each into a folder of the batch; then a manifest names
    the folder of every part, so a reader never sees half of a batch and a table can be opened again. The row of the
    greatest version of a key wins, however late or often it comes. Folders that no manifest of the last two names go.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", version: str = "version", parts: int = 16) -> None:
        self.spark, self.path, self.key, self.version, self.parts = spark, path.rstrip("/"), key, version, parts
        self.where: dict[int, str] = {}  # part: folder
        self.before: set[str] = set()
        try:
            last = spark.read.parquet(self.path + "/manifest")
        except AnalysisException:  # a new table
            return
        newest = last.agg(F.max("batch_id")).first()[0]
        self.where = {r["part"]: r["folder"] for r in last.where(F.col("batch_id") == newest).collect()}  # ``parts`` rows

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _folders(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*folders) if folders else None

    def read(self) -> DataFrame | None:
        return self._folders(sorted(self.where.values()))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """A batch that is sent again gives the same table."""
        if any(folder.startswith(f"{self.path}/b{batch_id}/") for folder in self.where.values()):
            return  # its manifest is there
        new = batch.withColumn("_part", self._part()).persist()
        try:
            touched = [r[0] for r in new.select("_part").distinct().collect()]  # at most ``parts``
            old = self._folders([self.where[p] for p in touched if p in self.where])
            rows = new.drop("_part") if old is None else old.unionByName(new.drop("_part"), allowMissingColumns=True)
            merged = latest(rows, self.key, self.version).withColumn("_part", self._part())
            merged.write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/b{batch_id}")
        finally:
            new.unpersist()
        replaced = {self.where[p] for p in touched if p in self.where}
        self.where = self.where | {p: f"{self.path}/b{batch_id}/_part={p}" for p in touched}
        rows = [(batch_id, p, folder) for p, folder in self.where.items()]
        self.spark.createDataFrame(rows, "batch_id bigint, part int, folder string").coalesce(1).write.mode("append").parquet(self.path + "/manifest")
        for folder in self.before - set(self.where.values()):
            self._remove(folder)
        self.before = replaced

    def _remove(self, folder: str) -> None:
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

    def with_pending(self, pending: DataFrame) -> DataFrame:
        """The table as if pending rows had been merged."""
        old = self.read()
        return latest(pending if old is None else old.unionByName(pending, allowMissingColumns=True), self.key, self.version)


def trigger_stream(messages: DataFrame, every: int = 2, window: int = 6, role: str = "user", session: str = "session_id", key: str = "id") -> DataFrame:
    """``session, n, ids``: at every ``every``-th message of the role, the session's last ``window`` messages. State per session: a counter and ``window`` ids."""
    kinds = dict(messages.dtypes)
    out = f"{session} {kinds[session]}, n bigint, ids array<{kinds[key]}>"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ids = state.get if state.exists else (0, [])
        ids = list(ids)
        fired = []
        for rows in batches:
            for row_key, row_role in rows.sort_values(key)[[key, "role"]].itertuples(index=False):
                ids = [*ids, row_key][-window:]
                if row_role == role:
                    n += 1
                    if n % every == 0:
                        fired.append((group[0], n, list(ids)))
        state.update((n, ids))
        yield pd.DataFrame(fired, columns=[session, "n", "ids"])

    return messages.groupBy(session).applyInPandasWithState(step, out, f"n bigint, ids array<{kinds[key]}>", "append", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, with the table's schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")
