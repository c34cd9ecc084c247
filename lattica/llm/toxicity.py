"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between, hashed to 2**bits
coordinates. Every coordinate has its own learning rate, and L1 keeps most weights at exactly zero, so the
model is a short list of coordinates and weights: at most 2**bits of them, broadcast to all tasks.

Learning is sequential. It runs on the driver over the features of about ``max_rows`` labelled rows and
``max_features`` features (4 bytes each) at most, whichever is less; the rows are chosen by a hash of their id. Every
other step is distributed.

Defined results
  null or empty text      scored by the model's bias alone
  null doc_id             never a training row; held out is false
  null label              not a training row
  no labelled rows        every score is 0.5
  empty table             no rows
  very long text          scored whole, in blocks; as a training row it counts with all its features
  repeated rows           rows are scored each on its own; repeated labels count as often as they stand there
  ties                    a score of exactly the threshold is predicted toxic
  other columns           carried along; a column named as one that this operator adds is replaced
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import materialize, text_blocks, tidied

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII; A-Z count as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class FtrlConfig:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.5
    epochs: int = 4
    max_rows: int = 16_000  # labelled rows that are learned from
    max_features: int = 40_000_000  # of these rows together
    calibrate_every: int = 5  # of the learned rows, each such one sets the scale of the scores instead of weights
    threshold: float = 0.7
    block_bytes: int = 1_000_000


@dataclass(frozen=True)
class FtrlModel:
    coordinates: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0  # of the calibrated log-odds in the sum of the weights


def _features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features of texts, and the text that each belongs to (repeats included)."""
    words = [t.encode("utf-8", "replace").translate(_FOLD).split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((crc32(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        shift = np.uint64(64 - bits)
        a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        one = ((h + np.uint64(1)) * a) >> shift
        two = (((h[:-1] + np.uint64(3)) * a ^ (h[1:] + np.uint64(5)) * b) * a) >> shift
        skip = (((h[:-2] + np.uint64(7)) * a ^ (h[2:] + np.uint64(11)) * c) * a) >> shift
    in_two, in_skip = row[:-1] == row[1:], row[:-2] == row[2:]
    return np.concatenate([one, two[in_two], skip[in_skip]]).astype(np.int64), np.concatenate([row, row[:-1][in_two], row[:-2][in_skip]])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, config: FtrlConfig, eligible: Column) -> DataFrame:
    """``doc_id, y, features`` of at most about ``max_rows`` rows whose ``doc_id`` is eligible."""
    marks = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & eligible)
    share = config.max_rows / max(marks.count(), 1)
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = marks.join(docs.select("doc_id", "text"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_blocks(batch, "text", config.block_bytes):
                lists = [np.unique(_features([t or ""], config.bits)[0]).astype(np.int32) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                features = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in ("doc_id", "y")] + [features], ["doc_id", "y", "features"])

    return rows.mapInArrow(tidied(run), StructType([rows.schema["doc_id"], rows.schema["y"], StructField("features", ArrayType(IntegerType()))]))


def train(rows: list[tuple[int, np.ndarray]], config: FtrlConfig = FtrlConfig()) -> FtrlModel:
    """FTRL-proximal over rows of (label, distinct coordinates), in the order given, ``epochs`` times. The last coordinate is the bias, without L1."""
    held = rows[:: config.calibrate_every] if len(rows) >= 20 * config.calibrate_every else []
    learned = [x for i, x in enumerate(rows) if i % config.calibrate_every] if held else rows
    size = 1 << config.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = config.l1

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((config.beta + np.sqrt(ni)) / config.alpha + config.l2), 0.0)
        w[-1] = -zi[-1] / ((config.beta + math.sqrt(ni[-1])) / config.alpha)
        return w

    for _ in range(config.epochs):
        for y, features in learned:
            at = np.append(features, size)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum()))))
            g = p - y
            if abs(g) < 1e-4:
                continue
            n_new = ni + g * g
            z[at] = zi + g - (np.sqrt(n_new) - np.sqrt(ni)) / config.alpha * w
            n[at] = n_new
    w = weights(z, n)
    kept = np.flatnonzero(w[:-1])
    bias, slope = (float(w[-1]) if rows else 0.0), 1.0
    if held:
        bias, slope = calibrated(np.array([w[:-1][f].sum() for _, f in held]), np.array([y for y, _ in held]), bias)
    return FtrlModel(kept.astype(np.int32), w[kept].astype(np.float32), bias, slope)


def calibrated(sums: np.ndarray, labels: np.ndarray, bias: float) -> tuple[float, float]:
    """Bias and slope of the log-odds by Newton's method, with smoothed targets so that separable rows stay finite."""
    positive = labels.sum()
    if not 0 < positive < len(labels):
        return bias, 1.0
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    x = np.stack([np.ones_like(sums), sums])
    v = np.array([bias, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(v @ x, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (target - p))
        v = v + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(v[0]), float(v[1])) if v[1] > 0 else (bias, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", config: FtrlConfig = FtrlConfig(), eligible: Column | None = None) -> FtrlModel:
    rows = training_rows(docs, labels, label, config, F.lit(True) if eligible is None else eligible)
    rows = materialize(rows, "toxicity-rows")
    share = config.max_features / max(rows.agg(F.sum(F.size("features"))).first()[0] or 0, 1)
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = rows.select("doc_id", "y", "features").toArrow()  # bounded by max_rows and max_features
    ids, ys = (found.column(i).to_pylist() for i in range(2))
    lists = found.column(2).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    order = sorted(range(len(ids)), key=lambda i: (crc32(str(ids[i]).encode()), ids[i], ys[i]))
    return train([(ys[i], flat[ends[i - 1] if i else 0 : ends[i]]) for i in order], config)


def score(docs: DataFrame, model: FtrlModel, config: FtrlConfig = FtrlConfig(), text: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    carried = [c for c in docs.columns if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast((model.coordinates, model.weights * np.float32(model.slope), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates, values, bias = sent.value
        dense = np.zeros(1 << config.bits, np.float32)
        dense[coordinates] = values
        for batch in batches:
            for lo, hi, texts in text_blocks(batch, text, config.block_bytes):
                at, row = _features([t or "" for t in texts], config.bits)
                some = dense[at] != 0
                keys = np.unique(row[some] << config.bits | at[some])  # each feature of a text counts once
                sums = bias + np.bincount(keys >> config.bits, dense[keys & (1 << config.bits) - 1].astype(np.float64), hi - lo)
                p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
                made = [pa.array(p), pa.array((p >= config.threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carried] + made, [*carried, "score", "predicted"])

    return docs.select(*carried).mapInArrow(tidied(run), StructType([docs.schema[c] for c in carried] + [StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
