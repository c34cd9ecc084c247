"""Language-model scores: a unigram base and prediction by partial matching over bytes.

PPM. The trie's contexts are the last ``order`` bytes and shorter ones. In a context that has been seen, a
symbol with count c has probability c / (T + D) and escape has D / (T + D) (T: the counts' sum, D: distinct
symbols); escape goes on to the context that is one byte shorter, where symbols of the longer contexts are
excluded, and at last to a uniform choice among the symbols left. The model is pretrained: counts of all
training texts, gathered as counts of grams of order + 1 bytes (a text begins with ``order`` bytes 0xFE and
ends with one 0xFF, which UTF-8 never has). A text's code length is the sum over its bytes and the end; since
it depends on the gram alone, it is computed once for each gram and looked up for the rest.

The counts of all grams decide. Up to ``max_grams`` distinct ones are broadcast as a trie. Of more, the
``max_grams`` most frequent ones (ties by gram) are broadcast with their probabilities, computed from the whole
table; of the others each text sends one row per gram, which meets the probabilities by an equi-join. Grams that
the training rows lack escape level by level, each level a join with the successors of its contexts, of which a
context has at most 256. Both ways give the same scores.

Base. Unigram counts of the training words grow without bound, so they stay a table. The ``head`` most
frequent words are broadcast and looked up where the texts are; of the others each text sends one row per
word, which meets the table by an equi-join. No word of that join is frequent, so none makes a hot task.

Defined results
  null or empty text    one token, the end
  null doc_id           not held out: crc32 of it is null
  repeated rows         scored, and learned from, each on its own
  ties                  broken by word and by gram
  no training rows      N and V are 0; every byte is coded by the uniform choice
  very long text        scored whole, in one task; its grams and words are counted with all others
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, materialize, slices

START, END = 0xFE, 0xFF


@dataclass(frozen=True)
class PpmConfig:
    order: int = 3  # bytes of context, 6 at most: grams have order + 1 bytes and are bigint
    max_grams: int = 1 << 20  # that are broadcast; the others are joined
    head: int = 100_000
    folds: int = 7
    held_out_fold: int = 2
    block_bytes: int = 4_000_000
    flush: int = 400_000  # distinct keys that a task counts before it passes them on


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(LOWER_BYTES)


def _width(order: int) -> type:
    if not 0 <= order <= 6:
        raise ValueError("the order must be 0 to 6")
    return np.uint32 if order <= 3 else np.uint64


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All grams of texts in order, and the number of each text's."""
    pad, end, width = bytes([START]) * order, bytes([END]), _width(order)
    data = np.frombuffer(b"".join(pad + t + end for t in texts), np.uint8).astype(width)
    gram = data[: len(data) - order].copy()
    for k in range(1, order + 1):
        gram <<= width(8)
        gram |= data[k : len(data) - order + k]
    sizes = np.array([len(t) + 1 for t in texts])
    keep = np.ones(len(gram), bool)  # those that end in a text's own bytes
    ends = np.cumsum(sizes + order)[:-1]
    for k in range(order):
        keep[ends - order + k] = False
    return gram[keep], sizes


class Trie:
    """Counts of grams, sorted, and those of all shorter contexts, derived from them."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int) -> None:
        self.order = order
        sorted_at = np.argsort(grams)
        key, n = grams[sorted_at].astype(np.uint64), counts[sorted_at].astype(np.int64)
        self.levels = [(key, n)]  # longest context first
        for k in range(order, 0, -1):  # drop the first byte of the context
            short = key & np.uint64((1 << 8 * k) - 1)
            key, inverse = np.unique(short, return_inverse=True)
            n = np.bincount(inverse, n, len(key)).astype(np.int64)
            self.levels.append((key, n))
        self.memo: dict[int, float] = {}
        self._tables()

    def successors(self, level: int, context: int) -> tuple[np.ndarray, np.ndarray]:
        key, n = self.levels[level]
        lo, hi = np.searchsorted(key, np.array([context << 8, (context + 1) << 8], np.uint64))
        return (key[lo:hi] & np.uint64(255)).astype(np.int64), n[lo:hi]

    def log10_p(self, gram: int) -> float:
        """log10 probability of a gram's last byte after the others."""
        known = self.memo.get(gram)
        if known is not None:
            return known
        symbol, context = gram & 255, gram >> 8
        excluded = np.zeros(256, bool)
        excluded[START] = True
        total = 0.0
        for level in range(self.order + 1):
            symbols, n = self.successors(level, context & (1 << 8 * (self.order - level)) - 1)
            free = ~excluded[symbols]
            symbols, n = symbols[free], n[free]
            if len(symbols):
                t, d = int(n.sum()), len(symbols)
                hit = np.flatnonzero(symbols == symbol)
                if len(hit):
                    total += math.log10(int(n[hit[0]]) / (t + d))
                    break
                total += math.log10(d / (t + d))
                excluded[symbols] = True
        else:
            total -= math.log10(int((~excluded).sum()))
        if len(self.memo) > 1_000_000:
            self.memo.clear()
        self.memo[gram] = total
        return total

    def _tables(self) -> None:
        """Code lengths of the grams that the longest contexts have, by array operations: log10 c / (T + D)."""
        key, n = self.levels[0]
        contexts, inverse, distinct = np.unique(key >> np.uint64(8), return_inverse=True, return_counts=True)
        totals = np.bincount(inverse, n, len(contexts)) + distinct
        self.keys = key.astype(_width(self.order))
        self.values = np.log10(n / totals[inverse]) if len(key) else np.zeros(0)
        # Dense lookup of grams whose bytes are all among the 63 most frequent ones.
        common = np.bincount((key & np.uint64(255)).astype(np.int64), n, 256) if len(key) else np.zeros(256)
        common[START] = common.max() + 1
        self.code = np.full(256, 63, np.uint32)
        self.code[np.argsort(-common, kind="stable")[:63]] = np.arange(63)
        self.dense = None
        if self.order == 3:
            self.dense = np.full(1 << 24, np.nan, np.float32)
            coded, plain = self._coded(self.keys)
            self.dense[coded[plain]] = self.values[plain]

    def _coded(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.code[(grams >> np.uint32(8 * k)) & np.uint32(255)] for k in range(3, -1, -1)]
        coded = parts[0] << 18 | parts[1] << 12 | parts[2] << 6 | parts[3]
        return coded, (parts[0] < 63) & (parts[1] < 63) & (parts[2] < 63) & (parts[3] < 63)

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probabilities of grams."""
        if self.dense is not None:
            coded, plain = self._coded(grams)
            out = np.where(plain, self.dense[coded], np.float32(np.nan)).astype(np.float64)
        else:
            out = np.full(len(grams), np.nan)
        left = np.flatnonzero(np.isnan(out))
        if len(left):
            unique, inverse = np.unique(grams[left], return_inverse=True)
            values = np.full(len(unique), np.nan)
            if len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
                hit = self.keys[at] == unique
                values[hit] = self.values[at[hit]]
            for i in np.flatnonzero(np.isnan(values)):
                values[i] = self.log10_p(int(unique[i]))
            out[left] = values[inverse]
        return out


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def training_counts(docs: DataFrame, config: PpmConfig) -> DataFrame:
    """``word, gram, n`` of the training rows: a row has a word or a gram; the empty word is the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            if words:
                n = len(words)
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(words.values()), pa.int64())], ["word", "gram", "n"])
                words.clear()
            if grams:
                key, n = _merged(grams)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.binary()), pa.array(key.astype(np.int64)), pa.array(n)], ["word", "gram", "n"])
                grams.clear()

        for batch in batches:
            texts = [normal(t) for t, held in zip(_column(batch, "text"), _column(batch, "held_out")) if not held]
            for lo, hi in slices(texts, [len(t) for t in texts], config.block_bytes):
                for t in texts[lo:hi]:
                    words.update(t.split())
                words[b""] += hi - lo
                found, _ = grams_of(texts[lo:hi], config.order)
                grams.append(np.unique(found, return_counts=True))
                if len(grams) >= 8:
                    grams[:] = [_merged(grams)]
                if len(words) > config.flush or len(grams[0][0]) > config.flush:
                    yield from sent()
        yield from sent()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, gram bigint, n bigint").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


def gram_values(grams: DataFrame) -> DataFrame:
    """``gram, n, value`` of all grams of the training rows: log10 of count / (T + D) in the longest context."""
    own = grams.withColumn("context", F.shiftright("gram", 8))
    totals = own.groupBy("context").agg((F.sum("n") + F.count("*")).alias("total"))
    return own.join(totals, "context").select("gram", "n", F.log10(F.col("n") / F.col("total")).alias("value"))


def escaped_values(wanted: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """``gram, value`` of grams that the training rows lack."""
    pending = wanted.select("gram", F.lit(0.0).alias("value"), F.lit((1 << START).to_bytes(32, "little")).alias("gone"))
    done: list[DataFrame] = []
    for level in range(order + 1):
        bits = 8 * (order - level)
        counts = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << bits + 8) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        seen = counts.groupBy(F.shiftright("key", 8).alias("context")).agg(F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(255)).alias("symbol"), "n")).alias("seen"))
        context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << bits) - 1))
        # Short contexts have every gram waiting: 256 rows at most, sent to them.
        joined = pending.withColumn("context", context).join(F.broadcast(seen) if bits <= 8 else seen, "context", "left")
        step = materialize(joined.select("gram", "value", "gone", "seen").mapInArrow(_escape(level == order), "gram bigint, value double, gone binary, done boolean"), "ppm-escape")
        done.append(step.where("done").select("gram", "value"))
        pending = step.where("NOT done").select("gram", "value", "gone")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _escape(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One level for grams with the symbols excluded so far (a bit each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, gones, dones = [], [], []
            for gram, value, gone, seen in zip(*(_column(batch, c) for c in ("gram", "value", "gone", "seen"))):
                gone, done = int.from_bytes(gone, "little"), False
                free = {x["symbol"]: x["n"] for x in seen or () if not gone >> x["symbol"] & 1}
                if free:
                    whole, n = sum(free.values()) + len(free), free.get(gram & 255)
                    value += math.log10((n or len(free)) / whole)
                    done = n is not None
                    for symbol in free:
                        gone |= 1 << symbol
                if last and not done:
                    value -= math.log10(256 - gone.bit_count())
                    done = True
                values.append(value)
                gones.append(gone.to_bytes(32, "little"))
                dones.append(done)
            yield pa.RecordBatch.from_arrays([pa.array(_column(batch, "gram"), pa.int64()), pa.array(values, pa.float64()), pa.array(gones, pa.binary()), pa.array(dones, pa.bool_())], ["gram", "value", "gone", "done"])

    return run


class Head:
    """log10 probabilities of the most frequent grams; those of others are unknown here."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def score(self, grams: np.ndarray) -> np.ndarray:
        """NaN for unknown ones."""
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        return np.where(self.keys[at] == grams, self.values[at], np.nan)


def score_documents(docs: DataFrame, config: PpmConfig = PpmConfig()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % config.folds == config.held_out_fold, F.lit(False))
    rows = docs.select("doc_id", "text").withColumn("held_out", held)
    counts = materialize(training_counts(rows, config), "ppm-counts")
    words = counts.where("word IS NOT NULL").select("word", "n")
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).first()
    n_train, denominator = int(size["tokens"]), int(size["tokens"]) + int(size["types"]) + 1
    top = words.orderBy(F.desc("n"), "word").limit(config.head).toArrow()
    grams = counts.where("gram IS NOT NULL").select("gram", "n")
    whole = grams.count() <= config.max_grams
    if not whole:
        found = materialize(gram_values(grams), "ppm-grams")
    kept = (grams if whole else found.orderBy(F.desc("n"), "gram").limit(config.max_grams).select("gram", "value")).toArrow()
    sent = spark.sparkContext.broadcast(
        (dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())), kept.column(0).to_numpy().astype(_width(config.order)), kept.column(1).to_numpy())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, keys, n = sent.value
        logs = {w: math.log10((c + 1) / denominator) for w, c in head.items()}
        model = Trie(keys, n, config.order) if whole else Head(keys, n)
        for batch in batches:
            texts = [normal(t) for t in _column(batch, "text")]
            tokens, known, base, score, rare, apart = [], [], [], [], [], []
            for lo, hi in slices(texts, [len(t) for t in texts], config.block_bytes):
                block = texts[lo:hi]
                found, sizes = grams_of(block, config.order)
                starts, p = np.cumsum(sizes) - sizes, model.score(found)
                if not whole:
                    missed = np.isnan(p)
                    p[missed] = 0
                    apart += [np.unique(found[lo:hi][missed[lo:hi]], return_counts=True) for lo, hi in zip(starts, starts + sizes)]
                    del missed
                score += np.add.reduceat(p, starts).tolist()
                del found, p  # blocks are large
                for t in block:
                    own = t.split()
                    own.append(b"")
                    values = [logs[w] for w in own if w in logs]
                    tokens.append(len(own))
                    known.append(len(values))
                    base.append(math.fsum(values))
                    rare.append(list(Counter(w for w in own if w not in logs).items()) if len(values) < len(own) else [])
            at = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32))
            pairs = pa.StructArray.from_arrays(
                [pa.array([w for r in rare for w, _ in r], pa.binary()), pa.array([c for r in rare for _, c in r], pa.int32())], ["word", "times"]
            )
            apart = apart or [(np.zeros(0, np.int64),) * 2] * len(texts)
            apart_at = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in apart])]).astype(np.int32))
            apart_pairs = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in apart)]).astype(np.int64)) for i in (0, 1)], ["gram", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(at, pairs), pa.ListArray.from_arrays(apart_at, apart_pairs),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "apart"],
            )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:binary,times:int>>, apart array<struct<gram:bigint,times:bigint>>"
    # Written once: rows get numbers of their own, since doc_id may be null or repeat, and both uses below read them.
    scored = materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "ppm-scored")
    tail = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(words, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    tail = tail.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"), F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(denominator)))).alias("tail_score")
    )
    out = scored.drop("rare", "apart")
    if not whole:
        rest = scored.select("row", F.explode("apart").alias("r")).select("row", "r.gram", "r.times")
        wanted = materialize(rest.select("gram").distinct().join(found, "gram", "left").select("gram", "value"), "ppm-wanted")
        lengths = wanted.where("value IS NOT NULL").unionByName(escaped_values(wanted.where("value IS NULL"), grams, config.order))
        out = out.join(rest.join(lengths, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("apart_score")), "row", "left")
        out = out.withColumn("score", F.col("score") + F.coalesce("apart_score", F.lit(0.0)))
    return out.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("tail_known"), F.lit(0))).alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce(F.col("tail_score"), F.lit(0.0))).alias("base_score"), "score",
    )
