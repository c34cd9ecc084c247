"""Near-duplicate groups by SetSketch registers.

Every text becomes the set of its distinct word shingles (64-bit hashes). Register i keeps the least of
exponentially distributed hashes of the set's elements, as a truncated step of an exponential scale:
``K_i = clip(floor(1 - log_b(x_i)), 0, q + 1)``. Sketches of parts merge by the greater register, and with b near
1 two sets agree in a register with a probability near their Jaccard similarity.

1. Texts with equal shingle sets form a class; a row number stands for it, so that repeated ids can't be mixed up.
   Only digests are grouped, with partial aggregation, so a class with a third of all rows costs a row per task.
2. Registers are banded. In every bucket each class is paired with the bucket's head, never all with all. Head is
   the class whose buckets are the fullest: of edited copies that is the least edited one, which most of the others
   link to, and the same one heads most of their buckets.
3. Pairs are kept if sizes allow the threshold and the joint likelihood of both sketches, with the sets' exact
   sizes, doesn't rule it out; then the full sets decide.
4. Components come from the confirmed links: blocks of about 2^20 links are contracted to stars, each by one task; what
   several blocks leave goes on by large-star/small-star rounds over DataFrames.
5. The members of all buckets of one head P form a group. Two of them in different components may still be linked,
   if at least one isn't linked to P. With D(x) the difference of x and P, x and y are linked if and only if
   |D(x) ^ D(y)| is small, and because |D| of an unlinked text is large, they must then share more than half of
   their differences. So texts are joined by prefixes of their differences, rarest within the group first: a pair
   that is linked shares an element of both prefixes, whichever P is. Edits of different copies rarely agree, so
   this finds every link of a bucket without making the other pairs.
6. A pair of the same two groups is made in the first of them only; pairs pass 3, links go to 4 again.

The 32 bands of 4 registers miss a pair at 0.8 with probability 5e-8, the likelihood's floor of 7 deviations with
less than 1e-9; neither grows with the table. Nothing is collected: links, components and fingerprints stay
DataFrames, cut by tables in the shared folder.

Defined results
  null or empty text, no words   an empty set: linked with nothing, component of its own
  fewer words than a shingle     the whole sequence is one shingle
  very long text                 a set like any other; a row holds it whole, 8 bytes a shingle
  null doc_id                    linked with nothing, component_id null, kept
  repeated doc_id                every row is a document of its own: rows of one id may be in different components
  ties                           the least doc_id stands for a component; of heads equally full the first row
  empty table                    no rows
  other columns                  ``near_duplicates`` reads doc_id and text only
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import LOWER_BYTES, materialize, text_blocks, tidied


@dataclass(frozen=True)
class SketchConfig:
    shingle: int = 5  # words
    threshold: int = 80  # per cent
    bands: int = 32
    rows: int = 4
    base: float = 1.001
    steps: int = 65534  # q: registers go from 0 to q + 1 and fit in 16 bits
    rate: float = 20.0  # of the exponential distribution
    seed: int = 20240229
    slack: float = 7.0  # standard deviations that an estimate may lie below the threshold
    block_bytes: int = 1_000_000
    task_bytes: int = 8_000_000  # about what a Python task takes of sketches, sets or texts

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k])
    return np.unique(out)


def _constants(config: SketchConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(config.seed)
    return rng.integers(0, 1 << 32, config.registers, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, config.registers, np.uint32)


def sketches(sets: list[np.ndarray], config: SketchConfig) -> np.ndarray:
    """Registers of non-empty sets, a row each."""
    a, c = _constants(config)
    flat = np.concatenate(sets)
    # Two halves of the hash, so that no register is a function of 32 bits alone.
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((len(sets), config.registers), np.uint32)
    v, w = np.empty_like(low), np.empty_like(low)
    for i in range(config.registers):
        np.multiply(low, a[i], out=v)
        np.add(high, c[i], out=w)
        np.bitwise_xor(v, w, out=v)
        np.multiply(v, np.uint32(0x85EBCA6B), out=v)
        np.right_shift(v, np.uint32(15), out=w)
        np.bitwise_xor(v, w, out=v)
        np.multiply(v, np.uint32(0xC2B2AE35), out=v)
        least[:, i] = np.minimum.reduceat(v, starts)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    exponential = -np.log1p(-uniform) / config.rate
    return np.clip(np.floor(1 - np.log(exponential) / math.log(config.base)), 0, config.steps + 1).astype(np.uint16)


def estimate(k1: np.ndarray, k2: np.ndarray, n1: int, n2: int, config: SketchConfig) -> float:
    """Maximum-likelihood Jaccard similarity of two sets of known sizes from their registers."""
    b = config.base
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    above, below = int((k1 > k2).sum()), int((k1 < k2).sum())
    same = len(k1) - above - below
    p = lambda x: -math.log1p(-x * (b - 1) / b) / math.log(b)

    def value(j: float) -> float:
        up, down = p(max(u - v * j, 0.0)), p(max(v - u * j, 0.0))
        total = 0.0
        for count, chance in ((above, up), (below, down), (same, 1 - up - down)):
            if count:
                total += count * math.log(max(chance, 1e-300))
        return total

    low, high = 0.0, min(u / v, v / u)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(40):  # the likelihood has one peak
        left, right = high - golden * (high - low), low + golden * (high - low)
        if value(left) < value(right):
            low = left
        else:
            high = right
    return (low + high) / 2


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def fingerprints(docs: DataFrame, config: SketchConfig) -> DataFrame:
    """``doc_id, mark, n_shingles, digest, sketch, bands``: a hash of the text, digest of the set, registers as bytes, and a hash per band."""
    schema = "doc_id bigint, mark bigint, n_shingles bigint, digest binary, sketch binary, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_blocks(batch, "text", config.block_bytes):
                sets = [shingle_hashes(t, config.shingle) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                packed: list[bytes | None] = [None] * len(sets)
                bands: list[list[int]] = [[] for _ in sets]
                if full:
                    registers = sketches([sets[i] for i in full], config)
                    keys = np.zeros((len(full), config.bands), np.uint64)
                    for k in range(config.rows):
                        keys = _mix(keys + np.arange(1, config.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + registers[:, k :: config.rows])
                    keys = keys.view(np.int64)
                    for i, r, key in zip(full, registers, keys):
                        packed[i], bands[i] = r.tobytes(), key.tolist()
                own = [_column(batch, c).slice(lo, hi - lo) for c in ("doc_id", "mark")]
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(packed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(own + made, ["doc_id", "mark", "n_shingles", "digest", "sketch", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(tidied(run), schema)


def _packed(rows: DataFrame, size: int | None, config: SketchConfig) -> DataFrame:
    """``rows``, made of about ``size`` bytes that their joins read, in as many tasks as that asks for, and three a core: what starts and ends a Python pass takes longer than a small partition."""
    least = 3 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(least, -(-(size or 0) // config.task_bytes)))


def _sets(docs: DataFrame, wanted: DataFrame, size: int | None, config: SketchConfig) -> DataFrame:
    """``node, shingles`` of ``wanted(node, doc_id, digest)``; of rows with a repeated id, those whose set has the digest. ``size``: bytes of all docs."""
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_blocks(batch, "text", config.block_bytes):
                found = []
                for node, digest, text in zip(*(_column(batch, c).slice(lo, hi - lo).to_pylist() for c in ("node", "digest")), texts):
                    shingles = shingle_hashes(text, config.shingle)
                    if _digest(shingles) == digest:
                        found.append((node, shingles.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["node", "shingles"])

    # Equal rows of an id give equal sets.
    texts = _packed(texts.select("node", "digest", "text"), size, config)
    return texts.mapInArrow(tidied(run), "node bigint, shingles binary").dropDuplicates(["node"])


def _likely(pairs: DataFrame, reps: DataFrame, config: SketchConfig) -> DataFrame:
    """Of ``a, b``, the pairs that sizes and likelihood leave possible."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(100 * F.least("n_a", "n_b") >= config.threshold * F.greatest("n_a", "n_b"))
    j = config.threshold / 100
    floor = j - config.slack * math.sqrt(j * (1 - j) / config.registers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb = (_column(batch, c) for c in ("k_a", "k_b"))
            keep = []
            for i, (m, n) in enumerate(zip(_column(batch, "n_a").to_pylist(), _column(batch, "n_b").to_pylist())):
                x, y = (np.frombuffer(k[i].as_buffer(), np.uint16) for k in (ka, kb))
                # Far too few equal registers need no likelihood.
                keep.append(int((x == y).sum()) >= (floor - 0.1) * len(x) and estimate(x, y, m, n, config) >= floor)
            yield pa.RecordBatch.from_arrays([_column(batch, c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = _packed(both.select("a", "b", "n_a", "n_b", "k_a", "k_b"), 2 * config.registers * (2 * pairs.count() + 2 * reps.count()), config)
    return both.mapInArrow(tidied(run), "a bigint, b bigint")


def _with_sets(pairs: DataFrame, sets: DataFrame, config: SketchConfig) -> DataFrame:
    """``a, b, s_a, s_b``, packed for a Python pass by the sets that the joins read and those of the pairs, of average length."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    count, total = sets.agg(F.count("*"), F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()
    size = total * 2 + total * 2 * pairs.count() // max(1, count)
    return _packed(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "s_a", "s_b"), size, config)


def _is_link(common: int, m: int, n: int, config: SketchConfig) -> bool:
    return 100 * common >= config.threshold * (m + n - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, config: SketchConfig) -> DataFrame:
    """Of ``a, b``, the pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (_column(batch, c) for c in ("a", "b", "s_a", "s_b"))
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (sa, sb))
                keep.append(_is_link(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), config))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, sets, config).mapInArrow(tidied(run), "a bigint, b bigint")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links ``a, b`` and for each the least node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # Every root goes to the least root it is linked with; of two rounds it takes part in one, so roots at least halve in two.
        np.minimum.at(root, x, y)
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _contracted(links: DataFrame, blocks: int, limit: int) -> DataFrame:
    """``node, component`` of every node of ``links(a, b)`` within each of ``blocks`` tasks, which hold ``limit`` links and their nodes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held, most = 0, limit
        for batch in batches:
            parts.append(tuple(_column(batch, c).to_numpy() for c in ("a", "b")))
            held += batch.num_rows
            if held > most:
                parts = [stars(*map(np.concatenate, zip(*parts)))]
                held = len(parts[0][0])
                most = limit + held
        if parts:
            nodes, roots = stars(*map(np.concatenate, zip(*parts)))
            for lo in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (nodes, roots)], ["node", "component"])

    return links.select("a", "b").coalesce(blocks).mapInArrow(tidied(run), "node bigint, component bigint")


def components(links: DataFrame, name: str = "components", block: int = 1 << 20) -> DataFrame:
    """``node, component`` of every node of ``links(a, b)`` with a link to another: the least node reachable.

    Blocks of about ``block`` links are contracted, each by one task; several are joined by alternating large-star and small-star rounds.
    """
    links = links.where("a <> b")
    blocks = max(1, -(-links.count() // block))
    found = materialize(_contracted(links, blocks, block), name)
    if blocks == 1:
        return found
    edges = materialize(found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).distinct(), name)
    mark = None
    while True:
        # Large star: every neighbour above a node goes to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its neighbours below go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        before, mark = mark, edges.agg(F.count("*"), F.sum("u"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with their component; one without links is its own."""
    return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _several(members: DataFrame, *keys: str) -> DataFrame:
    """Members that share ``keys`` with one of another component whom they meet nowhere else: not in the group ``first`` of both."""
    ends = members.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in ("component", "first") for n, f in (("lo", F.min), ("hi", F.max))))
    open_ = ends.where((F.col("component_lo") < F.col("component_hi")) & ((F.col("first_lo") < F.col("first_hi")) | (F.col("first_lo") == F.col("head"))))
    return members.join(open_.select(*keys), [*keys], "left_semi")


def _differences(members: DataFrame, sets: DataFrame, config: SketchConfig) -> DataFrame:
    """``head, node, e, weight, size, far`` of ``members(head, node)``: a row for every element e of D(node), with the length
    of D, ``weight`` = (100 + t) |D| - (100 - t) |node|, and whether the node isn't linked to the head.

    Two nodes are linked if and only if they share at least (weight + weight') / (2 (100 + t)) differences.
    """
    t = config.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, node, sa, sb = (_column(batch, c) for c in ("a", "b", "s_a", "s_b"))
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (sa, sb))
                d = np.setxor1d(x, y, assume_unique=True)
                far = not _is_link((len(x) + len(y) - len(d)) // 2, len(x), len(y), config)
                same = lambda v, kind: pa.array([v] * len(d), kind)
                columns = [same(head[i].as_py(), pa.int64()), same(node[i].as_py(), pa.int64()), pa.array(d.view(np.int64))]
                columns += [same((100 + t) * len(d) - (100 - t) * len(y), pa.int64()), same(len(d), pa.int64()), same(far, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["head", "node", "e", "weight", "size", "far"])

    pairs = members.select(F.col("head").alias("a"), F.col("node").alias("b"))
    return _with_sets(pairs, sets, config).mapInArrow(tidied(run), "head bigint, node bigint, e bigint, weight bigint, size bigint, far boolean")


def _meetings(members: DataFrame, sets: DataFrame, config: SketchConfig) -> DataFrame:
    """``a, b``: pairs of members(head, node, component, first) of a group that share enough of their differences' prefixes to be linked."""
    unit = 2 * (100 + config.threshold)
    rows = materialize(_differences(members, sets, config), "neardup-differences")
    # Elements that only one member has are first in its order and meet nothing: they count, but aren't moved.
    shared = rows.groupBy("head", "e").agg(F.count("*").alias("n")).where("n > 1")
    texts = rows.select("head", "node", "weight", "far").distinct()
    bounds = texts.groupBy("head").agg(F.min(F.when(F.col("far"), F.col("weight"))).alias("far_least"), F.min(F.when(~F.col("far"), F.col("weight"))).alias("near_least")).where("far_least IS NOT NULL")
    order = Window.partitionBy("head", "node").orderBy(F.desc("n"), F.desc("e"))
    ranked = rows.join(shared, ["head", "e"]).withColumn("at", F.col("size") - F.row_number().over(order))
    ranked = ranked.join(bounds, "head")
    # With at least k shared elements, the first size - k + 1 elements of both have one of them.
    first_with = lambda least: F.col("size") - F.ceil((F.col("weight") + F.col(least)) / unit) + 1
    ranked = ranked.withColumn("to_far", first_with("far_least")).withColumn("to_near", F.when(F.col("far"), first_with("near_least")))
    ranked = ranked.where("at < greatest(to_far, to_near)").drop("n", "far_least", "near_least")
    ranked = materialize(ranked.join(members.select("head", "node", "component", "first"), ["head", "node"]), "neardup-prefixes")
    some = _several(ranked, "head", "e")
    some = materialize(some, "neardup-shared")
    other = some.where("far").select("head", "e", *(F.col(c).alias(f"{c}_2") for c in ("node", "component", "first", "weight", "size", "at", "to_far", "to_near")))
    # Pairs of two far members are made once, a near member meets the far ones.
    ask = (F.col("component") != F.col("component_2")) & ((F.col("first") != F.col("first_2")) | (F.col("first") == F.col("head")))
    far = F.col("far") & (F.col("node") < F.col("node_2")) & (F.col("at_2") < F.col("to_far_2"))
    near = ~F.col("far") & (F.col("at_2") < F.col("to_near_2"))
    left = F.least(F.col("size") - F.col("at"), F.col("size_2") - F.col("at_2"))
    enough = unit * left >= F.col("weight") + F.col("weight_2")
    met = some.join(other, ["head", "e"]).where(ask & (F.col("at") < F.col("to_far")) & (far | near) & enough)
    return met.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, config: SketchConfig = SketchConfig()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, mark`` of every row of ``docs(doc_id, text)``; mark is the text's xxhash64."""
    prints = materialize(fingerprints(docs, config), "neardup-prints")
    known = prints.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "neardup-classes")  # from here on the row numbers are fixed
    reps = known.select("doc_id", "digest", "sketch", "bands").join(classes, ["digest", "doc_id"]).dropDuplicates(["node"])
    reps = materialize(reps.select("node", "doc_id", "digest", "n_shingles", "sketch", "bands"), "neardup-representatives")
    buckets = reps.select("node", F.explode("bands").alias("bucket"))
    buckets = materialize(buckets.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "neardup-buckets")
    fullness = materialize(buckets.groupBy("node").agg(F.sum("n").alias("fullness")), "neardup-fullness")
    heads = buckets.join(fullness, "node").groupBy("bucket").agg(F.min(F.struct(-F.col("fullness"), "node")).alias("head"))
    pairs = buckets.join(heads, "bucket").where("head.node <> node").select(F.col("head.node").alias("head"), "node").distinct()
    pairs = materialize(pairs, "neardup-members")
    wanted = reps.select("node", "doc_id", "digest").join(fullness.select("node"), "node", "left_semi")
    size = prints.agg(8 * F.sum("n_shingles")).first()[0]  # a text has about as many bytes as its set
    sets = materialize(_sets(docs, wanted, size, config), "neardup-sets")

    def links_of(pairs: DataFrame) -> DataFrame:
        likely = materialize(_likely(pairs, reps, config), "neardup-likely")
        return materialize(_confirmed(likely, sets, config), "neardup-links")

    links = links_of(pairs.select(F.col("head").alias("a"), F.col("node").alias("b")))
    found = components(links)
    # A node's first group is that of its fullest head; there it meets the members that are in several groups with it.
    ranked_heads = pairs.join(fullness.withColumnRenamed("node", "head"), "head")
    first = ranked_heads.groupBy("node").agg(F.min(F.struct(-F.col("fullness"), "head")).alias("first")).select("node", F.col("first.head").alias("first"))
    members = materialize(_labelled(pairs, found).join(first, "node"), "neardup-labelled")
    members = materialize(_several(members, "head"), "neardup-open")
    more = links_of(materialize(_meetings(members, sets, config), "neardup-meetings"))
    if more.limit(1).count():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    classed = _labelled(classes, found)
    # A table of its own, so that a component with a third of all classes can be split in the join.
    least = materialize(classed.groupBy("component").agg(F.min("doc_id").alias("component_id")), "neardup-least")
    classed = classed.join(least, "component").select("digest", "n_shingles", "component_id")
    joined = prints.select("doc_id", "mark", "n_shingles", "digest").join(classed, ["digest", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    joined = joined.select("doc_id", "n_shingles", component.alias("component_id"), "mark")
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "mark")
