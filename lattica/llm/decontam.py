"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: a shard holds the postings (positions, ascending) of all terms of a block of
training documents, whatever the benchmark. It is a table of a row per shard, written once and searched as often as
there are benchmarks. A search runs in every shard: the postings of a phrase's rarest term in that shard, moved
back by the term's offset, are intersected with those of its next rarest term, and so on; most phrases end at a
term that the shard doesn't have. Postings never leave their shard, so a term that holds a third of all words makes
no hot task.

The benchmark's terms and phrases are broadcast in blocks of ``block_words`` words; a task searches one block after
the other and holds one at a time. A longer item is split over blocks, with the windows across the cuts.

Exact matches are places where a window's words follow each other. Proximity matches are the positions of a
window's rarest term that lie in a stretch of a document of the window's length plus ``slop`` words that has all of
the window's words, as often as the window has them, in any order.

Defined results
  null or empty text     no words, no windows; never hit
  very long text         a shard of its own, with all its postings in one task
  null item_id           counts as an item; it is left out of the list of ids
  short items            an item of fewer words than a window is one window
  repeated items         rows of equal item_id are one item in the list of ids
  repeated documents     searched each on its own
  overlapping hits       a word counts once
  empty tables           no rows, or no hits
  other columns          ``decontaminate`` carries them along; a column named as one that it adds is replaced
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType
from xxhash import xxh3_64_intdigest

from .common import materialize, text_blocks, tidied

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII; A-Z count as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class DecontamConfig:
    window: int = 10
    block_words: int = 1_000_000  # words of a benchmark block; with their terms well below 64 MB
    shard_bytes: int = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass
class Phrases:
    """Windows of a benchmark block: rows of term numbers by length, with the item of each; terms by their hash."""

    terms: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]  # window length: (windows x length terms, item of each)
    names: list[str | None]


def phrases_of(items: list[tuple[object, list[bytes]]], window: int) -> Phrases:
    """Each item is its id and its words, or some of them: at least a window's, if the item has that many."""
    vocabulary: dict[bytes, int] = {}
    rows: dict[int, list[tuple[list[int], int]]] = {}
    for i, (_, words) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        size = min(window, len(ids))
        for at in range(len(ids) - size + 1) if size else ():
            rows.setdefault(size, []).append((ids[at : at + size], i))
    by_length = {n: (np.array([w for w, _ in found]), np.array([i for _, i in found])) for n, found in rows.items()}
    return Phrases(_hashes(list(vocabulary)), by_length, [None if k is None else str(k) for k, _ in items])


def benchmark_blocks(benchmark: DataFrame, config: DecontamConfig) -> Iterator[Phrases]:
    """The benchmark in bounded blocks, read row by row, never as a whole."""
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        at = 0
        while at == 0 or at + config.window - 1 < len(words):
            part = words[at : at + config.block_words + config.window - 1]
            if block and size + len(part) > config.block_words:
                yield phrases_of(block, config.window)
                block, size = [], 0
            block.append((row["item_id"], part))
            size += len(part)
            at += config.block_words
    if block:
        yield phrases_of(block, config.window)


class Shard:
    """Postings of a block of documents; positions count words, with one free position behind each document."""

    def __init__(self, terms: np.ndarray, postings: np.ndarray, bounds: np.ndarray) -> None:
        self.terms, self.postings, self.bounds = terms, postings, bounds

    @classmethod
    def of_texts(cls, texts: list[str | None]) -> tuple[Shard, np.ndarray]:
        """The shard of some texts, and their numbers of words."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        hashes = _hashes([w for ws in words for w in ws])
        position = np.arange(len(hashes)) + np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        return cls(ordered[first], position[order], np.append(first, len(ordered))), sizes

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """This shard's numbers of terms, -1 for those that it doesn't have."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def candidates(self, phrases: Phrases, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Windows all of whose terms the shard has: number, the shard's term numbers, and offsets with the rarest term first."""
        own = self.number(phrases.terms)[windows]
        sizes = np.diff(self.bounds)
        for i in np.flatnonzero(own.min(axis=1) >= 0):
            yield int(i), own[i], np.argsort(sizes[own[i]], kind="stable")

    def of(self, term: int) -> np.ndarray:
        return self.postings[self.bounds[term] : self.bounds[term + 1]]

    def exact(self, phrases: Phrases, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Windows with occurrences, and where those start."""
        for i, terms, order in self.candidates(phrases, windows):
            at = self.of(terms[order[0]]) - order[0]
            for k in order[1:]:
                other = self.of(terms[k])
                place = np.minimum(np.searchsorted(other, at + k), len(other) - 1)
                at = at[other[place] == at + k]
                if not len(at):
                    break
            if len(at):
                yield i, at

    def near(self, phrases: Phrases, windows: np.ndarray, slop: int, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Windows with proximity matches, and the positions of the rarest term there; ``owner`` is the document of a position."""
        for i, terms, order in self.candidates(phrases, windows):
            reach = len(terms) + slop
            at = self.of(terms[order[0]])
            distinct, wanted = np.unique(terms, return_counts=True)
            lists = [self.of(t) for t in distinct]
            for other in lists:  # far from a term there is no match
                low = np.searchsorted(other, at - reach + 1)
                at = at[np.searchsorted(other, at + reach - 1, side="right") > low]
            good = [p for p in at.tolist() if self._surrounded(p, reach, lists, wanted, owner)]
            if good:
                yield i, np.array(good)

    @staticmethod
    def _surrounded(place: int, reach: int, lists: list[np.ndarray], wanted: np.ndarray, owner: np.ndarray) -> bool:
        """Whether some stretch of ``reach`` positions around a place has every term as often as wanted, in one document."""
        around, which = [], []
        for k, other in enumerate(lists):
            some = other[np.searchsorted(other, place - reach + 1) : np.searchsorted(other, place + reach - 1, side="right")]
            some = some[owner[some] == owner[place]]
            if len(some) < wanted[k]:
                return False
            around.append(some)
            which.append(np.full(len(some), k))
        position, term = np.concatenate(around), np.concatenate(which)
        order = np.argsort(position)
        position, term = position[order].tolist(), term[order].tolist()
        missing, count, first = int(wanted.sum()), [0] * len(lists), 0
        for p, t in zip(position, term):
            count[t] += 1
            missing -= count[t] <= wanted[t]
            while position[first] <= p - reach:
                u = term[first]
                missing += count[u] <= wanted[u]
                count[u] -= 1
                first += 1
            # The stretch that ends at p, or further on if p is before the place.
            if not missing and position[first] > place - reach and place > p - reach:
                return True
        return False


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def build_index(docs: DataFrame, config: DecontamConfig = DecontamConfig(), carried: list[str] | None = None) -> DataFrame:
    """One row per shard: the documents' carried columns (``docs``), their sizes, and the terms, postings and bounds as integers."""
    carried = ["doc_id"] if carried is None else carried
    binary = [StructField(c, BinaryType()) for c in ("terms", "postings", "bounds")]
    schema = StructType([StructField("docs", ArrayType(StructType([docs.schema[c] for c in carried]))), StructField("sizes", ArrayType(LongType())), *binary])
    names = list(dict.fromkeys([*carried, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_blocks(batch, "text", config.shard_bytes):
                shard, sizes = Shard.of_texts(texts)
                rows = pa.StructArray.from_arrays([_column(batch, c).slice(lo, hi - lo) for c in carried], carried)
                one = pa.array([0, hi - lo], pa.int32())
                packed = [x.astype(kind).tobytes() for x, kind in ((shard.terms, "<u8"), (shard.postings, "<i4"), (shard.bounds, "<i4"))]
                arrays = [pa.ListArray.from_arrays(one, rows), pa.ListArray.from_arrays(one, pa.array(sizes)), *(pa.array([x], pa.binary()) for x in packed)]
                yield pa.RecordBatch.from_arrays(arrays, ["docs", "sizes", "terms", "postings", "bounds"])

    return docs.select(*names).mapInArrow(tidied(run), schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, Shard]]:
    """Documents, their sizes and first positions, and the shard of every row."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs = _column(batch, "docs").slice(i, 1).flatten()
            sizes = _column(batch, "sizes").slice(i, 1).flatten().to_numpy().astype(np.int64)
            shard = Shard(*(np.frombuffer(_column(batch, c)[i].as_buffer(), kind) for c, kind in (("terms", "<u8"), ("postings", "<i4"), ("bounds", "<i4"))))
            yield docs, sizes, np.cumsum(sizes + 1) - sizes - 1, shard


class _Sent:
    """Blocks of a benchmark, broadcast one by one; a task reads one at a time."""

    def __init__(self, frame: DataFrame, benchmark: DataFrame, config: DecontamConfig) -> None:
        context = frame.sparkSession.sparkContext
        self.blocks = [context.broadcast(p) for p in benchmark_blocks(benchmark, config)]

    def __iter__(self) -> Iterator[Phrases]:
        for block in self.blocks:
            yield block.value
            if len(self.blocks) > 1:
                block.__dict__.pop("_value", None)


def search_index(index: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()) -> DataFrame:
    """Documents of an index with n_words, n_hit, hits (spans of hit words) and items (ids with occurring windows)."""
    sent = _Sent(index, benchmark, config)
    kept = index.schema["docs"].dataType.elementType.fields
    schema = StructType(kept + [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("hits", SPANS), StructField("items", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, sizes, starts, shard in _shards(batches):
            edge = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
            found: list[set[str | None]] = [set() for _ in sizes]
            for known in sent:
                for length, (windows, items) in known.by_length.items():
                    for w, at in shard.exact(known, windows):
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + length, -1)
                        for d in np.unique(np.searchsorted(starts, at, side="right") - 1).tolist():
                            found[d].add(known.names[items[w]])
            hit = (np.cumsum(edge)[:-1] > 0).astype(np.int64)
            totals = np.add.reduceat(hit, starts) if len(starts) else np.zeros(0, np.int64)
            spans_of: list[list[dict[str, int]]] = [[] for _ in sizes]
            for d in np.flatnonzero(totals):
                turn = np.flatnonzero(np.diff(hit[starts[d] : starts[d] + sizes[d]], prepend=0, append=0))
                spans_of[d] = [{"start": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2])]
            made = [pa.array(sizes), pa.array(totals), pa.array(spans_of, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array([list(f) for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([docs.field(f.name) for f in kept] + made, [*(f.name for f in kept), "n_words", "n_hit", "hits", "items"])

    return index.mapInArrow(tidied(run), schema)


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("length", IntegerType())]))
FOUND = ("n_words", "n_hit", "hits", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig(), keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, hits, items, n_items, items_sha256 and contaminated."""
    carried = [c for c in docs.columns if c not in (*FOUND, "n_items", "items_sha256", "contaminated", "text")]
    index = materialize(build_index(docs, config, carried + ["text"] * keep_text), "decontam-index")
    out = search_index(index, benchmark, config)
    ids = F.sort_array("items")
    digest = F.sha2(F.array_join(ids, ","), 256)
    return out.withColumns({"items": ids, "n_items": F.size("items").cast("bigint"), "items_sha256": digest, "contaminated": F.col("n_hit") > 0})


def find_near_matches(index: DataFrame, benchmark: DataFrame, slop: int = 5, config: DecontamConfig = DecontamConfig()) -> DataFrame:
    """``doc_id, item_id, position`` of the proximity matches in an index; positions count a document's words from 0."""
    sent = _Sent(index, benchmark, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, sizes, starts, shard in _shards(batches):
            ids = docs.field("doc_id").to_pylist()
            owner = np.repeat(np.arange(len(sizes)), sizes + 1)
            rows = {
                (int(owner[p]), known.names[items[w]], int(p - starts[owner[p]]))
                for known in sent
                for windows, items in known.by_length.values()
                for w, at in shard.near(known, windows, slop, owner)
                for p in at.tolist()
            }
            ordered = sorted(rows, key=lambda r: (r[0], r[2], r[1] or ""))
            arrays = [pa.array([ids[d] for d, _, _ in ordered], pa.int64()), pa.array([n for _, n, _ in ordered], pa.string()), pa.array([p for _, _, p in ordered], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "position"])

    return index.mapInArrow(tidied(run), "doc_id bigint, item_id string, position bigint")
