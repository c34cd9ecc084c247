"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pending merges wait in one bucket per merge rank; a bucket holds positions of a linked list of tokens, in
order. Two levels of 256-bit words say which buckets hold anything, so the lowest rank is found by two
find-first-set steps. Entries whose pair has changed since are skipped when they surface. A merge costs a
constant number of queue steps whatever the pre-token's length, so a pre-token of megabytes is no trouble.

Pre-tokens repeat, so a worker keeps the ids of those it has met, up to ``CACHE_BYTES`` while a partition lasts and
half of that between its tasks. New ones of a block of texts go through one queue together: their lists lie side by side, a bucket
holds positions of all of them, and a step merges the leftmost position of every pre-token in the bucket with array
operations. Long pre-tokens, and those of blocks with few new ones, go through the queue alone; both ways give
the same ids, which the tests compare.

Defined results
  null or empty text    no ids; the decoded bytes are empty
  very long text        a block of its own; time and memory grow with its length, whatever its pre-tokens' lengths
  characters unassigned in this Python's Unicode tables   neither letters nor digits
  ties                  of equal ranks the leftmost pair merges first
  repeated rows         encoded each on its own
  empty table           no rows
  other columns         carried along by ``encode``; a column named as one that it adds is replaced
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import text_blocks, tidied

#: The characters of the property White_Space, as ranges.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CACHE_BYTES = 24 << 20  # of a worker's cache, besides the block at hand
ENTRY_BYTES = 190  # of an entry beside its characters and ids
LONG_PIECE = 2048  # bytes of a pre-token that goes through the queue alone
FEW_PIECES = 48  # fewer new pre-tokens go through it one by one
BLOCK = 1_000_000  # bytes of the texts that are looked at together


@lru_cache(maxsize=4)
def _category(first: str) -> str:
    """The characters whose general category begins with a letter, as ranges of a character class."""
    out, start = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] == first
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(code - 1))}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def _odd() -> frozenset[str]:
    r"""Characters that ``[^\W\d_]``, ``\d`` and ``\s`` class otherwise than \p{L}, \p{N} and White_Space do."""
    chars = map(chr, range(0x80, sys.maxunicode + 1))
    odd = [c for c in chars if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L"]
    return frozenset(["\x1c", "\x1d", "\x1e", "\x1f", *odd])


@lru_cache(maxsize=8)
def compile_pattern(pattern: str) -> tuple[re.Pattern, re.Pattern | None]:
    r"""A pattern of \p{L}, \p{N} and \s for Python's own engine: an exact one, and a fast one that agrees on texts without odd characters.

    A leading alternative of contractions moves behind that of letters: no match of the one can begin like a
    match of the other, so the order between them doesn't matter.
    """
    parts = _alternatives(pattern)
    letters = [p for p in parts if p.endswith(r"\p{L}+") and "[" not in p]
    ordered = "|".join(letters + [p for p in parts if p not in letters])
    classes = {r"\p{L}": _category("L"), r"\p{N}": _category("N"), r"\s": WHITE_SPACE}
    text = ""
    for piece in re.split(r"(\[\^?[^\]]*\]|\\p\{[LN]\}|\\[sS])", ordered):
        if piece.startswith("["):
            for name, chars in classes.items():
                piece = piece.replace(name, chars)
        elif piece == r"\S":
            piece = f"[^{WHITE_SPACE}]"
        elif piece in classes:
            piece = f"[{classes[piece]}]"
        text += piece
    fast = ordered.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)")
    fast = fast if r"\p" not in re.sub(r"\\p\{[LN]\}", "", fast) and "[" not in fast.replace(r"[^\s\w]", "") else None
    return re.compile(text), fast and re.compile(fast.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))


def _alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern whose bars all stand outside groups and classes."""
    return pattern.split("|") if not re.search(r"[(\[][^)\]]*\|", pattern) else [pattern]


def load_ranks(path: str) -> bytes:
    """A rank file as it stands; a vocabulary's size is bounded, so it can be broadcast."""
    with open(path, "rb") as f:
        return f.read()


class RankBitmap:
    """The set of ranks with entries: 256-bit words below one word that says which of them aren't empty."""

    def __init__(self, size: int) -> None:
        self.words, self.top = [0] * (size // 256 + 1), 0

    def add(self, rank: int) -> None:
        self.words[rank >> 8] |= 1 << (rank & 255)
        self.top |= 1 << (rank >> 8)

    def pop(self) -> int:
        """Remove and return the lowest rank."""
        high = (self.top & -self.top).bit_length() - 1
        word = self.words[high]
        rank = high << 8 | ((word & -word).bit_length() - 1)
        self.words[high] = word = word & (word - 1)
        if not word:
            self.top &= self.top - 1
        return rank


class Encoder:
    """Ids of pre-tokens. ``packed(texts)`` gives each text's ids as little-endian 32-bit integers."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.exact, self.fast = compile_pattern(pattern)
        self._byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        found = [
            (left << 32 | right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := get(token[:cut], -1)) >= 0 and (right := get(token[cut:], -1)) >= 0
        ]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self._pair_keys, self._pair_ranks = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        # Two generations: entries that the younger one asks for move there, the others go when it is full.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the younger one

    def release(self) -> None:
        """Forget the older generation; the younger one, half of ``CACHE_BYTES`` and a block at most, serves the worker's next task."""
        self.older = {}

    def pattern_for(self, text: str) -> re.Pattern:
        """The pattern to use for a text; both give the same pre-tokens on texts without odd characters."""
        return self.fast if self.fast and _odd().isdisjoint(set(text)) else self.exact

    def findall(self, text: str) -> list[str]:
        return self.pattern_for(text).findall(text)

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Pre-tokens of texts; afterwards the cache has all of them."""
        found = [self.findall(t) for t in texts]
        self.learn(*found)
        return found

    def learn(self, *lists: list[str]) -> None:
        """Have the ids of all pre-tokens of some lists in the cache."""
        if self.held > CACHE_BYTES // 2:
            self.cache, self.older, self.held = {}, self.cache, 0
        self.add(*lists)

    def add(self, *lists: list[str]) -> None:
        """``learn`` what belongs to the block at hand: nothing goes for it."""
        cache, older = self.cache, self.older
        new = set().union(*lists).difference(cache)
        if older and new:
            again = {p: older[p] for p in new if p in older}
            cache.update(again)
            new = new.difference(again)
            self.held += sum(map(len, again)) + sum(map(len, again.values())) + ENTRY_BYTES * len(again)
        if new:
            coded = [(p, p.encode("utf-8", "replace")) for p in new]
            together = [x for x in coded if len(x[1]) <= LONG_PIECE] if len(coded) >= FEW_PIECES else []
            ids = dict(zip((p for p, _ in together), self.merge_many([b for _, b in together])))
            for p, b in coded:
                if not together or len(b) > LONG_PIECE:
                    ids[p] = np.array(self.merge(b), "<u4").tobytes()
            cache.update(ids)
            self.held += sum(len(b) for _, b in coded) + sum(map(len, ids.values())) + ENTRY_BYTES * len(ids)

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of pre-tokens that the cache has."""
        cached = self.cache
        return [len(cached[p]) >> 2 for p in pieces]

    def packed(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.cache.__getitem__, pieces)) for pieces in self.pieces(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = [*range(1, n + 1)]  # where the token that starts here ends
        before = [*range(-1, n - 1)]  # where the token before it starts
        pending = [-1] * n  # rank of the pair that starts here
        waiting, buckets = RankBitmap(len(self.tokens)), {}

        def push(i: int, end: int) -> None:
            pending[i] = r = rank_of(piece[i:end], -1)
            if r < 0:
                return
            if bucket := buckets.get(r):
                heappush(bucket, i)
            else:
                buckets[r] = [i]
                waiting.add(r)

        for i in range(n - 1):
            push(i, i + 2)
        while waiting.top:
            r = waiting.pop()
            bucket = buckets[r]
            i = heappop(bucket)
            if bucket:
                waiting.add(r)
            if pending[i] != r:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pending[i] = pending[j] = -1
            if k < n:
                before[k] = i
                push(i, after[k])
            if before[i] >= 0:
                push(before[i], k)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == keys, self._pair_ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token: one queue for all, whose buckets hold positions of all their lists."""
        ids = [self.ranks.get(p) for p in pieces]
        todo = [i for i, x in enumerate(ids) if x is None and pieces[i]]
        out = [b"" if x is None else pack("<I", x) for x in ids]
        if not todo:
            return out
        sizes = np.array([len(pieces[i]) for i in todo])
        token = self._byte_ids[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)]
        n = len(token)
        owner = np.repeat(np.arange(len(todo)), sizes)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1  # -1: none
        before[ends - sizes] = -1
        pending, alive = np.full(n, -1), np.ones(n, bool)
        waiting, buckets = RankBitmap(len(self.tokens)), {}

        def push(at: np.ndarray) -> None:
            """Queue the pairs that start at these positions, each of which has a token after it."""
            ranks = pending[at] = self._rank_of_pairs(token[at], token[after[at]])
            some = ranks >= 0
            at, ranks = at[some], ranks[some]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for lo, hi in zip(bounds, bounds[1:]):
                r = int(ranks[lo])
                if bucket := buckets.get(r):
                    bucket.append(at[lo:hi])
                else:
                    buckets[r] = [at[lo:hi]]
                    waiting.add(r)

        push(np.flatnonzero(after >= 0))
        while waiting.top:
            r = waiting.pop()
            bucket = buckets.pop(r)
            at = bucket[0] if len(bucket) == 1 else np.sort(np.concatenate(bucket))
            at = at[pending[at] == r]  # the others are stale
            if len(at) > 1:
                own = owner[at]
                first = np.concatenate([[True], own[1:] != own[:-1]])
                if not first.all():  # a pre-token's later positions wait for what its first one brings about
                    buckets[r] = [at[~first]]
                    waiting.add(r)
                    at = at[first]
            elif not len(at):
                continue
            gone = after[at]
            then = after[gone]
            token[at] = r
            after[at] = then
            alive[gone] = False
            pending[gone] = pending[at] = -1
            linked = then >= 0
            before[then[linked]] = at[linked]
            ahead = before[at]
            push(np.concatenate([at[linked], ahead[ahead >= 0]]))
        ids_left = token[alive].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(owner[alive], minlength=len(todo))) * 4).tolist()
        for i, lo, hi in zip(todo, [0, *stops], stops):
            out[i] = ids_left[lo:hi]
        return out


_encoders: dict[tuple[int, str, type[Encoder]], Encoder] = {}


def encoder(rank_file: bytes, pattern: str, kind: type[Encoder] = Encoder) -> Encoder:
    """This process's encoder; its tables, of the vocabulary's size, outlive a task, and whoever uses it releases its cache."""
    key = (hash(rank_file), pattern, kind)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = kind(rank_file, pattern)
    return _encoders[key]


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids (if kept), ids_sha256 and decoded_sha256; decoding reads the ids, not the text."""
    names = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    carried = [c for c in docs.columns if c not in names]
    fields = [docs.schema[c] for c in carried] + [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if keep_ids:
        fields.append(StructField("ids", ArrayType(IntegerType(), False)))
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value, pattern)
        try:
            yield from coded(bpe, batches)
        finally:
            bpe.release()

    def coded(bpe: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in text_blocks(batch, text, BLOCK):
                packed = bpe.packed([x or "" for x in texts])
                n = [len(ids) >> 2 for ids in packed]
                sha = [hashlib.sha256(ids).hexdigest() for ids in packed]
                plain = [hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest() for ids in packed]
                arrays = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carried] + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(plain, pa.string())]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                yield pa.RecordBatch.from_arrays(arrays, carried + ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return docs.select(*carried).mapInArrow(tidied(run), StructType(fields))


def decode(encoded: DataFrame, rank_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of its ids (null ids: empty)."""
    spark: SparkSession = encoded.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(rank_path))
    carried = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value, "")
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids))
            decoded = [b"".join(bpe.tokens[t] for t in values[i].as_py() or ()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in carried] + [pa.array(decoded, pa.binary())], [*carried, "decoded"])

    return encoded.select(*carried).mapInArrow(run, StructType([encoded.schema[c] for c in carried] + [StructField("decoded", BinaryType())]))
