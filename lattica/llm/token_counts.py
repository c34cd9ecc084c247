"""Token counts that follow edits.

A document's state is a segment tree over blocks of its pre-tokens: every node has the characters and the
tokens below it. An edit re-encodes only the blocks that it touches and the context around it that can
change pre-token boundaries, then updates the sums on the paths to the root.

Why that is enough: a match of the pre-token pattern depends on the text from its start to two characters
beyond its end at most (a contraction's second letter, the character after a run of white space), so a
pre-token that ends two characters before the edit stays. The pattern never looks back, so once the new
scan meets an old block boundary behind the edit, all that follows is as before. However long an insertion is, only
its own pre-tokens, the context and the blocks at both ends are encoded; where it needs more blocks, they go
between the old ones.

State columns: n_tokens and tree, an array of 2 * capacity * 2 numbers (characters and tokens by node, node 1
is the root, leaf i is node capacity + i). Counting is a narrow step: documents don't move.

Texts and edits go block by block, so that new pre-tokens are encoded together: those of all texts, then those that every
text's first edit asks for, then the second's and so on. ``count_edits`` counts and edits in one pass with one cache.

Defined results
  null or empty text      no tokens; the tree has one empty leaf
  null edits              no edits; nulls among them are skipped
  edits out of range      positions and lengths are cut to the text as it is when their turn comes
  ties                    edits apply in the order given, each to the result of those before it
  repeated rows           rows are counted each on its own
  very long text          a tree of 1/16 of its pre-tokens; an edit's work doesn't depend on the text's length but for copying it
  empty table             no rows
  other columns           carried along; a column named as one that an operator adds is replaced
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .bpe import Encoder, encoder, load_ranks
from .common import slices, text_blocks, tidied

LEAF = 32  # pre-tokens of a block
COUNT_BLOCK = 3_000_000  # bytes of the texts whose new pre-tokens are encoded together
SWEEP_PIECE = 64  # bytes of the longest pre-token that is merged in rows
SWEEP_BYTES = 1 << 18  # of pre-tokens that are rows of a sweep's matrices together
NO_PAIR = np.int32(2**31 - 1)  # above all ranks
CONTEXT = 2  # characters behind a pre-token's end that its match can depend on

#: Schema of the column of edits: replace ``length`` characters from ``start`` by ``insert``.
EDITS = "array<struct<start:int,length:int,insert:string>>"


class RowEncoder(Encoder):
    """An encoder that merges short new pre-tokens as rows of matrices; other ones as ``Encoder`` does, with the same ids.

    A merge takes one token from a row, so a sweep goes down from the longest rows to single tokens: at each length it
    merges the lowest, leftmost pair of every row at once, rows without a pair are done, and the others join those that
    begin at the length below. A sweep has as many steps as its longest pre-token has bytes.
    """

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        super().__init__(rank_file, pattern)
        pairs = self._rank_of_pairs(np.repeat(self._byte_ids, 256), np.tile(self._byte_ids, 256))
        self._byte_pairs = np.where(pairs < 0, NO_PAIR, pairs).astype(np.int32)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        ids = [self.ranks.get(p) for p in pieces]
        out = [b"" if x is None else pack("<I", x) for x in ids]
        long = [i for i, x in enumerate(ids) if x is None and len(pieces[i]) > SWEEP_PIECE]
        for i, packed in zip(long, super().merge_many([pieces[i] for i in long])):
            out[i] = packed
        rows = [i for i, x in enumerate(ids) if x is None and 0 < len(pieces[i]) <= SWEEP_PIECE]
        sizes = [len(pieces[i]) for i in rows]
        for lo, hi in slices(rows, sizes, SWEEP_BYTES):
            self._sweep([(i, pieces[i]) for i in rows[lo:hi]], out)
        return out

    def _sweep(self, rows: list[tuple[int, bytes]], out: list[bytes]) -> None:
        """Put the packed ids of pre-tokens at their places in ``out``."""
        starting: dict[int, list[tuple[int, bytes]]] = {}
        for row in rows:
            starting.setdefault(len(row[1]), []).append(row)
        size = max(starting)
        place, token, pair = np.zeros(0, np.int64), np.zeros((0, size), np.int32), np.zeros((0, size - 1), np.int32)
        for size in range(size, 0, -1):
            if new := starting.get(size):
                raw = np.frombuffer(b"".join([p for _, p in new]), np.uint8).reshape(len(new), size).astype(np.int32)
                place = np.concatenate([place, [i for i, _ in new]])
                token = np.concatenate([token, self._byte_ids[raw].astype(np.int32)])
                pair = np.concatenate([pair, self._byte_pairs[raw[:, :-1] << 8 | raw[:, 1:]]])
            at = np.arange(len(place))
            best = pair.argmin(axis=1) if size > 1 else at * 0
            rank = pair[at, best] if size > 1 else np.full(len(at), NO_PAIR)
            done = rank == NO_PAIR
            packed, width = token[done].astype("<u4").tobytes(), 4 * size
            for k, i in enumerate(place[done].tolist()):
                out[i] = packed[k * width : (k + 1) * width]
            left = ~done
            if size == 1:
                return
            place, token, pair, best, rank = place[left], token[left], pair[left], best[left], rank[left]
            at = np.arange(len(place))
            kept = np.ones(token.shape, bool)
            kept[at, best + 1] = False
            token = token[kept].reshape(len(at), size - 1)
            token[at, best] = rank
            kept = np.ones(pair.shape, bool)
            kept[at, best] = False
            pair = pair[kept].reshape(len(at), size - 2)
            # The merged token's pairs with the tokens before and behind it.
            before, behind = np.flatnonzero(best > 0), np.flatnonzero(best < size - 2)
            row, first = np.concatenate([before, behind]), np.concatenate([best[before] - 1, best[behind]])
            found = self._rank_of_pairs(token[row, first].astype(np.int64), token[row, first + 1])
            pair[row, first] = np.where(found < 0, NO_PAIR, found)


def build_tree(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Segment tree over pre-tokens with these characters and tokens; rows are nodes, columns characters and tokens."""
    return tree_over(leaves_of(sizes, counts))


def leaves_by_joins(bpe: Encoder, pieces: list[str]) -> np.ndarray:
    """``leaves_of`` of pre-tokens that the encoder's cache has, from the lengths of what they and their ids make together."""
    ids, starts = list(map(bpe.cache.__getitem__, pieces)), range(0, len(pieces), LEAF)
    sizes = [len("".join(pieces[i : i + LEAF])) for i in starts]
    counts = [len(b"".join(ids[i : i + LEAF])) >> 2 for i in starts]
    return np.array([sizes, counts], np.int64).T.reshape(-1, 2)


def leaves_of(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of characters and tokens for every ``LEAF`` pre-tokens."""
    starts = np.arange(0, len(sizes), LEAF)
    return np.stack([np.add.reduceat(x, starts) for x in (sizes, counts)], axis=1) if len(sizes) else np.zeros((0, 2), np.int64)


def tree_over(leaves: np.ndarray) -> np.ndarray:
    capacity = 1 << max(len(leaves) - 1, 0).bit_length()
    tree = np.zeros((2 * capacity, 2), np.int64)
    tree[capacity : capacity + len(leaves)] = leaves
    while capacity > 1:
        half = capacity // 2
        tree[half:capacity] = tree[capacity : 2 * capacity : 2] + tree[capacity + 1 : 2 * capacity : 2]
        capacity = half
    return tree


def leaf_at(tree: np.ndarray, offset: int) -> tuple[int, int]:
    """The leaf that holds a character, and where it starts; the last leaf with text for offsets beyond."""
    capacity, node, start = len(tree) // 2, 1, 0
    offset = min(offset, int(tree[1, 0]) - 1)
    while node < capacity:
        node *= 2
        left = int(tree[node, 0])
        if offset >= start + left:
            start += left
            node += 1
    return node - capacity, start


def tokens_before(tree: np.ndarray, leaf: int) -> int:
    """Sum of the tokens of all leaves before one."""
    node, total = leaf + len(tree) // 2, 0
    while node > 1:
        if node & 1:
            total += int(tree[node - 1, 1])
        node >>= 1
    return total


class CountedText:
    """A text and its tree."""

    def __init__(self, bpe: Encoder, text: str, tree: np.ndarray | None = None) -> None:
        self.bpe, self.text, self.encoded = bpe, text, 0
        self.open: tuple[list[str], int | None, int | None] = [], None, None
        self.pattern = bpe.pattern_for(text)
        if tree is None:
            self._rebuild()
        else:
            self.tree = tree

    def _rebuild(self) -> None:
        pieces = self.bpe.pieces([self.text])[0]
        self.encoded += len(pieces)
        self.tree = build_tree(np.array([len(p) for p in pieces], np.int64), np.array(self.bpe.counts(pieces), np.int64))

    @property
    def n_tokens(self) -> int:
        return int(self.tree[1, 1])

    def edit(self, start: int, length: int, insert: str) -> None:
        self.bpe.learn(self.scan(start, length, insert))
        self.settle()

    def scan(self, start: int, length: int, insert: str) -> list[str]:
        """Edit the text. The pre-tokens that this brings about, which ``settle`` expects in the encoder's cache."""
        old, tree = self.text, self.tree
        start = min(max(start, 0), len(old))
        stop = min(start + max(length, 0), len(old))
        self.text = new = old[:start] + insert + old[stop:]
        if self.pattern is not self.bpe.exact:  # it serves for the old text and for what is left of it
            self.pattern = self.bpe.pattern_for(insert)
        if not old or not new:
            pieces = self.bpe.findall(new)
            self.open = pieces, None, None
            return pieces
        capacity, shift = len(tree) // 2, len(new) - len(old)
        first, begin = leaf_at(tree, max(start - CONTEXT, 0))
        # Boundaries behind the edit that the new scan may meet, each with the leaf that ends there.
        last, end = leaf_at(tree, max(stop - 1, 0))
        last, end = max(first, last), end
        end = begin + int(tree[capacity + first, 0]) if last == first else end + int(tree[capacity + last, 0])
        pieces = []
        goal = end + shift
        for m in self.pattern.finditer(new, begin):
            pieces.append(m[0])
            at = m.end()
            if at < goal:
                continue
            while at > goal:
                last += 1
                goal += int(tree[capacity + last, 0])
            if at == goal and at - shift >= stop:
                break
        self.open = pieces, first, last
        return pieces

    def settle(self) -> None:
        """Bring the tree up to date with the last ``scan``."""
        (pieces, first, last), tree = self.open, self.tree
        self.encoded += len(pieces)
        fresh = leaves_by_joins(self.bpe, pieces)
        if first is None:
            self.tree = tree_over(fresh)
            return
        capacity = len(tree) // 2
        slots = last - first + 1
        if len(fresh) > slots:
            # New leaves go between the old ones, whose sums stay as they are; none of their text is encoded again.
            leaves = tree[capacity:]
            leaves = np.concatenate([leaves[:first], fresh, leaves[last + 1 :]])
            self.tree = tree_over(leaves[leaves[:, 0] > 0])
            return
        tree[capacity + first : capacity + last + 1] = 0
        tree[capacity + first : capacity + first + len(fresh)] = fresh
        lo, hi = (capacity + first) // 2, (capacity + last) // 2
        while lo:
            tree[lo : hi + 1] = tree[2 * lo : 2 * hi + 2 : 2] + tree[2 * lo + 1 : 2 * hi + 2 : 2]
            lo, hi = lo // 2, hi // 2


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _lists(trees: list[np.ndarray]) -> pa.Array:
    sizes = [t.size for t in trees]
    flat = np.concatenate([t.ravel() for t in trees]).astype(np.int32) if trees else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _counted(bpe: Encoder, batches: Iterator[pa.RecordBatch], text: str, carried: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, texts in text_blocks(batch, text, COUNT_BLOCK):
            trees = [tree_over(leaves_by_joins(bpe, pieces)) for pieces in bpe.pieces([t or "" for t in texts])]
            made = [pa.array([int(t[1, 1]) for t in trees], pa.int64()), _lists(trees)]
            yield pa.RecordBatch.from_arrays([_column(batch, c).slice(lo, hi - lo) for c in carried] + made, [*carried, "n_tokens", "tree"])


def _edited(bpe: Encoder, batches: Iterator[pa.RecordBatch], text: str, edits: str, carried: list[str], keep_state: bool = True, known: bool = False) -> Iterator[pa.RecordBatch]:
    """known: the cache has the pre-tokens of a batch's texts."""
    for batch in batches:
        for lo, hi, texts in text_blocks(batch, text, COUNT_BLOCK):
            trees = _column(batch, "tree").slice(lo, hi - lo)
            done = [CountedText(bpe, value or "", tree.values.to_numpy().astype(np.int64).reshape(-1, 2)) for value, tree in zip(texts, trees)]
            todo = [(state, iter([c for c in changes or () if c])) for state, changes in zip(done, _column(batch, edits).slice(lo, hi - lo).to_pylist())]
            if not known:
                bpe.learn()
            while todo := [(state, changes, change) for state, changes in todo if (change := next(changes, None))]:
                bpe.add(*[state.scan(change["start"] or 0, change["length"] or 0, change["insert"] or "") for state, _, change in todo])
                for state, _, _ in todo:
                    state.settle()
                todo = [(state, changes) for state, changes, _ in todo]
            made = {"n_tokens": pa.array([s.n_tokens for s in done], pa.int64()), "n_encoded": pa.array([s.encoded for s in done], pa.int64())}
            if keep_state:
                made = {text: pa.array([s.text for s in done], pa.string()), "tree": _lists([s.tree for s in done])} | made
            yield pa.RecordBatch.from_arrays([_column(batch, c).slice(lo, hi - lo) for c in carried] + [*made.values()], [*carried, *made])


#: Fields that the operators add.
TOKENS, TREE, ENCODED = StructField("n_tokens", LongType()), StructField("tree", ArrayType(IntegerType(), False)), StructField("n_encoded", LongType())


def count_tokens(docs: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and tree."""
    carried = [c for c in docs.columns if c not in ("n_tokens", "tree")]
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value, pattern, RowEncoder)
        try:
            yield from _counted(bpe, batches, text, carried)
        finally:
            bpe.release()

    return docs.select(*carried).mapInArrow(tidied(run), StructType([docs.schema[c] for c in carried] + [TOKENS, TREE]))


def apply_edits(counted: DataFrame, rank_path: str, pattern: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """``counted`` after its edits: text, n_tokens and tree are replaced; n_encoded tells how many pre-tokens were encoded for that."""
    carried = [c for c in counted.columns if c not in (text, "n_tokens", "tree", "n_encoded")]
    ranks = counted.sparkSession.sparkContext.broadcast(load_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value, pattern, RowEncoder)
        try:
            yield from _edited(bpe, batches, text, edits, carried)
        finally:
            bpe.release()

    return counted.mapInArrow(tidied(run), StructType([counted.schema[c] for c in carried] + [StructField(text, StringType()), TREE, TOKENS, ENCODED]))


def count_edits(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", edits: str = "edits", keep_state: bool = True) -> DataFrame:
    """``apply_edits`` of ``count_tokens`` in one pass, and n_before, the tokens before the edits; text and tree go unless their state is kept."""
    carried = [c for c in docs.columns if c not in ("n_tokens", "tree", "n_encoded", "n_before")]
    left = [c for c in carried if c != text]
    state = [StructField(text, StringType()), TREE] if keep_state else []
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value, pattern, RowEncoder)
        counted = (b.append_column("n_before", _column(b, "n_tokens")) for b in _counted(bpe, batches, text, carried))
        try:
            yield from _edited(bpe, counted, text, edits, [*left, "n_before"], keep_state, known=True)
        finally:
            bpe.release()

    return docs.select(*carried).mapInArrow(tidied(run), StructType([docs.schema[c] for c in left] + [StructField("n_before", LongType()), *state, TOKENS, ENCODED]))
