"""Vector arithmetic as Column expressions, in double precision.

Against a literal vector the sums are unrolled, so they stay inside whole-stage code generation; between two
columns they are higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | Sequence[float]
UNROLL = 512


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def as_column(v: Vector) -> Column:
    return v if isinstance(v, Column) else literal(v)


def _fold(a: Column, b: Vector, term: Callable[[Column, Column], Column]) -> Column:
    if not isinstance(b, Column) and len(b) <= UNROLL:
        return reduce(add, (term(F.get(a, F.lit(i)).cast("double"), F.lit(float(x))) for i, x in enumerate(b)), F.lit(0.0))
    pairs = F.zip_with(a, as_column(b), lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), add)


def _same_size(a: Column, b: Vector) -> Column:
    return F.size(a) == (F.size(b) if isinstance(b, Column) else len(b))


def dot(a: Column, b: Vector) -> Column:
    """Dot product; 0 for vectors of different size."""
    return F.when(_same_size(a, b), _fold(a, b, lambda x, y: x * y)).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Vector) -> Column:
    """Cosine similarity; 0 for vectors of different size or without length."""
    other = F.lit(sum(float(x) ** 2 for x in b) ** 0.5) if not isinstance(b, Column) else norm(b)
    scale = norm(a) * other
    return F.when(_same_size(a, b) & (scale > 0), _fold(a, b, lambda x, y: x * y) / scale).otherwise(0.0)


def distance(a: Column, b: Vector) -> Column:
    """Euclidean distance; infinite for vectors of different size."""
    return F.when(_same_size(a, b), F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))).otherwise(float("inf"))


def negative_distance(a: Column, b: Vector) -> Column:
    return -distance(a, b)


SIMILARITIES: dict[str, Callable[[Column, Vector], Column]] = {"cosine": cosine, "dot": dot, "euclidean": negative_distance}
#: Distances of the indexes; a vector without length has cosine distance 1.
DISTANCES: dict[str, Callable[[Column, Vector], Column]] = {"euclidean": distance, "cosine": lambda a, b: 1 - cosine(a, b), "dot": lambda a, b: -dot(a, b)}


def normalized(a: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def stddev(a: Column) -> Column:
    """Sample standard deviation of the components; 0 for fewer than two."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - mean) * (x.cast("double") - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0)


def is_valid(a: Column) -> Column:
    """Not null, not empty, every component finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(a) > 0) & F.forall(a, finite), F.lit(False))


def hamming(a: Column, b: Column | int) -> Column:
    """Differing bits of two packed codes."""
    return F.bit_count(a.bitwiseXOR(b if isinstance(b, Column) else F.lit(b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared items over the greater set's size; 0 if a set is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(0.0)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps from term to weight."""
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x)
    shared = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.element_at(b, k), F.lit(0.0)))
    scale = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(scale > 0, shared / scale).otherwise(0.0)


# Dimension adaptation. Each returns a vector of length 1, as the adapted vector of the reference's policies is.


def truncate(a: Column, dim: int) -> Column:
    return normalized(F.slice(a, 1, dim))


def truncate_by_importance(a: Column, dim: int) -> Column:
    """The ``dim`` components of greatest magnitude in their old order; ties go to the first."""
    indexed = F.transform(a, lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("m"), i.alias("i"), x.alias("x")))
    top = F.slice(F.array_sort(indexed), 1, dim)
    return normalized(F.transform(F.array_sort(F.transform(top, lambda t: F.struct(t.i.alias("i"), t.x.alias("x")))), lambda t: t.x))


def pad(a: Column, dim: int) -> Column:
    filled = F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(a), F.lit(0))))
    return normalized(filled)


def pad_with_noise(a: Column, dim: int, seed: int = 42) -> Column:
    """Padding of 1 % of the vector's deviation, from a seeded hash of the vector (sum of 12 uniform values less 6)."""
    spread = stddev(a) * 0.01
    uniform = lambda i, k: F.pmod(F.xxhash64(a, i, F.lit(seed + k)), F.lit(1 << 30)) / float(1 << 30)
    noise = lambda i: (reduce(add, (uniform(i, k) for k in range(12))) - 6.0) * spread
    extra = F.when(F.size(a) < dim, F.transform(F.sequence(F.size(a), F.lit(dim - 1)), noise)).otherwise(F.array().cast("array<double>"))
    return normalized(F.concat(F.transform(a, lambda x: x.cast("double")), extra))


def adapt(a: Column, dim: int, policy: str = "smart") -> Column:
    """A vector of ``dim`` components. Policies: strict, warn (a mismatch is an error), truncate, pad, smart."""
    same = F.transform(a, lambda x: x.cast("double"))
    if policy in ("strict", "warn"):
        changed = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(a).cast("string"))).cast("array<double>")
    elif policy in ("smart", "truncate", "pad"):
        shorter = truncate_by_importance(a, dim) if policy == "smart" else truncate(a, dim)
        longer = pad_with_noise(a, dim) if policy == "smart" else pad(a, dim)
        changed = F.when(F.size(a) > dim, shorter).otherwise(longer)
    else:
        raise ValueError(f"unknown policy {policy}")
    return F.when(F.size(a) == dim, same).otherwise(changed)
