"""Metadata filters: expression tree, builder, parser, and their Column forms.

Metadata are maps from string to string. A numeric literal is compared as a number if the value parses as one, else
as text. Two flavours differ in four points:

  pre    missing key: the row drops out, also for != and NOT; LIKE ignores case; < and > against a number ask for numbers
  post   missing key: only != holds; LIKE respects case; NOT of a missing key's comparison holds
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "between", "in", "like", "regex")


@dataclass(frozen=True)
class Filter:
    """A comparison (op, key, value), or and/or/not over parts."""

    op: str
    key: str = ""
    value: Any = None
    parts: tuple[Filter, ...] = field(default=())

    def __and__(self, other: Filter) -> Filter:
        return Filter("and", parts=(self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter("or", parts=(self, other))

    def __invert__(self) -> Filter:
        return Filter("not", parts=(self,))

    def column(self, get: Callable[[str], Column] | str = "metadata", flavour: str = "pre") -> Column:
        """A condition that is never null. ``get`` gives a key's value, or names a map column."""
        lookup = (lambda k: F.element_at(F.col(get), k)) if isinstance(get, str) else get
        return F.coalesce(self._column(lookup, flavour), F.lit(False))

    def _column(self, get: Callable[[str], Column], flavour: str) -> Column:
        if self.op in ("and", "or"):
            return reduce(and_ if self.op == "and" else or_, (p._column(get, flavour) for p in self.parts))
        if self.op == "not":
            inner = self.parts[0]._column(get, flavour)
            return ~inner if flavour == "pre" else ~F.coalesce(inner, F.lit(False))
        v = get(self.key)
        if self.op == "between":
            low, high = self.value
            return compare(v, ">=", low, flavour) & compare(v, "<=", high, flavour)
        if self.op == "in":
            return reduce(or_, (compare(v, "=", x) for x in self.value)) if self.value else F.lit(False)
        if self.op == "like":
            return v.ilike(self.value) if flavour == "pre" else v.like(self.value)
        if self.op == "regex":
            return v.rlike(self.value)
        out = compare(v, self.op, self.value, flavour)
        return F.coalesce(out, F.lit(True)) if self.op == "!=" and flavour == "post" else out


def text_of(value: Any) -> str:
    """The text that a typed value is stored as."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return f"{value:g}" if isinstance(value, float) else str(value)


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def compare(value: Column, op: str, literal: Any, flavour: str = "pre") -> Column:
    same = _COMPARE[op]
    if isinstance(literal, (int, float)) and not isinstance(literal, bool):
        number = value.cast("string").try_cast("double")
        if flavour == "pre" and op not in ("=", "!="):
            return same(number, F.lit(float(literal)))
        return F.when(number.isNotNull(), same(number, F.lit(float(literal)))).otherwise(same(value.cast("string"), F.lit(text_of(literal))))
    return same(value.cast("string"), F.lit(text_of(literal)))


class MetadataFilter:
    """Builder whose calls are joined by AND; ``or_`` joins two builders' filters."""

    def __init__(self, root: Filter | None = None) -> None:
        self.root = root

    def _add(self, f: Filter) -> MetadataFilter:
        return MetadataFilter(f if self.root is None else self.root & f)

    def equal(self, key: str, value: Any) -> MetadataFilter:
        return self._add(Filter("=", key, value))

    def not_equal(self, key: str, value: Any) -> MetadataFilter:
        return self._add(Filter("!=", key, value))

    def greater_than(self, key: str, value: Any) -> MetadataFilter:
        return self._add(Filter(">", key, value))

    def greater_than_or_equal(self, key: str, value: Any) -> MetadataFilter:
        return self._add(Filter(">=", key, value))

    def less_than(self, key: str, value: Any) -> MetadataFilter:
        return self._add(Filter("<", key, value))

    def less_than_or_equal(self, key: str, value: Any) -> MetadataFilter:
        return self._add(Filter("<=", key, value))

    def between(self, key: str, low: Any, high: Any) -> MetadataFilter:
        return self._add(Filter("between", key, (low, high)))

    def in_(self, key: str, *values: Any) -> MetadataFilter:
        return self._add(Filter("in", key, tuple(values)))

    def not_in(self, key: str, *values: Any) -> MetadataFilter:
        return self._add(~Filter("in", key, tuple(values)))

    def like(self, key: str, pattern: str) -> MetadataFilter:
        return self._add(Filter("like", key, pattern))

    def regex(self, key: str, pattern: str) -> MetadataFilter:
        return self._add(Filter("regex", key, pattern))

    def and_(self, other: MetadataFilter) -> MetadataFilter:
        return self if other.root is None else self._add(other.root)

    def or_(self, other: MetadataFilter) -> MetadataFilter:
        if self.root is None or other.root is None:
            return MetadataFilter(self.root or other.root)
        return MetadataFilter(self.root | other.root)

    def is_empty(self) -> bool:
        return self.root is None

    def build(self) -> Filter:
        if self.root is None:
            raise ValueError("empty filter")
        return self.root


_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*'|\"[^\"]*\")|(?P<op>!=|<>|>=|<=|:=|=|>|<|:)|(?P<mark>[(),])|(?P<word>[^\s()=<>!:,'\"]+))")


def parse_filter(text: str) -> Filter:
    """``key op value`` joined by NOT, AND, OR (in falling precedence) and parentheses; also BETWEEN a AND b, IN (...), LIKE, REGEX, key:value."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read filter at {text[at:]!r}")
        tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    place = 0

    def peek() -> tuple[str, str]:
        return tokens[place] if place < len(tokens) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal place
        place += 1
        return tokens[place - 1] if place <= len(tokens) else ("end", "")

    def is_word(word: str) -> bool:
        return peek()[0] == "word" and peek()[1].upper() == word

    def expect(value: str) -> None:
        kind, got = take()
        if got.upper() != value:
            raise ValueError(f"expected {value}, got {got or kind!r}")

    def literal() -> Any:
        kind, got = take()
        if kind == "text":
            return got[1:-1].replace("''", "'") if got[0] == "'" else got[1:-1]
        if kind != "word":
            raise ValueError(f"expected a value, got {got or kind!r}")
        if got.lower() in ("true", "false"):
            return got.lower() == "true"
        for convert in (int, float):
            try:
                return convert(got)
            except ValueError:
                pass
        return got

    def either() -> Filter:
        left = both()
        while is_word("OR"):
            take()
            left = left | both()
        return left

    def both() -> Filter:
        left = single()
        while is_word("AND"):
            take()
            left = left & single()
        return left

    def single() -> Filter:
        if is_word("NOT"):
            take()
            return ~single()
        if peek()[1] == "(":
            take()
            inner = either()
            expect(")")
            return inner
        kind, key = take()
        if kind not in ("word", "text"):
            raise ValueError(f"expected a key, got {key or kind!r}")
        key = key if kind == "word" else key[1:-1]
        negated = is_word("NOT") and bool(take())
        kind, op = take()
        word = op.upper()
        if kind == "op":
            out = Filter({"<>": "!=", ":": "=", ":=": "="}.get(op, op), key, literal())
        elif word == "BETWEEN":
            low = literal()
            expect("AND")
            out = Filter("between", key, (low, literal()))
        elif word == "IN":
            expect("(")
            values = [literal()]
            while peek()[1] == ",":
                take()
                values.append(literal())
            expect(")")
            out = Filter("in", key, tuple(values))
        elif word in ("LIKE", "REGEX"):
            out = Filter(word.lower(), key, str(literal()))
        else:
            raise ValueError(f"expected an operator, got {op or kind!r}")
        return ~out if negated else out

    root = either()
    if place < len(tokens):
        raise ValueError(f"unexpected {tokens[place][1]!r}")
    return root


def equality_filter(wanted: Mapping[str, Any], metadata: str = "metadata") -> Column:
    """Every key has exactly this text; a missing key fails."""
    conditions = [F.coalesce(F.element_at(F.col(metadata), k) == text_of(v), F.lit(False)) for k, v in wanted.items()]
    return reduce(and_, conditions, F.lit(True))


@dataclass(frozen=True)
class Facet:
    """kind: equals, in, range (low, high; either may be None), contains, prefix, exists, and, or, not."""

    kind: str
    value: Any = None
    parts: Sequence[Facet] = ()

    def column(self, v: Column) -> Column:
        return F.coalesce(self._column(v), F.lit(False))

    def _column(self, v: Column) -> Column:
        if self.kind in ("and", "or"):
            return reduce(and_ if self.kind == "and" else or_, (p._column(v) for p in self.parts))
        if self.kind == "not":
            return ~reduce(and_, (p._column(v) for p in self.parts))
        if self.kind == "equals":
            return compare(v, "=", self.value)
        if self.kind == "in":
            return reduce(or_, (compare(v, "=", x) for x in self.value))
        if self.kind == "range":
            low, high = self.value
            number = v.cast("string").try_cast("double")
            bounds = ([number >= float(low)] if low is not None else []) + ([number <= float(high)] if high is not None else [])
            return reduce(and_, bounds, number.isNotNull())
        if self.kind == "exists":
            return v.isNotNull() if self.value in (None, True) else v.isNull()
        text = v.cast("string")
        if self.kind == "contains":
            return F.contains(F.lower(text), F.lit(self.value.lower()))
        if self.kind == "prefix":
            return F.startswith(F.lower(text), F.lit(self.value.lower()))
        raise ValueError(f"unknown facet {self.kind}")


def facets_filter(facets: Mapping[str, Facet], get: Callable[[str], Column]) -> Column:
    return reduce(and_, (f.column(get(k)) for k, f in facets.items()), F.lit(True))
