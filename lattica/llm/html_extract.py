"""Main text of web pages by nearest-URL page differencing.

Pages are paired with the nearest page of the same host in URL-path order, their text lines are aligned by
longest common subsequence, and shared lines are deleted: menus, footers and notices that a site repeats. The
markup only mends what a pair can't show. Lines in a page's article stay even if the other page repeats them,
because a passage that two articles share is text of both; and lines that the pair doesn't share go if they stand in
elements that are boilerplate by name, class or role, like an advert that only one page has.

Pages move once, to tasks by ranges of (host, path, page_id), and are read there in that order with one page
before and after in hand, so a host with a third of all rows is spread out and no group is collected. The
bounds of the ranges come from a sample of the addresses; a pass over the addresses finds the first and last
page of each range, and these are also sent to the range before and after, as neighbours only. So every page
whose host has another page is paired, however the ranges fall.

Defined results
  null html          an empty text
  null url           host and path are empty
  ties               pages of equal path are ordered by page_id, null first
  no other page      on the host: nothing is deleted by differencing
  br, inline tags    part of their block; a br counts as white space
  repeated rows      a page each; from a page with the same lines differencing deletes nothing
  very long html     read whole, in one task; the alignment takes a bit a line of one page for each line of the other
  empty table        no rows
  other columns      ignored
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidied

#: HTML element names by role.
RAW = "script|style|noscript|template|svg|math|textarea|title|iframe|object|select|button|canvas|audio|video|datalist"
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may be left unclosed or that no rule needs to follow to their end.
UNTRACKED = frozenset("p li dt dd tr td th thead tbody tfoot hr br h1 h2 h3 h4 h5 h6 option caption body html head".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs topbar header footer masthead cookie cookies consent notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comments comment respond replies disqus widget "
    "form search pagination pager toolbar copyright legal skip".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _marks(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is an article."""
    if tag in BOILERPLATE_TAGS:
        return True, False
    boiler, content = False, tag in ("article", "main")
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            value = next(filter(None, values), "").strip()
            if name.lower() == "role":
                boiler |= value.lower() in BOILERPLATE_ROLES
                content |= value.lower() == "main"
            else:
                words = set(_SPLIT.split(value.lower()))
                boiler |= bool(words & BOILERPLATE_WORDS)
                content |= tag in ("div", "section") and bool(words & CONTENT_WORDS)
    return boiler and tag not in ("html", "body"), content and not boiler


def page_lines(page: str) -> list[tuple[str, bool, bool]]:
    """Blocks of a page in order: text, whether it stands in boilerplate, and in an article."""
    out: list[tuple[str, bool, bool]] = []
    open_tags: list[tuple[str, bool, bool]] = []  # tag, boilerplate, article: of the element or one around it
    buffer: list[str] = []
    line_off = False  # the block itself (p, li, h1 ...) is boilerplate

    def flush() -> None:
        nonlocal line_off
        text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        if text:
            _, boiler, content = open_tags[-1] if open_tags else ("", False, False)
            out.append((text, boiler or line_off, content))
        line_off = False

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            buffer.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if tag in UNTRACKED:
            line_off = not m["end"] and _marks(tag, m["attrs"])[0]
        elif m["end"]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    del open_tags[i:]
                    break
        elif not m["attrs"].endswith("/"):
            boiler, content = _marks(tag, m["attrs"])
            _, b, c = open_tags[-1] if open_tags else ("", False, False)
            open_tags.append((tag, boiler or b, content or c))
    if at < len(page):
        buffer.append(page[at:])
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by bit-parallel rows over Python integers."""
    masks: dict[str, int] = {}
    for i, line in enumerate(a):
        masks[line] = masks.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for line in b:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # Bit i of a row is 0 where the LCS grows by a[i]: walk back from the end.
    found, i = set(), len(a) - 1
    for j in range(len(b) - 1, -1, -1):
        before = rows[j - 1] if j else full
        while i >= 0 and rows[j] >> i & 1:
            i -= 1
        if i < 0:
            break
        if before >> i & 1 == 0:  # without b[j] the same length
            continue
        if a[i] == b[j]:
            found.add(i)
            i -= 1
    return found


def main_text(lines: list[tuple[str, bool, bool]], other: list[tuple[str, bool, bool]] | None) -> tuple[str, int]:
    """A page's lines without those that the other page shares, and how many those are; then what is boilerplate by markup goes, too."""
    here, there = ([x[0] for x in page] for page in (lines, other or []))
    shared = common_lines(here, there) if here != there else set()  # a copy of the page shows nothing
    gone = {i for i in shared if not lines[i][2]}  # an article's lines stay
    return "\n".join(text for i, (text, boiler, _) in enumerate(lines) if i not in gone and not boiler), len(gone)


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


#: Sampled addresses for each range, which the driver sorts; pages of a range; most ranges that follow from that.
SAMPLED, RANGE_PAGES, RANGES = 30, 2048, 20_000


def _bounds(keys: DataFrame, n: int, parts: int) -> list[tuple]:
    """Least keys of all ranges but the first, from a sample of the n rows."""
    if parts < 2 or not n:
        return []
    wanted = SAMPLED * parts
    found = sorted(tuple(r) for r in (keys.sample(min(1.0, wanted / n), 42) if n > wanted else keys).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


KEY = "struct<host:string,path:string,at:bigint>"


def _constant(value: list, kind: str) -> Column:
    """A literal in one expression, however long."""
    return F.from_json(F.lit(json.dumps(value)), kind, {"mode": "FAILFAST"})


def _part(k: Column, bounds: list[tuple]) -> Column:
    """The number of bounds up to a key, by binary search."""
    least = _constant([dict(zip(("host", "path", "at"), b)) for b in bounds], f"array<{KEY}>")
    steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(least, n + step - 1) <= k, n + step).otherwise(n))


def extract_main_text(pages: DataFrame, prefix: int | None = None, parts: int | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared`` for every row of ``pages(page_id, url, html)``; n_shared lines went because the paired page has them.

    ``parts``: how many ranges, by default as many as shuffle partitions, or more for a table of more pages; ``prefix``: of no effect, callers still pass it.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    address = F.regexp_replace(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = rows.withColumn("host", F.lower(F.regexp_extract(address, "^[^/?#]*", 0))).withColumn("path", F.regexp_extract(address, "^[^/?#]*([^?#]*)", 1))
    rows = rows.withColumn("at", F.coalesce(F.col("page_id").cast("bigint"), F.lit(-(1 << 63))))
    key = ("host", "path", "at")
    n = rows.count()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-n // RANGE_PAGES), RANGES))
    bounds = _bounds(rows.select(*key), n, parts)
    rows = rows.withColumn("k", F.struct(*key))
    if bounds:
        rows = rows.withColumn("part", _part(F.col("k"), bounds))
        edges = rows.groupBy("part").agg(F.min("k").alias("first"), F.max("k").alias("last")).orderBy("part").collect()
        # For each range its edge pages and the next ranges with rows on both sides, where these pages go too.
        seams: list[dict] = [{}] * (len(bounds) + 1)
        for i, e in enumerate(edges):
            seams[e["part"]] = {"first": e["first"].asDict(), "last": e["last"].asDict()}
            seams[e["part"]] |= {"before": edges[i - 1]["part"] if i else None, "after": edges[i + 1]["part"] if i + 1 < len(edges) else None}
        seam = F.get(_constant(seams, f"array<struct<first:{KEY},last:{KEY},before:int,after:int>>"), F.col("part"))
        to = [F.when(F.col("k") == seam["first"], seam["before"]), F.when(F.col("k") == seam["last"], seam["after"])]
        rows = rows.select("page_id", "url", "html", *key, F.posexplode(F.array_compact(F.array("part", *to))).alias("copy", "part"))
        rows = rows.repartitionById(len(bounds) + 1, F.col("part"))
    else:
        rows = rows.withColumn("copy", F.lit(0)).repartition(1)
    rows = rows.select("page_id", "url", "html", *key, "copy").sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed() -> Iterator[tuple]:
            for batch in batches:
                cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "host", "path", "copy")]
                for i in range(batch.num_rows):
                    page_id, url, page, host, path, copy = (c[i].as_py() for c in cols)
                    yield page_id, url, host, path, page_lines(page or ""), copy

        def results() -> Iterator[tuple]:
            before, here = None, None
            for after in _chain(parsed()):
                if here is not None and not here[5]:
                    near = [x for x in (before, after) if x is not None and x[2] == here[2]]
                    best = max(near, key=lambda x: _alike(x[3], here[3]), default=None)
                    yield here[0], here[1], *main_text(here[4], best and best[4])
                before, here = here, after

        out: list[tuple] = []
        size = 0
        for row in results():
            out.append(row)
            size += len(row[2])
            if size > 4_000_000 or len(out) >= 2000:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    return rows.mapInArrow(tidied(run), "page_id bigint, url string, text string, n_chars bigint, n_shared bigint")


def _chain(rows: Iterator[tuple]) -> Iterator[tuple | None]:
    yield from rows
    yield None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
        ["page_id", "url", "text", "n_chars", "n_shared"],
    )
