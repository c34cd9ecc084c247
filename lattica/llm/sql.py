"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .chat import ChatConfig
from .common import LOWER, UPPER
from .quality import BOILERPLATE, NAVIGATION, SYMBOLS, QualityConfig
from .warc import BASE32

_LOW = "translate({t}, '" + UPPER + "', '" + LOWER + "')"
_WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"


def _chat(c: ChatConfig = ChatConfig()) -> str:
    escaped = "length(replace(replace(replace(replace({x}, '\\', '\\\\'), '<turn:', '<\\turn:'), ':>', ':\\>'), '</turn>', '<\\/turn>'))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
a AS (SELECT *, row_number() OVER w - 1 AS idx, greatest(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), (strlen(text) + 3) // 4) + {c.turn_overhead} AS tokens,
  17 + {escaped.format(x='role')} + {escaped.format(x='text')} AS size FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (SELECT *, (tokens > {c.long_tokens})::INT AS long, sum(tokens) OVER w - tokens AS before FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
s AS (SELECT *, sum(long) OVER (PARTITION BY conv_id ORDER BY idx) - long AS longs, (before + tokens - 1) // {c.span_tokens} AS span FROM b),
o AS (SELECT *, min(idx) OVER w AS start, sum(tokens) OVER w + coalesce(max(tokens) FILTER (idx = 0 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS taken
  FROM s WINDOW w AS (PARTITION BY conv_id, longs, long, span)),
r AS (SELECT x.conv_id, sum(x.size) AS size FROM o h JOIN o x ON x.conv_id = h.conv_id AND x.idx < h.idx WHERE h.idx = h.start
  AND ((x.idx = 0 AND x.role = 'system') OR (h.idx - x.idx <= {c.history_turns} AND h.before - x.before <= least({c.history_tokens}, {c.budget_tokens} - h.taken))) GROUP BY 1),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '') AS loss, sum(size) AS own FROM o GROUP BY 1)
SELECT g.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (own + coalesce(r.size, 0))::BIGINT AS formatted_chars FROM g LEFT JOIN r USING (conv_id)"""


_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_GROUP = "to_base(('0x' || substr(h, {at}, 10))::BIGINT, 32, 8)"
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, translate({' || '.join(_GROUP.format(at=1 + 10 * g) for g in range(4))}, '{_DIGITS}', '{BASE32}') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM o"""


def _quality(c: QualityConfig = QualityConfig()) -> str:
    count = lambda pattern: f"len(regexp_extract_all(l, '{pattern}'))"
    n = count(r"[^\x20\x09-\x0D]+")
    fails = (
        f"({count(SYMBOLS)} * 100 > {n} * {c.symbol_percent}) OR ({count('[!?]')} * 100 > {n} * {c.bang_percent} AND {count('[!?]')} > 2)"
        f" OR ({n} >= {c.shout_words} AND {count(chr(92) + 'p{Lu}')} * 100 > {count(chr(92) + 'p{L}')} * {c.shout_percent})"
        f" OR ({count(NAVIGATION)} * 100 > {n} * {c.separator_percent} AND {n} > 1) OR (regexp_matches(l, '{BOILERPLATE}') AND {n} <= {c.notice_words})"
    )
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(t='text')} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i + 1 : i + 5], ' ')) AS c FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d)),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE c > 1) GROUP BY 1),
k AS (SELECT doc_id, coalesce(list_sum(list_transform(list_distinct(list_filter(ls, lambda l: NOT ({fails}))), lambda l: length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')))), 0) AS chars FROM d),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, chars FROM d LEFT JOIN r USING (doc_id) JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND chars * 100 >= word_chars * {c.keep_percent} AS kept FROM s"""


_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(t=_LOW.format(t='text'))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS total, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * shared >= 80 * (total - shared)), m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT m.b, r.root FROM r JOIN m ON m.a = r.id WHERE r.root < m.b)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, c.root AS component_id, s.doc_id = c.root AS kept FROM s JOIN (SELECT id, min(root) AS root FROM r GROUP BY 1) c ON c.id = s.doc_id"""

_TERMS = r"regexp_extract_all(coalesce(" + _LOW.format(t="text") + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAM = f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS key FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM k))),
h AS (SELECT doc_id, n, i, item_id FROM g JOIN k USING (n, key)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": _chat(),
    "op3_warc_archive": _WARC,
    "op4_quality_rules": _quality(),
    "op5_minhash_near_dedup": _NEAR,
    "op10_benchmark_decontamination": _DECONTAM,
}
