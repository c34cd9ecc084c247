"""Quality rules, line first, with DataFrame functions only.

Rules look at single lines: punctuation (symbol clutter, shouting), navigation (bars of short links,
breadcrumb separators) and boilerplate (notices, and a line that repeats an earlier one). Lines that fail are removed; a
document is rejected if its statistics fail, or if removal takes too much of its text. Everything is computed
within the document's row, so nothing is shuffled.

Repeated windows are found exactly: positions are packed under 34 bits of a hash of their window and sorted;
neighbours with equal hashes are candidates, and the windows' words decide.

Defined results
  null or empty text   no words, no lines; base_failed, not kept; the cleaned text is empty
  very long text       any length; up to 2**30 words
  ties, repeated rows  rows are judged on their own
  empty table          no rows
  other columns        carried along; a column named as one that this operator adds is replaced
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, once, words_of

POSITION_BITS = 30
WINDOW = 5

#: Phrases of boilerplate lines and separators of navigation bars, as Java regular expressions.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|we use cookies|accept (all )?cookies|"
    r"javascript (is|must be) (disabled|enabled)|enable javascript|click here|read more|sign up for our newsletter|subscribe to our|"
    r"follow us on|share (this|on) (facebook|twitter)|skip to (main )?content|powered by|lorem ipsum)\b"
)
NAVIGATION = r"[|»›·•]|(^|\s)(>|/|::)(\s|$)"
SEPARATORS = r"[|»›·•>/:]"  # characters that every separator has one of
SYMBOLS = r"[#*$%&|<>]"
COUNTED_SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityConfig:
    symbol_percent: int = 40  # symbols per 100 words that a line may have
    shout_percent: int = 60  # capitals per 100 letters, in lines of shout_words words at least
    shout_words: int = 3
    bang_percent: int = 50  # exclamation marks and question marks per 100 words
    separator_percent: int = 15  # navigation separators per 100 words
    notice_words: int = 30  # a line with a boilerplate phrase fails up to this length
    keep_percent: int = 50  # of the text's word characters that must be left


def repeated_words(words: Column, n: Column) -> Column:
    """Number of words in 5-word windows that occur twice or more in the text."""
    mask = F.lit((1 << POSITION_BITS) - 1).cast("long")
    at = lambda i, k: F.get(words, i + k)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(*(at(i, k) for k in range(WINDOW))), POSITION_BITS).bitwiseOR(i.cast("long")))
    high = lambda x: F.shiftright(x, POSITION_BITS)

    def candidates(keys: Column) -> Column:
        return F.filter(keys, lambda x, j: F.coalesce(high(x) == high(F.get(keys, j - 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(keys, j + 1)), F.lit(False)))

    def exact(found: Column) -> Column:
        spelled = F.transform(found, lambda x: F.struct(F.array_join(F.slice(words, x.bitwiseAND(mask).cast("int") + 1, WINDOW), " ").alias("w"), x.bitwiseAND(mask).alias("i")))
        same = lambda v, x, j: x["w"].eqNullSafe(F.get(v, j)["w"])
        kept = let(F.sort_array(spelled), lambda v: F.filter(v, lambda x, j: same(v, x, j - 1) | same(v, x, j + 1)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    start = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
    total = F.aggregate(
        let(let(F.sort_array(packed), candidates), lambda found: F.when(F.size(found) > 0, exact(found)).otherwise(F.array().cast("array<bigint>"))),
        start,
        lambda a, s: F.struct(s.alias("last"), (a.total + F.least(F.lit(WINDOW).cast("long"), s - a.last)).alias("total")),
        lambda a: a.total,
    )
    return F.coalesce(total, F.lit(0)).cast("long")


def line_fails(line: Column, words: Column, config: QualityConfig) -> Column:
    """Whether a line with words fails a punctuation, navigation or boilerplate rule. ``words``: their number."""
    symbols, bangs = F.regexp_count(line, F.lit(SYMBOLS)), F.regexp_count(line, F.lit("[!?]"))
    # Letters are counted by taking runs of other characters out: a list of single letters would be far longer.
    capitals, letters = (F.length(F.regexp_replace(line, rf"\P{{{kind}}}+", "")) for kind in ("Lu", "L"))
    # What is cheap or seldom true comes first, the rest is then not asked.
    return (
        (symbols * 100 > words * config.symbol_percent)
        | let(bangs, lambda n: (n > 2) & (n * 100 > words * config.bang_percent))
        | ((words >= config.shout_words) & let(capitals, lambda n: (n > 0) & (n * 100 > letters * config.shout_percent)))
        | ((words > 1) & line.rlike(SEPARATORS) & (F.regexp_count(line, F.lit(NAVIGATION)) * 100 > words * config.separator_percent))
        | ((words <= config.notice_words) & line.rlike(BOILERPLATE))
    )


def apply_quality_rules(docs: DataFrame, config: QualityConfig = QualityConfig(), text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned_text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned_text"]
    value = F.coalesce(F.col(text), F.lit(""))
    spoken = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    chars = lambda x: F.length(F.translate(x, SPACES, ""))
    n_words = lambda x: F.regexp_count(x, F.lit(f"[^{SPACE_CLASS[1:]}+"))
    carried = docs.select(*[c for c in docs.columns if c not in names])
    parts = once(carried.withColumn("_text", value), _words=words_of(F.col("_text")), _lines=F.split("_text", "\n"))
    parts = once(parts, _said=F.filter("_lines", spoken))
    counted = once(
        parts,
        n_words=F.size("_words").cast("long"),
        word_chars=chars(F.col("_text")).cast("long"),
        n_symbols=F.regexp_count("_text", F.lit(COUNTED_SYMBOLS)).cast("long"),
        n_dup_lines=(F.size("_said") - F.size(F.array_distinct("_said"))).cast("long"),
        n_repeat_words=repeated_words(F.col("_words"), F.size("_words")),
    )
    counted = counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    good = F.filter("_lines", lambda x: ~spoken(x) | let(n_words(x), lambda n: ~line_fails(x, n, config)))
    # Of lines that an earlier one equals, the first stays; array_distinct keeps first places, and empty lines are separators anyway.
    cleaned = once(counted, _good=good)
    cleaned = once(cleaned, cleaned_text=F.array_join(F.when(F.col("n_dup_lines") > 0, F.array_distinct("_good")).otherwise(F.col("_good")), "\n"))
    enough = chars(F.col("cleaned_text")) * 100 >= F.col("word_chars") * config.keep_percent
    judged = once(cleaned, kept=~F.col("base_failed") & enough)
    return judged.select(*carried.columns, *names)
