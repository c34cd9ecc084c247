"""Chat formatting in budgeted windows, with DataFrame functions only.

A window holds a turn-aligned span of a conversation. Prefix sums of turn tokens choose the spans: a turn
belongs to the span ``floor((prefix sum through it - 1) / span_tokens)``, and a turn longer than
``long_tokens`` is a span of its own, so a span has less than ``span_tokens + long_tokens`` tokens unless it
is one long turn. Every window after the first repeats the system turn and up to ``history_turns`` turns before its
span, as far as they fit into ``history_tokens`` and, with the span and the system turn, into ``budget_tokens``.
So only a long turn or a long system turn can bring a window over the budget. Assistant turns of the span are
targets; repeated ones are masked. Turns are never cut. Tokens are estimated: runs of non-blank characters, or a
quarter of the bytes if that is more, so that scripts without blanks count too.

Prefix sums are taken in two levels (blocks of ``block_turns`` turn numbers, then blocks of the
conversation), so a conversation with a third of all rows is spread over many tasks, and no step collects
more than one window.

Template: ``<turn:ROLE:>\\n TEXT </turn>\\n`` for each turn. In roles and texts every backslash is doubled and
a backslash is put inside the control strings, so none of them occurs there; dropping each backslash
before a character gives the text back.

Defined results
  null text, role    empty
  null conv_id       one conversation of its own
  null turn          before all others
  ties               rows of equal turn are ordered by role, then text; equal rows stay, each a turn
  repeated rows      turns of their own
  very long texts    a window of their own; a text is never cut
  empty table        no windows
  other columns      ignored
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, MIDDLE, CLOSE = "<turn:", ":>", "</turn>"


@dataclass(frozen=True)
class ChatConfig:
    budget_tokens: int = 512
    span_tokens: int = 256
    long_tokens: int = 128
    history_turns: int = 2
    history_tokens: int = 96
    turn_overhead: int = 4  # tokens that the template adds to a turn
    block_turns: int = 1024


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, MIDDLE, CLOSE):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column, config: ChatConfig) -> Column:
    """Token estimate of a turn: runs of characters other than blank, tab and line ends, or a quarter of the bytes; and the template's."""
    runs = F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long")
    return F.greatest(runs, F.ceil(F.octet_length(text) / 4)) + F.lit(config.turn_overhead)


def numbered_turns(turns: DataFrame, config: ChatConfig) -> DataFrame:
    """``conv_id, idx, role, text, tokens, before, longs``: position, tokens and long turns before it, by two-level prefix sums."""
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tokens", turn_tokens(F.col("text"), config)).withColumn("block", F.floor(F.col("turn") / config.block_turns))
    rows = rows.withColumn("is_long", (F.col("tokens") > config.long_tokens).cast("long"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        "*", F.row_number().over(inside).cast("long").alias("nth"), F.sum("tokens").over(inside).alias("upto"), F.sum("is_long").over(inside).alias("longs_upto")
    )
    earlier = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("is_long").alias("l"))
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("n", "t", "l")),
    )
    joined = local.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block")))
    return joined.select(
        "conv_id", (F.col("n0") + F.col("nth") - 1).alias("idx"), "role", "text", "tokens", "is_long",
        (F.col("t0") + F.col("upto") - F.col("tokens")).alias("before"), (F.col("l0") + F.col("longs_upto") - F.col("is_long")).alias("longs"),
    )


def format_windows(turns: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """``conv_id, window_start, formatted, n_repeated, loss_spans``: a row per window.

    ``window_start`` is the position of the span's first turn; ``loss_spans`` has start and length (code
    points of ``formatted``) of the targets' escaped texts; the first ``n_repeated`` turns are repeated ones.
    """
    turns = numbered_turns(turns, config)
    span = F.floor((F.col("before") + F.col("tokens") - 1) / config.span_tokens)
    spans = Window.partitionBy("conv_id", "longs", "is_long", "span")
    own = turns.withColumn("span", span).withColumn("window_start", F.min("idx").over(spans))
    heads = own.where((F.col("idx") == F.col("window_start")) & (F.col("idx") > 0)).select(
        F.col("conv_id").alias("_conv"), F.col("window_start").alias("_start"), F.col("before").alias("_before"),
        F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.sequence(F.greatest(F.col("idx") - config.history_turns, F.lit(0)), F.col("idx") - 1)))).alias("_idx"),
    )
    near = (F.col("_start") - F.col("idx") <= config.history_turns) & (F.col("_before") - F.col("before") <= config.history_tokens)
    repeated = heads.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("idx") == F.col("_idx"))).where(
        ((F.col("idx") == 0) & (F.col("role") == "system")) | near
    )
    item = lambda owned, back: F.struct("idx", "role", "text", F.lit(owned).alias("own"), "tokens", back.alias("back")).alias("item")
    parts = own.select("conv_id", "window_start", item(True, F.lit(0).cast("long"))).unionByName(
        repeated.select("conv_id", F.col("_start").alias("window_start"), item(False, F.col("_before") - F.col("before")))
    )
    windows = parts.groupBy("conv_id", "window_start").agg(F.sort_array(F.collect_list("item")).alias("items"))
    kept_first = lambda x: x.own | ((x.idx == 0) & (x.role == "system"))
    taken = F.aggregate("items", F.lit(0).cast("long"), lambda total, x: total + F.when(kept_first(x), x.tokens).otherwise(F.lit(0)))
    # An item's ``back`` is the tokens from it to the span, so what fits is the nearest turns.
    windows = windows.withColumn("room", F.lit(config.budget_tokens) - taken)
    windows = windows.withColumn("items", F.filter("items", lambda x: kept_first(x) | (x.back <= F.col("room"))))
    head = lambda x: F.concat(F.lit(OPEN), escape(x.role), F.lit(MIDDLE + "\n"))
    windows = windows.withColumn(
        "pieces",
        F.transform("items", lambda x: F.struct(head(x).alias("head"), escape(x.text).alias("body"), ((x.role == "assistant") & x.own).alias("loss"))),
    )
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        start, size = state.at + F.length(piece["head"]), F.length(piece["body"])
        found = F.struct(start.alias("start"), size.alias("length"))
        spans_now = F.when(piece["loss"], F.concat(state.spans, F.array(found))).otherwise(state.spans)
        return F.struct((start + size + len(CLOSE) + 1).alias("at"), spans_now.alias("spans"))

    return windows.select(
        "conv_id", "window_start",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "").alias("formatted"),
        F.size(F.filter("items", lambda x: ~x.own)).alias("n_repeated"),
        F.aggregate("pieces", zero, step, lambda s: s.spans).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Turns read back from formatted windows, repeated ones left out: ``conv_id, window_start, nth, role, text``."""
    pieces = F.split(F.col("formatted"), CLOSE + "\n")
    pieces = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    read = windows.select("conv_id", "window_start", F.posexplode(pieces).alias("nth", "piece"))
    at = F.instr("piece", MIDDLE + "\n")
    return read.select(
        "conv_id", "window_start", "nth",
        unescape(F.substring("piece", F.lit(len(OPEN) + 1), at - 1 - len(OPEN))).alias("role"),
        unescape(F.substring("piece", at + len(MIDDLE) + 1, F.length("piece"))).alias("text"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, from its windows alone. A digest of a whole conversation needs its text in one row."""
    turns = read_windows(windows).select("conv_id", "window_start", "nth", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"))
    per_turn = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window_start", "nth", "said"))).alias("all")
    )
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s.start + 1, s.length))), "")
    per_window = windows.select("conv_id", "window_start", F.length("formatted").cast("long").alias("chars"), masked.alias("loss"))
    per_window = per_window.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window_start", "loss"))).alias("losses")
    )
    left = per_turn.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("all", lambda x: x.said), ""), 256).alias("turns_sha256"))
    text = F.array_join(F.transform("losses", lambda x: x.loss), "")
    right = per_window.select(
        F.col("conv_id").alias("_conv"), F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars"
    )
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
