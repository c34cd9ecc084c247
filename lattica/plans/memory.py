"""Agent memory: scopes, expiry, recall in several channels, reflection and observation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import search as S

#: Words that mark preferences and causes in memories.
PREFERENCE_WORDS = ("prefers", "likes", "enjoys", "chooses", "selects")
CAUSE_WORDS = ("because", "since", "due to", "caused", "resulted in", "led to")
#: Sections of a reflection by type of memory.
SECTIONS = (("world", "Facts"), ("bank", "Experiences"), ("observation", "Insights"), ("opinion", "Beliefs"))


@dataclass(frozen=True)
class Bank:
    id: str
    name: str = ""
    skepticism: int = 3
    literalism: int = 3
    empathy: int = 3

    def is_valid(self) -> bool:
        return all(1 <= t <= 5 for t in (self.skepticism, self.literalism, self.empathy))


def bucket(scope: str, user: str = "", session: str = "", namespace: str = "default") -> str:
    """Bucket id of a scope: global, user or session; an empty scope is the narrowest that has an id."""
    scope = scope.strip().lower() or ("session" if session.strip() else "user" if user.strip() else "global")
    owner = {"global": None, "user": user, "session": session}
    if scope not in owner:
        raise ValueError(f"unsupported scope {scope}")
    if owner[scope] is None:
        return f"memory:{scope}:{namespace}"
    if not owner[scope].strip():
        raise ValueError(f"an id is required for scope {scope}")
    return f"memory:{scope}:{owner[scope]}:{namespace}"


def with_expiry(memories: DataFrame, ttl_seconds: Column, created: str = "created_at") -> DataFrame:
    """``expires_at``: creation plus a positive time to live, else null."""
    return memories.withColumn("expires_at", F.when(ttl_seconds > 0, F.timestamp_seconds(F.unix_timestamp(created) + ttl_seconds)))


def alive(memories: DataFrame, now: Column | None = None) -> DataFrame:
    return memories.where(F.col("expires_at").isNull() | (F.col("expires_at") >= (F.current_timestamp() if now is None else now)))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return S.ranked(rows.select("id", "score"), k)


def recall(memories: DataFrame, bank: str, k: int = 10, vector: Sequence[float] | None = None, words: Sequence[str] = (), between: tuple[datetime, datetime] | None = None, entities: Sequence[str] = ()) -> DataFrame:
    """``id, score`` of a bank's memories by up to four channels (semantic, keyword, temporal, entity), fused by reciprocal ranks if more than one ran.

    Bank and time are asked before any channel's top-k.
    """
    own = memories.where(F.col("bank_id") == bank)
    score = V.cosine(F.col("vector"), vector) if vector is not None else F.lit(0.0)
    legs = []
    if vector is not None:
        legs.append(_ranked(own.withColumn("score", score), k))
    if words:
        legs.append(_ranked(T.bm25_search(own.select("id", T.token_set(F.col("content")).alias("tokens")), [w.lower() for w in words]), k))
    if between is not None:
        legs.append(_ranked(own.where(F.col("created_at").between(*between)).withColumn("score", score), k))
    if entities:
        named = F.arrays_overlap(F.transform("entities", F.lower), F.array(*(F.lit(e.lower()) for e in entities)))
        legs.append(_ranked(own.where(named).withColumn("score", score), k))
    fused = legs[0].select("id", "score") if len(legs) == 1 else S.rrf(legs)
    return fused.orderBy(F.desc("score"), "id").limit(k)


def reflect(recalled: DataFrame, query: str, budget_tokens: int = 0) -> DataFrame:
    """One row (context, tokens): recalled ``id, type, content, score, confidence`` as text by type; tokens are a quarter of the characters."""
    shown = {
        "world": F.format_string("- %s (score: %.3f)\n", "content", "score"), "bank": F.concat(F.lit("- "), "content", F.lit("\n")),
        "observation": F.format_string("- %s (confidence: %.2f)\n", "content", "confidence"), "opinion": F.format_string("- %s (confidence: %.2f)\n", "content", "confidence"),
    }
    line = F.coalesce(*(F.when(F.col("type") == kind, text) for kind, text in shown.items()))
    rows = recalled.select("type", F.struct((-F.col("score")).alias("s"), "id", line.alias("line")).alias("x"))
    out = F.concat(F.lit(f"# Relevant Memories for: {query}\n\n"))
    lists = rows.agg(*(F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.col("x")))).alias(kind) for kind, _ in SECTIONS))
    for kind, title in SECTIONS:
        body = F.array_join(F.transform(kind, lambda x: x.line), "")
        end = "" if kind == "opinion" else "\n"
        out = F.concat(out, F.when(F.size(kind) > 0, F.concat(F.lit(f"## {title}\n"), body, F.lit(end))).otherwise(F.lit("")))
    empty = sum((F.size(kind) for kind, _ in SECTIONS), F.lit(0)) == 0
    text = lists.select(F.when(empty, F.lit("No relevant memories found.")).otherwise(out).alias("context"))
    if budget_tokens > 0:
        text = text.select(F.substring("context", 1, 4 * budget_tokens).alias("context"))
    return text.withColumn("tokens", F.floor(F.length("context") / 4))


def confidence(n: Column, bank: Bank | None) -> Column:
    """A tenth per memory up to 0.9, times 0.8 for skeptical banks and 1.1 for trusting ones, between 0.1 and 1."""
    base = F.least(n / 10, F.lit(0.9))
    if bank is not None:
        base = base * (0.8 if bank.skepticism >= 4 else 1.1 if bank.skepticism <= 2 else 1.0)
    return F.greatest(F.least(base, F.lit(1.0)), F.lit(0.1))


def _mentions(words: Sequence[str]) -> Column:
    content = F.lower(F.coalesce(F.col("content"), F.lit("")))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(content, F.lit(w))
    return found


def observe(memories: DataFrame, bank: Bank | None = None) -> DataFrame:
    """``kind, subject, memories, confidence``: entities with two memories and preference or cause words, and the most frequent long word of three memories or more (ties: the least word)."""
    each = memories.select("id", F.explode(F.array_distinct("entities")).alias("subject"), _mentions(PREFERENCE_WORDS).cast("int").alias("p"), _mentions(CAUSE_WORDS).cast("int").alias("c"))
    groups = each.groupBy("subject").agg(F.count("*").alias("memories"), F.max("p").alias("p"), F.max("c").alias("c")).where("memories >= 2")
    kinds = F.explode(F.filter(F.array(F.when(F.col("p") > 0, F.lit("preference")), F.when(F.col("c") > 0, F.lit("causal"))), lambda k: k.isNotNull()))
    found = groups.select(kinds.alias("kind"), "subject", "memories")
    words = memories.select(F.explode(T.fields(F.lower("content"))).alias("subject")).where(F.octet_length("subject") > 4)
    top = words.groupBy("subject").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "subject").limit(1)
    total = memories.agg(F.count("*").alias("memories")).where("memories >= 3")
    general = top.crossJoin(F.broadcast(total)).select(F.lit("generalization").alias("kind"), "subject", "memories")  # single rows
    return found.unionByName(general).withColumn("confidence", confidence(F.col("memories"), bank))


def chat_search(messages: DataFrame, vector: Sequence[float], session: str | None = None, user: str | None = None, exclude: str | None = None, k: int = 10) -> DataFrame:
    """Messages by similarity, in a session or of a user's sessions but one."""
    kept = messages.where(F.col("vector").isNotNull())
    for column, value in (("session_id", session), ("user_id", user)):
        kept = kept if value is None else kept.where(F.col(column) == value)
    kept = kept if exclude is None else kept.where(F.col("session_id") != exclude)
    return S.top_k(kept, vector, k)


def keyword_messages(messages: DataFrame, sessions: DataFrame, words: Sequence[str], user: object, exclude: object = None, k: int = 10, require_all: bool = True) -> DataFrame:
    """A user's messages with the words, by BM25 over all of them, outside one session."""
    theirs = messages.join(sessions.where(F.col("user_id") == user).select("session_id"), "session_id", "left_semi")
    theirs = theirs if exclude is None else theirs.where(F.col("session_id") != exclude)
    hits = T.bm25_search(theirs.select("id", T.token_set(F.col("content")).alias("tokens")), [w.lower() for w in words], require_all=require_all)
    return hits.orderBy(F.desc("score"), "id").limit(k)


def extracted(memories: DataFrame, facts: DataFrame) -> DataFrame:
    """Memories with the facts that an extractor gave; facts without id or vector are left out."""
    from ..operators.store import upsert

    return upsert(memories, facts.where(F.col("id").isNotNull() & V.is_valid(F.col("vector"))))
