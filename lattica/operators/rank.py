"""Rerankers, normalisation and greedy selection.

Greedy steps depend on each choice before, so they run in numpy, one task per query, over candidate lists whose
size is bounded by the caller's k.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def normalize(rows: DataFrame, low: float = 0.0, high: float = 1.0, group: Sequence[str] = (), score: str = "score", flat: float | None = None) -> DataFrame:
    """Scores mapped to [low, high] within each group; where all are equal, ``flat`` or ``low``. The window sees aggregates joined back, not one task."""
    ends = rows.groupBy(*group).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    joined = rows.join(ends, [*group]) if group else rows.crossJoin(F.broadcast(ends))
    width = F.col("_hi") - F.col("_lo")
    value = F.when(width < 1e-9, F.lit(low if flat is None else flat)).otherwise(low + (F.col(score) - F.col("_lo")) / width * (high - low))
    return joined.withColumn(score, value).drop("_lo", "_hi")


def keyword_boost(rows: DataFrame, keywords: Sequence[str], boost: float = 0.1, content: str = "content", score: str = "score") -> DataFrame:
    """Score times 1 + boost for each keyword that the text contains, ignoring case."""
    found = sum((F.contains(F.lower(F.coalesce(F.col(content), F.lit(""))), F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return rows.withColumn(score, F.col(score) * (1 + boost * found))


def word_overlap(content: Column, query: str) -> Column:
    """Share of the query's words (repeats count) that are words of the text."""
    words = query.lower().split()
    if not words:
        return F.lit(0.0)
    own = T.fields(F.lower(content))
    return sum((F.array_contains(own, w).cast("int") for w in words), F.lit(0)) / len(words)


def rrf_rerank(rows: DataFrame, query: str, k: float = 60.0, vector_weight: float = 0.5, text_weight: float = 0.5, content: str = "content", key: str = "id") -> DataFrame:
    """Weighted reciprocal ranks by score and by word overlap (ties by score order). ``rows`` are one query's candidates."""
    by_score = rows.withColumn("_v", F.row_number().over(Window.orderBy(F.desc("score"), key))).withColumn("_t", word_overlap(F.col(content), query))
    by_text = by_score.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_t"), "_v")))
    return by_text.withColumn("score", vector_weight / (k + F.col("_v")) + text_weight / (k + F.col("_r"))).drop("_v", "_t", "_r")


def weighted_rerank(legs: Sequence[tuple[DataFrame, float]], key: str = "id") -> DataFrame:
    """``key, score``: weighted mean of several rerankers' scores."""
    total = sum(w for _, w in legs)
    united = None
    for leg, weight in legs:
        part = leg.select(key, (F.col("score") * weight).alias("score"))
        united = part if united is None else united.unionByName(part)
    return united.groupBy(key).agg((F.sum("score") / total).alias("score"))


def _cosines(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1)
    return np.divide(v @ v.T, n[:, None] * n[None, :], out=np.zeros((len(v), len(v))), where=(n[:, None] * n[None, :]) > 0)


def mmr(scores: np.ndarray, vectors: np.ndarray, k: int, weight: float = 0.5) -> list[int]:
    """Positions in order of choice: weight times the score less the rest times the greatest similarity to those chosen (at least 0)."""
    weight = weight or 0.5
    if not len(scores):
        return []
    similar = _cosines(vectors)
    chosen = [int(np.argmax(scores))]
    most = np.maximum(similar[chosen[0]], 0)
    free = np.ones(len(scores), bool)
    free[chosen[0]] = False
    while len(chosen) < min(k, len(scores)):
        value = np.where(free, weight * scores - (1 - weight) * most, -np.inf)
        best = int(np.argmax(value))
        chosen.append(best)
        free[best] = False
        most = np.maximum(most, similar[best])
    return chosen


def spread(scores: np.ndarray, vectors: np.ndarray, k: int, least: float = 0.1) -> list[int]:
    """Positions by falling score whose cosine distance to all chosen before is ``least`` at least."""
    similar, chosen = _cosines(vectors), []
    for i in np.argsort(-scores, kind="stable"):
        if len(chosen) >= k:
            break
        if all(1 - similar[i, j] >= least for j in chosen):
            chosen.append(int(i))
    return chosen


def determinantal(scores: np.ndarray, vectors: np.ndarray, k: int, most: int = 100) -> list[int]:
    """Greedy choice by kernel gain K_ii - sum K_ij^2 / K_jj, K_ij = similarity * sqrt(s_i s_j), K_ii = s_i, of the first ``most`` candidates; ends at gains of 0."""
    n = min(len(scores), most)
    if n <= k:
        return list(range(n))
    s = np.maximum(scores[:n], 0)
    kernel = _cosines(vectors[:n]) * np.sqrt(s[:, None] * s[None, :])
    np.fill_diagonal(kernel, scores[:n])
    gain, free, chosen = kernel.diagonal().copy(), np.ones(n, bool), []
    while len(chosen) < k:
        value = np.where(free, gain, -np.inf)
        best = int(np.argmax(value))
        if value[best] <= 0:
            break
        chosen.append(best)
        free[best] = False
        if kernel[best, best] > 0:
            gain = gain - kernel[:, best] ** 2 / kernel[best, best]
    return chosen


SELECTIONS: dict[str, Callable[..., list[int]]] = {"mmr": mmr, "distance": spread, "dpp": determinantal}


def select_diverse(candidates: DataFrame, k: int, method: str = "mmr", group: str = "query_id", key: str = "id", **options: float) -> DataFrame:
    """``group, key, score, rank`` of the rows chosen from ``group, key, score, vector``; candidates are taken in order of score, then key."""
    choose = SELECTIONS[method]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", key], ascending=[False, True], kind="stable")
        picked = choose(rows["score"].to_numpy(), np.array(rows["vector"].tolist(), np.float64), k, **options)
        out = rows.iloc[picked][[group, key, "score"]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    kinds = dict(candidates.dtypes)
    return candidates.select(group, key, "score", "vector").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, score double, rank bigint")


def select_random(candidates: DataFrame, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    """k of the 2 k best by a seeded hash of the key, in order of score."""
    pool = candidates.orderBy(F.desc("score"), key).limit(2 * k)
    return pool.orderBy(F.xxhash64(F.lit(seed), key)).limit(k).orderBy(F.desc("score"), key)


def pack(sizes: Sequence[int], owners: Sequence[object], most: int, budget: int, per_owner: int) -> list[int]:
    """Positions that fit: at most ``most``, ``per_owner`` each, and a budget that skips what is too long; the first always fits."""
    taken: list[int] = []
    counts: dict[object, int] = {}
    used = 0
    for i, (size, owner) in enumerate(zip(sizes, owners)):
        if len(taken) >= most:
            break
        if owner and counts.get(owner, 0) >= per_owner:
            continue
        if taken and used + size > budget:
            continue
        taken.append(i)
        used += size
        if owner:
            counts[owner] = counts.get(owner, 0) + 1
    return taken or [0][: len(sizes)]


#: A reranker takes the candidates ``id, content, score`` and the query, and returns them with another score.
Reranker = Callable[[DataFrame, str], DataFrame]


def by_score(score: Callable[[Column, Column], Column]) -> Reranker:
    """The reranker of a scoring function of content and score, built-in expression or pandas UDF."""
    return lambda rows, query: rows.withColumn("score", score(F.col("content"), F.col("score")))


def search_reranked(rows: DataFrame, query: Sequence[float], text: str, reranker: Reranker, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """The max(50, 5 k) nearest rows, reranked; those below a positive threshold go, the k best stay."""
    from .search import top_k

    found = reranker(top_k(rows, query, max(50, 5 * k)), text)
    found = found.where(F.col("score") >= threshold) if threshold > 0 else found
    return found.orderBy(F.desc("score"), "id").limit(k)
