"""Result diversification: content types in turn, maximal marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Substrings of lower-cased content that give its type; the first type with one of them counts.
CONTENT_TYPES = {
    "code": ["function", "def ", "class ", "import ", "const ", "let ", "var ", "```", "code example", "snippet", "syntax"],
    "tutorial": ["step 1", "step 2", "tutorial", "guide", "walkthrough", "how to", "instructions", "follow these steps"],
    "api": ["api", "endpoint", "request", "response", "http", "get ", "post ", "put ", "delete ", "rest"],
    "configuration": ["config", "configuration", "settings", "options", "setup", "install", "environment"],
}


def content_type(content: Column, metadata: Column | None = None) -> Column:
    """``metadata.content_type`` if there, else by the content's substrings, else 'general'."""
    low = F.lower(content)
    out = None
    for kind, parts in CONTENT_TYPES.items():
        found = F.lit(False)
        for p in parts:
            found = found | low.contains(p)
        out = F.when(found, kind) if out is None else out.when(found, kind)
    out = out.otherwise("general")
    return out if metadata is None else F.coalesce(F.try_variant_get(metadata, "$.content_type", "string"), out)


def by_content_type(results: DataFrame, cap: int = 2, seq: str = "seq", score: str = "similarity", group: str | None = None) -> DataFrame:
    """Results in turn from each type, best type first, at most ``cap`` of a type; those over it go.

    ``content_type`` must be set; ``seq`` is the order of the results and is numbered anew from 1. ``group``: the column
    that tells queries apart.
    """
    scope = [group] if group else []
    kind = Window.partitionBy(*scope, "content_type")
    ranked = results.withColumns({"_turn": F.row_number().over(kind.orderBy(seq)), "_best": F.max(score).over(kind), "_first": F.min(seq).over(kind)})
    kept = ranked.filter(F.col("_turn") <= cap)  # a few rows a query
    order = Window.partitionBy(*scope or [F.lit(0)]).orderBy("_turn", F.desc("_best"), "_first")
    return kept.withColumn(seq, F.row_number().over(order)).drop("_turn", "_best", "_first")


def _jaccard(a: str | None, b: str | None) -> float:
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    return len(x & y) / len(x | y) if x and y else 0.0


def _unit(v) -> np.ndarray | None:
    if v is None:
        return None
    x = np.asarray(v, float)
    n = np.linalg.norm(x)
    return x / n if n else np.zeros_like(x)


def mmr_order(query, vectors: list, contents: list, scores: list, weight: float = 0.7, k: int | None = None) -> list[int]:
    """Greedy maximal marginal relevance: the most relevant first, then ``weight * relevance - (1 - weight) * nearest``.

    The nearest of those chosen counts 0 at least. Results without a vector are compared by their words and keep their own
    score as relevance. Of equal results the first one is taken.
    """
    n = len(vectors)
    unit = [_unit(v) for v in vectors]
    q = _unit(query)
    relevance = np.array([float(u @ q) if u is not None and q is not None else float(s or 0) for u, s in zip(unit, scores, strict=True)])
    nearest = np.zeros(n)
    left = np.ones(n, bool)
    out: list[int] = []
    while len(out) < min(n, n if k is None else k):
        value = relevance if not out else weight * relevance - (1 - weight) * nearest
        best = int(np.where(left, value, -np.inf).argmax())
        out.append(best)
        left[best] = False
        for i in np.flatnonzero(left):
            same = float(unit[i] @ unit[best]) if unit[i] is not None and unit[best] is not None else _jaccard(contents[i], contents[best])
            nearest[i] = max(nearest[i], same)
    return out


def mmr(results: DataFrame, group: str, weight: float = 0.7, k: int | None = None, seq: str = "seq") -> DataFrame:
    """Results of each ``group`` in MMR order, with ``mmr_rank``; needs query_embedding, embedding, content, similarity.

    A group is one query's candidates, a few dozen rows at most; each is ordered by one task.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq, kind="stable").reset_index(drop=True)
        got = lambda c: [None if v is None else v for v in pdf[c]] if c in pdf else [None] * len(pdf)
        chosen = mmr_order(pdf["query_embedding"].iloc[0], got("embedding"), got("content"), got("similarity"), weight, k)
        return pdf.iloc[chosen].assign(mmr_rank=np.arange(1, len(chosen) + 1, dtype=np.int32))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema.fields if f.name != "mmr_rank"), "mmr_rank int"])
    return results.groupBy(group).applyInPandas(order, schema)


def diversified(results: DataFrame, strategy: str, group: str, weight: float = 0.7, cap: int = 3, k: int | None = None) -> DataFrame:
    """mmr, content_type, or hybrid (types in turn, then MMR); any other strategy keeps the order. ``seq`` orders the outcome."""
    if strategy in ("content_type", "hybrid"):
        results = by_content_type(results, cap, group=group)
    if strategy in ("mmr", "hybrid"):
        out = mmr(results, group, weight, k)
        return out.withColumn("seq", F.col("mmr_rank"))
    return results.filter(F.col("seq") <= k) if k else results

