"""Reranking by a pair scorer (a cross-encoder, or the offline word overlap)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.plans.models import Scorer, load_scorer


def pair_score(query: Column, text: Column, load: Callable[[], Scorer]) -> Column:
    """The scorer's value of each pair; the model is loaded once for each worker and batch stream."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            yield pd.Series(model.predict(list(zip(q.fillna(""), t.fillna(""), strict=True))), index=q.index, dtype=float)

    return run(query, text)


def overlap(query: Column, text: Column) -> Column:
    """The share of the query's distinct words that the text holds, as an expression."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    wanted = split(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, split(text))).cast("double"), F.size(wanted).cast("double")), F.lit(0.0))


def reranked(results: DataFrame, score: Column, threshold: float | None = None, seq: str = "seq") -> DataFrame:
    """``rerank_score`` added, results in its order (equal ones in theirs), those under the threshold gone."""
    out = results.withColumn("rerank_score", score)
    if threshold is not None:
        out = out.filter(F.coalesce("rerank_score", F.lit(0.0)) >= threshold)
    return out.orderBy(F.desc_nulls_last("rerank_score"), seq)


def first_that_loads(paths: Sequence[str], load: Callable[[str], Scorer] = load_scorer) -> Scorer | None:
    """The model of the first path that can be loaded (a local file, a URL, a default name); none if none can."""
    for p in paths:
        try:
            return load(p)
        except Exception:
            continue
    return None


def scorer_of(settings: Settings) -> Scorer | None:
    """The scorer that the settings name, where reranking is on."""
    return first_that_loads(settings.reranker_paths) if settings.use_reranking else None
