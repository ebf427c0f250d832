"""Similarity of dense vectors and of word sets.

Expressions stay in the JVM and are the form that plans and oracles are checked with; ``topk_batched`` multiplies
matrices of Arrow batches and keeps a running top k, so a scan of any size sends k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance, from -1 to 1; null if either vector is null or has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """As ``cosine``, but 0 where that is null."""
    return F.coalesce(cosine(a, b), F.lit(0.0))


def words(text: Column) -> Column:
    """The distinct lower-cased words between white space."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"\s+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts; 0 if either has none."""
    return jaccard_of_words(words(a), words(b))


def jaccard_of_words(x: Column, y: Column) -> Column:
    """As ``jaccard``, of two texts' ``words``: columns of a table, so that a text is split once however often they are used."""
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared / (F.size(x) + F.size(y) - shared).cast("double"))


def topk(df: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k rows most similar to ``query``, with ``similarity``; rows without one come last, ties by id."""
    # Only id and vector are sorted on; wide columns are fetched for k rows by a join on the caller's side.
    ranked = df.withColumn("similarity", cosine(F.col(vector_col), vector_literal(query)))
    return ranked.orderBy(F.desc_nulls_last("similarity"), id_col).limit(k)


#: Similarities that a task computes at a time.
TILE = 1 << 21


class Best:
    """The k best rows so far of each of some queries (vectors of length 1): by similarity (to nine digits), then id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.rows = np.zeros((len(ids), k), np.int64)
        self.sims = np.full((len(ids), k), np.nan)  # NaN: no row here

    def add(self, rows: np.ndarray, x: np.ndarray, which: np.ndarray | None = None) -> None:
        """Compare rows (ids and vectors of any length) with the queries ``which`` (all), TILE pairs at a time."""
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        which = np.arange(len(self.ids)) if which is None else which
        per = max(256, TILE // max(1, len(which)))
        for lo in range(0, len(rows), per):
            part, none = x[lo : lo + per], length[lo : lo + per, 0] == 0
            each = max(1, TILE // len(part))
            for at in range(0, len(which), each):
                self._merge(which[at : at + each], rows[lo : lo + per], part, none)

    def _merge(self, at: np.ndarray, rows: np.ndarray, x: np.ndarray, none: np.ndarray) -> None:
        sims = self.q[at] @ x.T
        sims[:, none] = -np.inf
        sims = np.hstack([self.sims[at], sims])
        keys = np.round(-sims, 9)  # NaN stands last
        ids = np.hstack([self.rows[at], np.broadcast_to(rows, (len(at), len(rows)))])
        n, few = keys.shape[1], min(keys.shape[1], 2 * self.k + 16)
        if few < n:
            some = np.argpartition(keys, few - 1, axis=1)[:, :few]
            of = np.take_along_axis(keys, some, 1)
            order = np.lexsort((np.take_along_axis(ids, some, 1), of), axis=1)
            best = np.take_along_axis(some, order[:, : self.k], 1)
            edge = np.take_along_axis(of, order, 1)
            open_ = np.flatnonzero(~(edge[:, self.k - 1] < edge[:, -1]))  # ties that may go on among the others
            if len(open_):
                best[open_] = np.lexsort((ids[open_], keys[open_]), axis=1)[:, : self.k]
        else:
            best = np.lexsort((ids, keys), axis=1)[:, : self.k]
        self.rows[at] = np.take_along_axis(ids, best, 1)
        self.sims[at] = np.take_along_axis(sims, best, 1)

    def batch(self) -> pa.RecordBatch:
        """query_id, id, similarity (null for a vector without length) of all that is held."""
        here = ~np.isnan(self.sims)
        sims = np.where(np.isinf(self.sims), np.nan, self.sims)[here]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, here.sum(1))), pa.array(self.rows[here]), pa.array(sims, mask=np.isnan(sims))], ["query_id", "id", "similarity"])


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def best_of_all(found: DataFrame, k: int) -> DataFrame:
    """``found`` (query_id, id, similarity) with the rank of each query's k best."""
    by = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc_nulls_last(), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def topk_batched(df: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, similarity, rank of the k most similar rows of each query (a stated set, sent to all tasks)."""
    ids = np.array([q for q, _ in queries], np.int64)
    q = unit(np.array([v for _, v in queries], np.float64).reshape(len(queries), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, q, k)
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if b.num_rows and len(ids):
                best.add(b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
        yield best.batch()

    found = df.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "query_id long, id long, similarity double")
    return best_of_all(found, k)
