"""Approximate vector search: an inverted file over k-means cells.

Cells are fitted on a bounded sample (``SAMPLE``), every row is put into its nearest cell, and a query reads the
cells nearest to it only: the index is written by cell, so the others are pruned as partitions. How many cells a query
probes for a wanted recall is measured on the sample: vectors without clusters need most of them, and exact search is then
as fast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import vector

SAMPLE, ROUNDS = 20_000, 12
#: Rows of the sample that stand as queries to find how many cells to probe, and how many of their neighbours count.
TRIED, NEAR = 256, 10


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def sample(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", limit: int | None = None) -> np.ndarray:
    """The vectors, of length 1, of about ``limit`` rows (all of fewer), chosen by the hashes of their ids: each task sends its share only."""
    limit = limit or SAMPLE
    rows = df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(share < 1.05 * limit / n) if n > limit else rows
    found = some.orderBy(F.xxhash64("id"), "id").select("embedding").toArrow()
    return _unit(np.stack(found["embedding"].to_pylist()).astype(float))


def fit(x: np.ndarray, cells: int = 100, seed: int = 1) -> np.ndarray:
    """Spherical k-means of a sample."""
    if not len(x):
        return x
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        empty = np.bincount(near, minlength=len(centres)) == 0
        centres = np.where(empty[:, None], centres, _unit(total))
    return centres


def probes_for(x: np.ndarray, centres: np.ndarray, recall: float = 0.95) -> int:
    """The fewest cells in which the first ``TRIED`` rows of a sample find this share of their ``NEAR`` nearest ones."""
    if not len(x):
        return 1
    q = x[:TRIED]
    near = np.argpartition(-(q @ x.T), min(NEAR, len(x) - 1), axis=1)[:, :NEAR]
    cell = (x @ centres.T).argmax(1)
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell in a query's order
    needed = np.take_along_axis(place, cell[near], 1)
    return next(n for n in range(1, len(centres) + 1) if (needed < n).mean() >= recall)


def assign(df: DataFrame, centres: np.ndarray, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """id, embedding, cell of every row; rows without a vector are in cell -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.full(b.num_rows, -1, np.int32)
            has = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            if has.any() and len(centres):
                x = b.column(1).filter(pa.array(has)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(has.sum()), -1)
                cell[has] = (_unit(x) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["id", "embedding", "cell"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding")).mapInArrow(run, "id long, embedding array<float>, cell int")


def probed(query: Sequence[float], centres: np.ndarray, probes: int) -> list[int]:
    q = np.asarray(query, float)
    return np.argsort(-(centres @ q), kind="stable")[:probes].tolist()


def topk(index: DataFrame, centres: np.ndarray, query: Sequence[float], k: int, probes: int = 10) -> DataFrame:
    """The k nearest rows in the ``probes`` nearest cells; the filter on ``cell`` prunes an index written by cell."""
    return vector.topk(index.filter(F.col("cell").isin(probed(query, centres, probes))), query, k)


def write(index: DataFrame, path: str) -> None:
    """The index as files by cell."""
    index.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, embedding array<float>, cell int").parquet(path)


def topk_batched(index: DataFrame, centres: np.ndarray, queries: Sequence[tuple[int, Sequence[float]]], k: int, probes: int = 10) -> DataFrame:
    """query_id, id, similarity, rank: each query meets the rows of its own cells only, as one matrix product a cell and batch."""
    ids = np.array([i for i, _ in queries], np.int64)
    q = _unit(np.array([v for _, v in queries], float).reshape(len(queries), centres.shape[1] if len(queries) else 0))
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes] if len(centres) and len(q) else np.zeros((len(q), 0), int)
    asks = {c: np.flatnonzero((order == c).any(1)) for c in np.unique(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = vector.Best(ids, q, k)
        for b in batches:
            cell = b.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(cell):
                if c in asks:
                    part = b.filter(pa.array(cell == c))
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                    best.add(part.column(0).to_numpy(), x, asks[c])
        yield best.batch()

    wanted = index.filter(F.col("cell").isin([int(c) for c in asks])).select("id", "embedding", "cell")
    near = wanted.mapInArrow(run, "query_id long, id long, similarity double")
    return vector.best_of_all(near, k)
