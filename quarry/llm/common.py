"""Helpers shared by the training-data operators: scratch tables, byte words, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that are turned into Python objects at a time; bounds a worker's memory.
SLICE_ROWS = 256
BATCH_ROWS = 1024


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``). Where none is set, a temporary one in local mode; else an error.

    What is stored there stays until the folder is emptied, but for what ``temporary`` deletes: results still read it.
    """
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open_scopes():
        _open_scopes()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_here = threading.local()


def _open_scopes() -> list[list[str]]:
    """The scopes that this thread has opened."""
    if not hasattr(_here, "scopes"):
        _here.scopes = []
    return _here.scopes


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Deletes the tables that this thread stores within at its end, but those given to the function it yields (what a result still reads).

    All that read the others must have been stored by then.
    """
    scopes = _open_scopes()
    scopes.append([])
    kept: set[str] = set()
    try:
        yield lambda *tables: kept.update(t._stored_at for t in tables)
    finally:
        for path in scopes.pop():
            if path not in kept:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            elif scopes:
                scopes[-1].append(path)  # for the scope around this one


def split_join(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has a key once, so that rows of a hot key are split over tasks.

    Adaptive execution splits a large partition of a join only where both sides come straight from a shuffle. A table made
    by an aggregate or another join on the same key would be joined without one, with all of a key's rows in one task; so it
    is stored first.
    """
    return rows.join(stored(table, "keys"), on, how)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, unless the session sets a number itself: documents are long, and workers share memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_ROWS))


def free_shuffles(spark: SparkSession) -> None:
    """Let the JVM drop the shuffle files of finished jobs now rather than at its next collection; frees disk, changes no result."""
    for _ in range(2):  # what the first pass finds unreachable is cleaned behind it
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and nothing else, so that extra columns can't clash with an operator's own."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with lines before it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0).cast("long"))


def rows_of(batches: Iterator[pa.RecordBatch], size: int = SLICE_ROWS) -> Iterator[list[list]]:
    """The columns of each batch as Python lists, a bounded number of rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            part = batch.slice(lo, size)
            yield [c.to_pylist() for c in part.columns]


def byte_words(text: str | None) -> list[bytes]:
    """Words between the ASCII white space 0x20 and 0x09-0x0D, as UTF-8; none for null."""
    return text.encode("utf-8", "replace").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words, vectorised; used to derive independent hashes from one."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
