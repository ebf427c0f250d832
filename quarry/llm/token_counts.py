"""Token counts by a separator scan of flat token files.

A token file is a bare run of little-endian ids, documents ending in a separator id, without an index. It is cut
into blocks at fixed places, wherever documents end. Each block is searched for separators at once (a vectorised
comparison) and reduced to a few numbers: its ids, its separators, the ids before the first and after the last.
A prefix scan over those, first within groups of ``GROUP`` blocks and then over the groups, gives each block the
number of documents that ended before it and the open document's ids so far, so documents that cross blocks are
stitched without reading a block again or in order.

``scan`` takes blocks (file, block, ids), ``read_flat_files`` makes them from files on any store that Spark reads.
An empty block or file has no documents; ids after the last separator are an unended document (``ended`` false).
A file's trailing bytes short of an id are an error. Null and empty texts are documents of no tokens; rows that repeat an id,
and rows of a null id, are counted one by one; extra columns take no part. A text is encoded whole, in one task, whatever its
length. Ids are written in 2 bytes, or in 4 where the vocabulary has more than 65 536.

``read_flat_files`` gives a file to one task, which must hold it: Spark's binary source reads no file of 2 GiB or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import only, rows_of, stored
from quarry.llm.tokens import size_of, tokens, vocabulary_path

GROUP = 1024
#: Ids in a block.
BLOCK_IDS = 1 << 19
SEPARATOR = 50256


def _with_before(df: DataFrame, scope: list[str], order: str, name: str, to: int = -1) -> DataFrame:
    """Add, over the rows of ``scope`` up to ``to`` of this one: the ids, the separators, and the ids since the last separator (all without one)."""
    by = Window.partitionBy(*scope).orderBy(order)
    own = by.rowsBetween(Window.unboundedPreceding, 0)
    upto = by.rowsBetween(Window.unboundedPreceding, to)
    zero = F.lit(0).cast("long")
    df = df.withColumn("_mark", F.when(F.col("ends") > 0, F.sum("n").over(own) - F.col("tail")))  # ids up to the last separator
    df = df.withColumns({f"{name}_n": F.coalesce(F.sum("n").over(upto), zero), f"{name}_ends": F.coalesce(F.sum("ends").over(upto), zero), "_last_mark": F.coalesce(F.last("_mark", ignorenulls=True).over(upto), zero)})
    return df.withColumn(f"{name}_open", F.col(f"{name}_n") - F.col("_last_mark")).drop("_mark", "_last_mark")


def scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """file, ordinal, n_tokens (without the separator), start (of its first id in the file), ended: a row for each document.

    ``blocks``: file long, block long, ids binary; the blocks of a file are numbered from 0 without gaps.
    """
    width = np.dtype(dtype).itemsize
    names = ["file", "block", "n", "ends", "head", "tail", "inner"]
    schema = "file long, block long, n long, ends long, head long, tail long, inner array<struct<i:long,n:long,start:long>>"
    kind = pa.struct([(c, pa.int64()) for c in ("i", "n", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, block, data = (c[i].as_py() for c in b.columns)
                if len(data or b"") % width:
                    raise ValueError(f"block {block} of file {file} holds {len(data)} bytes: not whole ids")
                ids = np.frombuffer(data or b"", dtype)
                at = np.flatnonzero(ids == separator)
                head = int(at[0]) if len(at) else len(ids)
                tail = len(ids) - 1 - int(at[-1]) if len(at) else len(ids)
                # the documents that begin and end in the block: their number in it, ids, and first place
                inner = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (np.arange(1, len(at)), np.diff(at) - 1, at[:-1] + 1)], fields=list(kind))
                cols = [pa.array([x], pa.int64()) for x in (file, block, len(ids), len(at), head, tail)]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)], names)

    parts = stored(only(blocks, "file", "block", "ids").mapInArrow(run, schema), "separators")
    group = F.floor(F.col("block") / GROUP)
    parts = parts.withColumn("group", group)
    # A group's own sums, then those of the groups before it, then those of the blocks before a block in its group.
    ran = _with_before(parts, ["file", "group"], "block", "g", to=0)
    groups = ran.groupBy("file", "group").agg(F.max_by(F.struct("g_n", "g_ends", "g_open"), "block").alias("g"))
    groups = groups.select("file", "group", F.col("g.g_n").alias("n"), F.col("g.g_ends").alias("ends"), F.col("g.g_open").alias("tail"))
    groups = _with_before(groups, ["file"], "group", "b").select("file", "group", "b_n", "b_ends", "b_open")
    parts = _with_before(parts, ["file", "group"], "block", "p")
    joined = parts.join(groups, ["file", "group"]).join(parts.groupBy("file").agg(F.max("block").alias("_end")), "file")
    ids, ends = F.col("b_n") + F.col("p_n"), F.col("b_ends") + F.col("p_ends")
    open_ = F.col("p_open") + F.when(F.col("p_ends") > 0, 0).otherwise(F.col("b_open"))
    joined = joined.select("file", ids.alias("_ids"), ends.alias("_ends"), open_.alias("_open"), "n", "ends", "head", "tail", "inner", (F.col("block") == F.col("_end")).alias("_last"))
    # The first document of a block began before it: what was open there belongs to it.
    first = F.struct(F.lit(0).cast("long").alias("i"), (F.col("_open") + F.col("head")).alias("n"), (-F.col("_open")).alias("start"))
    ended = joined.filter("ends > 0").select("file", "_ids", "_ends", F.inline(F.concat(F.array(first), "inner")).alias("i", "n_tokens", "start"))
    ended = ended.select("file", (F.col("_ends") + F.col("i")).alias("ordinal"), "n_tokens", (F.col("_ids") + F.col("start")).alias("start"), F.lit(True).alias("ended"))
    left = joined.filter(F.col("_last")).withColumn("n_tokens", F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("_open") + F.col("n")))
    left = left.filter("n_tokens > 0").select("file", (F.col("_ends") + F.col("ends")).alias("ordinal"), "n_tokens", (F.col("_ids") + F.col("n") - F.col("n_tokens")).alias("start"), F.lit(False).alias("ended"))
    return ended.unionByName(left)


def read_flat_files(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, dtype: str = "<u2") -> DataFrame:
    """Blocks (file, block, ids) of the flat token files under ``path``; file is the XXH64 of the file's path.

    Whole files are read by Spark's binary source, each by one task, which cuts them as it reads them.
    """
    width = np.dtype(dtype).itemsize * block_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for k in range(max(1, -(-len(data) // width))):
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([k], pa.int64()), pa.array([data[k * width : (k + 1) * width]], pa.binary())], ["file", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content").mapInArrow(run, "file long, block long, ids binary")


def width_of(vocabulary: str) -> str:
    """The type of the ids in files of this vocabulary."""
    return "<u2" if size_of(vocabulary) <= 1 << 16 else "<u4"


def write_token_blocks(docs: DataFrame, vocabulary: str | None = None, block_ids: int = BLOCK_IDS, separator: int = SEPARATOR) -> DataFrame:
    """Every partition's documents as one flat file, in blocks of ``block_ids``, with the documents' ids in their order.

    Rows are either a block (ids) or a document (doc_id, ordinal); special tokens' strings in a text are ordinary text,
    so no document holds the separator.
    """
    path = vocabulary or vocabulary_path()
    dtype = np.dtype(width_of(path))
    names = ["file", "block", "ids", "doc_id", "ordinal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(path, special=False)
        file = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        size = block = ordinal = 0
        end = np.array([separator], dtype)

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, block
            data = np.concatenate(held) if held else np.zeros(0, dtype)
            cut = len(data) if last else len(data) // block_ids * block_ids
            for lo in range(0, cut, block_ids):
                part = data[lo : min(cut, lo + block_ids)].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([part], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)
                block += 1
            held, size = [data[cut:]], len(data) - cut

        for doc_id, text in rows_of(batches):
            for x in text:
                held += [t.encode(x).astype(dtype), end]
                size += len(held[-2]) + 1
                if size >= block_ids:
                    yield from blocks(last=False)
            n = len(doc_id)
            numbers = np.arange(ordinal, ordinal + n)
            ordinal += n
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(doc_id, pa.int64()), pa.array(numbers, pa.int64())], names)
        yield from blocks(last=True)

    named = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return named.mapInArrow(run, "file long, block long, ids binary, doc_id long, ordinal long")


def count(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, file, ordinal, start of every row: its text is written to a flat file and counted from that."""
    path = vocabulary or vocabulary_path()
    out = stored(write_token_blocks(docs, path), "token-files")
    counted = scan(out.filter("ids IS NOT NULL").select("file", "block", "ids"), dtype=width_of(path)).filter("ended")
    named = out.filter("ordinal IS NOT NULL").select("file", "ordinal", "doc_id")
    return named.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
