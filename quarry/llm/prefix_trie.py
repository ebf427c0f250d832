"""The trie of conversations' prefixes: what each shared beginning would save if it were stored once.

Every conversation is rebuilt first: the first h turns of its group's head, then its own turns behind its first h. A node is a
distinct sequence of turns (role and text); its members are the conversations that begin with it.

A node belongs to its smallest member, so a conversation owns a suffix of its path: the members of a deeper node are among
those of a shallower one. Three figures of each conversation say all about that suffix: the depth where it starts, the words
before it, and whether its last node has no child. With them one aggregate by prefix gives the sums over whole subtrees: words
of a member's path below the node, less those of nodes it owns, are what storing once saves; leaves and children are counted
at their owners.

Prefixes are known by 128 bits, the exclusive or of hashes of (depth, role, text). Like turn numbers and words so far these are
running totals along a conversation, found in two levels: within ranges of sorted rows, then over the ranges that a conversation
spans. So a conversation of any length is split over tasks, and so are prefixes that many share, since rows meet them only
in aggregates that are summed before they are shuffled, and in joins that split hot keys.

Turns are ordered by turn (null first), then role, the first characters of the text, and its hash. Null role or text counts as
empty. Rows without a conv_id are no conversation and are left out; repeated rows are turns of their own. A conversation whose
turns all fall away is a member of the root, as every other; an empty table has no node. Extra columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import only, small_batches, stored, temporary

WORDS = r"[^\x20\x09-\x0D]+"
#: Conversations of one group share the turns of the one whose id is divisible by GROUP; ids' checksums modulo SHARES say how many.
GROUP, SHARES = 20, 4
#: Characters of a text that order turns of the same number and role.
TIE_CHARS = 16
#: Bytes of the ids that are hashed at a time.
PIECE_BYTES = 1 << 20
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, order: Sequence[Column], sums: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``<c>_run`` for each long column ``c`` of ``sums`` and ``xors``: its total over the key's rows up to this one.

    Rows are dealt by ranges of (key, order) and sorted, so a key of any size is split. Only a range's first key can have begun
    before it: one row for each range, broadcast, adds what the ranges before have of it.
    """
    taken = [*sums, *xors]
    names = rows.columns
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    schema = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, {', '.join(f'{c}_run long' for c in taken)}, _range int, _first boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        first = last = None
        carry = dict.fromkeys(taken, np.int64(0))
        for batch in batches:
            keys = batch.column(names.index(key)).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            if first is None:
                first = keys[0]
            new = np.r_[True, keys[1:] != keys[:-1]]
            if last is not None and keys[0] == last:
                new[0] = False
            starts = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))  # -1: of the batch before
            totals = []
            with np.errstate(over="ignore"):
                for c in taken:
                    add = c in sums
                    x = batch.column(names.index(c)).to_numpy(zero_copy_only=False)
                    upto = np.cumsum(x) if add else np.bitwise_xor.accumulate(x)
                    before = np.where(starts > 0, upto[starts - 1], 0)  # what stands before the key's first row
                    before = np.where(starts < 0, -carry[c] if add else carry[c], before)
                    totals.append(upto - before if add else upto ^ before)
                    carry[c] = totals[-1][-1]
            last = keys[-1]
            columns = [*batch.columns, *map(pa.array, totals), pa.array(np.full(len(keys), at, np.int32)), pa.array(keys == first)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *[f"{c}_run" for c in taken], "_range", "_first"])

    small_batches(rows.sparkSession)
    parts = stored(dealt.mapInArrow(run, schema), "running")
    spanning = parts.filter("_first").select(key).distinct()
    mine = parts.join(F.broadcast(spanning), key, "left_semi")  # a key for each range at most
    totals = mine.groupBy(key, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums], *[F.bit_xor(c).alias(f"_{c}") for c in xors])
    later = totals.select(F.col(key).alias("_key"), F.col("_range").alias("_later"))
    before = totals.join(F.broadcast(later), (F.col(key) == F.col("_key")) & (F.col("_range") < F.col("_later")))
    before = before.groupBy("_key", F.col("_later").alias("_range")).agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in sums], *[F.bit_xor(f"_{c}").alias(f"_{c}") for c in xors])
    joined = parts.join(F.broadcast(before), F.col("_first") & (parts["_range"] == before["_range"]) & (F.col(key) == F.col("_key")), "left")
    zero = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
    out = [(F.col(f"{c}_run") + zero(c)).alias(f"{c}_run") for c in sums] + [F.col(f"{c}_run").bitwiseXOR(zero(c)).alias(f"{c}_run") for c in xors]
    return joined.select(*[parts[n] for n in names], *out)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, i (the turn's place, from 1), h1 and h2 (hashes of role and text), words: a row for each turn."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = only(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.left(text, F.lit(TIE_CHARS)).alias("head"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"), F.lit(1).cast("long").alias("i"),
    )
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("head"), F.col("h1")]
    return running(turns, "conv_id", order, sums=["i"]).select("conv_id", F.col("i_run").alias("i"), "h1", "h2", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, len (the conversation's depth), h1, h2, words: the turns of every rebuilt conversation and, at depth 0, its root."""
    ids = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    ids = ids.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES, "b": F.col("conv_id") - F.col("conv_id") % GROUP})
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("i") < SHARES))
    heads = heads.groupBy(F.col("conv_id").alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "h1", "h2", "words"))).alias("head"))  # a few turns
    made = ids.join(heads, "b", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
    made = made.withColumn("m", F.size("head").cast("long"))
    convs = stored(made.select("conv_id", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), "head"), "rebuilt")
    own = turns.join(convs.drop("head"), "conv_id").filter("i > h").select("conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("depth"), "len", "h1", "h2", "words")
    shared = convs.select("conv_id", "len", F.inline("head")).select("conv_id", F.col("i").alias("depth"), "len", "h1", "h2", "words")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), "len", zero.alias("h1"), zero.alias("h2"), zero.alias("words"))
    return own.unionByName(shared).unionByName(root)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, len, k1 and k2 (the prefix's key), p1 and p2 (its parent's), before (words in the turns before), words."""
    at = F.when(F.col("depth") == 0, F.lit(0)).otherwise  # the root's key is zero
    marked = turns.withColumns({"x1": at(F.xxhash64("depth", "h1")), "x2": at(F.xxhash64("depth", "h2"))}).drop("h1", "h2")
    run = running(marked, "conv_id", [F.col("depth")], sums=["words"], xors=["x1", "x2"])
    up = lambda n: F.when(F.col("depth") > 0, F.col(f"x{n}_run").bitwiseXOR(F.col(f"x{n}"))).alias(f"p{n}")
    return run.select("conv_id", "depth", "len", F.col("x1_run").alias("k1"), F.col("x2_run").alias("k2"), up(1), up(2), (F.col("words_run") - F.col("words")).alias("before"), "words")


def joined_sha256(rows: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: of each key's conv_ids in ascending order, with commas between.

    Ids are joined to pieces of PIECE_BYTES in the ranges where they are sorted, so only a row for each piece goes on to where a
    key's pieces are hashed in order, one at a time.
    """
    names = ["k1", "k2", "conv_id", "piece"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        key, first, parts, size, done = None, 0, [], 0, 0

        def close() -> None:
            nonlocal done
            if key is not None and parts:
                held.append((*key, first, b",".join(parts)))
                done += size

        for batch in batches:
            for a, b, c in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if (a, b) != key or size >= PIECE_BYTES:
                    close()
                    key, first, parts, size = (a, b), c, [], 0
                parts.append(b"%d" % c)
                size += len(parts[-1]) + 1
            if held and (len(held) >= 1024 or done >= PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names)
                held, done = [], 0
        close()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for a, b, piece in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if (a, b) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(piece)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["k1", "k2", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["k1", "k2", "ends_sha256"])

    keys = ["k1", "k2", "conv_id"]
    pieces = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(joined, "k1 long, k2 long, conv_id long, piece binary")
    return pieces.repartition("k1", "k2").sortWithinPartitions(*keys).drop("conv_id").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def nodes_of(path: DataFrame) -> DataFrame:
    """The nodes of stored ``paths``, with their figures (see ``trie``)."""
    small_batches(path.sparkSession)
    nodes = path.groupBy("k1", "k2").agg(
        F.min(F.struct("conv_id", "depth", "before", "p1", "p2")).alias("own"), (F.count("*") == F.count_if(F.col("depth") == F.col("len"))).alias("leaf")
    )
    nodes = stored(nodes.select("k1", "k2", "own.*", "leaf"), "nodes")
    # of each conversation's owned suffix: its first node, and whether its last one is a leaf
    owners = stored(nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before", "p1", "p2")).alias("own"), F.max("leaf").alias("leaf")).select("conv_id", "own.*", "leaf"), "owners")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    owners = owners.join(above, ["p1", "p2"], "left").select("conv_id", F.col("depth").alias("own_from"), F.col("before").alias("own_before"), "leaf", "above")
    ends = path.filter("depth = len").select("conv_id", "k1", "k2", (F.col("before") + F.col("words")).alias("total"))
    marks = ends.join(owners, "conv_id", "left").select("conv_id", "own_from", F.coalesce("own_before", "total").alias("until"), F.coalesce(F.col("leaf").cast("long"), F.lit(0)).alias("leaf"), "above")
    marks = stored(marks, "marks")
    deeper = F.col("depth") + 1
    found = path.join(marks, "conv_id").groupBy("k1", "k2").agg(
        F.min(F.struct("conv_id", F.when(F.col("depth") == F.col("own_from"), F.col("above")).otherwise(F.col("conv_id")).alias("up"))).alias("own"),
        F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.count_if((deeper >= F.col("own_from")) & (deeper <= F.col("len"))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("until") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    return found.join(joined_sha256(ends), ["k1", "k2"], "left").select(
        F.col("own.conv_id").alias("conv_id"), "depth", F.col("own.up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``n_leaves`` and ``saved_tokens`` are of the whole subtree; ``ends_sha256`` is of the ids of the members that end there.
    """
    with temporary(conversations.sparkSession) as keep:
        path = stored(paths(rebuilt(numbered(conversations))), "paths")
        out = stored(nodes_of(path), "trie")
        keep(out)
    return out
