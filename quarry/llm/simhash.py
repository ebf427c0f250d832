"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints are one or more words of 64 bits. The bits of a word are grouped into partitions so that correlated
ones stand together; with thresholds ``t_i`` that sum to ``tau - m + 1`` over ``m`` partitions (-1: the partition is
not used) any two fingerprints with at most ``tau`` bits apart agree in some partition up to its threshold. Counts over
all fingerprints (each pair of bits, each block of 8 bits) estimate how many candidates each threshold gives, and a
dynamic programme allocates the thresholds. A fingerprint is probed under its key (threshold 0) or all keys one bit
away as well (threshold 2: both sides meet in the middle); candidates in a bucket are verified.

Only distinct fingerprints are searched, buckets of one fingerprint are dropped before anything is sorted, and
a bucket gives at most one edge for each member (its links' local forest), not its pairs. Buckets of more than
``BUCKET`` members are split. For ``tau = 2`` over distinct fingerprints each member is probed instead under itself and all 64
fingerprints one bit away: two are linked exactly if they share one, and no more than 65 can. Otherwise
salted parts find their own links and send one leader of each local group on, which ties most members; all members of
a bucket that aren't yet in the component of most of it are then compared with all its members, in pairs of parts.
Components come from ``components``.

``near_duplicates`` links at 2 bits, exactly. ``without_near_duplicates`` searches in the same way the first 64 of the 1024 SimHash
bits over a text's set of five-word shingles, and finds all pairs with at most ``RADIUS`` of these apart. It is about similarity,
though: fingerprints of 64 bits differ in some 10 at a similarity of 0.8, too many for any exact search. Pairs beyond the radius
are candidates if they share one of ``bands`` keys, each of the least of ``ROWS`` orders of a text's shingles: two texts share a
key with a probability that depends on their similarity alone, wherever their words differ and however many texts there are.
Candidates of both kinds are verified by all 1024 bits, which are joined to the texts that share a probe or key with another one,
and to no others.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each have a row of results; rows of
a null id are linked too, but name no component while another member has an id. Extra columns take no part; very long texts
are hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_shuffles, mix64, only, rows_of, split_join, stored, temporary
from quarry.llm.components import components

SEED = 42
BUCKET = 256
#: Least shingles in a key of ``without_near_duplicates``, and the share of pairs at its bound that may have no key in common.
ROWS, MISSED = 3, 1e-4
#: Bits of the first word within which ``without_near_duplicates`` finds every pair.
RADIUS = 2
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Columns of the bits that verify.
V = [f"v{i}" for i in range(1, 17)]
PROBE = ["sig", "node", "fp"]
NAMES = [*PROBE, *V]
SCHEMA = ", ".join(f"{c} long" for c in NAMES)


# --- fingerprints -----------------------------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``k`` consecutive words, joined by spaces; of all words if fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    return np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[k:], strict=False)), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; zero without hashes."""
    n = len(hashes)
    if not n:
        return 0
    if n < 400:
        b = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        b = np.concatenate([np.bincount(x, minlength=256) @ _BITS for x in hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T])
    return int(np.packbits(2 * b > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint over ``k``-word shingles with repeats, A-Z lower-cased, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in rows_of(batches):
            fp = [_signed(majority(shingle_hashes((t or "").encode("utf-8", "replace").lower().split(), k))) for t in text]
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fp long")


def majorities(hashes: np.ndarray, words: int) -> list[int]:
    """``words`` fingerprints of the hashes and of hashes derived from them."""
    out = []
    for _ in range(words):
        out.append(_signed(majority(hashes)))
        hashes = mix64(hashes)
    return out


def bands(similarity: float) -> int:
    """How many keys leave at most MISSED of the pairs of that Jaccard similarity without one in common."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(similarity**ROWS)))


def band_keys(hashes: np.ndarray, n: int) -> list[int]:
    """``n`` keys of a set of hashes, each of its least ones in ROWS orders; the same ones for all empty sets."""
    seeds = mix64(np.arange(1, n * ROWS + 1, dtype=np.uint64))[:, None]
    least = np.full(n * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 4096):
        least = np.minimum(least, mix64(hashes[None, lo : lo + 4096] ^ seeds).min(1))
    keys = mix64(np.arange(n, dtype=np.uint64))
    for part in least.reshape(n, ROWS).T:
        keys = mix64(keys ^ part)
    return keys.view(np.int64).tolist()


def wide_fingerprints(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, fps, v1 .. v16 of the set of ``k``-word shingles: its band keys find candidates, the 1024 bits v verify."""
    n = bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in rows_of(batches):
            fps, v = [], []
            for t in text:
                hashes = np.unique(shingle_hashes((t or "").encode("utf-8", "replace").lower().split(), k))
                fps.append(band_keys(hashes, n))
                v.append(majorities(hashes, len(V)))
            cols = [pa.array(doc_id, pa.int64()), pa.array(fps, pa.list_(pa.int64()))] + [pa.array(list(c), pa.int64()) for c in zip(*v, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fps", *V])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, fps array<long>, " + ", ".join(f"{c} long" for c in V))


# --- the search plan --------------------------------------------------------------------------------------------


def _fps(column: pa.ListArray) -> np.ndarray:
    """(rows, words) of a column of arrays of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _summed(nodes: DataFrame, size: int, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all fingerprints of what ``count`` gives for some of them; each task sends one row for each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                total += count(_fps(b.column(0).slice(lo, 4096)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["i", "n"])

    out = np.zeros(size, np.int64)
    for r in nodes.select("fps").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r.i] = r.n
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(nodes: DataFrame, words: int) -> np.ndarray:
    """(words, 64, 64): how many fingerprints have both bits of a word."""

    def count(x: np.ndarray) -> np.ndarray:
        bits = [_bits(x[:, w]).astype(np.float32) for w in range(words)]
        return np.concatenate([(b.T @ b).astype(np.int64).ravel() for b in bits])

    return _summed(nodes, words * 4096, count).reshape(words, 64, 64)


def block_counts(nodes: DataFrame, orders: list[list[int]]) -> np.ndarray:
    """(words, 8, 256): how often each block of 8 bits of a word's order has each value."""

    def count(x: np.ndarray) -> np.ndarray:
        out = []
        for w, order in enumerate(orders):
            out += [np.bincount(col, minlength=256) for col in np.packbits(_bits(x[:, w])[:, order], axis=1, bitorder="little").T]
        return np.concatenate(out)

    return _summed(nodes, len(orders) * 2048, count).reshape(len(orders), 8, 256)


def correlated_order(both: np.ndarray) -> list[int]:
    """All 64 bits, each next to one of those it is most correlated with: a greedy chain over |correlation|."""
    n = max(1, int(both.diagonal().max()))
    total = max(n, 1)
    p = both.diagonal() / total
    cov = both / total - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    c = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(c, -1)
    order = list(map(int, np.unravel_index(c.argmax(), c.shape)))
    while len(order) < 64:
        left = [i for i in range(64) if i not in order]
        near = c[np.ix_(left, order[-8:])].mean(1)
        order.append(left[int(near.argmax())])
    return order


def distance_shares(counts: np.ndarray, bits: range) -> np.ndarray:
    """The share of pairs at each distance (0..len(bits)) in some bits of the order, blocks of 8 taken as independent."""
    x = np.arange(256)
    apart = np.bitwise_count(x[:, None] ^ x[None])
    out = np.ones(1)
    for i in range(8):
        inside = [b - 8 * i for b in bits if 8 * i <= b < 8 * i + 8]
        if not inside:
            continue
        mask = sum(1 << b for b in inside)
        folded = np.bincount(x & mask, counts[i], 256)
        folded = folded / max(1.0, folded.sum())
        d = np.bitwise_count((x[:, None] ^ x[None]) & mask) if mask != 255 else apart
        out = np.convolve(out, np.bincount(d.ravel(), np.outer(folded, folded).ravel(), len(inside) + 1))
    return out


def allocate(shares: list[np.ndarray], widths: list[int], n: int, budget: int) -> tuple[float, float, list[int]]:
    """Thresholds from -1, 0, 2 of the least estimated cost whose sum is at least ``budget``, by dynamic programming: (cost, pairs, thresholds)."""
    best: dict[int, tuple[float, float, list[int]]] = {0: (0.0, 0.0, [])}  # by the sum of the thresholds plus 1
    for s, w in zip(shares, widths, strict=True):
        after: dict[int, tuple[float, float, list[int]]] = {}
        for total, (cost, pairs, chosen) in best.items():
            for t, probes in ((-1, 0), (0, 1), (2, w + 1)):
                more = n * float(n) / 2 * s[: t + 1].sum() if t >= 0 else 0.0
                new = (cost + probes * n + more / 20, pairs + more, [*chosen, t])  # comparing two is far cheaper than shuffling a row
                at = total + t + 1
                if at not in after or new < after[at]:
                    after[at] = new
        best = after
    return min(v for k, v in best.items() if k - len(widths) >= budget)


Part = tuple[int, list[int], int]  # word, bits, threshold


def plan(nodes: DataFrame, words: int, tau: int) -> list[Part]:
    """The partitions to probe, from counts over all fingerprints: those of the least cost that find every pair with at most ``tau`` bits apart (of one word)."""
    n = nodes.count()
    orders = [correlated_order(c) for c in bit_counts(nodes, words)]
    counts = block_counts(nodes, orders)
    found = []
    for m in (2, 3, 4, 5):
        cut = [round(64 * i / m) for i in range(m + 1)]
        parts = [(w, range(a, b)) for w in range(words) for a, b in zip(cut, cut[1:], strict=False)]
        try:
            cost, _, t = allocate([distance_shares(counts[w], p) for w, p in parts], [len(p) for _, p in parts], n, tau - m + 1)
        except ValueError:
            continue
        found.append((cost, [(w, [orders[w][b] for b in p], x) for (w, p), x in zip(parts, t, strict=True) if x >= 0]))
    return min(found, key=lambda x: x[0])[1]


# --- probing and verifying --------------------------------------------------------------------------------------


def probes(fps: np.ndarray, parts: list[Part]) -> np.ndarray:
    """(rows, probes) signatures of each fingerprint (rows, words) in every used partition."""
    fps = fps.view(np.uint64)
    out = []
    for i, (word, bits, t) in enumerate(parts):
        fp = fps[:, word]
        mask = np.uint64(sum(1 << b for b in bits))
        keys = [fp & mask]
        if t == 2:
            keys += [(fp ^ np.uint64(1 << b)) & mask for b in bits]
        out += [mix64(k ^ mix64(np.full(1, i + 1, np.uint64))) for k in keys]
    return np.stack(out, 1)


def _signatures(nodes: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A row for each signature that ``make`` gives of each node's fingerprint; fp is its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                fps = _fps(part.column(1))
                sig = make(fps)
                cols = [sig.ravel().view(np.int64)] + [np.repeat(x, sig.shape[1]) for x in (part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), fps[:, 0])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], PROBE)

    return nodes.select("node", "fps").mapInArrow(run, ", ".join(f"{c} long" for c in PROBE))


def _close(fp: np.ndarray, v: list[np.ndarray], tau: int, tau_v: int) -> np.ndarray:
    """(groups, members) columns to (groups, members, members): which are linked."""
    x = np.bitwise_count(fp[:, :, None] ^ fp[:, None]) <= tau
    if tau_v < 64 * len(V):
        x &= sum(np.bitwise_count(c[:, :, None] ^ c[:, None]).astype(np.int16) for c in v) <= tau_v
    return x


def _forest(near: np.ndarray) -> np.ndarray:
    """(groups, members): for each member the first one of its local component."""
    g, m, _ = near.shape
    label = np.broadcast_to(np.arange(m, dtype=np.int32), (g, m)).copy()
    while True:
        new = np.where(near, label[:, None, :], m).min(2).astype(np.int32)
        new = np.take_along_axis(new, new, 1)
        if np.array_equal(new, label):
            return label
        label = new


def _grouped(rows: DataFrame, keys: list[str], tau: int, tau_v: int, leaders: bool = False) -> DataFrame:
    """Edges (a, b) of each group's local forest; with ``leaders`` also one row for each local component (b null, the row's columns).

    ``rows`` are dealt by ``keys`` and sorted, so a group is a run of rows; groups have a bounded number of members.
    """
    schema = "a long, b long" + (", " + SCHEMA if leaders else "")

    def solve(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(cols["node"])
        new = np.ones(n, bool)
        new[1:] = np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        for size in np.unique(sizes):
            if size == 1 and not leaders:
                continue
            of = starts[sizes == size]
            per = max(1, 2_000_000 // int(size * size))
            for lo in range(0, len(of), per):
                at = of[lo : lo + per, None] + np.arange(size)
                near = _close(cols["fp"][at].view(np.uint64), [cols[c][at].view(np.uint64) for c in V], tau, tau_v)
                label = _forest(near)
                first = np.take_along_axis(at, label.astype(np.int64), 1)
                tied = first != at
                a, b = cols["node"][at[tied]], cols["node"][first[tied]]
                if not leaders:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    continue
                # of each local component the member with the most links goes on, the first of equals
                rank = near.sum(2) * (size + 1) - np.arange(size)
                top = np.where(label[:, :, None] == label[:, None], rank[:, None], -(size + 1)).argmax(2) == np.arange(size)
                who = at[top]
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)] + [none] * len(NAMES), ["a", "b", *NAMES])
                gone = pa.nulls(len(who), pa.int64())
                yield pa.RecordBatch.from_arrays([gone, gone] + [pa.array(cols[c][who]) for c in NAMES], ["a", "b", *NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            cols = {c: b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, c in enumerate(b.schema.names)}
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
            if not len(cols["node"]):
                continue
            same = np.all([cols[k] == cols[k][-1] for k in keys], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = {c: x[cut:] for c, x in cols.items()}
            if cut:
                yield from solve({c: x[:cut] for c, x in cols.items()})
        if held is not None and len(held["node"]):
            yield from solve(held)

    wanted = list(dict.fromkeys([*keys, *NAMES]))
    return rows.select(*wanted).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _counted(rows: DataFrame) -> DataFrame:
    """The rows of signatures that more than one row has, with that number."""
    n = rows.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1")
    return split_join(rows, n, "sig")


def links(nodes: DataFrame, parts: list[Part] | None, tau: int, tau_v: int = 64 * len(V)) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``nodes`` (node, fps, and V where ``tau_v`` needs it) that share a probe and verify.

    Without ``parts`` the words of ``fps`` are the probes. They verify with at most ``tau`` bits apart in the first word (64: whatever that is) and ``tau_v`` in V.
    """
    rows = _signatures(nodes, lambda fps: probes(fps, parts) if parts is not None else fps)
    if tau >= 64:
        rows = rows.withColumn("fp", F.lit(0).cast("long"))
    rows = _counted(rows)
    if tau_v < 64 * len(V):
        rows = rows.join(nodes.select("node", *V), "node")
    else:
        rows = rows.withColumns({c: F.lit(0).cast("long") for c in V})
    rows = stored(rows, "probes")
    free_shuffles(rows.sparkSession)
    edges = _grouped(rows.filter(F.col("n") <= BUCKET), ["sig"], tau, tau_v)
    hot = rows.filter(F.col("n") > BUCKET)
    if tau == 2 and tau_v >= 64 * len(V):  # else many nodes may have one fingerprint
        return edges.unionByName(_all_around(hot, tau_v))
    if hot.isEmpty():
        return edges
    found, left = [edges], hot
    while not left.isEmpty():
        size = left.count()
        salted = left.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(len(found))), F.ceil(F.col("n") / BUCKET)))
        out = stored(_grouped(salted, ["sig", "salt"], tau, tau_v, leaders=True), "leaders")
        found.append(out.filter("a IS NOT NULL").select("a", "b"))
        on = stored(_counted(out.filter("a IS NULL").select(*NAMES)), "leaders")
        found.append(_grouped(on.filter(F.col("n") <= BUCKET), ["sig"], tau, tau_v))
        left = on.filter(F.col("n") > BUCKET)
        if left.count() > size / 2:
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    roots = stored(components(out), "tied")
    tied = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return tied.unionByName(_untied_with_all(hot, roots, tau, tau_v))


def _all_around(hot: DataFrame, tau_v: int) -> DataFrame:
    """Links at up to 2 bits: those that share one of the 65 fingerprints that are at most one bit away from each."""
    flips = np.array([0, *[1 << b for b in range(64)]], np.uint64)
    around = _signatures(hot.select("node", F.array("fp").alias("fps")).distinct(), lambda fps: fps.view(np.uint64)[:, :1] ^ flips[None])
    bits = hot.select("node", *V).distinct()
    return _grouped(_counted(around).join(bits, "node"), ["sig"], 2, tau_v)


def _untied_with_all(hot: DataFrame, roots: DataFrame, tau: int, tau_v: int) -> DataFrame:
    """The links of each large bucket between members of different components.

    In every pair of those one at least is outside the component of most members. Members are dealt to parts, those outside
    (``rest``) first; each of these goes to all pairs of its part with another, the others to those with a part of the rest.
    """
    half = max(1, BUCKET // 2)
    rows = hot.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rows.groupBy("sig", "root").agg(F.count("*").alias("m"))
    most = sizes.groupBy("sig").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.max("m").alias("m"), F.sum("m").alias("of")).filter("m < of")
    rows = rows.drop("n").join(most, "sig").withColumn("rest", F.col("root") != F.col("top"))
    rows = rows.withColumns({"rests": F.ceil((F.col("of") - F.col("m")) / half), "mains": F.ceil(F.col("m") / half)})
    salt = F.xxhash64("node", F.lit(SEED))
    rows = rows.withColumn("part", F.when(F.col("rest"), F.pmod(salt, "rests")).otherwise(F.col("rests") + F.pmod(salt, "mains")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1 + F.when(F.col("rest"), F.col("mains")).otherwise(0))))
    rows = rows.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    return _grouped(rows, ["sig", "lo", "hi"], tau, tau_v)


# --- the operators ----------------------------------------------------------------------------------------------


def _roots(find: Callable[..., DataFrame], nodes: DataFrame, *args) -> DataFrame:
    """node, root of all nodes with links, stored; the tables of the search are deleted."""
    spark = nodes.sparkSession
    with temporary(spark) as keep:
        roots = stored(components(find(nodes, *args)), "roots")
        keep(roots)
    free_shuffles(spark)
    return roots


def _least(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """node, least: for every node the least ``least_id`` of its component."""
    tied = nodes.select("node", "least_id").join(roots, "node")
    least = tied.groupBy("root").agg(F.min("least_id").alias("_least"))
    found = split_join(tied, least, "root").select("node", "_least")
    return nodes.select("node", "least_id").join(found, "node", "left").select("node", F.coalesce("_least", "least_id").alias("least"))


def near_duplicates(docs: DataFrame, k: int = 3, tau: int = 2) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (the least doc_id reachable by links) of every row."""
    with temporary(docs.sparkSession) as keep:
        fps = stored(fingerprints(docs, k), "fingerprints")
        nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
        searched = nodes.select(F.col("fp").alias("node"), F.array("fp").alias("fps"))
        known = stored(_least(nodes.withColumnRenamed("fp", "node"), _roots(links, searched, plan(searched, 1, tau), tau)), "keys")
        keep(fps, known)
    found = fps.join(known.select(F.col("node").alias("fp"), F.col("least").alias("component_id")), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _within_and_beyond(nodes: DataFrame, parts: list[Part], tau_v: int) -> DataFrame:
    """Links of ``nodes`` (node, fps: band keys, V) that V verifies: all within ``RADIUS`` bits of the first word, and those that share a band key."""
    near = links(nodes.withColumn("fps", F.array(V[0])), parts, RADIUS, tau_v)
    return near.unionByName(links(nodes, None, 64, tau_v))


def without_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, slack: int = 16) -> DataFrame:
    """The rows of ``docs`` without those whose group of near-duplicates holds a smaller ``doc_id``.

    Two documents are linked if the 1024 SimHash bits over their sets of ``k``-word shingles differ in at most as many as a
    Jaccard similarity of ``similarity`` leads to, plus ``slack`` (by default 1.4 standard deviations of that number, so that
    few pairs at the bound are lost). Every such pair is found by pigeonhole search whose first 64 bits differ in ``RADIUS`` at
    most, and of the others those that share one of the keys of their sets of shingles.
    Rows that repeat a kept id stay; rows of a null id stay only where their group has no id.
    """
    cosine = 2 * similarity / (1 + similarity)
    tau_v = round(64 * len(V) * math.acos(cosine) / math.pi) + slack
    with temporary(docs.sparkSession) as keep:
        wide = stored(wide_fingerprints(docs, k, similarity).withColumn("node", F.xxhash64("fps", *V)), "fingerprints")
        nodes = stored(wide.groupBy("node").agg(F.min("fps").alias("fps"), *[F.min(c).alias(c) for c in V], F.min("doc_id").alias("least_id")), "nodes")
        words = stored(nodes.select(F.array(V[0]).alias("fps")).distinct(), "words")
        known = _least(nodes, _roots(_within_and_beyond, nodes, plan(words, 1, RADIUS), tau_v))
        gone = split_join(wide.select("node", "doc_id"), known, "node").filter("least IS NOT NULL AND NOT (doc_id <=> least)")
        gone = stored(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
        keep(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
