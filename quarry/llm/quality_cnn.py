"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole document. Learned filters of
``WIDTH`` bytes run over every chunk, at every second byte; a rectifier and a max-pool leave one number for each filter and
chunk, and the chunks' pooled numbers are combined (their mean and their maximum over the document) by a small
dense layer into one probability. The first layer is a sum of table rows, one table for each pair of
neighbouring bytes in the filter, so scoring needs no multiplication per byte.

Training takes a bounded sample of labelled rows (at most ``TRAIN_ROWS`` of at most ``TRAIN_BYTES`` in all, half of each class
where there are enough), each with all its chunks, and bounded numbers of steps and of chunks, so its cost doesn't grow with
the corpus; every document is scored whole.

Null and empty texts score as a document of one blank chunk. Repeated rows get equal scores. Rows of a null id are scored and
teach nothing. Extra columns take no part. Without a label of either class every score is the share of label 1 (0.5 without
labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_ROWS, fold, only, rows_of, small_batches, stored

CHUNK, OVERLAP = 256, 32
WIDTH, FILTERS = 8, 24
HIDDEN = 16
#: Bounds of the training sample: rows, and the bytes of their whole texts.
TRAIN_ROWS, TRAIN_BYTES = 3000, 12 << 20
STEPS, BATCH, RATE = 1200, 48, 4e-3
#: Chunks in a batch, about: fewer documents where they are long; and chunks seen in all, after which training ends.
BATCH_CHUNKS, WORK = 4096, 2_000_000
#: This share of a batch shows a short cut of the document instead, so that short texts are learned too.
SHORT_SHARE = 0.25
SCORE_CHUNKS = 128
PAD = 32


def chunks_of(data: bytes) -> np.ndarray:
    """Rows of ``CHUNK`` bytes that together cover ``data``, each overlapping the last."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.full((n - 1) * step + CHUNK, PAD, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class ByteCNN:
    """``table``: (WIDTH, 256, FILTERS), what each byte at each place of a filter adds; then two dense layers."""

    table: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def start(cls, seed: int = 7) -> ByteCNN:
        r = np.random.default_rng(seed)
        f = lambda *shape, s: r.normal(0, s, shape).astype(np.float32)
        return cls(f(WIDTH, 256, FILTERS, s=0.3), np.zeros(FILTERS, np.float32), f(2 * FILTERS, HIDDEN, s=0.25), np.zeros(HIDDEN, np.float32), f(HIDDEN, s=0.25), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.w1, self.b1, self.w2, self.b2]

    def pairs(self) -> np.ndarray:
        """(WIDTH / 2, 65536, FILTERS): the tables of two neighbouring bytes, high byte first."""
        t = self.table
        return np.stack([(t[i][:, None] + t[i + 1][None]).reshape(65536, FILTERS) for i in range(0, WIDTH, 2)])

    def dense(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled @ self.w1 + self.b1, 0) @ self.w2 + self.b2[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _filtered(pairs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What each filter gives at each second byte of each chunk: (chunks, places, FILTERS)."""
    at = rows.astype(np.int32)
    code = (at[:, 0:-1:2] << 8) | at[:, 1::2]
    n = code.shape[1] - WIDTH // 2 + 1
    out = pairs[0][code[:, :n]]
    for i in range(1, WIDTH // 2):
        out += pairs[i][code[:, i : i + n]]
    return out


def _pool(net: ByteCNN, pairs: np.ndarray, docs: list[bytes]) -> np.ndarray:
    """The mean and the maximum over each document's chunks of the chunks' pooled filters."""
    out = np.zeros((len(docs), 2 * FILTERS), np.float32)
    for i, data in enumerate(docs):
        rows = chunks_of(data)
        total, top = np.zeros(FILTERS, np.float64), np.zeros(FILTERS, np.float32)
        for lo in range(0, len(rows), SCORE_CHUNKS):
            best = np.maximum(_filtered(pairs, rows[lo : lo + SCORE_CHUNKS]).max(1) + net.bias, 0)
            total += best.sum(0)
            top = np.maximum(top, best.max(0))
        out[i, :FILTERS], out[i, FILTERS:] = total / len(rows), top
    return out


def _gradients(net: ByteCNN, rows: np.ndarray, doc: np.ndarray, n_docs: int, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss for a batch: ``rows`` are chunks, ``doc`` the document of each."""
    n = CHUNK // 2 - WIDTH // 2 + 1
    at = rows[:, : 2 * (n + WIDTH // 2 - 1)]
    where, peak = np.zeros((len(rows), FILTERS), np.int64), np.zeros((len(rows), FILTERS), np.float32)
    for lo in range(0, len(rows), SCORE_CHUNKS):  # a long document's chunks are never held filtered all at once
        part = at[lo : lo + SCORE_CHUNKS]
        conv = net.table[0][part[:, 0 : 2 * n : 2]]
        for i in range(1, WIDTH):
            conv += net.table[i][part[:, i : i + 2 * n : 2]]
        here = where[lo : lo + SCORE_CHUNKS] = conv.argmax(1)
        peak[lo : lo + SCORE_CHUNKS] = np.take_along_axis(conv, here[:, None], 1)[:, 0] + net.bias
    best = np.maximum(peak, 0)
    count = np.bincount(doc, minlength=n_docs).astype(np.float32)
    mean = np.zeros((n_docs, FILTERS), np.float32)
    np.add.at(mean, doc, best)
    mean /= count[:, None]
    top = np.zeros_like(mean)
    np.maximum.at(top, doc, best)
    pooled = np.hstack([mean, top])
    pre = pooled @ net.w1 + net.b1
    hidden = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2[0], -30, 30)))
    dz = ((p - labels) * weight / n_docs).astype(np.float32)
    dh = dz[:, None] * net.w2 * (pre > 0)
    dp = dh @ net.w1.T
    d_best = dp[doc, :FILTERS] / count[doc, None] + dp[doc, FILTERS:] * (best == top[doc])
    d_best *= peak > 0
    d_table = np.zeros_like(net.table)
    cols = np.broadcast_to(np.arange(FILTERS), where.shape)
    for i in range(WIDTH):
        np.add.at(d_table[i], (np.take_along_axis(at, 2 * where + i, 1), cols), d_best)
    return [d_table, d_best.sum(0), pooled.T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, steps: int | None = None, seed: int = 7) -> ByteCNN:
    """Adam over batches with both classes equally often in each, ``STEPS`` of them if not given, or as many as have ``WORK`` chunks."""
    steps = steps or STEPS
    net, r = ByteCNN.start(seed), np.random.default_rng(seed)
    sets = [chunks_of(t) for t in texts]
    cuts = []
    for t in texts:
        size = int(r.integers(24, CHUNK))
        at = int(r.integers(0, max(1, len(t) - size)))
        cuts.append(chunks_of(t[at : at + size]))
    share = labels.mean()
    kinds = [np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)]
    # The classes are balanced in a batch; the weights put their natural shares (floored) back, so that scores are probabilities.
    share = float(np.clip(share, 0.2, 0.8))
    m = [np.zeros_like(x) for x in net.parts()]
    v = [np.zeros_like(x) for x in net.parts()]
    seen = step = 0
    while step < steps and seen < WORK:
        step += 1
        pick = np.stack([r.choice(k, BATCH // 2) for k in kinds], 1).ravel()
        short = r.random(BATCH) < SHORT_SHARE
        shown = [cuts[i] if u else sets[i] for i, u in zip(pick, short, strict=True)]
        pairs = 1 + int(np.searchsorted(np.cumsum([len(a) + len(b) for a, b in zip(shown[::2], shown[1::2], strict=True)])[:-1], BATCH_CHUNKS))
        pick, shown = pick[: 2 * pairs], shown[: 2 * pairs]
        rows = np.concatenate(shown)
        seen += len(rows)
        doc = np.repeat(np.arange(len(shown)), [len(x) for x in shown])
        y = labels[pick].astype(np.float32)
        grads = _gradients(net, rows, doc, len(shown), y, np.where(y == 1, 2 * share, 2 * (1 - share)).astype(np.float32))
        rate = RATE * max(0.0, 1 - max(step / (steps + 1), seen / WORK))
        for k, (x, g) in enumerate(zip(net.parts(), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def within(rows: list[tuple[int, int, int]], most: int) -> set[int]:
    """Of (order, id, bytes) the ids that are taken, in their order, as long as all taken have at most ``most`` bytes; one that would pass it is left out."""
    taken, size = set(), 0
    for _, i, n in sorted(rows):
        if size + n <= most:
            taken.add(i)
            size += n
    return taken


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, size: int) -> list[tuple[bytes, int]]:
    """Up to ``rows / 2`` labelled documents of each class outside the held-out fold, whole, with up to ``size / 2`` bytes, in the order of a hash of their ids.

    Labels of a null id or of no value teach nothing; a document with conflicting labels counts once with each, and one with
    several texts by the least of them. The rows are stored first, and only those within the bytes reach the driver.
    """
    known = only(labels, "doc_id", label).filter(f"doc_id IS NOT NULL AND `{label}` IN (0, 1)").distinct()
    known = known.filter(fold(F.col("doc_id"), folds) != held)
    ids = None
    for kind in (0, 1):
        part = known.filter(F.col(label) == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        ids = part if ids is None else ids.unionByName(part)
    found = only(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `rows` ids
    found = found.groupBy("doc_id", F.col(label).cast("int").alias("label")).agg(F.min("text").alias("text")).withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    found = stored(found, "sample")
    sizes = found.select("label", F.xxhash64("doc_id"), "doc_id", F.octet_length("text")).collect()  # at most `rows` rows of numbers
    out: list[tuple[int, bytes, int]] = []
    for kind in (0, 1):
        taken = sorted(within([tuple(r[1:]) for r in sizes if r.label == kind], size // 2))
        for row in found.filter((F.col("label") == kind) & F.col("doc_id").isin(taken)).toLocalIterator():
            out.append((row.doc_id, bytes(row.text), kind))
    out.sort()
    return [(data, y) for _, data, y in out]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2) -> tuple[ByteCNN | None, float]:
    """The network (none without both classes) and the share of label 1 in its sample (0.5 without labels)."""
    sample = training_sample(docs, labels, label, folds, held, TRAIN_ROWS, TRAIN_BYTES)
    y = np.array([s[1] for s in sample])
    return train([s[0] for s in sample], y) if len(set(y)) == 2 else None, float(y.mean()) if len(y) else 0.5


def _probabilities(net: ByteCNN | None, constant: float, pairs: np.ndarray | None, texts: list[str | None]) -> np.ndarray:
    return net.dense(_pool(net, pairs, [(t or "").encode("utf-8", "replace") for t in texts])).astype(float) if net else np.full(len(texts), constant)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; learns from the folds other than ``held``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, folds, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, constant = shared.value
        pairs = net.pairs() if net else None
        for doc_id, text in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(_probabilities(net, constant, pairs, text), pa.float64())], ["doc_id", "score"])

    out = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more. No row leaves its partition.

    Without both classes of labels nothing can be told apart, and all rows stay.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, constant = shared.value
        pairs = net.pairs() if net else None
        for b in batches:
            for lo in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(lo, SLICE_ROWS)
                keep = _probabilities(net, constant, pairs, part.column(at).to_pylist()) >= threshold if net else np.ones(part.num_rows, bool)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
