"""Packing: order-preserving dynamic programming over window cuts.

Every partition's documents form one stream of ids, in their order there. Windows may end at the end of a
document (free), of a sentence (``AT_SENTENCE``) or, in stretches without either, at evenly spaced places
(``AT_WORD``). The cuts minimise padding plus those penalties: with ``f(j)`` the least cost of the stream up
to ``j``,

    f(j) = penalty(j) + min( min over j - limit <= i < j of f(i) + limit - (j - i),  min over k of f(j - 2^k) ),

where the first minimum comes from a monotone queue over ``f(i) + i`` and the second, over ``2^k`` in ``POWERS``, holds because
windows whose length is a power of two are not padded; shorter powers would only split texts further. No row leaves its
partition; a partition's stream is cut in blocks, the last windows of a block being decided with the next one.

A null or empty text is its end id alone. Repeated rows and ids are packed as they come; ids need not differ, and may be
null. A text of any length is encoded whole and cut in blocks; extra columns take no part.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import only, rows_of
from quarry.llm.tokens import tokens, vocabulary_path

LIMIT, END_ID = 1024, 0
AT_SENTENCE, AT_WORD = 4, 16
#: Evenly spaced cuts in stretches of more ids than this without a natural one.
STRETCH = 48
#: Lengths that need no padding and are worth a window of their own.
POWERS = (64, 128, 256, 512)
BLOCK = 1 << 17
SEQUENCES = 1 << 36


def best_cuts(at: list[int], penalty: list[int], limit: int = LIMIT, powers: tuple[int, ...] = POWERS) -> list[int]:
    """The cuts of least cost among the places ``at`` (ascending, from 0; neighbours at most ``limit`` apart), without 0."""
    n = len(at)
    cost, back = [0] * n, [0] * n
    where = {p: i for i, p in enumerate(at)}
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, index), costs ascending
    oldest = 0
    for j in range(1, n):
        p = at[j]
        while at[queue[0][1]] < p - limit:
            queue.popleft()
        best, oldest = queue[0]
        best += limit - p
        for s in powers:
            i = where.get(p - s)
            if i is not None and cost[i] < best:
                best, oldest = cost[i], i
        cost[j], back[j] = best + penalty[j], oldest
        key = cost[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def places(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Where windows may end in the stream, from 0 to its length, and at which penalty."""
    natural = np.flatnonzero(ends[ids]) + 1
    marks = np.unique(np.concatenate([[0], natural, doc_ends, [len(ids)]]))
    gap = np.diff(marks)
    wide = np.flatnonzero(gap > STRETCH)
    more = [np.arange(marks[i] + STRETCH, marks[i + 1], STRETCH) for i in wide]
    at = np.unique(np.concatenate([marks, *more])) if more else marks
    cost = np.full(len(at), AT_WORD)
    cost[np.isin(at, natural)] = AT_SENTENCE
    cost[np.isin(at, doc_ends)] = 0
    cost[-1] = 0
    return at.tolist(), cost.tolist()


class Packer:
    """Takes (document, ids) in order and gives the pieces of finished windows."""

    def __init__(self, ends: np.ndarray, first_sequence: int, limit: int = LIMIT, block: int = BLOCK):
        self.ends, self.limit, self.block = ends, limit, block
        self.sequence = first_sequence
        self.held: list[list] = []  # [document, ids, place of the first one in the document, ids in the document]
        self.size = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        for lo in range(0, len(ids), self.block):
            self.held.append([doc, ids[lo : lo + self.block], lo, len(ids)])
            self.size += len(self.held[-1][1])
            if self.size >= self.block:
                yield from self._cut(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.size:
            yield from self._cut(last=True)

    def _cut(self, last: bool) -> Iterator[tuple]:
        stream = np.concatenate([h[1] for h in self.held])
        until = np.cumsum([len(h[1]) for h in self.held])
        whole = [h[2] + len(h[1]) == h[3] for h in self.held]
        at, penalty = places(stream, self.ends, until[np.array(whole, bool)])
        cuts = best_cuts(at, penalty, self.limit)
        if not last:
            cuts = cuts[:-2]
        i, start, used = 0, 0, 0
        for cut in cuts:
            while start < cut:
                doc, ids, first, total = self.held[i]
                lo = start - (int(until[i]) - len(ids))
                hi = min(len(ids), lo + cut - start)
                yield doc, first + lo, ids[lo:hi], total, self.sequence, start - used, cut - used
                start += hi - lo
                i += hi == len(ids)
            self.sequence += 1
            used = cut
        rest = []
        for h, end in zip(self.held[i:], until[i:], strict=True):
            lo = max(0, used - (int(end) - len(h[1])))
            if lo < len(h[1]):
                rest.append([h[0], h[1][lo:], h[2] + lo, h[3]])
        self.held, self.size = rest, sum(len(h[1]) for h in rest)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def pack(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents' ids: where each is in its document and in its sequence.

    ``with_ids`` adds the ids themselves (``ids``, little-endian unsigned 32-bit) for a writer of training files.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(path)
        packer = Packer(t.ends_sentence(), TaskContext.get().partitionId() * SEQUENCES, limit)
        pending: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset, length = (list(c) for c in zip(*pending, strict=True))
            pending.clear()
            data = [x.astype("<u4").tobytes() for x in ids]
            cols = [doc, start, [len(x) for x in ids], [zlib.crc32(x) for x in data], total, sequence, offset, length]
            out = [pa.array(c, pa.int64()) for c in cols] + ([pa.array(data, pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids)

        end = np.array([END_ID], np.uint32)
        for doc_id, text in rows_of(batches):
            for d, x in zip(doc_id, text, strict=True):
                pending.extend(packer.add(d, np.concatenate([t.encode(x), end])))
                if len(pending) >= 4096:
                    yield flush()
        pending.extend(packer.finish())
        if pending:
            yield flush()

    named = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return named.mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))
