"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are folded to lower-case words between spaces (ASCII punctuation and white space become one space). An item
of ``n`` bytes, taken with the space on each side, may differ from a passage in ``e = n * RATE`` edits, whatever its length;
cut into ``e + 1`` pieces, at least one piece then stands in the passage unchanged. The pieces of a block of items are
known by their first ``KEY`` bytes, in a sorted table behind a bit map; all places of a batch of texts are looked up there at
once, and pieces that then stand in the text whole are hits. Around each hit, only stretches with as many of the item's runs
of ``GRAM`` bytes as the edits must leave are kept, in one vectorised pass; there Myers' bit-parallel algorithm gives the
least edit distance of the item to any passage. So what is common to items and texts costs a look, not a distance.

Items reach the tasks in blocks of at most ``BLOCK_BYTES`` (a worker needs some five times that), each block meeting all
documents, so the benchmark may be of any size; one of more than a block costs a pass over the documents for each, and the
driver keeps all blocks until the result has been read. An item too short for an edit must stand as whole words, unchanged. Null and empty items and
texts match nothing. Repeated items and rows give repeated results; very long texts are searched whole; extra columns take no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_ROWS, only, rows_of, small_batches

RATE = 0.08
BLOCK_BYTES = 16 << 20
#: Bytes at a piece's start that it is looked up by, and bits of the map for each piece.
KEY, MAP_BITS = 8, 16
#: Bytes of texts that are searched at a time.
SEARCHED = 1 << 20
#: Bytes of the runs that are counted before a distance is taken.
GRAM = 4

#: A-Z to a-z; other ASCII but digits and a-z to a space; bytes over 0x7F stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    """The folded text between two spaces; empty without words."""
    words = text.encode("utf-8", "replace").translate(_FOLD).split() if text else []
    return b" " + b" ".join(words) + b" " if words else b""


def least_distance(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Myers: the least edit distance of ``item`` to any substring of ``text`` and where the first such one ends; (most + 1, -1) if over ``most``."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    mask: dict[int, int] = {}
    for i, c in enumerate(item):
        mask[c] = mask.get(c, 0) | 1 << i
    pv, mv, now = full, 0, m
    best, end = (m, 0) if m <= most else (most + 1, -1)  # all of it away from no text
    get = mask.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if now < best:
            best, end = now, j + 1
            if not now:
                break
    return best, end


def _spread(keys: np.ndarray, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)


def _grams(body: bytes) -> np.ndarray:
    """The runs of GRAM bytes of ``body``, in their order, as numbers."""
    return np.ndarray(max(0, len(body) - GRAM + 1), "<u4", body, strides=(1,)) if len(body) >= GRAM else np.zeros(0, np.uint32)


def likely(item: bytes, text: bytes, most: int) -> list[tuple[int, int]]:
    """The stretches (start, end) of ``text``, apart from each other, that hold all passages within ``most`` edits of ``item``.

    An edit spoils GRAM of the item's runs at most, so all the others stand in the passage, at places of their own. A passage
    has ``len(item) + most`` bytes at most; where a stretch of that length has fewer places with a run of the item, none lies in it.
    """
    need = len(item) - GRAM + 1 - GRAM * most
    reach = len(item) + most
    if need <= 0 or len(text) <= GRAM:
        return [(0, len(text))]
    known = np.isin(_grams(text), _grams(item))
    upto = np.concatenate([[0], np.cumsum(known)])
    first = np.arange(len(known))  # a passage may start at each place, and a stretch at the end is shorter
    good = first[upto[np.minimum(first + reach - GRAM + 1, len(known))] - upto[first] >= need]
    out: list[tuple[int, int]] = []
    if len(good):
        cut = np.flatnonzero(np.diff(good) > reach)
        for a, b in zip(good[np.concatenate([[0], cut + 1])].tolist(), good[np.concatenate([cut, [len(good) - 1]])].tolist(), strict=True):
            out.append((a, min(len(text), b + reach)))
    return out


class Finder:
    """The pieces of a block of items, in a table for each length of keys (shorter pieces than KEY are their own keys)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[tuple[int, bytes, int]] = []
        pieces: dict[int, list[tuple[int, int, int]]] = {}  # (item, where the piece starts, its bytes) by the length of the key
        for item_id, text in items:
            body = folded(text)
            if not body:
                continue
            most = int((len(body) - 2) * RATE)
            cut = [round(len(body) * k / (most + 1)) for k in range(most + 2)]
            for a, b in zip(cut, cut[1:], strict=False):
                pieces.setdefault(min(KEY, b - a), []).append((len(self.items), a, b - a))
            self.items.append((item_id, body, most))
        self.tables = []
        for size, found in pieces.items():
            keys = np.array([int.from_bytes(self.items[i][1][a : a + size], "little") for i, a, _ in found], np.uint64)
            order = np.argsort(keys, kind="stable")
            shift = 64 - max(10, (MAP_BITS * len(keys)).bit_length())
            bits = np.zeros(1 << (64 - shift), bool)
            bits[_spread(keys, shift)] = True
            self.tables.append((np.uint64((1 << 8 * size) - 1), keys[order], np.array(found, np.int32)[order], shift, bits))

    def _hits(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(place, item, place of the piece in the item) of each piece that stands in ``data``, which ends in KEY zeros."""
        eight = np.ndarray(len(data) - KEY + 1, "<u8", data, strides=(1,))
        for mask, keys, pieces, shift, bits in self.tables:
            x = eight & mask
            place = np.flatnonzero(bits[_spread(x, shift)])
            lo, hi = (np.searchsorted(keys, x[place], side=side) for side in ("left", "right"))
            some = np.flatnonzero(hi > lo)
            for p, a, b in zip(place[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                for i, start, size in pieces[a:b].tolist():
                    if data[p : p + size] == self.items[i][1][start : start + size]:
                        yield p, i, start

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """(item id, its bytes, distance, end of the passage in the folded text) of each item that each text holds."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        bodies = [folded(t) for t in texts]
        lo = 0
        while lo < len(bodies) and self.tables:
            hi, size = lo, 0
            while hi < len(bodies) and (hi == lo or size + len(bodies[hi]) < SEARCHED):
                size += len(bodies[hi]) + KEY
                hi += 1
            # zeros stand in no piece, so none is found across two texts
            data = b"".join(b + bytes(KEY) for b in bodies[lo:hi])
            first = np.cumsum([0, *(len(b) + KEY for b in bodies[lo:hi])])
            starts: dict[tuple[int, int], list[int]] = {}
            for p, i, start in self._hits(data):
                k = int(np.searchsorted(first, p, side="right")) - 1
                starts.setdefault((k, i), []).append(p - int(first[k]) - start)
            for (k, i), found in starts.items():
                best = self._nearest(i, bodies[lo + k], found)
                if best is not None:
                    out[lo + k].append(best)
            lo = hi
        return out

    def _nearest(self, i: int, body: bytes, found: list[int]) -> tuple[int, int, int, int] | None:
        """The item's least distance to a passage near one of the starts that its pieces' places lead to; None if over its budget."""
        item_id, item, most = self.items[i]
        best, end = most + 1, -1
        lo = hi = None
        for s in [*sorted(found), None]:  # passages whose windows meet are searched as one
            if s is not None and hi is not None and s - most <= hi:
                hi = s + len(item) + most
                continue
            if hi is not None:
                near = body[max(0, lo) : hi]
                for a, b in likely(item, near, most):
                    d, e = least_distance(item, near[a:b], most)
                    if d < best:
                        best, end = d, max(0, lo) + a + e
                if not best:
                    break
            if s is not None:
                lo, hi = s - most, s + len(item) + most
        return (item_id, len(item) - 2, best, end) if best <= most else None


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, block by block; a block is bounded, so the driver never holds them all."""
    block, size = [], 0
    for r in only(items, "item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        if block and size + len(r.text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, item_bytes, distance, passage_end: a row for each document and item whose passage it holds."""
    schema = "doc_id long, item_id long, item_bytes long, distance long, passage_end long"
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for doc_id, text in rows_of(batches):
                found = [(d, *x) for d, some in zip(doc_id, finder.find_all(text), strict=True) for x in some]
                cols = [list(c) for c in zip(*found, strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in schema.split(", ")])

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item. No row leaves its partition."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for b in batches:
                for lo in range(0, b.num_rows, SLICE_ROWS):
                    part = b.slice(lo, SLICE_ROWS)
                    yield part.filter(pa.array([not x for x in finder.find_all(part.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
