"""Substring dedup: an FM-index of each shard gives the matching statistics of streamed documents.

A window is ``WINDOW`` consecutive words of one document; words covered by a window that also stands in a document
of a smaller id are removed. What the indexes see is narrowed down first, over all rows:

1. Every document gives its anchors, the minima of its hashed ``GRAM``-word runs over each window: equal windows have
   equal anchors. The least id that has an anchor owns it; windows of anchors that one document has alone end here.
2. Windows whose anchor the document owns form the indexed text, dealt to shards by owner. Those of anchors that others
   own are cut into pieces at places that depend on the words alone; equal pieces of an owner are merged, and each is
   sent to its owner's shard.
3. A shard's words form an FM-index over a wavelet matrix. Backward search of each piece gives its matches; windows inside
   matches of ``WINDOW`` words or more that stand at an id not over the owner's are removed.
4. Windows that their anchor's owner doesn't have may still stand in another document of a smaller id. They are
   hashed, the least id of each hash owns it, and they go through step 3 once more with these owners.

The index compares words, so equal hashes of different words remove nothing.

Null texts have no words. Rows of a null id neither lose words nor make others lose any. Rows that repeat an id are one
document: they don't take words from each other. Documents shorter than a window stay as they are. Very long texts are taken
whole; extra columns take no part and are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_ROWS, free_shuffles, fresh, mix64, small_batches, split_join, stored, temporary
from quarry.llm.fm_index import FMIndex, long_matches

WINDOW, GRAM = 13, 6
#: A piece ends behind a window whose hash is divisible by CUT, or after MOST windows.
CUT, MOST = 32, 128
#: Words of a shard's index, on average at most, and shards for each shuffle partition at least.
SHARD_WORDS, SHARDS_PER_PARTITION = 100_000, 4
#: Pieces searched at a time; a shard asked for more than LEAST_SPLIT and UNEVEN times the mean is built more than once.
PIECES, LEAST_SPLIT, UNEVEN = 2048, 512, 3

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_B, _C = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_LETTER = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.full(max(1024, 2 * n), base, np.uint64)
            known[0] = 1
            known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words between ASCII white space."""
    x = np.frombuffer(data, np.uint8)
    solid = ~_SPACE[x]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    length = ends - starts
    word = np.cumsum(np.diff(solid, prepend=False) & solid) - 1  # of each byte, the last word begun; -1 before the first
    place = np.arange(len(x)) - starts[np.maximum(word, 0)]
    with np.errstate(over="ignore"):
        value = _LETTER[x] * _power(_B, int(length.max()) + 1)[np.clip(place, 0, length.max())] * solid
        return starts, ends, mix64(np.add.reduceat(value, starts) + length.astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each ``k`` consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = _power(_C, k)
    with np.errstate(over="ignore"):
        out = h[:n] * p[0]
        for i in range(1, k):
            out += h[i : i + n] * p[i]
        return mix64(out)


def minima(h: np.ndarray) -> np.ndarray:
    """For each window the least hash of the GRAM-word runs in it."""
    g = grams(h, GRAM)
    w = WINDOW - GRAM + 1
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for i in range(1, w):
        np.minimum(out, g[i : i + n], out=out)
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield (x.as_py() or "").encode("utf-8", "replace")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()  # offsets are those of a slice
    for a, b in zip(offsets, offsets[1:], strict=False):
        yield values[a:b]


Batches = Iterator[pa.RecordBatch]


def _anchors(batches: Batches) -> Batches:
    for b in batches:
        doc, h = [], []
        for d, data in zip(b.column(0).to_numpy(), _texts(b.column(1)), strict=True):
            x = np.unique(minima(words_of(data)[2]))
            doc.append(np.full(len(x), d))
            h.append(x)
        if h:
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(c)) for c in (doc, h)], ["doc", "h"])


#: Columns that a piece of an owner is known by.
KEY = ["piece", "twin"]
PIECE = "indexed boolean, owner long, words string, doc long, row long, start long"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
    types = [pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PIECE.split(", ")])


def _sliced(batches: Batches) -> Batches:
    for b in batches:
        for lo in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(lo, SLICE_ROWS)


def _pieces(batches: Batches) -> Batches:
    """Runs of windows whose anchors the document owns (indexed), and pieces of those that another one owns."""
    for b in _sliced(batches):
        out: list[tuple] = []
        for r, d, data, known, owners in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), _texts(b.column(2)), _lists(b.column(3)), _lists(b.column(4)), strict=True):
            starts, ends, words = words_of(data)
            anchor = minima(words).view(np.int64)
            if not len(anchor):
                continue
            order = np.argsort(known)
            known, owners = known[order], owners[order]
            at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            owner = owners[at]
            shared = known[at] == anchor
            # windows in runs of one owner each, none where not shared; others' windows are cut as the words say
            cut = np.zeros(len(anchor), bool)
            cut[1:] = (grams(words, WINDOW)[:-1] % np.uint64(CUT) == 0) & (owner[:-1] != d)
            change = np.ones(len(anchor), bool)
            change[1:] = (shared[1:] != shared[:-1]) | (owner[1:] != owner[:-1]) | cut[1:]
            first = np.flatnonzero(change)
            for lo, hi in zip(first, np.append(first[1:], len(anchor)), strict=True):
                if not shared[lo]:
                    continue
                own = owner[lo] == d
                for s in range(lo, hi, hi - lo if own else MOST):
                    e = (hi if own else min(hi, s + MOST)) - 1 + WINDOW
                    out.append((bool(own), int(owner[lo]), b" ".join(data[x:y] for x, y in zip(starts[s:e], ends[s:e], strict=True)).decode(), int(d), int(r), int(s)))
        yield _piece_batch(out)


def _split_pieces(batches: Batches) -> Batches:
    """Of a piece's windows (first, owner) those of one owner each: runs of a document's own ones, and pieces of others'."""
    for b in batches:
        out: list[tuple] = []
        for doc, row, start, words, windows in zip(*(c.to_pylist() for c in b.columns), strict=True):
            w = words.split(" ")
            windows = sorted((x["first"], x["owner"]) for x in windows)
            lo = 0
            for i in range(1, len(windows) + 1):
                if i == len(windows) or windows[i] != (windows[i - 1][0] + 1, windows[lo][1]):
                    first, owner = windows[lo]
                    out.append((owner == doc, owner, " ".join(w[first : windows[i - 1][0] + WINDOW]), doc, row, start + first))
                    lo = i
        yield _piece_batch(out)


def _searched(batches: Batches) -> Batches:
    """owner, piece, twin, first, windows, h: the runs of a piece's windows that stand in its owner's shard at an id not over the
    owner's; and each other window with 0 windows and its hash.

    Rows (shard, indexed, owner, words, piece, twin) come shard by shard, a shard's indexed rows first.
    """
    shard = None
    texts: list[tuple[int, list[str]]] = []
    pieces: list[tuple[int, int, int, list[str]]] = []
    index: FMIndex | None = None
    number: dict[str, int] = {}
    rank: np.ndarray = np.zeros(0, np.int64)

    def build() -> None:
        nonlocal index, rank, texts
        number.clear()
        rank = np.unique([o for o, _ in texts]) if texts else np.zeros(0, np.int64)
        text: list[int] = []
        owner: list[np.ndarray] = []
        for o, words in texts:
            text += [number.setdefault(w, len(number) + 1) for w in words]
            text.append(0)
            owner.append(np.full(len(words) + 1, np.searchsorted(rank, o)))
        index = FMIndex(np.array(text), np.concatenate(owner)) if texts else None
        texts = []

    def search() -> Batches:
        if texts:
            build()
        if pieces:
            names = ["owner", "piece", "twin", "first", "windows", "h"]
            owner, piece, twin = (np.array([p[i] for p in pieces], np.int64) for i in range(3))
            get = number.get
            coded = [np.array([get(w, -1) for w in words]) for *_, words in pieces]
            sizes = np.array([len(x) for x in coded])
            windows = sizes - WINDOW + 1
            if index is not None:
                hit, at = long_matches(index, coded, np.searchsorted(rank, owner, side="right") - 1, WINDOW)
            else:
                hit, at = np.zeros(windows.sum(), bool), np.cumsum(windows) - windows
            of = np.repeat(np.arange(len(pieces)), windows)  # the piece of each window
            same = np.append(of[1:] == of[:-1], False)
            goes_on = same & hit & np.append(hit[1:], False)
            first, last = np.flatnonzero(hit & ~np.append(False, goes_on[:-1])), np.flatnonzero(hit & ~goes_on)
            if len(first):
                k = of[first]
                yield pa.RecordBatch.from_arrays([_longs(x) for x in (owner[k], piece[k], twin[k], first - at[k], last - first + 1)] + [pa.nulls(len(k), pa.int64())], names)
            rest = np.flatnonzero(~hit)
            if len(rest):
                some = np.unique(of[rest])
                h = grams(words_of(" ".join(w for i in some for w in pieces[i][3]).encode())[2], WINDOW)
                word = np.zeros(len(pieces), np.int64)
                word[some] = np.cumsum(sizes[some]) - sizes[some]
                k = of[rest]
                yield pa.RecordBatch.from_arrays([_longs(x) for x in (owner[k], piece[k], twin[k], rest - at[k], np.zeros(len(k), np.int64), h[word[k] + rest - at[k]])], names)
        pieces.clear()

    for b in batches:
        for s, indexed, owner, words, piece, twin in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if s != shard:
                yield from search()
                shard, index = s, None
                texts.clear()
            if indexed:
                texts.append((owner, words.split(" ")))
            else:
                pieces.append((owner, piece, twin, words.split(" ")))
                if len(pieces) == PIECES:
                    yield from search()
    yield from search()


def _search(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the indexes say of each piece (``_searched``), stored; and the searched pieces (owner, KEY, words).

    A shard that is asked for far more pieces than others is built in several tasks, each of which gets a part of them.
    """
    spark = pieces.sparkSession
    # An owner's text may stand there more than once; equal pieces of an owner are searched once.
    asked = stored(pieces.groupBy("indexed", "owner", *KEY).agg(F.min("words").alias("words")), "asked")
    size, n = asked.agg(F.sum(F.when(F.col("indexed"), F.length("words"))), F.count_if(~F.col("indexed"))).first()
    shards = max(SHARDS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // (6 * SHARD_WORDS))
    most = max(LEAST_SPLIT, UNEVEN * n // shards)
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    busy = asked.filter("NOT indexed").groupBy("shard").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("parts > 1")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    own = F.when(F.col("indexed"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("piece"), parts).cast("int")))
    dealt = split_join(asked, busy, "shard", "left").withColumn("part", F.explode(own)).withColumn("shard", F.col("shard") * 2**20 + F.col("part"))
    dealt = dealt.select("shard", "indexed", "owner", "words", *KEY).repartition("shard").sortWithinPartitions("shard", F.desc("indexed"))
    found = dealt.mapInArrow(_searched, "owner long, piece long, twin long, first long, windows long, h long")
    return stored(found, "found"), asked.filter("NOT indexed").select("owner", *KEY, "words")


def _keyed(pieces: DataFrame) -> DataFrame:
    """With two independent hashes of the words: equal pieces of an owner are known by both."""
    return pieces.withColumns({"piece": F.xxhash64("words"), "twin": F.xxhash64(F.lit(1), "words")})


def _spans_of(places: DataFrame, found: DataFrame) -> DataFrame:
    """doc, row, span: the confirmed windows of each place of each piece."""
    hits = found.filter("windows > 0").select("owner", *KEY, "first", "windows")
    return places.join(hits, ["owner", *KEY]).select("doc", "row", F.struct((F.col("start") + F.col("first")).alias("first"), "windows").alias("span"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc, row, spans: for each row of ``docs`` (row, doc, text) that has any, the windows to remove (first, windows), stored.

    ``row`` tells rows of one id with different texts apart.
    """
    spark = docs.sparkSession
    with temporary(spark) as keep:
        out = _repeats(docs)
        keep(out)
    free_shuffles(spark)
    return out


def _repeats(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.filter("doc IS NOT NULL AND text IS NOT NULL").select("row", "doc", "text")
    with temporary(spark) as keep:  # all anchors are many; the shared ones are few
        every = stored(rows.select("doc", "text").mapInArrow(_anchors, "doc long, h long"), "anchors")
        shared = every.groupBy("h").agg(F.min("doc").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("h", "owner")
        anchors = stored(split_join(every, shared, "h").groupBy("doc").agg(F.collect_list("h").alias("hs"), F.collect_list("owner").alias("owners")), "anchors")
        keep(anchors)
    del every, shared
    free_shuffles(spark)
    pieces = rows.join(anchors, "doc").select("row", "doc", "text", "hs", "owners").mapInArrow(_pieces, PIECE)
    pieces = stored(_keyed(pieces), "pieces")
    free_shuffles(spark)
    places = pieces.filter("NOT indexed").select("owner", *KEY, "doc", "row", "start")
    found, asked = _search(pieces)
    spans = _spans_of(places, found)
    # What the anchors' owners don't have, by the windows' own hashes.
    # A window's hash may be that of a third of all places, so the places are stored before they meet the owners of hashes.
    rest = stored(places.join(found.filter("windows = 0").select("owner", *KEY, "first", "h"), ["owner", *KEY]), "rest")
    owned = rest.groupBy("h").agg(F.min("doc").alias("_owner"), F.max("doc").alias("_last")).filter("_owner < _last").select("h", "_owner")
    again = split_join(rest, owned, "h").groupBy("owner", *KEY, "doc", "row", "start").agg(F.collect_list(F.struct("first", F.col("_owner").alias("owner"))).alias("windows"))
    again = again.join(asked, ["owner", *KEY]).select("doc", "row", "start", "words", "windows").mapInArrow(_split_pieces, PIECE)
    again = stored(_keyed(again), "pieces")
    free_shuffles(spark)
    found, _ = _search(again)
    spans = spans.unionByName(_spans_of(again.filter("NOT indexed"), found))
    return stored(spans.groupBy("doc", "row").agg(F.collect_set("span").alias("spans")), "spans")


def _kept(data: bytes, firsts: np.ndarray, windows: np.ndarray) -> tuple[int, list[bytes], np.ndarray]:
    """Words of the text, those that stay, and which are removed."""
    words = data.split()
    change = np.zeros(len(words) + 1, np.int64)
    if len(firsts):
        np.add.at(change, firsts, 1)
        np.add.at(change, firsts + windows - 1 + WINDOW, -1)
    gone = np.cumsum(change)[:-1] > 0
    return len(words), [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words, gone


def _with_spans(docs: DataFrame) -> DataFrame:
    """The rows and, behind their columns, two more: the first windows and the numbers of windows to remove."""
    small_batches(docs.sparkSession)
    doc, key, firsts, windows = (fresh(docs, c) for c in ("_doc", "_row", "_firsts", "_windows"))
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), key: F.xxhash64("text")})
    spans = repeats(keyed.select(F.col(key).alias("row"), F.col(doc).alias("doc"), "text"))
    spans = spans.select(F.col("doc").alias(doc), F.col("row").alias(key), F.col("spans.first").alias(firsts), F.col("spans.windows").alias(windows))
    return keyed.join(spans, [doc, key], "left").drop(doc, key)


def _spans(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for first, n in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
        yield (np.array(first.as_py() or [], np.int64), np.array(n.as_py() or [], np.int64))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for data, (first, n) in zip(_texts(b.column(1)), _spans(b), strict=True):
                total, kept, gone = _kept(data, first, n)
                out.append((total, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = [list(c) for c in zip(*out, strict=True)] or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(df).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; texts without any stay as they are. ``n_chars`` is kept right."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Batches) -> Batches:
        for b in batches:
            out: list[str | None] = []
            for t, (first, n) in zip(b.column(at), _spans(b), strict=True):
                text = t.as_py()
                out.append(b" ".join(_kept(text.encode("utf-8", "replace"), first, n)[1]).decode() if len(first) else text)
            arrays = [b.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    spans = _with_spans(docs)
    out = spans.select(*[F.col(f"`{c}`") for c in [*columns, *spans.columns[-2:]]]).mapInArrow(run, docs.schema)
    return out.withColumn(n_chars, F.length("text").cast(docs.schema[n_chars].dataType)) if n_chars in columns else out
