"""Byte-level BPE by tree reduction: halves are encoded alone and joined by re-encoding a window around their seam.

An encoded text is its tokens and how many of them each piece (match of the vocabulary's pattern) has. Joining two of them gives
what encoding both texts together gives, so encoding is a homomorphism and texts may be cut anywhere, also over tasks:

* A piece of the left text is certain if two characters or more follow it, since no match looks further ahead. From the left
  text's last certain boundary on a window is matched anew. It grows over the right text, doubling, until a boundary that is
  certain in it is one of the right text's own; matches depend only on what follows, so all behind stays as it was.
* Within a piece, tokens are right if each neighbouring pair is what its bytes are encoded to: the first merge over a boundary
  in the whole piece would be the first one in its pair too. So a window of tokens at the seam is encoded anew and grows,
  doubling, until the pairs at its ends hold.

Texts over ``BLOCK`` characters are cut into blocks that Spark deals to tasks and joins level by level, two neighbours each.
Shorter ones are encoded where they are, by the same joins from leaves of ``LEAF_CHARS`` characters. Distinct short pieces of
many texts are merged together, a round for all of them at a time. Decoding concatenates tokens' bytes up the tree.

The vocabulary is a file of ranks, whose path is a parameter; no special tokens. Null text counts as empty: no tokens. Null and
repeated ids are allowed, each row is a text of its own; extra columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import only, rows_of, stored

#: Characters of a block that is dealt by itself, and of a leaf within.
BLOCK, LEAF_CHARS = 1 << 16, 1 << 12
#: Bytes of a piece that are merged without halving: together with other pieces, and alone.
LEAF_BYTES, LONG_LEAF_BYTES = 32, 1024
#: Pieces, and bytes of long ones, that a worker remembers; then it begins anew.
KNOWN_PIECES, KNOWN_BYTES = 300_000, 1 << 22
NEVER = np.int32((1 << 31) - 1)

#: Tokens, and the number of them in each piece.
Encoded = tuple[list[int], list[int]]


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """A vocabulary with its pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.match = regex.compile(pattern).findall
        self.newer = self._newer(regex)
        self.words: list[bytes] = [b""] * (1 + max(self.ranks.values()))
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.decimal = [str(i) for i in range(len(self.words))]
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self._pairs()
        self.known: dict[str, list[int]] = {}
        self.held = 0  # bytes of long pieces in it
        self._pair_holds: dict[tuple[int, int], bool] = {}

    def _newer(self, regex) -> tuple | None:
        """Characters that belong to another class in the library's Unicode tables than in this one's: a quick search (any beyond
        the basic plane may be one), and stand-ins of the right class.

        A probe with a vocabulary of bytes and a class as its pattern gives all characters of the class as the library has it.
        """
        import tiktoken

        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        probe = {bytes([i]): i for i in range(256)}
        stand_ins: dict[int, str] = {}
        for kind, stand_in in ((r"\s", "\t"), (r"\p{L}", "z"), (r"\p{N}", "0")):
            theirs = set(bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=probe, special_tokens={}).encode_ordinary(everything)).decode())
            ours = set(regex.findall(kind, everything))
            stand_ins |= {ord(c): "!" for c in ours - theirs if ord(c) not in stand_ins} | {ord(c): stand_in for c in theirs - ours}
        if not stand_ins:
            return None
        basic = "".join(re.escape(chr(c)) for c in stand_ins if c < 0x10000)
        return re.compile(f"[{basic}\U00010000-\U0010ffff]").search, stand_ins

    def find(self, text: str) -> list[str]:
        """The pieces of a text."""
        if self.newer is None or text.isascii() or not self.newer[0](text):
            return self.match(text)
        out, at = [], 0
        for p in self.match(text.translate(self.newer[1])):
            out.append(text[at : at + len(p)])
            at += len(p)
        return out

    def _pairs(self) -> None:
        """The token that each pair of neighbours makes, as a table of keys in a power of two of slots: linear probing, vectorised."""
        ranks = self.ranks
        made = {(ranks[w[:i]], ranks[w[i:]]): r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}
        self.pair = made
        size = 1 << (2 * len(made) + 1).bit_length()
        keys = np.array([a << 32 | b for a, b in made], np.int64)
        values = np.array(list(made.values()), np.int32)
        self.mask = np.int64(size - 1)
        self.slots, self.made = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.slots[at[left]] < 0
            put = left[free]
            self.slots[at[put]] = keys[put]  # of several for a slot the last one stays
            won = put[self.slots[at[put]] == keys[put]]
            self.made[at[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.int64(-7046029254386353131) >> np.int64(40)) & self.mask

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The tokens that pairs make; NEVER where none or where one of the two is negative."""
        keys = a.astype(np.int64) << np.int64(32) | b
        at = self._slot(keys)
        there = self.slots[at]
        out = np.where(there == keys, self.made[at], NEVER)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.slots[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The tokens of many short pieces: in each round every piece merges its first pair of the least rank."""
        out: list[list[int]] = [[] for _ in pieces]
        sizes = np.array([len(p) for p in pieces], np.int64)
        for high in (4, 8, 16, LEAF_BYTES):
            self._merge_rows(pieces, np.flatnonzero((sizes <= high) & (sizes > (0 if high == 4 else high // 2))), sizes, out)
        return out

    def _merge_rows(self, pieces: list[bytes], owner: np.ndarray, sizes: np.ndarray, out: list[list[int]]) -> None:
        """A row for each piece, its tokens from the left; pairs' ranks beside them."""
        size = sizes[owner]
        if not len(owner):
            return
        ids = np.full((len(owner), size.max() + 1), -1, np.int32)
        ids[np.arange(ids.shape[1]) < size[:, None]] = self.byte[np.frombuffer(b"".join([pieces[i] for i in owner]), np.uint8)]
        ranks = self._made(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while True:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(ids)), at]
            live = least < NEVER
            if not live.all():
                for k in np.flatnonzero(~live):
                    out[owner[k]] = ids[k, : size[k]].tolist()
                owner, size, at, least = owner[live], size[live], at[live], least[live]
                if not len(owner):
                    return
                width = size.max() + 1
                ids, ranks = ids[live, :width], ranks[live, : width - 1]
            row, column = np.arange(len(ids)), np.arange(ids.shape[1])
            moved = column > at[:, None]
            ids[:, :-1] = np.where(moved[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(moved[:, :-2], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NEVER
            ids[row, at] = least
            size -= 1
            ranks[row, at] = self._made(ids[row, at], ids[row, at + 1])
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self._made(ids[inner, at[inner] - 1], ids[inner, at[inner]])

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of a few bytes."""
        ids, pair = [int(self.byte[b]) for b in piece], self.pair
        while len(ids) > 1:
            best, at = NEVER, -1
            for i in range(len(ids) - 1):
                r = pair.get((ids[i], ids[i + 1]), NEVER)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            ids[at : at + 2] = [int(best)]
        return ids

    def _bytes(self, ids: Iterable[int]) -> bytes:
        words = self.words
        return b"".join([words[i] for i in ids])

    def _holds(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are side by side."""
        known = self._pair_holds.get((a, b))
        if known is None:
            if len(self._pair_holds) > KNOWN_PIECES:
                self._pair_holds.clear()
            known = self._pair_holds[a, b] = self.merge(self.words[a] + self.words[b]) == [a, b]
        return known

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of bytes within one piece, from those of both halves."""
        if len(piece) <= LONG_LEAF_BYTES:
            return self._window(piece)
        half = len(piece) // 2
        return self.join_within(self.merged(piece[:half]), self.merged(piece[half:]))

    def join_within(self, a: list[int], b: list[int]) -> list[int]:
        """The tokens of one piece from those of its two parts."""
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self._window(self._bytes(a[len(a) - i :]) + self._bytes(b[:j]))
            left = i == len(a) or self._holds(a[-i - 1], window[0])
            right = j == len(b) or self._holds(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            if not left:
                i *= 2
            if not right:
                j *= 2

    def _window(self, text: bytes) -> list[int]:
        """The tokens of bytes within a piece: of a few by trying all pairs, of more by a heap of pairs over linked neighbours."""
        if len(text) <= 64:
            return self.merge(text)

        n = len(text)
        ids = [int(self.byte[b]) for b in text]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            k = after[i]
            if ids[i] < 0 or k >= n or self.pair.get((ids[i], ids[k])) != r:
                continue  # one of the two has gone into another token
            ids[i], ids[k] = r, -1
            after[i] = after[k]
            if after[k] < n:
                before[after[k]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (made := self.pair.get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (made, x))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: Iterable[str]) -> None:
        """Find the tokens of pieces that aren't known: a token is itself; short ones are merged together."""
        short = []
        for p in pieces:
            if p in self.known:
                continue
            raw = p.encode()
            own = self.ranks.get(raw)
            if own is None and len(raw) <= LEAF_BYTES:
                short.append((p, raw))
                continue
            self.known[p] = [own] if own is not None else self.merged(raw)
            self.held += len(raw)
        if short:
            self.known.update(zip([p for p, _ in short], self.merge_all([raw for _, raw in short]) if len(short) > 8 else [self.merge(raw) for _, raw in short], strict=True))

    def forget(self) -> None:
        """Begin anew with an empty memory where it has grown too large."""
        if len(self.known) > KNOWN_PIECES or self.held > KNOWN_BYTES:
            self.known.clear()
            self.held = 0

    def _of(self, pieces: list[str]) -> Encoded:
        found = list(map(self.known.__getitem__, pieces))
        return list(chain.from_iterable(found)), list(map(len, found))

    def join(self, a: Encoded, b: Encoded) -> Encoded:
        """The encoded text of which ``a`` and ``b`` are the two parts."""
        (a_ids, a_counts), (b_ids, b_counts) = a, b
        if not a_counts or not b_counts:
            return b if not a_counts else a
        i, cut, text = len(a_counts), len(a_ids), ""
        while i and len(text) < 2:
            i -= 1
            text = self._bytes(a_ids[cut - a_counts[i] : cut]).decode() + text
            cut -= a_counts[i]
        taken = 1
        while True:
            taken = min(taken, len(b_counts))
            starts, at, low = {}, 0, len(text)  # where b's pieces start in the window: how many pieces and tokens stand before
            right = []
            for k in range(taken):
                starts[low] = (k, at)
                right.append(self._bytes(b_ids[at : at + b_counts[k]]).decode())
                at += b_counts[k]
                low += len(right[-1])
            window = text + "".join(right)
            found, place, kept = [], 0, None
            for p in self.find(window):
                if place in starts and place + 2 <= len(window):
                    kept = starts[place]
                    break
                found.append(p)
                place += len(p)
            if kept is None and taken == len(b_counts):
                kept = (len(b_counts), len(b_ids))
            if kept is not None:
                self.learn(found)
                ids, counts = self._of(found)
                return a_ids[:cut] + ids + b_ids[kept[1] :], a_counts[:i] + counts + b_counts[kept[0] :]
            taken *= 2

    def encode(self, text: str) -> Encoded:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[Encoded]:
        """Texts, each from the leaves up; the leaves' pieces that aren't known are merged together."""
        leaves = [[self.find(t[i : i + LEAF_CHARS]) for i in range(0, len(t), LEAF_CHARS)] for t in texts]
        self.forget()
        self.learn(set().union(*[leaf for t in leaves for leaf in t]))
        return [self._tree([self._of(leaf) for leaf in t]) for t in leaves]

    def _tree(self, parts: list[Encoded]) -> Encoded:
        if not parts:
            return [], []
        if len(parts) == 1:
            return parts[0]
        half = (len(parts) + 1) // 2
        return self.join(self._tree(parts[:half]), self._tree(parts[half:]))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of tokens: those of both halves, one behind the other."""
        if len(ids) <= LEAF_CHARS:
            return self._bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One instance for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _unpacked(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, block: int | None = None) -> DataFrame:
    """doc_id, ids (binary: unsigned 32-bit numbers, little-endian) of every row's text."""
    path, pattern, block = path or vocabulary_path(), pattern or default_pattern(), block or BLOCK
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for doc_id, texts in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array([_packed(ids) for ids, _ in c.encode_all(texts)], pa.binary())], ["doc_id", "ids"])

    short = rows.filter(F.length("text") <= block).mapInArrow(whole, "doc_id long, ids binary")
    return short.unionByName(_long(rows.filter(F.length("text") > block), path, pattern, block))


def _long(rows: DataFrame, path: str, pattern: str, block: int) -> DataFrame:
    """As ``encode``, for texts of several blocks: encoded by block in any task, then joined two by two."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for doc_id, texts in rows_of(batches, 1):
            row += 1
            for t in texts:
                for i in range(0, len(t), block):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (row,)] + [pa.array(doc_id, pa.int64()), pa.array([i // block], pa.int64()), pa.array([t[i : i + block]])], ["row", "doc_id", "node", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for row, doc_id, node, texts in rows_of(batches, 1):
            ids, counts = c.encode(texts[0])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(doc_id, pa.int64()), pa.array(node), pa.array([_packed(ids)], pa.binary()), pa.array([_packed(counts)], pa.binary())], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of texts and nodes: an even node waits for the odd one behind it."""
        c, held = codec(path, pattern), None
        made = lambda r, d, n, e: pa.RecordBatch.from_arrays([pa.array([r]), pa.array([d], pa.int64()), pa.array([n // 2]), pa.array([_packed(e[0])], pa.binary()), pa.array([_packed(e[1])], pa.binary())], names)
        for row, doc_id, node, ids, counts in rows_of(batches, 1):
            one = (row[0], doc_id[0], node[0], (_unpacked(ids[0]), _unpacked(counts[0])))
            if held and held[0] == one[0] and held[2] + 1 == one[2] and one[2] % 2:
                yield made(*one[:3], c.join(held[3], one[3]))
                held = None
                continue
            if held:
                yield made(*held)
            held = one
        if held:
            yield made(*held)

    names = ["row", "doc_id", "node", "ids", "counts"]
    schema = "row long, doc_id long, node long, ids binary, counts binary"
    spark = rows.sparkSession
    blocks = stored(rows.mapInArrow(cut, "row long, doc_id long, node long, text string"), "blocks")
    top = blocks.agg(F.max("node")).first()[0]
    if top is None:
        return spark.createDataFrame([], "doc_id long, ids binary")
    level = stored(blocks.repartition("row", "node").mapInArrow(leaves, schema), "encoded")
    while top:
        near = level.withColumn("pair", F.expr("node div 2")).repartition("row", "pair").sortWithinPartitions("row", "node").drop("pair")
        level = stored(near.mapInArrow(joined, schema), "encoded")
        top //= 2
    return level.select("doc_id", "ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded (binary) of rows with ids as ``encode`` gives them."""
    path, pattern = path or vocabulary_path(), default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for doc_id, ids in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array([c.decode(_unpacked(x)) if x is not None else None for x in ids], pa.binary())], ["doc_id", "decoded"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, block: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with commas between), decoded_sha256 (of the bytes that the ids give)."""
    path, pattern = path or vocabulary_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        decimal = c.decimal
        for doc_id, packed in rows_of(batches):
            out = []
            for raw in packed:
                ids = _unpacked(raw)
                out.append((len(ids), hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            n, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path, pattern, block).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
