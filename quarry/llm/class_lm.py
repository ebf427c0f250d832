"""LM scoring with Brown class-based bigrams.

The counts of every token of the training fold come from one pass over all its texts. The ``HEAD`` most frequent words are
clustered into ``CLASSES`` classes so that the likelihood of the class bigrams grows: exchange moves the ``UNITS`` most
frequent ones and ``SHAPES`` groups of all others (by their first and last byte) one at a time; then, in ``ROUNDS`` rounds over
all training tokens, every other word of the head moves to its own best class by its left and right class counts, all of a
round against the classes of the round before; a round that doesn't raise the likelihood is undone. Words beyond the head
have the class of their group. A text's probability is

    prod P(class | class before) * P(token | class),

with transitions interpolated with the classes' own shares, and emissions by absolute discounting: of the ``c`` of a token
``D`` goes to the unseen tokens of its class, which are one symbol: a text's score is the probability of that text with each
unseen word written as its class's unknown one. The end of a text is a class of its own and stands before the first token.

Texts are encoded once, and the code of each token is stored: its place in the head, or its group. The counts of the ``HEAD``
words (a fixed bound) are sent to all tasks; those of the others are joined to the documents' remaining words, pre-counted for
each document. Words are known by their 64-bit XXH64.

Null texts count as empty: their only token is the end. Repeated rows count as often as they stand there; rows of a null id
teach like any other; extra columns take no part. With no training text every token is unseen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold, free_shuffles, only, rows_of, stored

HEAD, UNITS, SHAPES, CLASSES = 131_072, 1000, 16, 48
SWEEPS, ROUNDS = 6, 2
#: Weight of a class's own share in a transition.
SMOOTH = 8.0
SEED = 42
KEPT_WORDS = 150_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, SEED)
    return h - (1 << 64) if h >> 63 else h


def shape(word: bytes) -> int:
    return (31 * word[0] + word[-1]) % SHAPES


def word_counts(docs: DataFrame) -> DataFrame:
    """h, g, c: hash, group and number of each word of ``docs``; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(counts)
            cols = [pa.array([word_hash(w) for w in words], pa.int64()), pa.array([shape(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(cols, ["h", "g", "c"])

        for (text,) in rows_of(batches):
            for t in text:
                counts.update(words_of(t))
            if len(counts) >= KEPT_WORDS:
                yield flush()
        if counts:
            yield flush()

    return only(docs, "text").mapInArrow(run, "h long, g int, c long").groupBy("h").agg(F.min("g").alias("g"), F.sum("c").alias("c"))


@dataclass
class Head:
    """The most frequent words: their hashes, counts and groups. A word's code is its place here, or ``limit`` and its group."""

    hashes: np.ndarray
    counts: np.ndarray
    groups: np.ndarray
    limit: int

    @property
    def end(self) -> int:
        """The code of the end of a text."""
        return self.limit + SHAPES

    def lookup(self):
        place = {int(h): i for i, h in enumerate(self.hashes)}
        known: dict[bytes, int] = {}

        def codes(words: list[bytes]) -> np.ndarray:
            if len(known) > KEPT_WORDS:
                known.clear()
            for w in set(words).difference(known):
                known[w] = place.get(word_hash(w), self.limit + shape(w))
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

        return codes

    def units(self) -> np.ndarray:
        """The clustering unit of each code: a frequent word itself, else its group; the end's is the last."""
        out = np.full(self.end + 1, UNITS + SHAPES)
        n = len(self.hashes)
        out[:n] = np.where(np.arange(n) < UNITS, np.arange(n), UNITS + self.groups)
        out[self.limit : self.end] = UNITS + np.arange(SHAPES)
        return out


def _arrays(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), kind))


def encoded(docs: DataFrame, head: Head) -> DataFrame:
    """row, doc_id, train, codes, rare: the codes of each text's words and the hashes of those that aren't in the head, in their order."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_of, limit = shared.value.lookup(), shared.value.limit
        row = TaskContext.get().partitionId() << 36
        for doc_id, train, text in rows_of(batches):
            codes, rare = [], []
            for t in text:
                words = words_of(t)
                codes.append(codes_of(words))
                rare.append(np.array([word_hash(words[i]) for i in np.flatnonzero(codes[-1] >= limit)], np.int64))
            n = len(doc_id)
            cols = [pa.array(range(row, row + n), pa.int64()), pa.array(doc_id, pa.int64()), pa.array(train, pa.bool_()), _arrays(codes, pa.int32()), _arrays(rare, pa.int64())]
            row += n
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "train", "codes", "rare"])

    return docs.select("doc_id", "train", "text").mapInArrow(run, "row long, doc_id long, train boolean, codes array<int>, rare array<long>")


def _sequences(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """The codes of each batch's texts in one run, an end before the first and behind each."""
    for b in batches:
        c = b.column(0)
        offsets, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        yield np.insert(values[offsets[0] : offsets[-1]], np.concatenate([[0], offsets[1:] - offsets[0]]), end) if len(c) else np.array([end])


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(offsets, offsets[1:], strict=False):
        yield values[a:b]


def bigrams(codes: DataFrame, of: np.ndarray) -> np.ndarray:
    """(n, n): how often each value of ``of`` (by code) follows each, over the texts of ``codes``; at most n * n numbers reach the driver."""
    n = int(of.max()) + 1
    shared = codes.sparkSession.sparkContext.broadcast(of.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        total = np.zeros(n * n, np.int64)
        for seq in _sequences(batches, len(of) - 1):
            x = of[seq]
            np.add.at(total, x[:-1] * n + x[1:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    out = np.zeros(n * n)
    table = codes.select("codes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[table["at"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(n, n)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, but for what no choice of classes changes."""
    return float(_h(table).sum() - _h(table.sum(0)).sum() - _h(table.sum(1)).sum())


def gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, self_: float, mine: int) -> tuple[np.ndarray, np.ndarray]:
    """What the likelihood gains with a unit in each class, and the table without it.

    ``right`` and ``left``: how often each class follows and precedes it, without itself; ``self_``: how often it follows itself.
    """
    n_right, n_left = right.sum() + self_, left.sum() + self_
    base = table.copy()
    base[mine] -= right
    base[:, mine] -= left
    base[mine, mine] -= self_
    base = np.maximum(base, 0)
    with_row = _h(base + right[None]) - _h(base)  # [c, d]: row c gains what follows the unit
    with_col = _h(base + left[:, None]) - _h(base)  # [d, c]: column c gains what stands before it
    diag = np.arange(len(table))
    gain = with_row.sum(1) - with_row[diag, diag] + with_col.sum(0) - with_col[diag, diag]
    own = base[diag, diag]
    gain += _h(own + right + left + self_) - _h(own)
    before, after = base.sum(1) + left, base.sum(0) + right  # what the other words of each class have, wherever the unit stands
    return gain - (_h(before + n_right) - _h(before) + _h(after + n_left) - _h(after)), base


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit: units move, one at a time, to the class that gives the bigrams the highest likelihood.

    The last unit (the end) keeps the last class for itself. Units start in classes by frequency.
    """
    n = len(pairs)
    free = classes - 1
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1))[: n - 1], kind="stable")
    of = np.full(n, free)
    of[order] = np.arange(n - 1) % free
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    table = one.T @ pairs @ one
    for _ in range(sweeps):
        moved = 0
        for u in order:
            right = np.bincount(of, pairs[u], classes)  # how often each class follows u
            left = np.bincount(of, pairs[:, u], classes)
            self_, mine = pairs[u, u], of[u]
            right[mine] -= self_
            left[mine] -= self_
            if not right.sum() + left.sum() + self_:
                continue
            gain, table = gains(table, right, left, self_, mine)
            to = int(gain[:free].argmax())
            if gain[to] <= gain[mine] + 1e-9:
                to = mine
            of[u] = to
            moved += to != mine
            table[to] += right
            table[:, to] += left
            table[to, to] += self_
        if not moved:
            break
    return of


def reassigned(codes: DataFrame, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The classes by code with each word of the head beyond the units, and each group, in its best class beside the others as they are.

    Every task sums the class counts around its words, in a table of fixed size, and sends a row for each word it has met.
    """
    end, classes = len(of) - 1, len(table)
    units = min(UNITS, end - SHAPES)
    n = end - units
    shared = codes.sparkSession.sparkContext.broadcast((of.astype(np.int64), table))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, _ = shared.value
        counts = np.zeros(n * (2 * classes + 1), np.uint32)  # of each word: the classes behind it, before it, and itself behind itself
        for seq in _sequences(batches, end):
            at = np.flatnonzero((seq >= units) & (seq < end))
            word = (seq[at].astype(np.int64) - units) * (2 * classes + 1)
            same_next, same_before = seq[at + 1] == seq[at], seq[at - 1] == seq[at]
            np.add.at(counts, word + np.where(same_next, 2 * classes, of[seq[at + 1]]), 1)
            np.add.at(counts, (word + classes + of[seq[at - 1]])[~same_before], 1)
        counts = counts.reshape(n, -1)
        for lo in range(0, n, 1 << 14):
            row, kind = np.nonzero(counts[lo : lo + (1 << 14)])
            number = counts[lo + row, kind].astype("<u4")
            word, first = np.unique(row, return_index=True)
            ends = np.append(first, len(row)).astype(np.int32)
            cols = [pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(size * ends), pa.py_buffer(x.tobytes())]) for size, x in ((np.int32(1), kind.astype(np.uint8)), (np.int32(4), number))]
            yield pa.RecordBatch.from_arrays([pa.array((word + lo + units).astype(np.int32)), *cols], ["code", "kind", "number"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = shared.value
        word, total = -1, np.zeros(2 * classes + 1)

        def choice() -> tuple[int, int]:
            mine = int(of[word])
            gain, _ = gains(table, total[:classes], total[classes : 2 * classes], total[-1], mine)
            to = int(gain[: classes - 1].argmax())
            return word, to if gain[to] > gain[mine] + 1e-9 else mine

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)], ["code", "class"])

        for b in batches:
            found = []
            for code, kind, number in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if code != word:
                    if word >= 0:
                        found.append(choice())
                    word, total = code, np.zeros(2 * classes + 1)
                total[np.frombuffer(kind, np.uint8)] += np.frombuffer(number, "<u4")
            yield batch(found)
        if word >= 0:
            yield batch([choice()])

    rows = codes.select("codes").mapInArrow(around, "code int, kind binary, number binary")
    out = of.copy()
    chosen = rows.repartition("code").sortWithinPartitions("code").mapInArrow(best, "code int, class int").toArrow()  # a row for each word of the head
    out[chosen["code"].to_numpy()] = chosen["class"].to_numpy()
    return out


@dataclass
class Model:
    head: Head
    step: np.ndarray  # (CLASSES, CLASSES): log10 P(class | class before)
    class_of: np.ndarray  # of each code
    class_size: np.ndarray  # log10 of the number of tokens of each class; 0 where there are none
    unseen: np.ndarray  # of each class: log10 of what its unseen tokens have together, times its size
    discount: float
    tokens: int
    kinds: int
    ends: int

    @property
    def least(self) -> float:
        return math.log10(self.tokens + self.kinds + 1)

    def parts(self, codes: np.ndarray) -> tuple[float, float, int, np.ndarray]:
        """Of a text's codes: log10 of what doesn't depend on rare words' counts (model, base), known head tokens, rare words' classes."""
        classes = self.class_of[np.append(codes, self.head.end)]
        before = np.concatenate([self.class_of[-1:], classes[:-1]])
        score = float(self.step[before, classes].sum() - self.class_size[classes[:-1]].sum())
        top = codes[codes < self.head.limit]
        c = self.head.counts[top].astype(float) if len(top) else np.zeros(0)
        score += float(np.log10(np.maximum(c - self.discount, 1e-9)).sum())
        base = float(np.log10(c + 1).sum()) + math.log10(self.ends + 1) - (len(codes) + 1) * self.least
        return score, base, len(top) + (self.ends > 0), classes[:-1][codes >= self.head.limit]


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the training rows of ``docs`` (doc_id, train, text), the stored counts of all their words, and all rows encoded."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs.filter("train")), "word-counts")
    free_shuffles(spark)
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
    head = Head(*(top[x].to_numpy().astype(np.int64) for x in ("h", "c", "g")), HEAD)
    by_group = {r.g: r for r in counts.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos")).collect()}
    codes = stored(encoded(docs, head), "codes")
    train = codes.filter("train")
    ends = train.count()
    ones, twos = sum(r.ones for r in by_group.values()), sum(r.twos for r in by_group.values())
    discount = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))
    units = head.units()
    of = exchange(bigrams(train, units))[units]
    table = bigrams(train, of)
    for _ in range(ROUNDS):
        new = reassigned(train, of, table)
        free_shuffles(spark)
        moved = bigrams(train, new)
        if likelihood(moved) <= likelihood(table):
            break
        of, table = new, moved
    size = table.sum(0)
    share = (size + 1) / (size.sum() + CLASSES)
    step = (table + SMOOTH * share) / (table.sum(1, keepdims=True) + SMOOTH)
    kinds = np.bincount(of[: len(head.counts)], minlength=CLASSES).astype(float)
    for g, r in by_group.items():
        kinds[of[HEAD + g]] += r.kinds - int((head.groups == g).sum())
    full = size > 0
    mass = np.where(full, discount * kinds, 1.0)
    model = Model(head, np.log10(step), of, np.log10(np.where(full, size, 1.0)), np.log10(np.maximum(mass, 1e-9)), discount, int(sum(r.n for r in by_group.values())) + ends, sum(r.kinds for r in by_group.values()) + (ends > 0), ends)
    return model, counts, codes


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, add-one), score (the model) of every row."""
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model, counts, codes = fit(docs.withColumn("train", fold(F.col("doc_id"), folds) != held))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "h", "n", "unseen", "doc_id", "n_tokens", "n_known", "base", "score"]
    schema = "row long, h long, n long, unseen double, doc_id long, n_tokens long, n_known long, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            row, doc_id = (b.column(i).to_pylist() for i in (0, 1))
            rows, hashes, number, unseen, own = [], [], [], [], []
            for r, codes, rare in zip(row, *(_lists(b.column(i)) for i in (2, 3)), strict=True):
                s, base, known, classes = m.parts(codes)
                own.append((len(codes) + 1, known, base, s))
                h, first, n = np.unique(rare, return_index=True, return_counts=True)
                rows.append(np.full(len(h), r))
                hashes.append(h)
                number.append(n)
                unseen.append(m.unseen[classes[first]])
            none = [None] * sum(map(len, rows))
            # the documents' own rows go by their numbers
            cols = [np.concatenate([*rows, row]), np.concatenate([*hashes, row]), np.concatenate([*number, np.zeros(len(row))]), np.concatenate([*unseen, np.zeros(len(row))])]
            cols = [pa.array(c.astype(np.int64), pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.float64())]
            more = [doc_id, *(list(c) for c in zip(*own, strict=True))] if own else [[]] * 5
            types = [pa.int64()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(cols + [pa.array(none + list(c), t) for c, t in zip(more, types, strict=True)], names)

    rows = codes.select("row", "doc_id", "codes", "rare").mapInArrow(run, schema).join(counts.select("h", "c"), "h", "left")
    c = F.when(F.col("n") > 0, F.coalesce("c", F.lit(0)))
    rows = rows.withColumns({
        "known": F.when(c > 0, F.col("n")).otherwise(0),
        "b": F.coalesce(F.col("n") * F.log10(c + 1.0), F.lit(0.0)),
        "s": F.when(c > 0, F.col("n") * F.log10(c - F.lit(model.discount))).otherwise(F.col("n") * F.col("unseen")),
    })
    out = rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.sum("known")).alias("n_known"),
        (F.max("base") + F.sum("b")).alias("base_score"), (F.max("score") + F.sum("s")).alias("score"),
    )
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
