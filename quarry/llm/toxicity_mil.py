"""Toxicity: multiple-instance learning with noisy-or over sentences.

A document is a bag of sentences; a sentence's score is a logistic function of its words and their first letters, and the
document's is ``1 - prod(1 - sentence)``. Only documents carry labels: the gradient of the document's log loss
reaches the sentences through the noisy-or, so the model learns which ones offend and can point at them.

The model is fitted on a bounded sample of labelled rows (at most ``TRAIN_ROWS`` of at most ``TRAIN_BYTES`` in all), whole, with
a fixed number of passes; every document is scored whole. A feature that fewer than ``MIN_DOCS`` sampled documents hold has
no weight.

Null and empty texts have no sentence and score 0, with no worst sentence. Repeated rows get equal scores; rows of a null id
are scored and teach nothing; extra columns take no part. Sentences end at ``.``, ``!``, ``?`` or a line break, or after
``LONGEST`` words. Without a label of either class every score is the share of label 1
(0 without labels).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold, only, rows_of
from quarry.llm.quality_cnn import training_sample

LONGEST = 64
#: Bounds of the training sample.
TRAIN_ROWS, TRAIN_BYTES, MIN_DOCS = 4000, 24 << 20, 6
PASSES, RATE, L1, SCREEN = 300, 2.0, 2e-4, 4.0
START_BIAS, HIGHEST_BIAS = -6.0, -4.0
#: A sentence of this score or more is named.
OFFENDS = 0.5

_WORD = re.compile(r"\w+|[.!?\n]")
_END = {".", "!", "?", "\n"}


def sentences(text: str) -> Iterator[tuple[list[str], int, int]]:
    """The lower-cased words of each sentence and its span of code points (from its first word to its last)."""
    words: list[str] = []
    first = last = 0
    for m in _WORD.finditer(text):
        w = m[0]
        if w in _END:
            if words:
                yield words, first, last
                words = []
            continue
        if not words:
            first = m.start()
        words.append(w.lower())
        last = m.end()
        if len(words) == LONGEST:
            yield words, first, last
            words = []
    if words:
        yield words, first, last


def features(word: str) -> tuple[str, ...]:
    """The word itself and its first 4 and 5 letters, marked: inflected forms share those."""
    return (word, "^" + word[:4], "^" + word[:5])


class NoisyOr:
    #: Words whose summed weight a worker keeps at a time.
    CACHED = 200_000

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "words": {}}

    def word(self, w: str) -> float:
        if len(self.words) >= self.CACHED:
            self.words.clear()
        z = self.words[w] = sum(self.weights.get(x, 0.0) for x in set(features(w)))
        return z

    def document(self, text: str) -> tuple[float, float, int, int, list[tuple[int, int, float]]]:
        """Score of the document, of its worst sentence with that one's span, and every sentence at OFFENDS or more (start, end, score)."""
        log_clean, worst = 0.0, (-1.0, -1, -1)
        offending: list[tuple[int, int, float]] = []
        for words, lo, hi in sentences(text):
            z = self.bias
            for w in set(words):
                known = self.words.get(w)
                z += self.word(w) if known is None else known
            p = 1 / (1 + math.exp(-z)) if z > -30 else 0.0
            log_clean += math.log1p(-min(p, 1 - 1e-12))
            if p >= OFFENDS:
                offending.append((lo, hi, p))
            if p > worst[0]:
                worst = (p, lo, hi)
        return -math.expm1(log_clean), worst[0], worst[1], worst[2], offending


def train(sample: list[tuple[str, int]]) -> NoisyOr:
    """Gradient descent with momentum on the class-balanced log loss of the noisy-or, and a soft threshold (L1).

    Only features whose document counts differ between the classes by ``SCREEN`` standard deviations take part.
    """
    y = np.array([label for _, label in sample], float)
    n = len(sample)
    df: dict[str, list[int]] = {}
    bags = []
    for (text, label), _ in zip(sample, y, strict=True):
        bag = [sorted({x for w in words for x in features(w)}) for words, _, _ in sentences(text)]
        bags.append(bag)
        for x in {x for words in bag for x in words}:
            df.setdefault(x, [0, 0])[label] += 1
    n1 = y.sum()
    n0 = n - n1
    number: dict[str, int] = {}
    for x, (a, b) in sorted(df.items()):
        share = (a + b) / n
        if a + b >= MIN_DOCS and abs(b / n1 - a / n0) >= SCREEN * (share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12) ** 0.5:
            number[x] = len(number)
    word, sent, doc = [], [], []
    for d, bag in enumerate(bags):
        for words in bag:
            ids = [number[w] for w in words if w in number]
            word += ids
            sent += [len(doc)] * len(ids)
            doc.append(d)
    word_a, sent_a, doc_a = (np.array(x, np.int32) for x in (word, sent, doc))
    m = len(number)
    weights, speed, bias, speed_bias = np.zeros(m), np.zeros(m), START_BIAS, 0.0
    per_class = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for _ in range(PASSES):
        z = np.bincount(sent_a, weights[word_a], len(doc)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(doc_a, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
        toxic = np.clip(-np.expm1(log_clean), 1e-9, 1.0)
        # d loss / d z of a sentence: p for a clean document, -p (1 - P) / P for a toxic one.
        dz = (np.where(y == 1, -(1 - toxic) / toxic, 1.0) * per_class)[doc_a] * p
        speed = 0.9 * speed - RATE * np.bincount(word_a, dz[sent_a], m)
        speed_bias = 0.9 * speed_bias - 0.1 * RATE * dz.sum()
        weights = weights + speed
        weights = np.sign(weights) * np.maximum(np.abs(weights) - RATE * L1, 0)
        bias = min(bias + speed_bias, HIGHEST_BIAS)
    return NoisyOr({w: float(weights[i]) for w, i in number.items() if weights[i]}, float(bias))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, the worst sentence's score and span, and all offending sentences, of every row of ``docs``."""
    sample = [(data.decode("utf-8", "replace"), y) for data, y in training_sample(docs, labels, label, folds, held, TRAIN_ROWS, TRAIN_BYTES)]
    kinds = {y for _, y in sample}
    constant = sum(y for _, y in sample) / len(sample) if sample else 0.0
    shared = docs.sparkSession.sparkContext.broadcast((train(sample) if len(kinds) == 2 else None, constant))
    schema = "doc_id long, score double, sentence_score double, sentence_start int, sentence_end int, offending array<struct<start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, constant = shared.value
        for doc_id, text in rows_of(batches):
            found = [net.document(t or "") if net else (constant, -1.0, -1, -1, []) for t in text]
            s, w, lo, hi, n = (list(x) for x in zip(*found, strict=True))
            none = [x < 0 for x in lo]
            cols = [pa.array(doc_id, pa.int64()), pa.array(s, pa.float64()), pa.array([None if z else x for x, z in zip(w, none, strict=True)], pa.float64())]
            cols += [pa.array([None if z else x for x, z in zip(v, none, strict=True)], pa.int32()) for v in (lo, hi)]
            cols.append(pa.array([[dict(zip(("start", "end", "score"), x, strict=True)) for x in some] for some in n], kind))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "sentence_score", "sentence_start", "sentence_end", "offending"])

    out = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentence_score", "sentence_start", "sentence_end", "offending")
