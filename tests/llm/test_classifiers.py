"""Quality and toxicity: held-out accuracy, and defined results in the odd cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from quarry.llm import quality_cnn as Q
from quarry.llm import toxicity_mil as M
from tests.llm.conftest import words


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def judged(spark, make):
    r = random.Random(1)
    rows, labels = {}, []
    for i in range(400):
        text = ". ".join(words(r, 12) for _ in range(r.randint(2, 12)))
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            parts = text.split(". ")
            parts[r.randrange(len(parts))] += " " + r.choice(["scoundrel", "blockhead", "nitwit"])
            text = ". ".join(parts)
        if bad:
            text = " ".join(w + r.choice(["$$$", "###", "%%%"]) for w in text.split())
        rows[i] = text
        if i % 8 != 7:
            labels.append((i, int(not bad), int(toxic)))
    docs = make(rows)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (int(i % 4 != 0), int(i % 5 == 0)) for i in rows}


def test_quality_on_held_out_rows(judged):
    docs, labels, truth = judged
    got = {r.doc_id: r for r in Q.score(docs, labels).collect()}
    assert len(got) == 400 and all(r.held_out == (fold(i, 4) == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == truth[i][0] for i in held]) > 0.9


def test_toxicity_on_held_out_rows(judged):
    docs, labels, truth = judged
    got = {r.doc_id: r for r in M.score(docs, labels).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert all(r.held_out == (fold(i, 5) == 0) for i, r in got.items())
    assert np.mean([got[i].predicted == truth[i][1] for i in held]) > 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in held:
        if truth[i][1] and got[i].predicted:
            sentence = texts[i][got[i].sentence_start : got[i].sentence_end]
            assert any(w in sentence for w in ("scoundrel", "blockhead", "nitwit"))


def test_labels_of_the_held_out_fold_teach_nothing(spark, judged):
    docs, labels, _ = judged
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a = {r.doc_id: r.score for r in Q.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in Q.score(docs, flipped).collect()}
    assert a == b


@pytest.mark.parametrize("score", [Q.score, M.score])
def test_odd_rows(spark, make, judged, score):
    docs, labels, _ = judged
    odd = make([(1000, None), (1001, ""), (1002, "x" * 200_000), (1003, "a b"), (1003, "a b"), (None, "text")]).withColumnRenamed("lang", "score").withColumnRenamed("source", "held_out")
    both = docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "held_out").unionByName(odd)
    got = score(both, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 406 and by[1000].score == by[1001].score and len([r for r in got if r.doc_id == 1003]) == 2 and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(("score", "kind"), [(Q.score, "quality"), (M.score, "toxic")])
def test_no_labels_or_no_documents(spark, make, score, kind):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(make({}), none).count() == 0
    assert [r.score for r in score(make({1: "a"}), none).collect()] == [0.5 if kind == "quality" else 0.0]
    assert [r.score for r in score(make({1: "a"}), one).collect()] == [1.0]


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        data = bytes(i % 251 + 1 for i in range(n))
        rows = Q.chunks_of(data)
        step = Q.CHUNK - Q.OVERLAP
        assert b"".join(bytes(r[:step]) for r in rows[:-1]) + bytes(rows[-1]) == data.ljust(len(rows) * step + Q.OVERLAP, b" ")
        assert (len(rows) - 1) * step + Q.CHUNK >= n


def test_tables_of_pairs_give_the_same_as_the_filters():
    net = Q.ByteCNN.start()
    rows = np.random.default_rng(0).integers(0, 256, (3, Q.CHUNK)).astype(np.uint8)
    fast = Q._filtered(net.pairs(), rows)
    for place in (0, 7, fast.shape[1] - 1):
        slow = sum(net.table[i][rows[:, 2 * place + i]] for i in range(Q.WIDTH))
        assert np.allclose(fast[:, place], slow, atol=1e-4)


def test_the_sample_is_bounded_by_bytes_and_whole(spark, make):
    docs = make([(1, "a" * 400), (1, "a" * 500), (2, "b" * 900), (3, "c" * 300), (4, None), (5, "e" * 100), (6, "ü" * 50)])
    labels = spark.createDataFrame([(i, int(i > 3), 0) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    ids = [i for i in range(1, 7) if fold(i, 4) != 2]
    whole = {1: b"a" * 400, 2: b"b" * 900, 3: b"c" * 300, 4: b"", 5: b"e" * 100, 6: "ü".encode() * 50}
    got = Q.training_sample(docs, labels, "quality", 4, 2, 100, 1 << 20)
    assert got == [(whole[i], int(i > 3)) for i in ids]
    assert sum(len(t) for t, y in Q.training_sample(docs, labels, "quality", 4, 2, 100, 800) if y == 0) <= 400
    assert len(Q.training_sample(docs, labels, "quality", 4, 2, 2, 1 << 20)) == 2
    assert Q.within([(3, 30, 5), (1, 10, 4), (2, 20, 9), (4, 40, 1)], 10) == {10, 30, 40}


def plain_score(net, data):
    """The network's probability of a document, one place and chunk at a time."""
    step = Q.CHUNK - Q.OVERLAP
    pooled = []
    for lo in range(0, max(1, len(data) - Q.OVERLAP), step):
        chunk = data[lo : lo + Q.CHUNK].ljust(Q.CHUNK, b" ")
        places = [sum(net.table[i][chunk[p + i]] for i in range(Q.WIDTH)) for p in range(0, Q.CHUNK - Q.WIDTH + 1, 2)]
        pooled.append(np.maximum(np.max(places, axis=0) + net.bias, 0))
    x = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    z = np.maximum(x @ net.w1 + net.b1, 0) @ net.w2 + net.b2[0]
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_the_network(judged):
    docs, labels, _ = judged
    net, _ = Q.fit(docs, labels)
    got = {r.doc_id: r.score for r in Q.score(docs, labels).collect()}
    for r in docs.filter("doc_id % 40 = 3").collect():
        assert got[r.doc_id] == pytest.approx(plain_score(net, r.text.encode()), abs=1e-4)


def test_toxic_scores_are_noisy_or(judged):
    docs, labels, _ = judged
    found = {r.doc_id: r for r in M.score(docs, labels).collect()}
    sample = Q.training_sample(docs, labels, "toxic", 5, 0, M.TRAIN_ROWS, M.TRAIN_BYTES)
    net = M.train([(t.decode(), y) for t, y in sample])
    for r in docs.collect():
        parts = []
        for words_, lo, hi in M.sentences(r.text):
            z = net.bias + sum(sum(net.weights.get(x, 0.0) for x in set(M.features(w))) for w in set(words_))
            parts.append((lo, hi, 1 / (1 + np.exp(-z))))
        got = found[r.doc_id]
        assert got.score == pytest.approx(1 - np.prod([1 - p for *_, p in parts]), abs=1e-9)
        assert [(x.start, x.end) for x in got.offending] == [(lo, hi) for lo, hi, p in parts if p >= 0.5]
        assert got.sentence_score == pytest.approx(max(p for *_, p in parts))


def test_gradients_by_differences():
    r = np.random.default_rng(1)
    net = Q.ByteCNN.start(3)
    rows, doc, y, w = r.integers(97, 105, (5, Q.CHUNK)).astype(np.uint8), np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        out = []
        for d in range(3):
            best = np.maximum(Q._filtered(net.pairs(), rows[doc == d]).max(1) + net.bias, 0)
            out.append(net.dense(np.concatenate([best.mean(0), best.max(0)]).astype(np.float32)))
        p = np.array(out, float)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grads = Q._gradients(net, rows, doc, 3, y, w)
    for part, grad in zip(net.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        eps, was = 1e-2, part[at]
        part[at] = was + eps
        up = loss()
        part[at] = was - eps
        down = loss()
        part[at] = was
        assert (up - down) / (2 * eps) == pytest.approx(grad[at], rel=0.15, abs=2e-3)


def test_noisy_or():
    m = M.NoisyOr({"bad": 6.0}, -4.0)
    p = 1 / (1 + np.exp(4.0))
    total, worst, lo, hi, n = m.document("fine words. so bad here! end")
    bad = 1 / (1 + np.exp(-2.0))
    assert total == pytest.approx(1 - (1 - p) ** 2 * (1 - bad)) and worst == pytest.approx(bad) and n == [(lo, hi, pytest.approx(bad))]
    text = "so bad here. fine words! bad"
    assert [text[a:b] for a, b, _ in m.document(text)[4]] == ["so bad here", "bad"]
    assert "fine words. so bad here! end"[lo:hi] == "so bad here"
    assert m.document("") == (0.0, -1.0, -1, -1, [])
    assert len(list(M.sentences("w " * 200))) == 4
