"""The pipeline against a plain version, and each stage on odd tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm import decontaminate
from quarry.llm import quality_cnn as Q
from tests.llm.conftest import words
from tests.llm.test_exact import plain_distance, plain_jaccard, plain_removal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, make, tmp_path_factory):
    r = random.Random(21)
    rows: dict[int, str | None] = {i: ". ".join(words(r, 12) for _ in range(r.randint(3, 12))) for i in range(160)}
    passage, items = words(r, 60), {k: words(r, 30) for k in range(5)}
    for i in range(0, 160, 4):
        rows[i] = " ".join(w + r.choice(["$$$", "###", "%%%"]) for w in rows[i].split())  # junk
    for i in (5, 50, 101):
        rows[i] += " " + passage
    for i, k in ((7, 0), (33, 1), (77, 2)):
        rows[i] += "\n" + items[k] + "."
    for i in range(200, 215):
        w = rows[i - 199].split()
        if i % 2:
            w[len(w) // 2] = "edited"
        rows[i] = " ".join(w)
    rows |= {300: None, 301: "", 302: " "}
    path = tmp_path_factory.mktemp("tables")
    labels = [(i, int(i % 4 != 0), 0) for i in range(160) if i % 5]
    make(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def plain_pipeline(spark, path, rows, items):
    """What each stage leaves: {id: text} of the first four."""
    net, _ = Q.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    pairs = net.pairs()
    rows = {i: t for i, t in rows.items() if net.dense(Q._pool(net, pairs, [(t or "").encode()]))[0] >= 0.7}
    yield rows
    group = {i: i for i in rows}
    order = sorted(rows)
    for a in order:
        for b in order:
            if b < a:
                j = plain_jaccard(rows[a], rows[b])
                assert not 0.5 < j < 0.8  # nothing here is near the threshold
                if j >= 0.8:
                    old, new = max(group[a], group[b]), min(group[a], group[b])
                    group = {i: new if g == old else g for i, g in group.items()}
    rows = {i: t for i, t in rows.items() if group[i] == i}
    yield rows
    kept = plain_removal(list(rows.items()))
    yield {i: kept[i] for i in rows}
    yield {i: t for i, t in rows.items() if not any(plain_distance(decontaminate.folded(x)[1:-1], decontaminate.folded(t)) <= int((len(decontaminate.folded(x)) - 2) * decontaminate.RATE) for x in items.values())}


def test_pipeline(spark, tables):
    import hashlib

    from quarry.llm.common import stored

    path, rows, items = tables
    want = list(plain_pipeline(spark, path, rows, items))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = []
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, path), "test")
        assert docs.columns == COLUMNS, name
        left.append({r.doc_id: r.text for r in docs.collect()})
    assert left[0].keys() == want[0].keys() and left[1].keys() == want[1].keys() and left[3].keys() == want[3].keys()
    assert np.mean([i % 4 != 0 for i in left[0] if i < 160]) > 0.95 and len([i for i in left[0] if i < 160]) > 110
    assert not [i for i in left[1] if 200 <= i < 215 and i - 199 in left[0]] and not left[3].keys() & {7, 33, 77}
    for i, (_, removed, sha) in want[2].items():
        if removed:
            assert hashlib.sha256((left[2][i] or "").encode()).hexdigest() == sha
        else:
            assert left[2][i] == left[1][i]
    pieces = P.run(spark, path).collect()
    assert {r.doc_id for r in pieces} == want[3].keys()
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.length > 0
    assert all(total[r.doc_id] == r.doc_tokens for r in pieces)


@pytest.mark.parametrize(("name", "stage"), P.STAGES)
def test_stages_on_odd_tables(spark, make, tables, name, stage):
    path = tables[0]
    text = " ".join(f"word{i}" for i in range(40))
    odd = make([(1, None), (None, None), (None, text), (2, ""), (3, "x" * 300_000), (4, text), (4, text), (5, text + " tail"), (6, " \n")])
    extra = {c: F.lit(1) for c in ("_row", "node", "_gone", "_firsts", "_windows", "fp", "n", "score", "keeps")}
    out = stage(spark, odd.withColumns(extra), path)
    rows = out.collect()
    if name != "packing":
        assert out.columns == [*COLUMNS, *extra] and all(r["_row"] == 1 and r["_firsts"] == 1 for r in rows)
    assert stage(spark, odd.limit(0), path).count() == 0
