"""Sources of pages, the store, ingestion, tools, job control and streaming."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.operators.rerank import scorer_of
from quarry.operators.search import SearchService
from quarry.plans.ingest import Ingest
from quarry.plans.jobs import CRAWLS
from quarry.plans.models import ChatService, HashingEmbedder, OverlapScorer, complete_all, embedding, load_scorer
from quarry.plans.tools import Tools
from quarry.functions.markdown import to_markdown
from quarry.sources import pages as P
from quarry.sources import store as S
from quarry.sources.web import fetched_urls, web_pages
from quarry.streaming.ingest import arriving_pages, keep_ingesting

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")
CODE = "def quarry(stone):\n    return stone * 2\n" * 3


@pytest.fixture
def ingest(spark, tmp_path):
    return Ingest(S.Store(spark, str(tmp_path / "kb")), now(), HashingEmbedder(16), settings=Settings(use_agentic_rag=True))


@pytest.fixture
def pages(spark):
    rows = [("https://a.b/1", "# Stone\nGranite is hard. " * 3), ("https://a.b/2", f"Text\n```python\n{CODE}```\nmore"), ("https://c.d/1", "Slate splits."), ("https://c.d/2", "")]
    return spark.createDataFrame(rows, "url string, markdown string")


# --- sources ---


def test_sitemaps(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.b/1</loc></url><url><loc>https://a.b/2</loc></url></urlset>'
    df = spark.createDataFrame([(xml,), ("not xml",), (None,), ("<a/>",)], "x string")
    assert [r[0] for r in df.select(P.sitemap_urls(F.col("x"))).collect()] == [["https://a.b/1", "https://a.b/2"], [], [], []]


def test_batch_keeps_successes_with_text(spark):
    df = spark.createDataFrame([(True, "u1", "x"), (False, "u2", "y"), (True, "u3", ""), (True, "u4", None)], "success boolean, url string, markdown string")
    assert [r.url for r in P.batch(df).collect()] == ["u1"]


def test_fetching(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            found = self.path in ("/a", "/b.txt")
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/plain" if self.path.endswith(".txt") else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"<h1>Stone</h1><p>hard</p>" if found else b"")

        def log_message(self, *args):
            pass

    site = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=site.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{site.server_port}"
    try:
        got = {r.url: r for r in web_pages(spark, [f"{base}/a", f"{base}/b.txt", f"{base}/none"], 2).collect()}
    finally:
        site.shutdown()
    assert got[f"{base}/a"].markdown == "# Stone\n\nhard" and got[f"{base}/b.txt"].markdown.startswith("<h1>")
    assert got[f"{base}/none"].success is False and "404" in got[f"{base}/none"].error_message
    assert web_pages(spark, []).count() == 0


def test_batches_of_answers():
    class Many:
        def __init__(self, bad):
            self.bad, self.calls = bad, 0

        def complete_many(self, prompts):
            self.calls += 1
            if self.bad in prompts:
                raise RuntimeError
            return [p.upper() for p in prompts]

        def complete(self, prompt):
            if prompt == self.bad:
                raise RuntimeError
            return prompt + "!"

    model = Many("c")
    assert complete_all(model, list("abcde"), 2) == ["A", "B", None, "d!", "e!"] and model.calls == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("")
    assert [r.markdown for r in P.text_files(spark, str(tmp_path)).collect()] == ["one\ntwo\n"]


def test_markdown():
    html = "<html><head><style>x{}</style><script>y()</script></head><body><nav><ul><li>menu</li></ul></nav><h2>Head</h2><p>a <b>b</b> c</p><ul><li>one</li></ul><pre><code>x = 1\n  y</code></pre><p>use <code>z</code></p></body></html>"
    md = to_markdown(html)
    assert "## Head" in md and "a b c" in md and "- one" in md and "```\nx = 1\n  y\n```" in md and "use `z`" in md
    assert md.startswith("## Head") and "menu" not in md and "y()" not in md and to_markdown(None) == ""


def test_links_and_levels(spark):
    html = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [("https://a.b/1", html("/2", "https://a.b/3#top", "https://other.c/x", "mailto:m@a.b")), ("https://a.b/2", html("4", "1")), ("https://a.b/3", "text" + html()), ("https://a.b/4", html("/5"))]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert {(r.url[-1], r.link) for r in P.links(pages).filter("url like '%1'").collect()} == {("1", "https://a.b/2"), ("1", "https://a.b/3")}
    start = spark.createDataFrame([("https://a.b/1#frag",)], "url string")
    seen = {r.url: r.depth for r in P.reachable(P.links(pages), start, 3).collect()}
    assert seen == {"https://a.b/1": 1, "https://a.b/2": 2, "https://a.b/3": 2, "https://a.b/4": 3}
    assert {r.url for r in P.reachable(P.links(pages), start, 1).collect()} == {"https://a.b/1"}
    assert {r.url[-1] for r in P.recursive_crawl(pages, start, 2).collect()} == {"1", "2", "3"}


# --- store ---


def test_source_stats(spark):
    sources = spark.createDataFrame([("s", "about", 1000, None), ("t", None, None, None)], "source_id string, summary string, total_word_count int, updated_at timestamp").withColumn("created_at", now())
    chunks = spark.createDataFrame([(1, "u1", "s"), (2, "u2", "s"), (3, "u3", "s")], "id long, url string, source_id string")
    code = spark.createDataFrame([(1, "u1", "s"), (2, "u1", "s"), (3, "u2", "s")], "id long, url string, source_id string")
    got = {r.source_id: r for r in S.source_stats(sources, chunks, code).collect()}
    assert (got["s"].total_documents, got["s"].total_chunks, got["s"].total_code_examples, got["s"].code_example_rows, got["s"].word_count) == (3, 3, 2, 3, 1000)
    assert (got["t"].total_documents, got["t"].word_count) == (0, 0) and got["s"].last_updated is not None
    assert S.source_exists(sources, chunks, code, "none").count() == 0


def test_replace_by_url_twice_is_once(spark):
    old = spark.createDataFrame([("u1", "a"), ("u2", "b")], "url string, v string")
    new = spark.createDataFrame([("u1", "c"), ("u1", "d")], "url string, v string")
    once = S.replaced_by_url(old, new)
    twice = S.replaced_by_url(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("u1", "c"), ("u1", "d"), ("u2", "b")]


def test_sources_are_set_not_added(spark):
    old = spark.createDataFrame([("s", "old", 50)], "source_id string, summary string, total_word_count int").withColumns({"created_at": now(), "updated_at": now()})
    new = spark.createDataFrame([("s", "new", 200), ("t", "t", 1)], "source_id string, summary string, total_word_count int")
    got = {r.source_id: r for r in S.updated_sources(old, new, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert got["s"].total_word_count == 200 and got["s"].summary == "new" and got["s"].created_at.year == 2024 and got["s"].updated_at.year == 2025 and got["t"].created_at.year == 2025


def test_source_texts(spark):
    rows = [("s", f"u{i:03d}", "word " * 500) for i in range(20)] + [("t", "u", "")]
    got = {r.source_id: r for r in S.source_texts(spark.createDataFrame(rows, "source_id string, url string, markdown string")).collect()}
    assert got["s"].word_count == 10_000 and got["s"].text == "\n\n".join(["word " * 500] * 20)[:10_000] and got["t"].text == ""


def test_ingest(spark, ingest, pages):
    out = ingest.run(pages)
    assert out["urls_processed"] == 3 and out["total_chunks"] == 3 and out["code_examples"] == 1 and out["sources_updated"] == ["a.b", "c.d"]
    ingest.run(pages)  # again: nothing is doubled
    chunks = ingest.store.read("chunks")
    assert chunks.count() == 3 and S.duplicates(chunks).count() == 0
    first = chunks.filter("url = 'https://a.b/1'").select(F.try_variant_get("metadata", "$.chunk_index", "int"), F.try_variant_get("metadata", "$.headers", "string"), F.size("embedding"), "source_id").first()
    assert tuple(first) == (0, "# Stone", 16, "a.b")
    code = ingest.store.read("code_examples").first()
    assert code.content.startswith("```python\ndef quarry") and code.summary
    stats = {r.source_id: r for r in ingest.store.stats().collect()}
    assert stats["a.b"].total_chunks == 2 and stats["a.b"].total_code_examples == 1 and stats["a.b"].summary == "Content from a.b"


def test_ingest_with_a_model(spark, ingest, pages):
    class Says:  # in here, so that workers get it with the function
        def complete(self, prompt):
            if "Slate" in prompt or not prompt.startswith("/no_think"):
                raise RuntimeError("no")
            return " <think>well</think> About stone. "

    ingest.llm, ingest.settings = Says(), Settings(use_agentic_rag=True, use_contextual_embeddings=True, disable_thinking=True)
    ingest.run(pages)
    got = {r.source_id: r.summary for r in ingest.store.read("sources").collect()}
    assert got == {"a.b": "well About stone.", "c.d": "Content from c.d"}
    assert ingest.store.read("code_examples").first().summary == "well About stone."
    vectors = {r.url: r.embedding for r in ingest.store.read("chunks").collect()}
    alone = ingest.embedder.embed(["Slate splits."])[0]
    assert vectors["https://c.d/1"] == pytest.approx(alone, abs=1e-6)  # no context where the model failed


def test_answers_are_paid_once(spark, tmp_path, pages):
    """A page again, and a passage that many pages share, make no second call; a failed answer is asked for again."""
    from quarry.plans.answers import Answers

    log = tmp_path / "calls"
    log.mkdir()

    class Counting:  # in here, so that workers get it with the function
        dimension = 2

        def __init__(self, where):
            self.where = where

        def _note(self, text):
            import os
            import uuid

            with open(os.path.join(self.where, uuid.uuid4().hex), "w") as f:
                f.write(text)

        def embed(self, texts):
            for t in texts:
                self._note("e:" + t[:20])
            return [[1.0, float(len(t))] for t in texts]

        def complete(self, prompt):
            self._note("c:" + prompt[-20:])
            return None if "Slate" in prompt else "About stone."

    calls = lambda: sorted(f.read_text() for f in log.iterdir())
    model = Counting(str(log))
    store = S.Store(spark, str(tmp_path / "kb"))
    paid = Ingest(store, now(), model, model, Settings(use_agentic_rag=True), Answers(store))
    shared = spark.createDataFrame([(f"https://e.f/{i}", "The same passage.") for i in range(30)], "url string, markdown string")
    paid.run(pages.unionByName(shared))
    first = calls()
    assert first.count("e:The same passage.") == 1 and len(first) == len(set(first))
    plain = S.Store(spark, str(tmp_path / "plain"))
    Ingest(plain, now(), model, model, Settings(use_agentic_rag=True)).run(pages.unionByName(shared))
    columns = ["url", "chunk_number", "content", "embedding"]
    for name in ("chunks", "code_examples"):
        assert sorted(map(tuple, store.read(name).select(*columns).collect())) == sorted(map(tuple, plain.read(name).select(*columns).collect()))
    assert {r.source_id: r.summary for r in store.read("sources").collect()} == {r.source_id: r.summary for r in plain.read("sources").collect()}
    before = len(calls())
    paid.run(pages.unionByName(shared))
    assert len(calls()) - before == sum("Slate" in c or "splits" in c for c in first if c.startswith("c:"))
    assert not store.files.names(f"{store.root}/staged")


def test_replaced_page(spark, ingest):
    one = lambda t: spark.createDataFrame([("https://a.b/1", t)], "url string, markdown string")
    ingest.run(one("A" * 12_000))
    assert ingest.store.read("chunks").count() == 3
    ingest.run(one("short"))
    assert [r.content for r in ingest.store.read("chunks").collect()] == ["short"]
    assert ingest.store.read("sources").first().total_word_count == 1


def test_empty_ingest(spark, ingest, pages):
    out = ingest.run(pages.limit(0))
    assert out["total_chunks"] == 0 and ingest.store.read("chunks").count() == 0


def chunk_rows(spark, rows):
    """Chunks from (url, number, content)."""
    df = spark.createDataFrame(rows, "url string, chunk_number int, content string")
    return df.select(S.row_id(F.col("url"), F.col("chunk_number")).alias("id"), "url", "chunk_number", "content", F.parse_json(F.lit("{}")).alias("metadata"), F.split("url", "/")[0].alias("source_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"), now().alias("created_at"))


def test_an_upsert_writes_only_its_buckets(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "kb"), buckets=8, compacts=False)
    assert store.add_chunks(chunk_rows(spark, [(f"s/{i}", 1, f"stone {i}") for i in range(40)]), now()) == 40
    before = store.snapshot()
    assert store.add_chunks(chunk_rows(spark, [("s/7", 1, "new"), ("s/7", 2, "extra")]), now()) == 2
    after = store.snapshot()
    assert after.number == before.number + 1 and after.group("chunks")["parts"][:-1] == before.group("chunks")["parts"]
    assert len(after.group("chunks")["parts"][-1]["buckets"]) == 1
    got = {(r.url, r.chunk_number): r.content for r in store.read("chunks").collect()}
    assert len(got) == 41 and got["s/7", 1] == "new" and got["s/8", 1] == "stone 8"
    ids = {r.id for r in store.read("chunks").collect()}
    assert {r.id for r in store.read("chunk_postings").collect()} == ids and store.read("sources").count() == 1
    assert {r.content for r in before.read("chunks").filter("url = 's/7'").collect()} == {"stone 7"}
    assert store.add_chunks(chunk_rows(spark, [("s/7", 1, "x")]).limit(0), now()) == 0 and store.snapshot().number == after.number


def test_buckets_split_by_linear_hashing(spark):
    for n in range(1, 40):
        for at in (0, 1, 5, 17, 63, 1000, S.ADDRESSES - 1):
            assert 0 <= S.bucket_of(at, n) < n
            assert S.bucket_of(at, n + 1) in (S.bucket_of(at, n), n)
            if S.bucket_of(at, n + 1) == n:
                assert S.bucket_of(at, n) == S.parent(n)
    rows = spark.range(2000).select(S.address(F.col("id").cast("string")).alias("a"))
    for n in (1, 6, 8, 13):
        assert all(r.b == S.bucket_of(r.a, n) for r in rows.select("a", S.bucket(F.col("a"), n).alias("b")).collect())


def test_splits_and_compaction_keep_all_rows(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "kb"), buckets=1, bucket_bytes=4000, keep=1, keep_seconds=0, compacts=False)
    want = {f"s/{i}": f"stone {i} granite" for i in range(300)}
    store.add_chunks(chunk_rows(spark, [(u, 1, t) for u, t in want.items()]), now())
    for step in range(4):
        new = {f"s/{i}": f"slate {step} {i}" for i in range(step, 300, 9 + step)}
        want |= new
        store.add_chunks(chunk_rows(spark, [(u, 1, t) for u, t in new.items()]), now())
        if step % 2:
            store.compact("chunks", everything=step == 3)
        snap = store.snapshot()
        assert {r.url: r.content for r in snap.read("chunks").collect()} == want
        assert {r.url for r in snap.read("chunk_postings").filter("term = 'slate'").collect()} == {u for u, t in want.items() if "slate" in t}
        assert snap.counts("chunks").first().rows == 300 and snap.stats().first().total_documents == 300
    g = store.snapshot().group("chunks")
    assert g["n"] >= 4 and all(len(p) == 1 for p in store.snapshot().holders("chunks").values())
    at = {r.url: (r.id, r.address) for r in store.snapshot().read("chunks", addressed=True).collect()}
    assert {S.bucket_of(a, g["n"]) for _, a in at.values()} == set(store.snapshot().holders("chunks"))
    assert [r.content for r in store.snapshot().fetch("chunks", [at["s/3"]]).collect()] == [want["s/3"]]


def test_a_large_write_of_few_keys_is_compacted_by_itself(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "kb"), buckets=2)
    for i in range(3):
        store.add_chunks(chunk_rows(spark, [(f"s/{k}", 1, f"text {i}") for k in range(20)]), now())
    assert all(len(p) == 1 for p in store.snapshot().holders("chunks").values()) and store.read("chunks").filter("content = 'text 2'").count() == 20


def test_a_spread_upsert_writes_few_bytes(spark, tmp_path):
    """Of 2000 pages of random words 20 are replaced, some in every bucket: less than 3 % of the bytes are written."""
    import random

    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(400))
    store = S.Store(spark, str(tmp_path / "kb"), buckets=4)
    store.add_chunks(chunk_rows(spark, [(f"s/{i}", 1, text()) for i in range(2000)]), now())
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "kb").rglob("*.parquet"))
    before = size()
    store.add_chunks(chunk_rows(spark, [(f"s/{i}", 1, text()) for i in range(0, 2000, 100)]), now())
    assert len(store.snapshot().group("chunks")["parts"][-1]["buckets"]) == 4
    assert size() - before < 0.03 * before
    assert store.read("chunks").count() == 2000


def scanned_buckets(df):
    """The bucket folders that a plan's scans list."""
    import re

    return {x for x in re.findall(r"rows/bucket=(\d+)", "\n".join(df.inputFiles()))}


def test_winners_are_fetched_from_their_buckets(spark, tmp_path):
    from quarry.operators import search

    store = S.Store(spark, str(tmp_path / "kb"), buckets=32)
    rows = chunk_rows(spark, [(f"s/{i}", 1, f"granite {i} stone") for i in range(200)])
    rows = rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"), (F.xxhash64("url") % 100 / 100).cast("float")))
    store.add_chunks(rows, now())
    store.add_chunks(rows.filter("url IN ('s/3', 's/4')"), now())  # two buckets of two parts
    snap = store.snapshot()
    table, fetch = snap.read("chunks", addressed=True), lambda found: snap.fetch("chunks", found)
    plain = store.read("chunks")
    for got, want in (
        (search.match(table, [1.0, 0.5], 3, fetch=fetch), search.match(plain, [1.0, 0.5], 3)),
        (search.hybrid(table, [1.0, 0.5], "granite stone", 3, postings=snap.read("chunk_postings", addressed=True), fetch=fetch), search.hybrid(plain, [1.0, 0.5], "granite stone", 3, text_col="content")),
        (search.hybrid(table, [1.0, 0.5], "granite stone", 3, text_col="content", fetch=fetch), search.hybrid(plain, [1.0, 0.5], "granite stone", 3, text_col="content")),
    ):
        columns = [c for c in want.columns if c not in ("metadata", "address")]
        assert sorted(got.drop("metadata").columns) == sorted(columns)
        assert got.select(*columns).collect() == want.select(*columns).collect()
        assert 1 <= len(scanned_buckets(got)) <= 3
    assert snap.fetch("chunks", []).count() == 0 and search.match(table.limit(0), [1.0, 0.5], 3, fetch=fetch).count() == 0


def vector_rows(spark, vectors):
    """Chunks from {number of the URL: vector}."""
    rows = spark.createDataFrame([(f"s/{i}", 1, f"text {i}", v) for i, v in vectors.items()], "url string, chunk_number int, content string, embedding array<float>")
    return rows.select(S.row_id(F.col("url"), F.col("chunk_number")).alias("id"), "url", "chunk_number", "content", F.parse_json(F.lit("{}")).alias("metadata"), F.lit("s").alias("source_id"), "embedding", now().alias("created_at"))


def test_search_through_the_vector_index(spark, tmp_path):
    """Found through the index are nearly all that exact search finds: among rows there at first, added, replaced and compacted."""
    import numpy as np

    from quarry.operators import search

    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 18))
    make = lambda n, lo: {lo + i: (centres[i % 12] + 0.4 * r.normal(size=18)).tolist() for i in range(n)}
    store = S.Store(spark, str(tmp_path / "kb"), buckets=4)
    assert store.build_index("chunks") is False
    there = make(1500, 0)
    store.add_chunks(vector_rows(spark, there | {9999: None}), now())
    assert store.snapshot().nearest("chunks", there[0], 5) is None  # no index yet
    assert store.build_index("chunks") is True
    new = make(100, 1500) | {i: (-np.array(there[i])).tolist() for i in range(0, 60, 3)}
    store.add_chunks(vector_rows(spark, new), now())
    for step in range(2):
        snap = store.snapshot()
        rows = {x.id: x.url for x in snap.read("chunks").collect()}
        assert snap.live("chunks", "codes").count() == 1600 and len(rows) == 1601
        index = store.index("chunks", snap.group("chunks")["index"])
        assert index.lower.shape[0] * index.lower.shape[1] >= 38
        hits = total = 0
        for i in (0, 3, 7, 1501, 1555):
            query = (there | new)[i]
            exact = search.match(snap.read("chunks"), query, 10).collect()
            got = search.match(snap.read("chunks", addressed=True), query, 10, fetch=lambda few, s=snap: s.fetch("chunks", few), near=lambda v, n, s=snap: s.nearest("chunks", v, n)).collect()
            assert got[0].url == f"s/{i}" and [x.similarity for x in got] == sorted((x.similarity for x in got), reverse=True)
            hits, total = hits + len({x.id for x in exact} & {x.id for x in got}), total + 10
            batched = snap.nearest_batched("chunks", [(7, query)], 10).orderBy("rank").collect()
            assert [x.id for x in batched] == [x.id for x in got]
        assert hits >= 0.95 * total
        store.compact("chunks", everything=True)
    service = SearchService.of(store, embedder=HashingEmbedder(18))
    assert service.search_documents("text 7", 3, use_hybrid=True).count() == 3 and service.search_documents("x", 2, source="s").count() == 2
    copy = store.index("chunks", snap.group("chunks")["index"])
    again = type(copy).load(copy.dump())
    assert (again.centres == copy.centres).all() and again.probes == copy.probes


def test_vectors_without_clusters_are_found_through_the_index(spark, tmp_path):
    """Candidates are as many as it takes: among vectors far from each other ten codes a result are too few."""
    import numpy as np

    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 256))
    store = S.Store(spark, str(tmp_path / "kb"), buckets=2)
    store.add_chunks(vector_rows(spark, dict(enumerate(x.tolist()))), now())
    assert store.build_index("chunks") is True
    snap = store.snapshot()
    rows = snap.read("chunks").select("id", "url", "embedding")
    ids = {y.url: y.id for y in rows.select("id", "url").collect()}
    queries = [(i, x[i].tolist()) for i in range(0, 3000, 75)]
    got = {(y.query_id, y.id) for y in snap.nearest_batched("chunks", queries, 10).collect()}
    exact = np.argsort(-(x / np.linalg.norm(x, axis=1)[:, None]) @ (x[::75] / np.linalg.norm(x[::75], axis=1)[:, None]).T, axis=0)[:10]
    assert sum((i, ids[f"s/{j}"]) in got for (i, _), of in zip(queries, exact.T, strict=True) for j in of) >= 0.95 * 400


def test_metadata_is_found_in_its_buckets(spark, tmp_path):
    from quarry.operators import metadata_index as M

    values = ['{"k": %d, "tags": ["a", {"x": %d}], "n": null}' % (i % 40, i % 3) for i in range(120)]
    values[7] = '{"k": 7, "tags": [{"x": 5, "y": 1}, {"x": 6, "y": 2}], "odd key": true, "f": 1.5}'
    rows = spark.createDataFrame([(f"s/{i}", 1, f"text {i}", v) for i, v in enumerate(values)], "url string, chunk_number int, content string, m string")
    rows = rows.select(S.row_id(F.col("url"), F.col("chunk_number")).alias("id"), "url", "chunk_number", "content", F.parse_json("m").alias("metadata"), F.when(F.col("url") == "s/7", "t").otherwise("s").alias("source_id"), F.lit(None).cast("array<float>").alias("embedding"), now().alias("created_at"))
    store = S.Store(spark, str(tmp_path / "kb"), buckets=16, compacts=False)
    store.add_chunks(rows, now())
    store.add_chunks(rows.filter("url = 's/47'").withColumn("metadata", F.parse_json(F.lit('{"k": 99}'))), now())
    for step in range(2):
        snap = store.snapshot()
        urls = lambda wanted, source=None, s=snap: sorted(r.url for r in s.where("chunks", wanted, source).collect())
        assert urls({"k": 7}) == ["s/7", "s/87"] and urls({"k": 7.0}, "t") == ["s/7"] and urls({"k": 99}) == ["s/47"] and urls({"k": "7"}) == []
        assert urls({"tags": [{"x": 5, "y": 1}]}) == ["s/7"] and urls({"tags": [{"x": 5, "y": 2}]}) == []  # all leaves are there, in two elements
        assert urls({"odd key": True, "f": 1.5}) == ["s/7"] and len(urls({"n": None, "tags": ["a"]})) == 118 and len(urls({"tags": []})) == 119 and len(urls({})) == len(urls(None)) == 120
        assert len(scanned_buckets(snap.where("chunks", {"k": 7}))) <= 2 < len(scanned_buckets(snap.where("chunks", None)))
        store.compact("chunks", everything=True)
    assert M.leaves_of({"a": [1, 1.0, True, "1", None]}) == M.leaves_of({"a": [None, "1", True, 1]}) and len(M.leaves_of({"a": [1, True, "1", None]})) == 4


def test_a_reader_keeps_its_state(spark, tmp_path):
    """Rows and postings change together: a snapshot taken before a write ranks and fetches what it saw."""
    store = S.Store(spark, str(tmp_path / "kb"), buckets=2)
    store.add_chunks(chunk_rows(spark, [("s/1", 1, "granite")]), now())
    service = SearchService.of(store, embedder=HashingEmbedder(1))
    for i in range(4):
        store.add_chunks(chunk_rows(spark, [("s/1", 1, f"slate {i}")]), now())
    assert [r.content for r in service.search_documents("granite", use_hybrid=True).collect()] == ["granite"]
    assert [r.text_rank > 0 for r in SearchService.of(store, embedder=HashingEmbedder(1)).search_documents("slate", use_hybrid=True).collect()] == [True]


def test_statistics_read_no_chunk(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "kb"), buckets=2)
    store.MOST_STATS = 2
    for i in range(5):
        store.add_chunks(chunk_rows(spark, [(f"s/{k}", n, "text") for k in range(i + 1) for n in range(1, 3)] + [("t/1", 1, "x")]), now())
    store.add_chunks(chunk_rows(spark, [("s/0", 1, "one left")]), now())
    stats = store.stats()
    got = {r.source_id: (r.total_documents, r.total_chunks) for r in stats.collect()}
    want = {r.source_id: (r.total_documents, r.total_chunks) for r in S.source_stats(store.read("sources"), store.read("chunks"), store.read("code_examples")).collect()}
    assert got == want == {"s": (5, 9), "t": (1, 1)}
    assert not any("/chunks/" in f and "/stats/" not in f for f in stats.inputFiles()) and len(store.snapshot().group("chunks")["stats"]) <= 3


def test_stored_postings_rank_as_texts_do(spark, tmp_path):
    from quarry.operators import fts

    store = S.Store(spark, str(tmp_path / "kb"), buckets=4)
    texts = ["Granite stones lie in the quarry.", "A stone, the quarry: granite.", "quarrying of stone and granites", "slate", "", "granite granite stone far away from any quarry"]
    store.add_chunks(chunk_rows(spark, [(f"s/{i}", 1, t) for i, t in enumerate(texts)]), now())
    for query in ("granite stones", "the quarry stone", "slate", "the", "absent stone"):
        want = {r.id: r.text_rank for r in fts.rank(store.read("chunks"), query, "id", "content").collect()}
        assert {r.id: r.text_rank for r in fts.rank_stored(store.read("chunk_postings"), query).collect()} == pytest.approx(want)
    plan = fts.rank_stored(store.read("chunk_postings"), "granite")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters:")[1]


def test_a_failed_write_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = S.Store(spark, str(tmp_path / "kb"), buckets=4)
    store.add_chunks(chunk_rows(spark, [("s/1", 1, "first")]), now())
    monkeypatch.setattr(S.Store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("power cut")))
    with pytest.raises(RuntimeError, match="power cut"):
        store.add_chunks(chunk_rows(spark, [("s/1", 1, "second"), ("s/2", 1, "other")]), now())
    monkeypatch.undo()
    assert [r.content for r in S.Store(spark, str(tmp_path / "kb")).read("chunks").collect()] == ["first"]
    parts = lambda: {d.name for d in (tmp_path / "kb" / "chunks").iterdir()}
    before = parts()
    store.vacuum()
    assert parts() == {p["id"] for p in store.snapshot().group("chunks")["parts"]} < before and [r.content for r in store.read("chunks").collect()] == ["first"]
    store.add_chunks(chunk_rows(spark, [("s/1", 1, "third")]), now())
    assert [r.content for r in store.read("chunks").collect()] == ["third"]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    store, other = (S.Store(spark, str(tmp_path / "kb"), buckets=1) for _ in range(2))
    commit, late = S.Store._commit, []

    def second_comes_first(self, number, groups):
        if self is store and not late:
            late.append(other.add_chunks(chunk_rows(spark, [("s/2", 1, "two"), ("s/3", 1, "three")]), now()))
        return commit(self, number, groups)

    monkeypatch.setattr(S.Store, "_commit", second_comes_first)
    store.add_chunks(chunk_rows(spark, [("s/1", 1, "one"), ("s/3", 1, "later three")]), now())
    assert {r.content for r in store.read("chunks").collect()} == {"one", "two", "later three"} and late == [2]


def test_old_versions_go(spark, tmp_path):
    import os

    store = S.Store(spark, str(tmp_path / "kb"), buckets=2, keep=2, keep_seconds=0)
    for i in range(5):
        store.add_chunks(chunk_rows(spark, [("s/1", 1, f"text {i}")]), now())
    kept = sorted(n for n in os.listdir(tmp_path / "kb" / "manifests") if n[0] != ".")
    assert len(kept) == 2 and int(kept[-1]) == store.snapshot().number
    assert [r.content for r in store.read("chunks").collect()] == ["text 4"]
    named = {p["id"] for n in kept for p in json.loads((tmp_path / "kb" / "manifests" / n).read_text())["groups"]["chunks"]["parts"]}
    stats = {p for n in kept for p in json.loads((tmp_path / "kb" / "manifests" / n).read_text())["groups"]["chunks"]["stats"]}
    assert {d.name for d in (tmp_path / "kb" / "chunks").iterdir()} == named | stats


def test_young_versions_stay(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "kb"), buckets=2, keep=1)
    store.add_chunks(chunk_rows(spark, [("s/1", 1, "first")]), now())
    first = store.snapshot()
    for i in range(4):
        store.add_chunks(chunk_rows(spark, [("s/1", 1, f"text {i}")]), now())
    assert [r.content for r in first.read("chunks").collect()] == ["first"]


def test_metadata_keeps_its_types(spark):
    from quarry.operators import filters

    rows = [(1, '{"chunk_index": 1, "tags": ["a"], "nested": {"k": 2}, "language": "old", "x": null, "y": 1.5, "z": true}'), (2, None), (3, "[1]"), (4, "{}"), (5, '{"q\\"uote": "v\\\\"}')]
    df = spark.createDataFrame(rows, "id int, m string").select("id", F.parse_json("m").alias("metadata"), F.lit("```sql\nselect\n```").alias("content"))
    out = S.with_fence_language(df)
    got = {r.id: json.loads(r.m) for r in out.select("id", F.to_json("metadata").alias("m")).collect()}
    assert got[1] == {"chunk_index": 1, "tags": ["a"], "nested": {"k": 2}, "language": "sql", "x": None, "y": 1.5, "z": True}
    assert got[2] == got[3] == got[4] == {"language": "sql"} and got[5] == {'q"uote': "v\\", "language": "sql"}
    for wanted in ({"chunk_index": 1}, {"nested": {"k": 2}}, {"tags": ["a"]}, {"language": "sql", "z": True}):
        assert filters.where_metadata(out, wanted).filter("id = 1").count() == 1


# --- tools ---


@pytest.fixture
def tools(spark, ingest, pages):
    settings = Settings(use_agentic_rag=True, use_reranking=True)

    def fetch(urls, max_concurrent):
        return urls.join(pages, "url", "left").select(F.col("markdown").isNotNull().alias("success"), "url", F.lit(None).cast("string").alias("html"), "markdown")

    def service():
        return SearchService.of(ingest.store, embedder=ingest.embedder, scorer=OverlapScorer(), settings=settings)

    return Tools(spark, ingest, service, fetch, settings=settings)


def test_tools(tools):
    one = json.loads(tools.crawl_single_page("https://a.b/1"))
    assert one["chunks_created"] == 1 and one["source_id"] == "a.b" and one["crawl_type"] == "single_page" and one["crawl_id"]
    none = json.loads(tools.crawl_single_page("https://no.where/"))
    assert none["success"] is False and none["url"] == "https://no.where/" and none["crawl_id"]
    known = json.loads(tools.smart_crawl_url("https://a.b/2"))
    assert known["already_exists"] and known["success"] is False and known["existing_stats"]["total_chunks"] == 1 and known["source_id"] == "a.b"
    again = json.loads(tools.smart_crawl_url("https://a.b/2", force_recrawl=True))
    assert (again["total_code_examples"], again["urls_processed"], again["urls_failed"], again["sources_updated"], again["force_recrawl"]) == (1, 1, 0, ["a.b"], True)
    assert json.loads(tools.smart_crawl_url("https://a.b/2", max_depth=99))["success"] is False
    sources = json.loads(tools.get_available_sources())
    assert sources["total_sources"] == 1 and sources["sources"][0]["source"] == "a.b" and sources["sources"][0]["last_updated"].startswith("2024-01-01")
    found = json.loads(tools.perform_rag_query("granite is hard.", match_count=3))
    assert found["success"] and found["search_type"] == "semantic" and found["total_results"] == len(found["results"]) and all(r["similarity_score"] >= 0.5 for r in found["results"])
    code = json.loads(tools.search_code_examples("quarry stone", match_count=1))
    assert code["total_results"] <= 1 and code["success"]
    refused = json.loads(tools.perform_rag_query(""))
    assert refused["success"] is False and refused["results"] == [] and refused["query"] == ""
    gone = json.loads(tools.cancel_crawl("none"))
    assert gone["success"] is False and gone["crawl_id"] == "none" and json.loads(tools.get_active_crawls())["total_active"] == 0 and json.loads(tools.cancel_all_crawls())["cancelled_count"] == 0


def test_hybrid_tool_reads_postings(tools):
    tools.crawl_single_page("https://a.b/1")
    tools.settings = Settings(use_hybrid_search=True, semantic_threshold=0.0)
    tools.service = lambda: SearchService.of(tools.ingest.store, embedder=tools.ingest.embedder, settings=tools.settings)
    found = json.loads(tools.perform_rag_query("granites hardness?"))
    assert found["success"] and found["search_type"] == "hybrid" and found["results"][0]["url"] == "https://a.b/1"


class Site:
    """A small web site on a port of its own."""

    def __init__(self, files):
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        asked = self.asked = []

        class Answers(BaseHTTPRequestHandler):
            def do_GET(self):
                asked.append(self.path)
                body = files.get(self.path)
                self.send_response(200 if body is not None else 404)
                self.send_header("Content-Type", "text/xml" if self.path.endswith(".xml") else "text/html; charset=utf-8")
                self.end_headers()
                self.wfile.write((body or "").replace("BASE", f"http://{self.headers['Host']}").encode())

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                asked.append((self.path, body, self.headers.get("Authorization")))
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps(files[self.path](body)).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
        self.base = f"http://127.0.0.1:{self.server.server_port}"

    def __enter__(self):
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_):
        self.server.shutdown()
        self.server.server_close()


def page(text, *links):
    return f"<h1>{text}</h1><p>{text} is a stone.</p>" + "".join(f'<a href="{x}">x</a>' for x in links)


def test_crawling_follows_links_over_the_web(spark, ingest):
    files = {"/": page("Granite", "/a", "/b#top", "/gone", "https://other.invalid/"), "/a": page("Slate", "/", "/c"), "/b": page("Marble"), "/c": page("Basalt", "/d"), "/d": page("Tuff")}
    files["/map/sitemap.xml"] = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>BASE/a</loc></url><url><loc>BASE/none</loc></url></urlset>'
    tools = Tools(spark, ingest, settings=Settings())
    with Site(files) as site:
        out = json.loads(tools.smart_crawl_url(f"{site.base}/#start", max_depth=3, max_concurrent=2))
        assert (out["urls_processed"], out["urls_failed"], out["crawl_type"]) == (4, 1, "webpage"), out
        assert sorted(site.asked) == ["/", "/a", "/b", "/c", "/gone"]  # each once, and nothing below the third level
        out = json.loads(tools.smart_crawl_url(f"{site.base}/", max_depth=1, force_recrawl=True))
        assert (out["urls_processed"], out["urls_failed"]) == (1, 0) and "forced" in out["message"]
        out = json.loads(tools.smart_crawl_url(f"{site.base}/map/sitemap.xml", force_recrawl=True))
        assert (out["urls_processed"], out["urls_failed"], out["crawl_type"]) == (1, 1, "sitemap")
    urls = {r.url.rsplit("/", 1)[-1] for r in ingest.store.read("chunks").collect()}
    assert urls == {"", "a", "b", "c"}


def test_requests_to_a_host_keep_their_distance(spark):
    with Site({f"/{i}": page("Tuff") for i in range(4)}) as site:
        urls = spark.createDataFrame([(f"{site.base}/{i}",) for i in range(4)], "url string")
        began = time.time()
        got = fetched_urls(urls, 3, per_host=1, delay=0.5).collect()
        assert time.time() - began >= 1.5 and len(got) == 4 and all(r.success for r in got) and len(site.asked) == 4


def test_a_failed_crawl_goes_on_when_asked_again(spark, ingest):
    files = {"/": page("Granite", "/a"), "/a": page("Slate")}
    with Site(files) as site:

        def fetch(urls, n):
            if site.asked and fetch.fails:
                raise OSError("no executor left")
            return fetched_urls(urls, n)

        fetch.fails, tools = True, Tools(spark, ingest, fetch=fetch, settings=Settings())
        assert json.loads(tools.smart_crawl_url(f"{site.base}/"))["success"] is False and site.asked == ["/"]
        fetch.fails = False
        out = json.loads(tools.smart_crawl_url(f"{site.base}/"))
        assert out["urls_processed"] == 2 and site.asked == ["/", "/a"]
        assert not ingest.store.files.names(f"{ingest.store.root}/crawls")


def test_a_cancelled_crawl_stops_between_levels(spark):
    pages = spark.createDataFrame([(True, "https://a.b/1", '<a href="/2">x</a>', "one"), (True, "https://a.b/2", "", "two")], "success boolean, url string, html string, markdown string")
    fetched = []

    def fetch(urls):
        fetched.append(sorted(r.url for r in urls.collect()))
        return pages.join(urls, "url")

    start = spark.createDataFrame([("https://a.b/1",)], "url string")
    assert {(r.url[-1], r.depth) for r in P.crawl_levels(fetch, start, 5).collect()} == {("1", 1), ("2", 2)} and fetched == [["https://a.b/1"], ["https://a.b/2"]]
    with pytest.raises(RuntimeError, match="cancelled"):
        P.crawl_levels(fetch, start, 5, stopped=lambda: len(fetched) == 3)


def test_services(spark):
    files = {
        "/v1/embeddings": lambda q: {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(q["input"])))]},
        "/v1/chat/completions": lambda q: {"choices": [{"message": {"content": q["messages"][0]["content"].upper()}}]},
        "/rerank": lambda q: [{"index": i, "score": len(t)} for i, t in reversed(list(enumerate(q["texts"])))],
    }
    with Site(files) as site:
        service = ChatService(f"{site.base}/v1", "e", "c", key="k", dimension=2)
        df = spark.createDataFrame([("a",), ("bcd",)], "t string")
        assert sorted(tuple(r[0]) for r in df.select(embedding(F.col("t"), service)).collect()) == [(1.0, 1.0), (3.0, 1.0)]
        assert complete_all(service, ["x", "y", "z"], 2) == ["X", "Y", "Z"]
        assert load_scorer(f"{site.base}/rerank").predict([("q", "aa"), ("r", "b"), ("q", "ccc")]) == [2.0, 1.0, 3.0]
        assert site.asked[0][2] == "Bearer k" and site.asked[0][1]["dimensions"] == 2
        settings = Settings(use_reranking=True, reranker_paths=("/no/such/folder", f"{site.base}/rerank"))
        assert scorer_of(settings).predict([("q", "four")]) == [4.0] and scorer_of(Settings()) is None
        assert scorer_of(Settings(use_reranking=True, reranker_paths=("/no/such/folder",))) is None
    with pytest.raises(Exception):
        service.complete("gone")


def test_code_tool_needs_its_flag(tools):
    tools.settings = Settings()
    assert "disabled" in json.loads(tools.search_code_examples("x"))["error"]


def test_cancelling_interrupts_the_job(spark):
    crawl = CRAWLS.start(spark, ["https://a.b"], "webpage")
    assert CRAWLS.active()[crawl.crawl_id]["url_count"] == 1 and not CRAWLS.is_cancelled(crawl.crawl_id)
    timer = threading.Timer(1.5, lambda: CRAWLS.cancel(spark, crawl.crawl_id))
    timer.start()
    began = time.time()
    try:
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(4, numPartitions=4).select(F.udf(lambda x: time.sleep(20) or x, "long")("id")).collect()
    finally:
        timer.join()
        CRAWLS.finish(spark, crawl.crawl_id)
    assert time.time() - began < 15 and CRAWLS.active() == {} and CRAWLS.is_cancelled(crawl.crawl_id)


def test_stream_of_pages(spark, ingest, pages, tmp_path):
    where, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    pages.coalesce(1).write.parquet(where)
    for _ in range(2):
        keep_ingesting(arriving_pages(spark, where), ingest, mark, available_now=True).awaitTermination(120)
    assert ingest.store.read("chunks").count() == 3
    spark.createDataFrame([("https://a.b/1", "new text")], "url string, markdown string").coalesce(1).write.mode("append").parquet(where)
    keep_ingesting(arriving_pages(spark, where), ingest, mark, available_now=True).awaitTermination(120)
    assert {r.content for r in ingest.store.read("chunks").filter("url = 'https://a.b/1'").collect()} == {"new text"}
