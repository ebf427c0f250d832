"""Vectors, full text, fusion, diversification, reranking and the search service."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import CrawlRequest, SearchRequest, Settings
from quarry.functions import vector as V
from quarry.operators import diversify, filters, fts, ivf, rerank, search
from quarry.plans.models import HashingEmbedder, OverlapScorer, embed_all


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "https://a.b/1", "alpha beta gamma", '{"category":"tutorial","level":"beginner","n":1,"tags":["x","y"]}', "a.b", [0.9, 0.1, 0.1]),
        (2, "https://a.b/2", "alpha gamma beta alpha", '{"category":"tutorial","level":"expert","n":1.0,"o":{"p":{"q":true}}}', "a.b", [0.8, 0.3, 0.1]),
        (3, "https://c.d/1", "beta only", '{"category":"api","n":"1","content_type":"api"}', "c.d", [0.1, 0.9, 0.1]),
        (4, "https://c.d/2", "", "{}", "c.d", [0.0, 0.0, 0.0]),
        (5, "https://c.d/3", "the alpha of the beta", "{}", "c.d", None),
    ]
    df = spark.createDataFrame(rows, "id long, url string, content string, m string, source_id string, embedding array<float>")
    return df.withColumns({"metadata": F.parse_json("m"), "chunk_number": F.lit(1)}).drop("m").cache()


def test_topk_order_and_rows_without_similarity(chunks):
    got = V.topk(chunks, [1, 0, 0], 5).collect()
    assert [r.id for r in got] == [1, 2, 3, 4, 5]
    assert got[0].similarity > got[1].similarity > got[2].similarity and got[3].similarity is None and got[4].similarity is None


def test_similarity_bounds(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    s = {r.id: r.similarity for r in V.topk(df, [1, 0], 3).collect()}
    assert s[1] > 0.99 and s[2] > 0.92 and s[3] < 0.2


def test_batched_equals_single(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 8)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(3)
    got = {(a.query_id, a["rank"]): a.id for a in V.topk_batched(df, [(i, x[i]) for i in (0, 7, 9)], 5).collect()}
    for q in (0, 7, 9):
        assert [got[q, k] for k in range(1, 6)] == [a.id for a in V.topk(df, x[q].tolist(), 5).collect()]


def test_ivf_recall(spark, tmp_path):
    r = np.random.default_rng(1)
    x = (r.normal(size=(40, 16))[r.integers(0, 40, 2000)] + 0.3 * r.normal(size=(2000, 16))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    queries = [(i, x[i].tolist()) for i in range(0, 2000, 50)]
    sample = ivf.sample(df)
    centres = ivf.fit(sample, 32)
    probes = ivf.probes_for(sample, centres)
    assert probes <= 8  # vectors in clusters need few of them
    ivf.write(ivf.assign(df.unionByName(spark.createDataFrame([(5000, None), (5001, [0.0] * 16)], df.schema)), centres), str(tmp_path / "index"))
    index = ivf.read(spark, str(tmp_path / "index"))
    assert index.count() == 2002
    found = {(a.query_id, a.id) for a in ivf.topk_batched(index, centres, queries, 10, probes).collect()}
    exact = {(a.query_id, a.id) for a in V.topk_batched(df, queries, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    everything = {(a.query_id, a.id, a["rank"]) for a in ivf.topk_batched(index, centres, queries, 10, 32).collect()}
    assert everything == {(a.query_id, a.id, a["rank"]) for a in V.topk_batched(df, queries, 10).collect()}
    plan = ivf.topk(index, centres, queries[0][1], 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters:")[1]
    assert ivf.fit(ivf.sample(df.limit(0)), 4).size == 0 and ivf.topk_batched(index, centres, [], 5).count() == 0


def test_metadata_containment(chunks):
    ids = lambda w, s=None: {r.id for r in filters.where_metadata(chunks, w, s).collect()}
    assert ids({"category": "tutorial"}) == {1, 2} and ids({"category": "tutorial", "level": "beginner"}) == {1}
    assert ids({}) == {1, 2, 3, 4, 5} == ids(None) and ids({}, "c.d") == {3, 4, 5}
    assert ids({"n": 1}) == {1, 2} and ids({"n": "1"}) == {3}
    assert ids({"tags": ["y"]}) == {1} and ids({"o": {"p": {"q": True}}}) == {2} and ids({"o": {}}) == {2} and ids({"o": {"p": 1}}) == set()


def test_language_filter_leaves_its_argument():
    mine = {"a": 1}
    assert filters.with_language(mine, "sql") == {"a": 1, "language": "sql"} and mine == {"a": 1} and filters.with_language(None, None) == {}


def test_full_text(chunks):
    ids = lambda q: {r.id for r in fts.match(chunks, q, "content").collect()}
    assert ids("alpha beta") == {1, 2, 5} and ids("the") == set() and ids("the gamma") == {1, 2} and ids("alp") == set()


def brute_rank(tokens, terms):
    covers = []
    for s in range(len(tokens)):
        for e in range(s, len(tokens)):
            if set(terms) <= set(tokens[s : e + 1]) and not set(terms) <= set(tokens[s + 1 : e + 1]) and not set(terms) <= set(tokens[s:e]):
                covers.append(0.1 / (1 + max(0, e - s - len(terms) + 1)))
    return sum(covers)


def test_cover_density_by_brute_force(spark):
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "x", "y"], 14)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    for query in ("alpha", "alpha beta", "alpha beta gamma"):
        terms = query.split()
        want = {i: brute_rank(t.split(), terms) for i, t in enumerate(texts) if set(terms) <= set(t.split())}
        got = {a.id: a.text_rank for a in fts.rank(df, query, "id", "content").collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_postings_hold_every_place(spark, tmp_path):
    rows = [(1, "Stones and a stone, the quarry", "u1"), (2, "", "u2"), (3, None, "u3"), (4, "the of", "u4"), (5, "stone " * 3, "u5")]
    df = spark.createDataFrame(rows, "id long, content string, url string")
    got = {(r.term, r.id, r.url): r.positions for r in fts.postings(df, "id", "content", keep=["url"]).collect()}
    assert got == {("stone", 1, "u1"): [1, 4], ("quarri", 1, "u1"): [6], ("stone", 5, "u5"): [1, 2, 3]}
    assert {(r.id, r.term, r.pos) for r in fts.places(df, "id", "content").collect()} == {(i, t, p) for (t, i, _), ps in got.items() for p in ps}
    fts.write_postings(fts.postings(df, "id", "content"), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert {r.id for r in fts.matching(stored, "the stones").collect()} == {1, 5} and fts.rank_stored(stored, "the").count() == 0


@pytest.mark.parametrize("k", [1, 5, 300])
def test_the_best_need_few_postings(spark, tmp_path, monkeypatch, k):
    """As ranking all and cutting, from a part of the postings where some texts use the terms often."""
    r = np.random.default_rng(3)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma"] + [f"w{j}" for j in range(9)], int(r.choice([5, 20, 400], p=[0.6, 0.38, 0.02])))) for _ in range(1500)]
    texts += ["alpha beta " * 3] * 4 + ["alpha " * 50 + "beta", "", "alpha beta gamma " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    fts.write_postings(fts.postings(df, "id", "content"), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    seen, rank = [], fts.rank_stored
    monkeypatch.setattr(fts, "SEEN", 2)
    monkeypatch.setattr(fts, "rank_stored", lambda rows, *a: seen.append(rows) or rank(rows, *a))
    for query in ("alpha", "beta alpha", "gamma alpha beta", "absent alpha", "the"):
        seen.clear()
        got = [(x.id, round(x.text_rank, 9)) for x in fts.top_stored(stored, query, k).collect()]
        want = sorted(((x.id, round(x.text_rank, 9)) for x in rank(stored, query).collect()), key=lambda x: (-x[1], x[0]))[:k]
        assert got == want
        if k == 1 and len(want):
            assert max(rows.count() for rows in seen) < stored.count() / 4
    plan = stored.filter(F.col("uses").isNull() | (F.col("uses") >= 3))._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(uses),GreaterThanOrEqual(uses,3))" in plan


def test_a_stem_like_a_stop_word_is_a_term(spark):
    df = spark.createDataFrame([(1, "a doe"), (2, "it does")], "id long, content string")
    assert [r.id for r in fts.match(df, "doe", "content").collect()] == [1]


def test_stemmed_search(spark):
    df = spark.createDataFrame([(1, "Running quarries"), (2, "a run at the quarry"), (3, "stone")], "id long, content string")
    assert {r.id for r in fts.match(df, "run quarry", "content", fts.Analyzer(stemmed=False)).collect()} == {2}
    assert {r.id for r in fts.match(df, "runs quarry", "content", fts.Analyzer(stemmed=True)).collect()} == {1, 2}


def test_tokens_of_every_kind(spark):
    texts = {
        1: "Café CRÈME, naïve Привет мир 你好 世界! ½ १२ e\u0301te\u0301",
        2: "Write to Some.One+tag@mail.example.com or see https://www.a-b.example.org/path/to.html?x=1#y. Then v1.2.3 and 3.14!",
        3: "state-of-the-art well-known -- a-b- e.g. end.Next .hidden trailing. 10-20",
        4: "a." * 5000 + "-b" * 5000 + " x@" + "y" * 20000,
        5: "",
    }
    df = spark.createDataFrame(list(texts.items()), "id long, content string")
    for stops in (True, False):
        a = fts.Analyzer(stemmed=False, stop_words=stops)
        got = {r.id: r.t for r in df.select("id", a.terms(F.col("content")).alias("t")).collect()}
        assert got == {i: a.all_terms(t) for i, t in texts.items()}
        stems = fts.Analyzer(stop_words=stops)
        assert {r.id: r.t for r in df.select("id", stems.terms(F.col("content")).alias("t")).collect()} == {i: stems.all_terms(t) for i, t in texts.items()}
    assert got[1] == ["café", "crème", "naïve", "привет", "мир", "你好", "世界", "½", "१२", "e\u0301te\u0301"]
    assert got[2] == ["write", "to", "some.one+tag@mail.example.com", "or", "see", "www.a-b.example.org/path/to.html?x=1#y", "www.a-b.example.org", "/path/to.html?x=1#y", "then", "v1", "2.3", "and", "3.14"]
    assert got[3][:6] == ["state-of-the-art", "state", "of", "the", "art", "well-known"] and "end.next" in got[3]
    ids = lambda q: {r.id for r in fts.match(df, q, "content").collect()}
    assert ids("crème café") == {1} and ids("ПРИВЕТ") == {1} and ids("你好") == {1} and ids("caf") == set() and ids("known") == {3} and ids("www.a-b.example.org") == {2}


def test_hybrid(chunks):
    got = {r.id: r for r in search.hybrid(chunks, [1, 0, 0], "alpha beta", 5).collect()}
    assert got[1].hybrid_score == pytest.approx(1 / 61 + 1 / (60 + sorted([got[1].text_rank, got[2].text_rank, got[5].text_rank], reverse=True).index(got[1].text_rank) + 1), abs=1e-3)
    assert got[3].text_rank == 0 and got[1].similarity > 0.9
    few = search.hybrid(chunks.filter("id <> 4"), [1, 0, 0], "alpha beta", 1).collect()
    assert len(few) == 1 and few[0].id in (1, 2)


def test_fusion_of_equal_arms(spark):
    rows = [(1, "q w", [1.0, 0.0]), (2, "none", [0.9, 0.5]), (3, "w x x x q", [-1.0, 0.1]), (4, "z", [0.8, 0.9])]
    df = spark.createDataFrame(rows, "id long, content string, embedding array<float>").withColumns({"metadata": F.parse_json(F.lit("{}")), "source_id": F.lit("s")})
    got = {r.id: r for r in search.hybrid(df, [1, 0], "q w", 2).collect()}
    assert got[1].hybrid_score == pytest.approx(2 / 61)


def test_content_types(spark):
    df = spark.createDataFrame([("A FUNCTION",), ("a guide",), ("an api",), ("settings",), ("words",)], "c string")
    assert [r[0] for r in df.select(diversify.content_type(F.col("c"))).collect()] == ["code", "tutorial", "api", "configuration", "general"]
    one = spark.range(1).select(diversify.content_type(F.lit("a function"), F.parse_json(F.lit('{"content_type":"mine"}')))).first()[0]
    assert one == "mine"


def test_types_in_turn(spark):
    rows = [(1, "code", 0.9), (2, "api", 0.85), (3, "code", 0.8), (4, "code", 0.7), (5, "general", 0.5), (6, "general", 0.4), (7, "general", 0.3)]
    df = spark.createDataFrame(rows, "seq int, content_type string, similarity double").withColumn("id", F.col("seq"))
    got = diversify.by_content_type(df, 2).orderBy("seq").collect()
    assert [r.id for r in got] == [1, 2, 5, 3, 6]


def plain_mmr(query, vectors, weight, k):
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if np.linalg.norm(a) and np.linalg.norm(b) else 0.0
    rel = [cos(query, v) for v in vectors]
    chosen, left = [], list(range(len(vectors)))
    while left and len(chosen) < k:
        def value(i):
            return rel[i] if not chosen else weight * rel[i] - (1 - weight) * max(0.0, *[cos(vectors[i], vectors[j]) for j in chosen], 0.0)

        best = max(left, key=value)
        chosen.append(best)
        left.remove(best)
    return chosen


def test_mmr():
    q, vs = [1, 0], [[1, 0], [0.999, 0.0447], [0, 1]]
    assert diversify.mmr_order(q, vs, [""] * 3, [0] * 3, 0.4) == [0, 2, 1]
    assert diversify.mmr_order(q, vs, [""] * 3, [0] * 3, 0.7) == [0, 1, 2]
    assert diversify.mmr_order(q, [None, None, None], ["a b", "a b", "c"], [0.9, 0.8, 0.7], 0.5) == [0, 2, 1]
    r = np.random.default_rng(3)
    for _ in range(20):
        vs, q = r.normal(size=(12, 4)), r.normal(size=4)
        vs[3] = 0
        assert diversify.mmr_order(q, vs, [""] * 12, [0] * 12, 0.6, 8) == plain_mmr(q, vs, 0.6, 8)


def test_rerank_order_and_threshold(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.7), (4, None)], "seq int, s double")
    assert [r.seq for r in rerank.reranked(df, F.col("s")).collect()] == [2, 3, 1, 4]
    assert [r.seq for r in rerank.reranked(df, F.col("s"), 0.6).collect()] == [2, 3]


def test_overlap_in_both_forms(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", "x"), ("a", "")], "q string, t string")
    got = df.select(rerank.overlap(F.col("q"), F.col("t")), rerank.pair_score(F.col("q"), F.col("t"), OverlapScorer)).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (0.0, 0.0), (0.0, 0.0)]


def test_first_model_that_loads():
    def load(path):
        if path != "third":
            raise OSError
        return OverlapScorer()

    assert rerank.first_that_loads(["a", "b", "third"], load) is not None and rerank.first_that_loads(["a"], load) is None


class Flaky:
    dimension = 2

    def __init__(self, bad=()):
        self.calls, self.bad = 0, bad

    def embed(self, texts):
        self.calls += 1
        if len(texts) > 1 or texts[0] in self.bad:
            raise RuntimeError
        return [[1.0, float(len(texts[0]))]]


def test_best_holds_a_tile_of_pairs_and_breaks_ties_by_id():
    rng = np.random.default_rng(5)
    q, x = V.unit(rng.normal(size=(3000, 4))), np.round(rng.normal(size=(6000, 4)))  # many rows alike
    x[7] = 0
    ids = rng.permutation(6000)
    tracemalloc.start()
    best = V.Best(np.arange(3000), q, 3)
    for lo in range(0, 6000, 4000):
        best.add(ids[lo : lo + 4000], x[lo : lo + 4000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # all pairs of a batch take 96 MB, and their order as much again, twice
    sims = np.round(q @ V.unit(x).T, 9)
    sims[:, 7] = -np.inf
    for i in range(0, 3000, 50):
        assert best.rows[i].tolist() == ids[np.lexsort((ids, -sims[i]))[:3]].tolist()


@pytest.mark.parametrize("stemmed", [True, False])
def test_terms_stay_in_the_worker(spark, stemmed):
    """Only what is found leaves it, not a list of all terms of each text; both give the same places."""
    texts = ["Running (runs)! http://a.example/x-y the", None, "", "the of", "run a.example run-run runs RUNNING"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    a = fts.Analyzer(stemmed)
    found = fts.positions(docs, "runs running", "doc_id", "text", a)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    stored = fts.postings(docs, "doc_id", "text", a)
    assert "ArrowEvalPython" not in stored._jdf.queryExecution().toString()
    places = {(r.term, r.id): r.positions for r in stored.collect()}
    assert places == {(t, i): [p for p, w in enumerate(a.all_terms(x or ""), 1) if w == t] for i, x in enumerate(texts) for t in set(a.all_terms(x or "")) - {""}}
    assert {(r.id, r.term, r.pos) for r in found.collect()} == {(i, t, p) for (t, i), ps in places.items() for p in ps if t in a.query_terms("runs running")}


def test_only_blank_texts_have_no_length():
    found = np.linalg.norm(HashingEmbedder().embed(["w0 w13", "w0 w13 w13 w0", "a", "\u00a0", "\x1c\x85", "", " \t\n\f\r"]), axis=1)
    assert np.allclose(found, [1, 1, 1, 1, 1, 0, 0])


def test_embedding_fallbacks():
    m = Flaky(bad=("bb",))
    assert embed_all(m, ["a", "bb", "ccc"], wait=lambda s: None) == [[1.0, 1.0], [0.0, 0.0], [1.0, 3.0]]
    assert m.calls == 6 and embed_all(m, []) == []


def test_waits_only_where_the_rate_is_limited():
    class Limited:
        dimension = 1

        def __init__(self, error):
            self.error = error

        def embed(self, texts):
            raise self.error

    limited = RuntimeError("too many")
    limited.code = 429
    for error, waits in ((RuntimeError("Error: rate_limit_exceeded"), [1.0, 2.0]), (limited, [1.0, 2.0]), (ValueError("bad text"), [])):
        waited = []
        assert embed_all(Limited(error), ["a"], wait=waited.append) == [[0.0]] and waited == waits


def test_prefixes(spark):
    main = spark.createDataFrame([(1, "same"), (2, "same")], "seq int, content string")
    more = spark.createDataFrame([(3, "same"), (4, "new"), (5, "new"), (6, "x" * 100 + "1"), (7, "x" * 100 + "2")], "seq int, content string")
    assert sorted(r.seq for r in filters.new_prefixes(main, more, "seq").collect()) == [1, 2, 4, 6]


def test_service(chunks):
    model = HashingEmbedder(16)
    texts = {r.id: r.content for r in chunks.collect()}
    pairs = [(i, model.embed([t])[0]) for i, t in texts.items()]
    own = chunks.drop("embedding").join(chunks.sparkSession.createDataFrame(pairs, "id long, embedding array<float>"), "id")
    service = search.SearchService(own, embedder=model)
    found = service.enhanced_search("alpha beta gamma", 3).collect()
    assert found[0].id in (1, 2) and [r.mmr_rank for r in found] == list(range(1, len(found) + 1))
    high = service.perform(SearchRequest("alpha beta gamma", num_results=3, semantic_threshold=0.95)).collect()
    assert all(r.similarity >= 0.95 for r in high)
    plain = search.SearchService(own, embedder=model, settings=Settings(use_result_diversification=False, use_hybrid_search=True))
    assert [r.seq for r in plain.enhanced_search("alpha beta", 2).collect()] == [1, 2]
    reranking = search.SearchService(own, embedder=model, scorer=OverlapScorer(), settings=Settings(use_reranking=True))
    scores = [r.rerank_score for r in reranking.perform(SearchRequest("alpha beta", semantic_threshold=0.0)).collect()]
    assert scores == sorted(scores, reverse=True) and all(s >= 0.3 for s in scores)


@pytest.mark.parametrize("bad", [{"query": ""}, {"query": "x" * 1001}, {"query": "x", "num_results": 0}, {"query": "x", "num_results": 21}, {"query": "x", "semantic_threshold": 1.5}, {"query": "x", "search_type": "other"}])
def test_search_bounds(bad):
    with pytest.raises(ValueError):
        SearchRequest(**bad)


@pytest.mark.parametrize("bad", [{"max_depth": 11}, {"max_concurrent": 0}, {"chunk_size": 99}, {"overlap": 1001}, {"chunk_size": 100, "overlap": 100}])
def test_crawl_bounds(bad):
    with pytest.raises(ValueError):
        CrawlRequest("https://a.b", **bad)


def batch_texts(n=400):
    r = random.Random(3)
    return [(i, None if i % 97 == 5 else " ".join(r.choice("abcdef" if i % 5 else "fghijk") + r.choice(["", "", "-q", ".", ", the"]) for _ in range(r.randint(0, 40)))) for i in range(n)]


BATCH = [(1, ["b"]), (2, ["b", "c"]), (3, ["c", "b"]), (4, ["f", "b", "d"]), (5, ["nowhere", "b"]), (6, []), (7, ["b-q", "q", "e", "f"]), (8, ["g", "h"])]


@pytest.mark.parametrize("stored", [False, True])
def test_best_texts_of_a_block_of_queries(spark, stored):
    """As each query's own ranking, of any number of terms, with ties; texts without all terms, and queries without terms, give none."""
    plain = fts.Analyzer(stemmed=False)
    docs = spark.createDataFrame(batch_texts(), "id long, content string").repartition(3)
    postings = fts.postings(docs, "id", "content", plain).drop("uses")
    got = sorted((r.query_id, r.text_place, r.id, round(r.text_rank, 9)) for r in fts.top_batched(postings if stored else docs, BATCH, 6, plain).collect())
    want = []
    for i, terms in BATCH:
        ranks = fts.cover_density(fts.places(docs, "id", "content", plain).filter(F.col("term").isin(terms)), terms) if terms else docs.limit(0).withColumn("text_rank", F.lit(0.0))
        best = sorted((-round(r.text_rank, 12), r.id) for r in ranks.collect())[:6]
        want += [(i, n, id_, round(-rank, 9)) for n, (rank, id_) in enumerate(best, 1)]
    assert got == sorted(want) and {r[0] for r in got} == {1, 2, 3, 4, 7, 8}


def test_best_texts_in_parts(monkeypatch):
    """Tables of any size give the same: by texts one at a time, and in tiles of a few texts, queries and places."""
    number, plain = {t: i for i, t in enumerate("abcdef")}, fts.Analyzer(stemmed=False)
    texts = [(i, t) for i, t in batch_texts() if t is not None]
    sets = [[1], [1, 2], [3, 1, 5], [2, 4]] * 5

    def best(step):
        out = fts.BestTexts(sets, len(number), 4)
        for lo in range(0, len(texts), step):
            ids, of = zip(*texts[lo : lo + step], strict=True)
            out.add(np.array(ids), *fts._uses_of(of, number, plain))
        return out.batch().to_pylist()

    whole = best(len(texts))
    assert len(whole) == 4 * len(sets) and best(1) == whole
    monkeypatch.setattr(fts, "CELLS", 30)
    monkeypatch.setattr(fts, "PLACES", 7)
    assert best(50) == whole


@pytest.mark.parametrize("stemmed", [False, True])
def test_uses_of_terms_are_those_of_all_terms(stemmed):
    a = fts.Analyzer(stemmed=stemmed)
    texts = ["", "  ", "http://foo.bar/baz/qux the ends", "a-b-c Foo-Bar\x1cone two\u2003three", "the and of", "HTTP:// (words) ..word!! x.y 3.14 me@a.bc", "É ñ — “quoted” \x0b tab\tend", "x" * 200 + " yes x-" + "y" * 90, " end\n"]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in a.all_terms(t) if w}))}
    want = sorted((i, pos, number[w]) for i, t in enumerate(texts) for pos, w in enumerate(a.all_terms(t), 1) if w)
    row, term, pos = fts._uses_of(texts, number | {"the": len(number)}, a)
    assert sorted(zip(row.tolist(), pos.tolist(), term.tolist(), strict=True)) == want
