"""Vector, full-text and hybrid search over a table of chunks or of code examples.

Ranking reads only ids, vectors and filters. The wide columns of the few rows that remain are fetched from where those lie, if the
table is a store's (``Fetch``), or joined to them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import SearchRequest, Settings
from quarry.functions import query as q
from quarry.functions import vector
from quarry.operators import diversify, filters, fts, rerank
from quarry.operators.vector_index import TAKEN
from quarry.plans.models import LLM, Embedder, HashingEmbedder, NoLLM, Scorer, embed_all


#: From a few (id, address) of a table with addresses to their rows.
Fetch = Callable[[list[tuple[int, int]]], DataFrame]


#: From a metadata filter and a source to the rows that pass, by an index.
Where = Callable[[dict[str, Any] | None, str | None], DataFrame]
#: From a vector and a number to as many (id, address) near it, or more, by an index; None where that can't be told.
Near = Callable[[Sequence[float], int], list[tuple[int, int]] | None]


def _nearest(kept: DataFrame, query: Sequence[float], k: int, near: Near | None, fetch: Fetch | None) -> DataFrame:
    """id (and address) with similarity of the k nearest rows: of all, or of the candidates that an index gives."""
    found = near(query, TAKEN * k) if near and fetch else None
    if found is None:
        return vector.topk(kept.select("id", *_address(kept), "embedding"), query, k).drop("embedding")
    few = kept.sparkSession.createDataFrame(found, "id long, address int")
    return vector.topk(fetch(found).select("id", "embedding").join(F.broadcast(few), "id"), query, k).select("id", "address", "similarity")


def _address(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c == "address"]


def _whole(table: DataFrame, best: DataFrame, fetch: Fetch | None) -> DataFrame:
    """``best`` (k rows) with the table's other columns: by address, read from those rows' buckets only, or by a join."""
    if fetch is None:
        return table.drop("embedding", "address").join(F.broadcast(best.drop("address")), "id")
    rows = best.collect()  # k rows
    few = best.sparkSession.createDataFrame(rows, best.schema).drop("address")
    return fetch([(r["id"], r["address"]) for r in rows]).drop("embedding").join(F.broadcast(few), "id")


def match(table: DataFrame, query: Sequence[float], k: int = 10, wanted: dict[str, Any] | None = None, source: str | None = None, fetch: Fetch | None = None, near: Near | None = None, where: Where | None = None) -> DataFrame:
    """The k rows nearest to ``query`` among those that pass the filters, with ``similarity`` (cosine).

    An index (``near``) is asked where there are no filters; with filters all rows that pass are compared.
    """
    kept = where(wanted, source) if where and wanted else filters.where_metadata(table, wanted, source)
    best = _nearest(kept, query, k, None if wanted or source is not None else near, fetch)
    return _whole(table, best, fetch).orderBy(F.desc_nulls_last("similarity"), "id")


def _numbered(df: DataFrame, *order, name: str) -> DataFrame:
    """Ranks of a few rows: the limit stands before, so the window never sees a corpus."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def hybrid(table: DataFrame, query: Sequence[float], text: str, k: int = 10, wanted: dict[str, Any] | None = None, source: str | None = None, rrf_k: int = 60, text_col: str | None = None, analyzer: fts.Analyzer | None = None, postings: DataFrame | None = None, fetch: Fetch | None = None, near: Near | None = None, where: Where | None = None) -> DataFrame:
    """Reciprocal rank fusion of the 2k nearest and the 2k best full-text rows: similarity, text_rank, hybrid_score of the k best.

    A row of one arm only has 0 for the other's value. Code examples are searched as content and summary together. With stored
    ``postings`` (term, id, positions) of the table the text arm reads no text, only the postings of the query's terms; where
    those say how often a text uses the term (uses), and nothing is filtered, only of texts that may be among the best.
    """
    searched = table if text_col else table.withColumn("_text", F.concat_ws(" ", "content", "summary") if "summary" in table.columns else F.col("content"))
    kept = where(wanted, source) if where and wanted and postings is not None else filters.where_metadata(searched, wanted, source)
    at = _address(table)
    nearest = _nearest(kept, query, 2 * k, None if wanted or source is not None else near, fetch)
    nearest = _numbered(nearest, F.desc_nulls_last("similarity"), "id", name="vector_rank")
    if postings is None:
        found = fts.rank(kept, text, "id", text_col or "_text", analyzer)
        found = found.join(table.select("id", *at), "id") if at else found
    else:
        if wanted or source is not None:
            found = fts.rank_stored(postings, text, analyzer).join(kept.select("id"), "id", "left_semi")
        else:
            found = fts.top_stored(postings, text, 2 * k, analyzer) if "uses" in postings.columns else fts.rank_stored(postings, text, analyzer)
    found = _numbered(found.orderBy(F.desc("text_rank"), "id").limit(2 * k), F.desc("text_rank"), "id", name="text_place")
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(rank)), F.lit(0.0))
    fused = nearest.join(found, "id", "full_outer").select(
        "id", *[F.coalesce(nearest[c], found[c]).alias(c) for c in at], F.when(F.col("vector_rank").isNull(), 0.0).otherwise(F.col("similarity")).alias("similarity"),
        F.coalesce("text_rank", F.lit(0.0)).alias("text_rank"), (part("vector_rank") + part("text_place")).alias("hybrid_score"),
    )
    best = fused.orderBy(F.desc("hybrid_score"), "id").limit(k)
    return _whole(table, best, fetch).orderBy(F.desc("hybrid_score"), "id")


def hybrid_batched(table: DataFrame, found: DataFrame, queries: Sequence[tuple[int, Sequence[float], str | Sequence[str]]], k: int = 10, rrf_k: int = 60, analyzer: fts.Analyzer | None = None) -> DataFrame:
    """query_id, id, similarity, text_rank, hybrid_score, rank: as ``hybrid``, for each of a block of queries (id, vector, text or terms) in one plan.

    ``found`` are the table's stored postings (term, id, positions) or, where it has none, its texts (id, content). Vectors are read
    once for all queries, and so are postings or texts; of either arm each task sends the 2k best rows of a query to where
    they are fused. Rows without a vector are found by their text only.
    """
    a = analyzer or fts.Analyzer()
    near = vector.topk_batched(table.select("id", "embedding"), [(i, v) for i, v, _ in queries], 2 * k).withColumnRenamed("rank", "vector_rank")
    text = fts.top_batched(found, [(i, a.query_terms(t) if isinstance(t, str) else t) for i, _, t in queries], 2 * k, a)
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(rank)), F.lit(0.0))
    fused = near.join(text, ["query_id", "id"], "full_outer").select(
        "query_id", "id", F.when(F.col("vector_rank").isNull(), 0.0).otherwise(F.col("similarity")).alias("similarity"), F.coalesce("text_rank", F.lit(0.0)).alias("text_rank"),
        (part("vector_rank") + part("text_place")).alias("hybrid_score"),
    )
    by = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "id")
    return fused.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


@dataclass
class SearchService:
    """Search over stored tables with models; the defaults need none."""

    chunks: DataFrame
    code_examples: DataFrame | None = None
    chunk_postings: DataFrame | None = None
    code_postings: DataFrame | None = None
    analyzer: fts.Analyzer = field(default_factory=fts.Analyzer)
    embedder: Embedder = field(default_factory=HashingEmbedder)
    llm: LLM = field(default_factory=NoLLM)
    scorer: Scorer | None = None
    settings: Settings = field(default_factory=Settings)
    fetch_chunks: Fetch | None = None
    fetch_code: Fetch | None = None
    near_chunks: Near | None = None
    near_code: Near | None = None
    where_chunks: Where | None = None
    where_code: Where | None = None

    @classmethod
    def of(cls, store, **more) -> SearchService:
        """Over all tables of a store in one state, its postings included; rows found are fetched by address."""
        now = store.snapshot()
        read = lambda name: now.read(name, addressed=True)
        fetch = {"fetch_chunks": lambda found: now.fetch("chunks", found), "fetch_code": lambda found: now.fetch("code_examples", found)}
        fetch |= {"near_chunks": lambda v, n: now.nearest("chunks", v, n), "near_code": lambda v, n: now.nearest("code_examples", v, n)}
        fetch |= {"where_chunks": lambda w, s: now.where("chunks", w, s), "where_code": lambda w, s: now.where("code_examples", w, s)}
        return cls(read("chunks"), read("code_examples"), read("chunk_postings"), read("code_postings"), store.analyzer, **(fetch | more))

    def _embed(self, text: str) -> list[float]:
        return embed_all(self.embedder, [text[: self.settings.embedding_max_chars]])[0]

    def _hybrid(self, use: bool | None) -> bool:
        return self.settings.use_hybrid_search if use is None else use

    def search_documents(self, query: str, k: int = 10, wanted: dict[str, Any] | None = None, source: str | None = None, use_hybrid: bool | None = None) -> DataFrame:
        vec = self._embed(query)
        if self._hybrid(use_hybrid):
            return hybrid(self.chunks, vec, query, k, wanted, source, self.settings.rrf_k, analyzer=self.analyzer, postings=self.chunk_postings, fetch=self.fetch_chunks, near=self.near_chunks, where=self.where_chunks)
        return match(self.chunks, vec, k, wanted, source, self.fetch_chunks, self.near_chunks, self.where_chunks)

    def search_code_examples(self, query: str, language: str | None = None, k: int = 10, wanted: dict[str, Any] | None = None, source: str | None = None, use_hybrid: bool | None = None) -> DataFrame:
        """The vector stands for a sentence about the query; the full-text arm reads the query itself."""
        within = f" in {language}" if language else ""
        vec = self._embed(f"Code example for {query}{within}\n\nSummary: Example code showing {query}")
        wanted = filters.with_language(wanted, language)
        if self._hybrid(use_hybrid):
            return hybrid(self.code_examples, vec, query, k, wanted, source, self.settings.rrf_k, analyzer=self.analyzer, postings=self.code_postings, fetch=self.fetch_code, near=self.near_code, where=self.where_code)
        return match(self.code_examples, vec, k, wanted, source, self.fetch_code, self.near_code, self.where_code)

    def enhanced_search(self, query: str, k: int = 10, wanted: dict[str, Any] | None = None, source: str | None = None, use_hybrid: bool | None = None, context: str | None = None) -> DataFrame:
        """The query's own results and, after them, new ones of up to three variations; sorted by score, then diversified to k."""
        use = self._hybrid(use_hybrid)
        main, more, _ = q.process(query, context, llm=self.llm)
        each = max(1, k // (len(more) + 1)) if more else 0
        order = F.desc_nulls_last("hybrid_score" if use else "similarity")

        def numbered(df: DataFrame, part: int) -> DataFrame:
            return df.withColumns({"seq": F.row_number().over(Window.orderBy(order, "id")) + F.lit(part * 10_000)})

        first = numbered(self.search_documents(main, k, wanted, source, use), 0)
        rest = None
        for i, text in enumerate(more[:3], 1):
            part = numbered(self.search_documents(text, each, wanted, source, use), i)
            rest = part if rest is None else rest.unionByName(part)
        found = filters.new_prefixes(first, rest, "seq") if rest is not None else first
        found = found.withColumn("seq", F.row_number().over(Window.orderBy(order, "seq")))
        if not self.settings.use_result_diversification:
            return found.filter(F.col("seq") <= k).orderBy("seq")
        vectors = self.chunks.select("id", "embedding")
        found = vectors.join(F.broadcast(found), "id").withColumns({  # a few rows a query
            "content_type": diversify.content_type(F.col("content"), F.col("metadata")),
            "query_embedding": vector.vector_literal(self._embed(query)),
            "query_id": F.lit(0),
            "metadata": F.to_json("metadata"),  # grouped Python operators take no VARIANT
        })
        out = diversify.diversified(found, "hybrid", "query_id", self.settings.mmr_lambda, self.settings.max_results_per_content_type, k)
        return out.withColumn("metadata", F.parse_json("metadata")).drop("query_embedding", "query_id", "embedding").orderBy("seq")

    def perform(self, request: SearchRequest, include_code: bool = False) -> DataFrame:
        """Search, threshold, then code examples behind (if asked for and enabled) and reranking (if enabled)."""
        use = request.search_type == "hybrid"
        found = filters.at_least(self.enhanced_search(request.query, request.num_results, None, request.source, use), "similarity", request.semantic_threshold)
        if include_code and self.settings.use_agentic_rag and self.code_examples is not None:
            code = self.search_code_examples(request.query, k=request.num_results, source=request.source, use_hybrid=use)
            found = found.unionByName(code.withColumn("seq", F.row_number().over(Window.orderBy(F.desc_nulls_last("similarity"), "id")) + 100_000), allowMissingColumns=True)
        if self.settings.use_reranking and self.scorer is not None:
            return self.rerank(found, request.query)
        return found.orderBy("seq")

    def rerank(self, results: DataFrame, query: str, column: str = "content", threshold: float | None = None) -> DataFrame:
        scorer = self.scorer
        at = self.settings.rerank_threshold if threshold is None else threshold
        return rerank.reranked(results, rerank.pair_score(F.lit(query), F.col(column), lambda: scorer), at)
