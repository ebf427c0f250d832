"""The service's tools: each answers with a JSON string, errors included."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import CrawlRequest, SearchRequest, Settings
from quarry.functions import text as T
from quarry.operators.rerank import scorer_of
from quarry.operators.search import SearchService
from quarry.plans.ingest import Ingest
from quarry.plans.jobs import CRAWLS
from quarry.sources import pages as P
from quarry.sources.frontier import StoredCrawl
from quarry.sources.web import fetched_urls


class Refused(Exception):
    """An answer without success that says more than an error."""

    def __init__(self, **fields):
        super().__init__(fields.get("error"))
        self.fields = fields


def _answering(f: Callable[[], dict], **on_error) -> str:
    """The answer of ``f``; of an error its text, with the fields ``on_error`` (those that are set)."""
    try:
        return json.dumps({"success": True} | f(), default=str)
    except Refused as e:
        return json.dumps({"success": False} | on_error | e.fields, default=str)
    except Exception as e:
        return json.dumps({"success": False, "error": str(e)} | on_error)


def _rows(df: DataFrame, limit: int) -> list[dict]:
    """A few result rows; metadata as an object."""
    kinds = dict(df.dtypes)
    shown = df.withColumn("metadata", F.to_json("metadata")) if kinds.get("metadata") == "variant" else df
    out = []
    for r in shown.limit(limit).toLocalIterator():
        d = r.asDict()
        if isinstance(d.get("metadata"), str):
            d["metadata"] = json.loads(d["metadata"])
        out.append(d)
    return out


def _iso(moment) -> str | None:
    return moment.isoformat() if moment is not None else None


class Tools:
    """``fetch(urls, max_concurrent)``: crawl results (success, url, html, markdown) of a table of URLs; from the web if not given."""

    def __init__(self, spark: SparkSession, ingest: Ingest, service: Callable[[], SearchService] | None = None, fetch: Callable[[DataFrame, int], DataFrame] | None = None, settings: Settings | None = None):
        self.spark, self.ingest, self.settings = spark, ingest, settings or Settings()
        self.service = service or (lambda: SearchService.of(ingest.store, embedder=ingest.embedder, llm=ingest.llm, scorer=scorer_of(self.settings), settings=self.settings))
        self.fetch = fetch or fetched_urls

    # --- reading ---

    def perform_rag_query(self, query: str, source: str | None = None, match_count: int = 5) -> str:
        def run() -> dict:
            kind = "hybrid" if self.settings.use_hybrid_search else "semantic"
            service = self.service()
            request = SearchRequest(query, source, match_count, self.settings.semantic_threshold, kind)
            reranks = self.settings.use_reranking and service.scorer is not None
            found = replace(service, settings=replace(service.settings, use_reranking=False)).perform(request)
            if reranks:
                found = service.rerank(found, query)
            results = [
                {"content": r["content"], "url": r["url"], "source": r["source_id"], "chunk_number": r["chunk_number"], "similarity_score": r["similarity"], "metadata": r["metadata"]} | ({"rerank_score": r["rerank_score"]} if "rerank_score" in r else {})
                for r in _rows(found, match_count)
            ]
            return {"query": query, "search_type": kind, "results": results, "total_results": len(results), "source_filter": source, "reranking_applied": reranks, "message": f"Found {len(results)} relevant results"}

        return _answering(run, query=query, results=[])

    def search_code_examples(self, query: str, source_id: str | None = None, match_count: int = 5) -> str:
        def run() -> dict:
            if not self.settings.use_agentic_rag:
                raise ValueError("Code example search is disabled: the setting use_agentic_rag is off")
            service = self.service()
            found = service.search_code_examples(query, k=2 * match_count, source=source_id)
            reranks = self.settings.use_reranking and service.scorer is not None
            if reranks:
                found = service.rerank(found.withColumn("seq", F.monotonically_increasing_id()), query, "summary")
            results = [
                {"code": r["content"], "language": (r["metadata"] or {}).get("language", "unknown"), "summary": r["summary"], "url": r["url"], "source": r["source_id"], "chunk_number": r["chunk_number"], "similarity_score": r["similarity"], "metadata": r["metadata"]} | ({"rerank_score": r["rerank_score"]} if reranks else {})
                for r in _rows(found, match_count)
            ]
            return {"query": query, "results": results, "total_results": len(results), "source_filter": source_id, "reranking_applied": reranks, "message": f"Found {len(results)} code examples" if results else "No code examples found matching the query"}

        return _answering(run, query=query, results=[])

    def get_available_sources(self) -> str:
        def run() -> dict:
            # a row for each source, as the answer must hold them all
            sources = [
                {"source": r.source_id, "summary": r.summary, "total_documents": r.total_documents, "total_chunks": r.total_chunks, "total_code_examples": r.total_code_examples, "word_count": r.word_count, "last_updated": _iso(r.last_updated)}
                for r in self.ingest.store.stats().toLocalIterator()
            ]
            return {"sources": sources, "total_sources": len(sources), "message": f"Found {len(sources)} available sources"}

        return _answering(run, sources=[], total_sources=0)

    # --- writing ---

    def _urls(self, *urls: str) -> DataFrame:
        return self.spark.createDataFrame([(u,) for u in urls], "url string")

    def _kept(self, df: DataFrame) -> DataFrame:
        """Fetched once, then read as often as needed."""
        return P.reliable(df)

    def crawl_single_page(self, url: str) -> str:
        def run() -> dict:
            crawl = CRAWLS.start(self.spark, [url], "single_page")
            try:
                page = P.batch(self._kept(self.fetch(self._urls(url), 1)))
                if page.isEmpty():
                    raise Refused(error="Failed to crawl the URL", crawl_id=crawl.crawl_id)
                out = self.ingest.run(page, "single_page")
                if not out["total_chunks"]:
                    raise Refused(error="No content chunks were generated", crawl_id=crawl.crawl_id)
                chunks = out["total_chunks"]
                return {"crawl_id": crawl.crawl_id, "url": url, "source_id": P.source_of(url), "chunks_created": chunks, "code_examples_created": out["code_examples"], "crawl_type": "single_page", "message": f"Successfully crawled and stored single page with {chunks} chunks"}
            except Exception as e:
                if CRAWLS.is_cancelled(crawl.crawl_id) and not isinstance(e, Refused):
                    raise Refused(error="Crawl operation was cancelled", crawl_id=crawl.crawl_id, message=str(e)) from e
                raise
            finally:
                CRAWLS.finish(self.spark, crawl.crawl_id)

        return _answering(run, url=url)

    def _known(self, url: str) -> dict | None:
        """What the store has of a URL's source, if it has any chunks."""
        source = P.source_of(url)
        r = self.ingest.store.stats(source).filter("total_chunks > 0").first()
        if r is None:
            return None
        stats = {"total_documents": r.total_documents, "total_chunks": r.total_chunks, "total_code_examples": r.total_code_examples, "word_count": r.word_count, "last_updated": str(r.last_updated), "summary": r.summary}
        return {"already_exists": True, "source_id": source, "existing_stats": stats, "message": f"Content for {source} already exists. Use force_recrawl=true to replace it."}

    def _stored_crawl(self, url: str, max_depth: int, fetch: Callable[[DataFrame], DataFrame]) -> StoredCrawl:
        """The crawl of a URL, kept in the store until its pages are ingested: one that failed or was cancelled goes on when asked for again."""
        name = hashlib.sha256(json.dumps([url, max_depth]).encode()).hexdigest()
        return StoredCrawl(self.spark, f"{self.ingest.store.root}/crawls/{name}", fetch, max_depth)

    def smart_crawl_url(self, url: str, max_depth: int = 3, max_concurrent: int = 10, chunk_size: int = 5000, force_recrawl: bool = False) -> str:
        def run() -> dict:
            request = CrawlRequest(url, max_depth, max_concurrent, chunk_size, min(self.settings.overlap, chunk_size - 1))
            known = None if force_recrawl else self._known(url)
            if known:
                raise Refused(**known)
            kind = self.spark.range(1).select(T.url_kind(F.lit(url))).first()[0]
            crawl = CRAWLS.start(self.spark, [url], {"txt": "txt_file", "sitemap": "sitemap"}.get(kind, "recursive"))
            fetch = lambda urls: self.fetch(urls, request.max_concurrent)
            followed = None
            try:
                if kind == "txt":
                    found, name = self._kept(fetch(self._urls(url))), "txt file"
                elif kind == "sitemap":
                    xml = self._kept(fetch(self._urls(url))).select(F.explode(P.sitemap_urls(F.coalesce("html", "markdown"))).alias("url")).distinct()
                    found, name = self._kept(fetch(xml)), "sitemap"
                else:
                    followed = self._stored_crawl(url, request.max_depth, fetch)
                    if force_recrawl:
                        followed.delete()
                    found, name = followed.run(self._urls(url), lambda: CRAWLS.is_cancelled(crawl.crawl_id)), "webpage"
                good = P.batch(found).dropDuplicates(["url"])
                if good.isEmpty():
                    if followed:
                        followed.delete()
                    raise Refused(error=f"No content found at {url}", crawl_id=crawl.crawl_id)
                failed = P.outcome(found).first().urls_failed
                sized = replace(self.ingest, settings=replace(self.ingest.settings, chunk_size=chunk_size, overlap=request.overlap))
                out = sized.run(good, name)
                if followed:
                    followed.delete()
                message = f"Successfully crawled {out['urls_processed']} URLs using {name} strategy" + (f" ({failed} URLs failed)" if failed else "") + (" (forced re-crawl)" if force_recrawl else "")
                return {"crawl_id": crawl.crawl_id, "crawl_type": name, "urls_processed": out["urls_processed"], "urls_failed": failed, "total_chunks_created": out["total_chunks"], "total_code_examples": out["code_examples"], "sources_updated": out["sources_updated"], "force_recrawl": force_recrawl, "message": message, "url": url}
            finally:
                CRAWLS.finish(self.spark, crawl.crawl_id)

        return _answering(run, url=url)

    # --- control ---

    def cancel_crawl(self, crawl_id: str) -> str:
        def run() -> dict:
            if not CRAWLS.cancel(self.spark, crawl_id):
                raise ValueError(f"Crawl operation {crawl_id} not found or already completed")
            return {"message": f"Crawl operation {crawl_id} has been cancelled", "crawl_id": crawl_id}

        return _answering(run, crawl_id=crawl_id)

    def cancel_all_crawls(self) -> str:
        def run() -> dict:
            n = CRAWLS.cancel_all(self.spark)
            return {"message": f"Cancelled {n} crawl operations", "cancelled_count": n}

        return _answering(run)

    def get_active_crawls(self) -> str:
        def run() -> dict:
            active = CRAWLS.active()
            return {"active_crawls": active, "total_active": len(active), "message": f"Found {len(active)} active crawl operations"}

        return _answering(run)
