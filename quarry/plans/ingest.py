"""From pages to stored chunks, code examples and source records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import Settings
from quarry.functions import text as T
from quarry.functions.chunking import with_chunks
from quarry.functions.code import code_blocks
from quarry.plans.answers import Answers
from quarry.plans.models import LLM, Embedder, HashingEmbedder, NoLLM, completed, embedding
from quarry.sources.store import Store, row_id, source_texts


@dataclass
class Ingest:
    """A pipeline over pages (url, markdown); ``now`` is injected so that a run can be repeated."""

    store: Store
    now: Column
    embedder: Embedder = field(default_factory=HashingEmbedder)
    llm: LLM = field(default_factory=NoLLM)
    settings: Settings = field(default_factory=Settings)
    answers: Answers | None = None

    def _embedded(self, rows: DataFrame, text: Column) -> DataFrame:
        """``rows`` with the ``embedding`` of a text; with ``answers`` each text is embedded once for all time."""
        s, model = self.settings, self.embedder
        if self.answers is None:
            return rows.withColumn("embedding", embedding(text, model, s.embedding_batch))
        kind = f"embedding-{getattr(model, 'model', type(model).__name__)}-{model.dimension}".replace("/", "_")
        found = self.answers.add(rows, text, kind, "array<float>", lambda c: embedding(c, model, s.embedding_batch), lambda v: F.exists(v, lambda x: x != 0))
        return found.withColumn("embedding", F.coalesce("_answer", F.array_repeat(F.lit(0.0).cast("float"), model.dimension))).drop("_answer")

    def _completed(self, rows: DataFrame, prompt: Column, name: str, batch: int) -> DataFrame:
        """``rows`` with the model's answer to a prompt, null where it fails or says nothing."""
        s, model = self.settings, self.llm
        ask = lambda c: completed(c, F.lit(None).cast("string"), model, s.disable_thinking, batch)["text"]
        if self.answers is None:
            return rows.withColumn(name, ask(prompt))
        kind = f"completion-{getattr(model, 'model', type(model).__name__)}-{'plain' if s.disable_thinking else 'thinking'}".replace("/", "_")
        return self.answers.add(rows, prompt, kind, "string", ask, lambda t: t.isNotNull()).withColumnRenamed("_answer", name)

    def chunks(self, pages: DataFrame, crawl_type: str) -> DataFrame:
        s = self.settings
        cut = with_chunks(pages.select("url", "markdown"), "markdown", s.chunk_size, s.overlap)
        text = F.col("chunk")
        if s.use_contextual_embeddings:
            prompt = F.concat(F.lit("Say in a sentence or two what this passage is about within its document.\n\nDocument:\n"), F.left("markdown", F.lit(25_000)), F.lit("\n\nPassage:\n"), F.col("chunk"))
            cut = self._completed(cut, prompt, "_context", s.contextual_batch)
            text = F.when(F.col("_context").isNotNull(), T.contextual_text(F.col("_context"), F.col("chunk"), s.embedding_max_chars)).otherwise(F.col("chunk"))
        source = T.netloc(F.col("url"))
        cut = self._embedded(cut, T.truncated(text, s.embedding_max_chars))
        return cut.select(
            row_id(F.col("url"), F.col("chunk_number")).alias("id"), "url", "chunk_number", F.col("chunk").alias("content"),
            T.chunk_metadata(F.col("chunk"), source, F.col("url"), F.col("chunk_number") - 1, F.lit(crawl_type), self.now.cast("string")).alias("metadata"),
            source.alias("source_id"), "embedding", self.now.alias("created_at"),
        )

    def code(self, pages: DataFrame) -> DataFrame:
        s = self.settings
        found = pages.select("url", F.posexplode(code_blocks(F.col("markdown"), s.code_min_length)).alias("_pos", "b"))
        shown = T.prompt_windows(F.lit(""), F.col("b.context_before"), F.col("b.code"), F.col("b.context_after"))
        prompt = F.concat(F.lit("Summarise this code example in a few sentences.\n\nBefore:\n"), shown["before"], F.lit("\n\nCode:\n"), shown["code"], F.lit("\n\nAfter:\n"), shown["after"])
        found = self._completed(found, prompt, "_said", s.summary_batch).withColumn("summary", F.coalesce("_said", F.lit("Code example for demonstration purposes.")))
        found = self._embedded(found, T.code_embedding_text(F.col("summary"), F.col("b.code"), F.col("b.language")))
        source = T.netloc(F.col("url"))
        return found.select(
            row_id(F.col("url"), F.col("_pos") + 1).alias("id"), "url", (F.col("_pos") + 1).alias("chunk_number"),
            T.fenced(F.col("b.code"), F.col("b.language")).alias("content"), "summary",
            F.parse_json(F.to_json(F.struct((F.col("_pos")).alias("chunk_index"), source.alias("source"), F.col("b.language").alias("language"), F.length("b.code").alias("char_count"), T.word_count(F.col("b.code")).alias("word_count"), F.col("summary")))).alias("metadata"),
            source.alias("source_id"), "embedding", self.now.alias("created_at"),
        )

    def sources(self, pages: DataFrame) -> DataFrame:
        texts = source_texts(pages.withColumn("source_id", T.netloc(F.col("url"))))
        prompt = F.concat(F.lit("Say in a few sentences what the site "), F.col("source_id"), F.lit(" is about.\n\n"), F.col("text"))
        texts = self._completed(texts, prompt, "_said", self.settings.summary_batch)
        return texts.select("source_id", T.clamped_summary(F.col("_said"), F.col("source_id")).alias("summary"), F.col("word_count").cast("int").alias("total_word_count"))

    def run(self, pages: DataFrame, crawl_type: str = "webpage") -> dict:
        """Store the pages' chunks, code examples and, last, sources; the totals. A page of a known URL is replaced."""
        pages, folder = self.store.staged(pages.select("url", "markdown").filter(F.coalesce("markdown", F.lit("")) != ""))
        try:
            chunks = self.store.add_chunks(self.chunks(pages, crawl_type), self.now)
            code = self.store.add_code(self.code(pages), self.now) if self.settings.use_agentic_rag else 0
            self.store.update_sources(self.sources(pages), self.now)
            return {"success": True, "crawl_type": crawl_type, "urls_processed": pages.count(), "total_chunks": chunks, "code_examples": code, "sources_updated": sorted(r[0] for r in pages.select(T.netloc(F.col("url"))).distinct().collect())}
        finally:
            self.store.files.delete(folder)
            if self.answers is not None:
                self.answers.release()
