"""Scalar functions on text and URLs, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def section_info(text: Column) -> Column:
    """struct<headers, char_count, word_count>: markdown headers joined by '; ', characters and words."""
    marks = F.regexp_extract_all(text, F.lit(r"(?m)^(#+)\s+(.+)$"), F.lit(1))
    titles = F.regexp_extract_all(text, F.lit(r"(?m)^(#+)\s+(.+)$"), F.lit(2))
    return F.struct(
        F.array_join(F.zip_with(marks, titles, lambda m, t: F.concat(m, F.lit(" "), t)), "; ").alias("headers"),
        F.length(text).alias("char_count"),
        word_count(text).alias("word_count"),
    )


def netloc(url: Column) -> Column:
    """The authority of a URL, port and user included; empty if there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def defragmented(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def url_kind(url: Column) -> Column:
    """txt, sitemap or page, in this order of precedence."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(url.endswith(".txt"), "txt").when(url.endswith("sitemap.xml") | path.contains("sitemap"), "sitemap").otherwise("page")


def _last(text: Column, part: str) -> Column:
    """0-based place of the last occurrence, -1 without one."""
    at = F.locate(part[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at - (len(part) - 1)).otherwise(-1)


def truncated(text: Column, limit: int = 32_000) -> Column:
    """At most ``limit`` characters, ending at the last sentence or else paragraph that lies in the last fifth."""
    cut = F.left(text, F.lit(limit))
    sentence, paragraph = _last(cut, ". "), _last(cut, "\n\n")
    shorter = F.when(sentence > 0.8 * limit, F.left(cut, sentence + 1)).when(paragraph > 0.8 * limit, F.left(cut, paragraph)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(shorter)


def without_think_tags(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))


def thinking_prompt(prompt: Column, disabled: bool) -> Column:
    return F.concat(F.lit("/no_think\n\n"), prompt) if disabled else prompt


def clamped_summary(summary: Column, source_id: Column, limit: int = 500) -> Column:
    """The summary, cut after ``limit`` characters with dots; a fixed sentence for none."""
    text = F.when(F.length(summary) > limit, F.concat(F.left(summary, F.lit(limit)), F.lit("..."))).otherwise(summary)
    return F.when(F.coalesce(F.trim(summary), F.lit("")) == "", F.concat(F.lit("Content from "), source_id)).otherwise(text)


def fenced(code: Column, language: Column) -> Column:
    return F.concat(F.lit(FENCE), F.coalesce(language, F.lit("")), F.lit("\n"), code, F.lit(f"\n{FENCE}"))


def code_embedding_text(summary: Column, code: Column, language: Column) -> Column:
    return F.concat(summary, F.lit("\n\n"), fenced(code, language))


def fence_language(content: Column) -> Column:
    """What follows the opening fence on its line; 'unknown' for nothing."""
    found = F.trim(F.regexp_extract(content, r"^```([^\n]*)", 1))
    return F.when(found == "", "unknown").otherwise(found)


def contextual_text(context: Column, chunk: Column, limit: int = 32_000) -> Column:
    return truncated(F.concat(context, F.lit("\n---\n"), chunk), limit)


def placeholder_context(number: Column, chunk: Column) -> Column:
    return F.format_string("Chunk %d of document: %s", number, chunk)


def prompt_windows(document: Column, before: Column, code: Column, after: Column) -> Column:
    """What prompts show: the document's first 25000 characters, the last 500 before, 1500 of the code, 500 after."""
    return F.struct(F.left(document, F.lit(25_000)).alias("document"), F.right(before, F.lit(500)).alias("before"), F.left(code, F.lit(1500)).alias("code"), F.left(after, F.lit(500)).alias("after"))


def chunk_metadata(chunk: Column, source: Column, url: Column, index: Column, crawl_type: Column, crawl_time: Column) -> Column:
    """A VARIANT of a chunk's section info and standard fields; ``index`` counts from 0."""
    info = section_info(chunk)
    fields = F.struct(
        info["headers"].alias("headers"), info["char_count"].alias("char_count"), info["word_count"].alias("word_count"),
        source.alias("source"), url.alias("url"), index.alias("chunk_index"), crawl_type.alias("crawl_type"), crawl_time.alias("crawl_time"),
    )
    return F.parse_json(F.to_json(fields))
