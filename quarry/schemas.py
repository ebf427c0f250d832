"""Schemas of the knowledge base's tables and of results."""

from __future__ import annotations

SOURCES = "source_id string, summary string, total_word_count int, created_at timestamp, updated_at timestamp"
CHUNKS = "id long, url string, chunk_number int, content string, metadata variant, source_id string, embedding array<float>, created_at timestamp"
CODE_EXAMPLES = "id long, url string, chunk_number int, content string, summary string, metadata variant, source_id string, embedding array<float>, created_at timestamp"
POSTINGS = "term string, id long, url string, uses int, positions array<int>"
CODE_BLOCKS = "array<struct<code:string,language:string,context_before:string,context_after:string,full_context:string>>"
CODE_POSITIONS = "array<struct<start:int,end:int,language:string,code_length:int,is_js_like:boolean>>"
CODE_SECTIONS = "array<struct<content:string,code_blocks_count:int,primary_language:string,is_js_like:boolean,total_code_length:int,section_start:int,section_end:int>>"
