"""Code blocks and code sections of markdown.

A text is split at its fences; every second part that a fence follows is code. One pass over the parts, with a running offset,
gives blocks with their surroundings and positions for sections, which look forwards and backwards line by line. Both come
from Arrow functions: where a part stands depends on all parts before it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import schemas

FENCE = "```"
CONTEXT = 1000

# Languages and patterns of JavaScript-like code, and of text that continues an explanation.
JS_LANGUAGES = ["javascript", "js", "typescript", "ts", "jsx", "tsx", "react"]
JS_PATTERNS = [
    r"import\s+.*from\s+['\"]",
    r"export\s+(default\s+)?",
    r"useState\s*\(",
    r"useEffect\s*\(",
    r"function\s+\w+\s*\(",
    r"const\s+\w+\s*=\s*\(",
    r"=>\s*\{",
    r"<\w+.*>.*</\w+>",
]
CONTINUES = [r"then\s*:", r"next\s*:", r"also\s*:", r"similarly\s*:", r"example\s*\d+", r"step\s*\d+"]
#: Blocks nearer than this belong together; a section's code, and a section, have at least so many characters.
NEAR, LEAST_CODE, LEAST_SECTION = 2000, 100, 500


def is_js_like(language: Column, code: Column) -> Column:
    found = F.lower(language).isin(JS_LANGUAGES)
    for p in JS_PATTERNS:
        found = found | code.rlike(p)
    return found


# --- sections: Python over Arrow batches ------------------------------------------------------------------------

_JS = [re.compile(p) for p in JS_PATTERNS]
_CONTINUES = re.compile("|".join(CONTINUES), re.IGNORECASE)
_MAJOR = re.compile(r"^#{1,2}\s+", re.MULTILINE)
_HEADER = re.compile(r"#{1,3}\s+")
_RULE = re.compile(r"-{3,}|\*{3,}|_{3,}")


def parts(text: str) -> Iterator[tuple[int, int, str]]:
    """Where each fenced part's opening fence starts, where its closing one does, and what stands between.

    A text that starts with a fence is read as if its first three characters weren't there; a fence without a partner opens
    no part.
    """
    at = 3 if text.strip().startswith(FENCE) else 0
    pieces = text[at:].split(FENCE)
    for i, piece in enumerate(pieces):
        if i % 2 and i < len(pieces) - 1:
            yield at - len(FENCE), at + len(piece), piece
        at += len(piece) + len(FENCE)


def labelled(part: str, most: int | None = None) -> tuple[str, str]:
    """Language and code of a part: its first line is a language if it is one word (of fewer than ``most`` characters)."""
    head, line, body = part.partition("\n")
    word = head.strip()
    named = bool(line) and bool(word) and " " not in word and (most is None or len(word) < most)
    return (word, body.strip()) if named else ("", part.strip())


def blocks(text: str | None, min_length: int = 1000) -> list[dict]:
    """The fenced blocks of at least ``min_length`` characters, with up to 1000 characters on each side."""
    out = []
    for start, end, part in parts(text or ""):
        language, code = labelled(part, 20)
        if len(part) >= min_length and len(code) >= min_length:
            before, after = text[max(0, start - CONTEXT) : start].strip(), text[end + len(FENCE) : end + len(FENCE) + CONTEXT].strip()
            out.append({"code": code, "language": language, "context_before": before, "context_after": after, "full_context": f"{before}\n\n{code}\n\n{after}"})
    return out


def code_blocks(text: Column, min_length: int = 1000) -> Column:
    @F.pandas_udf(schemas.CODE_BLOCKS)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: blocks(x, min_length))

    return run(text)


def positions(text: str) -> list[dict]:
    """Fenced blocks with at least 100 characters of code: start, end, language, code_length, is_js_like."""
    out = []
    for start, end, part in parts(text):
        language, code = labelled(part)
        if len(code) >= LEAST_CODE:
            js = language.lower() in JS_LANGUAGES or any(p.search(code) for p in _JS)
            out.append({"start": start, "end": end + len(FENCE), "language": language, "code_length": len(code), "is_js_like": js})
    return out


def _together(a: dict, b: dict, text: str) -> bool:
    if b["start"] - a["end"] < NEAR or (a["language"] and a["language"] == b["language"]) or (a["is_js_like"] and b["is_js_like"]):
        return True
    between = text[a["end"] : b["start"]]
    return bool(_CONTINUES.search(between)) or not _MAJOR.search(between)


def _start(text: str, at: int, reach: int) -> int:
    """From ``at`` back to the nearest header, or behind the nearest rule, within ``reach``."""
    lowest = max(0, at - reach)
    lines = text[lowest:at].split("\n")
    offset = at + 1
    for line in reversed(lines):
        offset -= len(line) + 1  # where the line starts
        if _HEADER.match(line.strip()):
            return offset
        if _RULE.match(line.strip()):
            return offset + len(line) + 1
    return lowest


def _stop(text: str, at: int, reach: int) -> int:
    """From ``at`` on to the next header or rule behind the sixth line, within ``reach``."""
    highest = min(len(text), at + reach)
    offset = at
    for i, line in enumerate(text[at:highest].split("\n")):
        if i > 5 and (_HEADER.match(line.strip()) or _RULE.match(line.strip())):
            return offset
        offset += len(line) + 1
    return highest


def sections(text: str | None, most: int = 4800) -> list[dict]:
    """Related code blocks with the text around them, cut at whole lines after ``most`` characters."""
    groups: list[list[dict]] = []
    for b in positions(text or ""):
        if groups and _together(groups[-1][-1], b, text):
            groups[-1].append(b)
        else:
            groups.append([b])
    out = []
    for g in groups:
        lo, hi = _start(text, g[0]["start"], most // 3), _stop(text, g[-1]["end"], most // 3)
        content = text[lo:hi]
        if len(content) > most:
            kept, size = [], 0
            for line in content.split("\n"):
                size += len(line) + 1
                if size > most:
                    break
                kept.append(line)
            content = "\n".join(kept)
        if len(content) >= LEAST_SECTION:
            named = Counter(b["language"] for b in g if b["language"])
            language = min(named, key=lambda x: (-named[x], x)) if named else ""  # of equally common ones the first by name
            out.append({"content": content, "code_blocks_count": len(g), "primary_language": language, "is_js_like": any(b["is_js_like"] for b in g), "total_code_length": sum(b["code_length"] for b in g), "section_start": lo, "section_end": hi})
    return out


def code_positions(text: Column) -> Column:
    @F.pandas_udf(schemas.CODE_POSITIONS)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: positions(x or ""))

    return run(text)


def code_sections(text: Column, most: int = 4800) -> Column:
    @F.pandas_udf(schemas.CODE_SECTIONS)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: sections(x, most))

    return run(text)
