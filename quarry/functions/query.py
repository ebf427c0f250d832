"""Query cleaning, typing and expansion; as expressions for tables of queries, and as functions for one query."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.plans.models import LLM, NoLLM

# The usual case of technical terms.
TERMS = {
    "api": "API", "rest": "REST", "json": "JSON", "xml": "XML", "http": "HTTP", "https": "HTTPS", "sql": "SQL", "css": "CSS",
    "html": "HTML", "javascript": "JavaScript", "python": "Python", "react": "React", "vue": "Vue", "angular": "Angular",
    "node": "Node", "npm": "npm", "git": "Git", "github": "GitHub", "docker": "Docker", "kubernetes": "Kubernetes",
    "aws": "AWS", "gcp": "GCP", "azure": "Azure",
}

# Substrings that give a query its type; the first type with one of them counts.
TYPES = {
    "code": ["function", "method", "class", "variable", "import", "export", "const", "let", "var", "def", "async", "await", "return", "if", "else", "for", "while", "loop", "array", "object", "string", "number", "boolean", "null", "undefined", "syntax", "example code", "code example", "snippet"],
    "how_to": ["how to", "how do i", "how can i", "tutorial", "guide", "step by step", "walkthrough", "instructions", "setup", "install", "configure", "create", "build", "implement"],
    "troubleshooting": ["error", "issue", "problem", "bug", "fix", "solve", "troubleshoot", "debug", "not working", "broken", "failed", "exception", "crash", "stuck"],
    "conceptual": ["what is", "what are", "explain", "concept", "theory", "principle", "difference between", "comparison", "overview", "introduction", "basics", "fundamentals"],
}

# How each type's queries are varied. A pair replaces its first text by its second; {} is the query.
EXPANSIONS: dict[str, list] = {
    "code": ["code example {}", "implementation of {}", "syntax for {}", "{} tutorial"],
    "how_to": [("how to", "tutorial for"), ("how to", "guide for"), ("how do i", "steps to"), "example of {}"],
    "troubleshooting": [("error", "issue"), ("problem", "error"), "solution for {}", "fix {}", "resolve {}"],
    "conceptual": [("what is", "explanation of"), ("explain", "overview of"), "definition of {}", "introduction to {}"],
    "factual": [],
}
MOST = 5


def clean(query: Column) -> Column:
    """White space collapsed, other signs than word characters, - . ? ! blanked, technical terms in their usual case."""
    text = F.regexp_replace(F.regexp_replace(F.trim(query), r"(?U)\s+", " "), r"(?U)[^\w\s\-.?!]", " ")
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    terms = F.create_map(*[F.lit(x) for pair in TERMS.items() for x in pair])

    def cased(word: Column) -> Column:
        bare = F.regexp_replace(F.lower(word), r"^[.,!?;:]+|[.,!?;:]+$", "")
        # What follows the bare term's length is put back, wherever the signs stood.
        return F.coalesce(F.concat(F.try_element_at(terms, bare), F.substring(word, F.length(bare) + 1, F.length(word))), word)

    return F.array_join(F.transform(tokens, cased), " ")


def query_type(query: Column) -> Column:
    q = F.lower(query)
    out = None
    for kind, parts in TYPES.items():
        found = F.lit(False)
        for p in parts:
            found = found | q.contains(p)
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out.otherwise("factual")


def expand(query: Column, kind: Column) -> Column:
    """The query and its variations, without repeats, five at most."""

    def variant(v) -> Column:
        if isinstance(v, tuple):
            return F.replace(query, F.lit(v[0]), F.lit(v[1]))
        before, after = v.split("{}")
        return F.concat(F.lit(before), query, F.lit(after))

    out = F.array(query)
    for name, variants in EXPANSIONS.items():
        if variants:
            out = F.when(kind == name, F.array(query, *[variant(v) for v in variants])).otherwise(out)
    return F.slice(F.array_distinct(out), 1, MOST)


# --- one query, on the driver -----------------------------------------------------------------------------------


def clean_text(query: str) -> str:
    if not query.strip():
        return ""
    out = []
    for w in re.sub(r"[^\w\s\-.?!]", " ", re.sub(r"\s+", " ", query.strip())).split():
        bare = w.lower().strip(".,!?;:")
        out.append(TERMS[bare] + w[len(bare) :] if bare in TERMS else w)
    return " ".join(out)


def type_of(query: str) -> str:
    q = query.lower()
    return next((kind for kind, parts in TYPES.items() if any(p in q for p in parts)), "factual")


def expansions(query: str, kind: str) -> list[str]:
    variants = [query.replace(*v) if isinstance(v, tuple) else v.replace("{}", query) for v in EXPANSIONS[kind]]
    return list(dict.fromkeys([query, *variants]))[:MOST]


def enhanced(query: str, context: str | None, llm: LLM) -> str:
    """The model's rewording for the context, if it has as many words as the query."""
    if not context:
        return query
    try:
        out = llm.complete(f"Context: {context[:500]}...\n\nQuery: {query}\n\nReword the query so that it finds documents better. Answer with the query only.").strip()
    except Exception:
        return query
    return out if out and len(out.split()) >= len(query.split()) else query


def rephrasings(query: str, llm: LLM, count: int = 3) -> list[str]:
    """The query and the model's rewordings: one a line, two words or more, ``count`` at most; the query alone without a model."""
    try:
        lines = llm.complete(f"Give {count - 1} other wordings of this query, one a line: {query}").strip().split("\n")
    except Exception:
        return [query]
    found = dict.fromkeys([query, *(x.strip() for x in lines if x.strip())])
    return [q for q in found if len(q.split()) >= 2][:count]


def process(query: str, context: str | None = None, multi: bool = False, expansion: bool = True, llm: LLM | None = None) -> tuple[str, list[str], str]:
    """(main query, up to five more, type)."""
    llm = llm or NoLLM()
    cleaned = clean_text(query)
    if not cleaned:
        return query, [], "factual"
    kind = type_of(cleaned)
    main = enhanced(cleaned, context, llm)
    more = (expansions(main, kind)[1:] if expansion else []) + (rephrasings(main, llm)[1:] if multi else [])
    return main, [q for q in dict.fromkeys(more) if q != main][:MOST], kind
