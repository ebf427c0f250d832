"""Scalar functions, the chunker, code extraction and query handling."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import code as C
from quarry.functions import query as Q
from quarry.functions import text as T
from quarry.functions.chunking import chunks, with_chunks
from quarry.functions.stemming import stem


def value(spark, column, *args):
    df = spark.createDataFrame([args or ("",)], [f"c{i}" for i in range(max(1, len(args)))])
    return df.select(column(*[F.col(c) for c in df.columns])).first()[0]


# --- chunker ---


def test_chunker_hard_cuts_and_trivial_texts():
    assert [len(c) for c in chunks("A" * 10_000, 5000)] == [5000, 5000]
    assert chunks("") == [] and chunks(None) == [] and chunks(" \n ") == []
    assert chunks("a short one") == ["a short one"]


def test_chunker_prefers_sentences():
    out = chunks("We mined the stone. " * 300, 5000)
    assert len(out) == 2 and out[0].endswith(".")


def test_chunker_kinds_of_boundary():
    fence = "x" * 700 + "```" + "y" * 800
    assert len(chunks(fence, 1000)[0]) == 700
    early_paragraph = "a" * 100 + "\n\n" + "b" * 500 + ". " + "c" * 900
    assert len(chunks(early_paragraph, 1000)[0]) == 1000  # a paragraph too far ahead forbids the sentence
    words = "a" * 850 + " " + "b" * 900
    assert len(chunks(words, 1000)[0]) == 850
    assert len(chunks("a" * 700 + " " + "b" * 900, 1000)[0]) == 1000


def test_no_overlap_between_the_first_two_chunks():
    text = "".join(f"{i:04d} " for i in range(1000))
    out = chunks(text, 1000, 200)
    assert out[1][:4] not in out[0]
    assert out[2][:4] in out[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([" ", ". ", "\n\n", "\n", ""]), max_size=120), st.integers(8, 60), st.integers(0, 7))
def test_chunks_cover_every_character(ends, size, overlap):
    text = "".join("".join(chr(0x4E00 + 4 * i + k) for k in range(4)) + end for i, end in enumerate(ends))  # no letter twice
    at = 0
    seen = bytearray(len(text))
    for c in chunks(text, size, overlap):
        where = text.find(c, max(0, at - overlap - 3))
        assert where >= 0
        seen[where : where + len(c)] = b"\1" * len(c)
        at = where + len(c)
    assert all(s or ch.isspace() for s, ch in zip(seen, text, strict=True))


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "A" * 10_000), (2, ""), (3, None)], "id int, t string")
    assert sorted((r.id, r.chunk_number) for r in with_chunks(df, "t").collect()) == [(1, 1), (1, 2)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024  # whole texts are in a batch


# --- scalar functions ---


def test_section_info(spark):
    got = value(spark, T.section_info, "# One\ntext here\n## Two words\n### Three")
    assert tuple(got) == ("# One; ## Two words; ### Three", 38, 9)
    assert tuple(value(spark, T.section_info, "plain")) == ("", 5, 1)
    assert tuple(value(spark, T.section_info, "")) == ("", 0, 0)


@pytest.mark.parametrize(("url", "kind"), [("https://a.b/sitemap.xml", "sitemap"), ("https://a.b/sitemap/index.xml", "sitemap"), ("https://a.b/x.txt", "txt"), ("https://a.b/x.html", "page"), ("https://a.b/x.pdf", "page"), ("https://sitemap.b/x", "page")])
def test_url_kind(spark, url, kind):
    assert value(spark, T.url_kind, url) == kind


def test_netloc_and_fragment(spark):
    assert value(spark, T.netloc, "https://u:p@a.b:8080/x#y") == "u:p@a.b:8080"
    assert value(spark, T.netloc, "no url") == ""
    assert value(spark, T.defragmented, "https://a.b/x#y") == "https://a.b/x"


def test_truncation(spark):
    cut = lambda t: value(spark, lambda c: T.truncated(c, 100), t)
    assert cut("x" * 100) == "x" * 100
    assert cut("x" * 90 + ". " + "y" * 50) == "x" * 90 + "."
    assert cut("x" * 90 + "\n\n" + "y" * 50) == "x" * 90
    assert cut("x" * 50 + ". " + "y" * 80) == ("x" * 50 + ". " + "y" * 80)[:100]


def test_summaries_and_tags(spark):
    assert value(spark, T.without_think_tags, "a<think>b</think>c") == "abc"
    assert len(value(spark, T.clamped_summary, "s" * 600, "src")) == 503
    assert value(spark, T.clamped_summary, " ", "src") == "Content from src"
    assert value(spark, T.fence_language, "```python\nx\n```") == "python"
    assert value(spark, T.fence_language, "```\nx\n```") == "unknown"


# --- code ---

LONG = "value = compute(1)\n" * 8


def blocks(spark, md, n=10):
    return value(spark, lambda c: C.code_blocks(c, n), md)


def test_code_blocks(spark):
    got = blocks(spark, f"Before\n```python\n{LONG}```\nAfter\n```\n{LONG}```")
    assert [b.language for b in got] == ["python", ""]
    assert got[0].code == LONG.strip() and got[0].context_before == "Before" and got[0].context_after.startswith("After")
    assert got[0].full_context.startswith("Before\n\nvalue")


def test_code_blocks_length_and_odd_fences(spark):
    assert blocks(spark, f"a ```js\n{LONG}") == []
    assert [b.language for b in blocks(spark, f"t\n```py\nx\n```\n```js\n{LONG}```", 50)] == ["js"]


def test_code_blocks_skip_a_leading_fence(spark):
    md = f"```\n{LONG}```\ntext\n```\n"
    assert [b.code for b in blocks(spark, md, 1)] == ["text"]  # the fences pair from the second one on


def plain_blocks(md, least):
    """The rules, one step after the other."""
    places, at = [], 3 if md.strip().startswith("```") else 0
    while (p := md.find("```", at)) >= 0:
        places.append(p)
        at = p + 3
    out = []
    for a, b in zip(places[::2], places[1::2], strict=False):
        head, line, rest = md[a + 3 : b].partition("\n")
        named = line and head.strip() and " " not in head.strip() and len(head.strip()) < 20
        code = (rest if named else md[a + 3 : b]).strip()
        if len(code) >= least:
            out.append((code, head.strip() if named else "", md[max(0, a - 1000) : a].strip(), md[b + 3 : b + 1003].strip()))
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["```", "js\n", "\n", "word ", "x = 1\n", "a b\n", "."]), max_size=14))
def test_code_blocks_as_by_the_rules(spark, parts):
    md = "".join(parts)
    assert [(b.code, b.language, b.context_before, b.context_after) for b in blocks(spark, md, 1)] == plain_blocks(md, 1)


def test_sections():
    js = "const x = (a) => {\n  return a;\n}\n" * 6
    md = f"# Guide\nintro\n```js\n{js}```\ntext\n```jsx\n{js}```\nmore\n```js\n{js}```\n" + "tail line\n" * 60
    got = C.sections(md, 2000)
    assert len(got) >= 1 and all(500 <= len(s["content"]) <= 2000 for s in got)
    assert got[0]["is_js_like"] and got[0]["code_blocks_count"] == 3 and got[0]["primary_language"] == "js"
    assert C.sections("no code") == [] and C.sections(None) == []


def test_unrelated_far_blocks_are_two_sections():
    a, b = "select 1 from t;\n" * 10, "print('x')\n" * 20
    md = f"# A\n```sql\n{a}```\n" + "filler text\n" * 250 + f"# B\n```python\n{b}```\n" + "tail\n" * 200
    assert [s["primary_language"] for s in C.sections(md)] == ["sql", "python"]


# --- queries ---


@pytest.mark.parametrize(("query", "kind"), [("parse a function", "code"), ("how to cook", "how_to"), ("the server is broken", "troubleshooting"), ("what is a quarry", "conceptual"), ("red stones", "factual"), ("information", "code")])
def test_query_types(spark, query, kind):
    assert Q.type_of(query) == kind == value(spark, Q.query_type, query)


def test_expansion(spark):
    for q in ("how to cook", "how do i cook", "error in oven", "what is x", "red stones", "a function"):
        got = value(spark, lambda c: Q.expand(c, Q.query_type(c)), q)
        assert got == Q.expansions(q, Q.type_of(q)) and got[0] == q and len(set(got)) == len(got) <= 5


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="apiAPI .,!?-_é@#(\t", max_size=24))
def test_cleaning_in_both_forms(spark, query):
    assert value(spark, Q.clean, query) == Q.clean_text(query)


def test_terms():
    assert Q.clean_text("the  api,  json!") == "the API JSON!"
    assert Q.clean_text(".api") == "APIi"  # what follows the bare term's length is put back
    assert Q.process("") == ("", [], "factual")
    main, more, kind = Q.process("how to use git")
    assert (main, kind) == ("how to use Git", "how_to") and 0 < len(more) <= 5


class Fixed:
    def __init__(self, answer):
        self.answer = answer

    def complete(self, prompt):
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer


def test_model_rewordings():
    assert Q.enhanced("two words", "ctx", Fixed("one")) == "two words"
    assert Q.enhanced("two words", "ctx", Fixed("now three words")) == "now three words"
    assert Q.enhanced("two words", None, Fixed("now three words")) == "two words"
    assert Q.rephrasings("a b", Fixed("c d\n\na b\nsingle\ne f\ng h")) == ["a b", "c d", "e f"]
    assert Q.rephrasings("a b", Fixed(RuntimeError())) == ["a b"]


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("formaliti", "formal"), ("triplicate", "triplic"), ("adoption", "adopt"), ("controll", "control"), ("sky", "sky"), ("sized", "size"), ("generalizations", "general"), ("generously", "generous"), ("knackeries", "knackeri"), ("sensibiliti", "sensibl"), ("skies", "sky"), ("proceedings", "proceed"), ("hopefulness", "hope"), ("gaps", "gap"), ("gas", "gas"), ("kiwis", "kiwi"), ("replacement", "replac"), ("fluently", "fluentli"), ("geologist", "geologist"), ("cried", "cri"), ("tied", "tie"), ("naïves", "naïves")])
def test_stems(word, root):
    assert stem(word) == root
