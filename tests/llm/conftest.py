from __future__ import annotations

import random

import pytest

from quarry.llm import quality_cnn

quality_cnn.STEPS = 400  # the tests' texts are few and easy

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> str:
    """Words that no other text has by chance, and some that all have."""
    return " ".join(r.choice(["the", "of", "and", "to", "in"]) if r.random() < 0.3 else "".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """documents from {id: text} or a list of (id, text), in several partitions."""

    def docs(rows, partitions=3):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return docs


@pytest.fixture(scope="session")
def corpus():
    """A small corpus with exact copies, near copies, shared passages, nulls, empty, short, long and repetitive texts."""
    r = random.Random(5)
    rows: dict[int | None, str | None] = {i: words(r, r.randint(30, 120)) for i in range(60)}
    passage = words(r, 60)
    for i in (3, 17, 29, 44):
        w = rows[i].split()
        rows[i] = " ".join([*w[:10], passage, *w[10:]])
    for i in range(60, 70):
        rows[i] = rows[i - 60]  # exact copies
    for i in range(70, 90):
        w = rows[i - 60].split() if i - 60 < 60 else rows[5].split()
        w[r.randrange(len(w))] = "changed"
        rows[i] = " ".join(w)
    for i in range(90, 130):
        w = rows[7].split()
        w[r.randrange(len(w))] = words(r, 1)
        rows[i] = " ".join(w)
    rows |= {130: "", 131: None, 132: " \t\n ", 133: "one", 134: "two words", 135: "rep " * 300, 136: "rep " * 200, 137: "x" * 5000, 138: words(r, 4000), 139: "the of and to in " * 5, 140: "É ñ ü — “quoted” \x0b tab\tend", 141: "\U0001f600 " * 30, 142: "\U0001f600 " * 30}
    return rows
