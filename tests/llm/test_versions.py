"""Prefix tries, byte-level BPE and branch merges against plain versions, on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, branch_merge, prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- the prefix trie --------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    path = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path[c] = turns.get(base, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def words(k):
        return len(k[-1][1].encode().split()) if k else 0

    def below(k):
        out, todo = [], [k]
        while todo:
            x = todo.pop()
            out.append(x)
            todo += kids[x]
        return out

    out = []
    for k, m in members.items():
        sub = below(k)
        ends = sorted(c for c in m if len(path[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), sum(not kids[x] for x in sub), sum((len(members[x]) - 1) * words(x) for x in sub), sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def odd_turns():
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["hi there", "a b c", "x", ""])) for c in range(-45, 90) for t in range(r.randint(1, 5)) if c % 11]
    rows += [(c, 0, "user", "one common first turn") for c in range(200, 320)] + [(c, 1, "assistant", "same again") for c in range(200, 300)]
    rows += [(7000, t, "user", f"long {t % 3}") for t in range(900)]  # one conversation with a third of all rows
    return rows + [(1, None, None, None), (1, None, "user", None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, 0, "assistant", "tie"), (None, 1, "user", "nobody"), (400, 0, "user", "gone")]


@pytest.mark.parametrize("piece", [1 << 20, 3])
def test_trie_equals_a_plain_one(spark, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", piece)
    rows = odd_turns()
    df = spark.createDataFrame([(*x, 0, 0) for x in rows], TURNS + ", depth long, k1 long").repartition(5)
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=repr) == plain_trie(rows)


def test_trie_of_no_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    one = prefix_trie.trie(spark.createDataFrame([(400, 0, "user", "gone")], TURNS)).collect()
    assert sorted(map(tuple, one)) == plain_trie([(400, 0, "user", "gone")])


def test_running_totals_over_ranges(spark):
    rows = [(k, i, i % 7, i * 2654435761 % 1000) for k in (1, 2, 3) for i in range(1 if k == 2 else 400)]
    df = spark.createDataFrame(rows, "k long, i long, a long, b long").repartition(6)
    got = {(r.k, r.i): (r.a_run, r.b_run) for r in prefix_trie.running(df, "k", [df["i"]], ["a"], ["b"]).collect()}
    for k in (1, 2, 3):
        a = b = 0
        for _, i, x, y in [r for r in rows if r[0] == k]:
            a, b = a + x, b ^ y
            assert got[k, i] == (a, b)


# --- byte-level BPE ---------------------------------------------------------------------------------------------

PARTS = ["a", "b", "'", "l", "s", "e", "ve", " ", "  ", "\n", "\t", "1", "23", "!", "é", "ü", "中", "日本", "\U0001f600", "=", "==", "x" * 9, "a" * 70, "the", "\xa0", "　", "\x1c", "'ll", "'re", "\r\n"]


def library(c):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
@pytest.mark.parametrize("leaf", [(3, 4, 4), (4096, 32, 1024)])
def test_tree_equals_the_library(monkeypatch, name, leaf):
    for key, n in zip(("LEAF_CHARS", "LEAF_BYTES", "LONG_LEAF_BYTES"), leaf, strict=True):
        monkeypatch.setattr(bpe, key, n)
    c = bpe.Codec(bpe.vocabulary_path(name), bpe.default_pattern())
    want, r = library(c), random.Random(1)
    texts = ["".join(r.choice(PARTS[: r.choice([8, 13, len(PARTS)])]) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 1500, " " * 2000, "=" * 3000 + "x", "\n \n" * 500, "base64" * 300 + "QUJD" * 500, "".join(r.choice("abcdefgh") for _ in range(5000))]
    for t, (ids, counts) in zip(texts, c.encode_all(texts), strict=True):
        assert ids == want.encode_ordinary(t) and sum(counts) == len(ids) and c.decode(ids) == t.encode()


def test_joins_at_every_place():
    c = bpe.Codec(bpe.vocabulary_path(), bpe.default_pattern())
    text = "It's  we'll\n\n  they've x12 ½ naïve 日本語!!  \t aaaaaaaaaaaaaaaaaaaaaaaaaaa  "
    whole = c.encode(text)
    for i in range(len(text) + 1):
        assert c.join(c.encode(text[:i]), c.encode(text[i:])) == whole


def test_pattern_over_every_code_point():
    c = bpe.Codec(bpe.vocabulary_path(), bpe.default_pattern())
    want = library(c)
    for lo in range(0, 0x110000, 0x1000):
        points = [chr(i) for i in range(lo, lo + 0x1000) if not 0xD800 <= i < 0xE000]
        text = "".join(f"a{x}{x} {x}1{x}! {x} \n{x}" for x in points)
        assert c.encode(text)[0] == want.encode_ordinary(text)


@pytest.mark.parametrize("block", [None, 61])
def test_encoding_over_tasks(spark, make, corpus, block):
    rows = [*corpus.items(), (3, corpus[3]), (3, "another of the same id " * 20), (None, "no id"), (None, None)]
    c = bpe.Codec(bpe.vocabulary_path(), bpe.default_pattern())
    lib = library(c)
    want = []
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    df = make(rows).withColumn("ids", F.lit(1)).withColumn("node", F.lit(2))
    assert sorted(map(repr, map(tuple, bpe.digests(df, block=block).collect()))) == sorted(map(repr, want))
    assert bpe.digests(make([], 1), block=block).collect() == []
    decoded = sorted((r.doc_id or -1, bytes(r.decoded)) for r in bpe.decode(bpe.encode(df, block=block)).collect())
    assert decoded == sorted((i or -1, (t or "").encode()) for i, t in rows)


# --- the branch merge -------------------------------------------------------------------------------------------


def plain_merge(rows):
    code = lambda b, i, name: zlib.crc32(f"{b}:{'' if i is None else i}:{name}".encode()) % 17
    out, added = [], defaultdict(dict)
    for i, text, lang, source in rows:
        base = {"lang": lang or "", "source": source or ""}
        lines = (text or "").split("\n")
        row = {b: code(b, i, "row") for b in "LR"}
        for b, far in (("L", 1), ("R", 5)):
            if row[b] in (3, 4) and i is not None:
                made = (base["lang"], base["source"], "!" if row[b] == 3 else "?")
                old = added[-far - i].get(b)
                added[-far - i][b] = min(old, made) if old else made
        changes = {}
        for b in "LR":
            mine = {}
            for c, v in base.items():
                k = code(b, i, c)
                new = {0: "", 1: v + "!", 2: v + "?"}.get(k, v)
                if new != v:
                    mine[c] = new
            for n, v in enumerate(lines):
                k = code(b, i, n)
                if k < 3:
                    mine["line", n] = {0: None, 1: v + "!", 2: v + "?"}[k]
                elif k < 5:
                    mine["gap", n] = "!" if k == 3 else "?"
            changes[b] = mine
        clean = ee = ed = ii = 0
        if 0 in row.values():
            kept = [b for b in "LR" if row[b]]
            conflict = any(changes[b] for b in kept)
            clean, ed = int(not conflict), int(conflict)
            if row["L"] == 0 or not conflict:
                out.append((i, None, None, None, clean, 0, ed, 0))
                continue
            take = dict(changes["L"])
        else:
            for u in {**changes["L"], **changes["R"]}:
                both = u in changes["L"] and u in changes["R"] and changes["L"][u] != changes["R"][u]
                if not both:
                    clean += 1
                elif u[0] == "gap":
                    ii += 1
                elif None in (changes["L"][u], changes["R"][u]):
                    ed += 1
                else:
                    ee += 1
            take = {**changes["R"], **changes["L"]}
        merged = []
        for n, v in enumerate(lines):
            line = take.get(("line", n), v)
            merged += [] if line is None else [line]
            merged += [take["gap", n]] if ("gap", n) in take else []
        out.append((i, take.get("lang", base["lang"]), take.get("source", base["source"]), sha("\n".join(merged)), clean, ee, ed, ii))
    for i, by in added.items():
        differ = len(set(by.values())) > 1
        lang, source, text = by.get("L") or by["R"]
        out.append((i, lang, source, sha(text), int(not differ), 0, 0, int(differ)))
    return sorted(map(repr, out))


def test_merge_equals_a_plain_one(spark):
    r = random.Random(9)
    text = lambda: "\n".join(r.choice(["", "a", "b c", "é\t", "x" * 50]) for _ in range(r.randint(1, 30)))
    rows = [(i, text(), r.choice(["en", "", None, "fr"]), r.choice(["s1", None, "s1!"])) for i in range(-40, 800)]
    rows += [(900, None, None, None), (901, "", "en", "s"), (None, "a\nb\n", "en", "s"), (5, "other\ntext", "en", "s"), (902, "line\n" * 3000, "en", "s"), (2**63 - 1, "far", "en", "s"), (-(2**63), "far", "en", "s")]
    rows += [(903, "same\nrow", "en", "s")] * 40 + [(i, "\n".join("ab"), "en", "s") for i in range(1000, 1400)]
    df = spark.createDataFrame([(*x, 1, "v") for x in rows], "doc_id long, text string, lang string, source string, unit int, value string").repartition(4)
    want = plain_merge(rows)
    got = sorted(map(repr, map(tuple, branch_merge.digests(df).collect())))
    assert got == want
    assert branch_merge.digests(df.limit(0)).collect() == []


def test_units_of_other_versions(spark):
    """The sweep takes any units: here one line that both change, one gap, and a column."""
    key = (1, 0, 0)
    rows = [(-3, 0, ""), (-2, 0, "en"), (-1, 0, "s"), (0, 0, "one"), (2, 0, "two"), (0, 1, "ONE"), (0, 2, None), (1, 1, "in"), (1, 2, "between"), (-2, 2, "fr"), (2, 1, "2"), (2, 2, "2")]
    df = spark.createDataFrame([(*key, *x) for x in rows], "doc_id long, part int, hash long, unit long, branch int, value string")
    assert [tuple(r) for r in branch_merge.merge(df).collect()] == [(1, "fr", "s", "ONE\nin\n2", 2, 0, 1, 1)]


def test_every_new_query_is_registered():
    assert {"op11_conversation_prefix_trie", "op12_byte_bpe", "op13_branch_merge"} <= set(queries.queries())
