"""Operators whose results are exact, against plain versions over the same texts."""

from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import class_lm, components, decontaminate, fm_index, license_scan, packing, simhash, substring_dedup, token_counts, tokens, winnow
from tests.llm.conftest import words

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(corpus):
    return sorted(((i, t) for i, t in corpus.items()), key=lambda x: x[0])


# --- 8: fingerprints ---


def plain_fingerprint(text, hashes, k=winnow.K, w=winnow.W):
    """Positions of kept hashes, given the hash of each k-gram."""
    kept = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        best = max(j for j in range(len(window)) if window[j] == min(window))
        if not kept or kept[-1] != i + best:
            kept.append(i + best)
    return kept


def rolled(hashes):
    """The cyclic polynomial of all of ``hashes``."""
    out = 0
    for h in hashes:
        out = ((out << 1) & (2**64 - 1) | out >> 63) ^ (h % 2**64)
    return out - 2**64 if out >> 63 else out


@pytest.mark.parametrize("k", [1, 3, 4, 6])
def test_fingerprints_by_the_rules(spark, make, corpus, k):
    df = make(corpus)
    got = {r.doc_id: r.fingerprint for r in winnow.fingerprints(df, k).collect()}
    tokens_ = df.select("doc_id", F.expr(r"transform(regexp_extract_all(lower(coalesce(text, '')), '\\S{1,8}', 0), x -> xxhash64(x))").alias("t")).collect()
    for r in tokens_:
        if not r.t:
            assert got[r.doc_id] == []
            continue
        h = [rolled(r.t[i : i + k]) for i in range(max(1, len(r.t) - k + 1))]
        assert [x.p for x in got[r.doc_id]] == plain_fingerprint(r.t, h, k)
        assert [x.h for x in got[r.doc_id]] == [h[x.p] for x in got[r.doc_id]]


def test_edits_and_neighbours(make, corpus):
    got = {r.doc_id: r for r in winnow.edit_likeness(make(corpus)).collect()}
    rows = rows_of(corpus)[::-1]
    assert len(got) == len(rows)
    fp = {i: frozenset(x.split(":")[1] for x in r.fingerprint.split()) for i, r in got.items()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (i, t), (j, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == pytest.approx(like(fp[i], fp[j]))
        assert r.near_edited == pytest.approx(like(fp[i], frozenset(x.split(":")[1] for x in r.edited_fingerprint.split())))
    assert got[0].fingerprint == got[60].fingerprint


def test_fingerprint_odd_tables(spark, make):
    assert winnow.edit_likeness(make({})).count() == 0
    one = winnow.edit_likeness(make({7: "abc def"})).first()
    assert one.near_next == 1.0 and one.n_chars == 7
    twice = winnow.edit_likeness(make([(1, "b c d e"), (1, "b c d e"), (None, "x"), (2, "z")]).withColumnRenamed("lang", "_b").withColumnRenamed("source", "_fp")).collect()
    assert len(twice) == 4
    ids = random.Random(0).sample(range(10**12), 200)
    rows = {i: f"text number {i}" for i in ids}
    got = {r.doc_id: r.edited_sha256 for r in winnow.edit_likeness(make(rows)).collect()}
    order = sorted(ids, reverse=True)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        n = len(rows[i])
        assert got[i] == hashlib.sha256((rows[i][: n - n // 3] + rows[j][: n // 3]).encode()).hexdigest()


def test_a_hot_id_is_cut_into_ranges(spark, make):
    """A third of all rows share an id: each range is read by itself, and every row still meets its next one."""
    rows = [(i % 200 if i % 3 else 77, f"text {i} of {i * i}") for i in range(900)]
    docs = make(rows)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / 256 for i in range(257)], 10_000)).first()[0]
    sizes = sorted(r["count"] for r in winnow._bucketed(docs, 512, bounds).groupBy("_b").count().collect())
    assert sizes[-1] < 30
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (-x[0], -hashed[x[1]]))
    got = sorted((r.doc_id, r.edited_sha256) for r in winnow.edit_likeness(docs).collect())
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)]
    assert got == sorted(want)


def test_ids_as_far_apart_as_can_be(spark, make):
    rows = [(None, "no id"), (2**63 - 1, "last"), (-(2**63), "first"), (0, "zero"), *((i, f"text {i}") for i in range(1, 3000))]
    got = {r.doc_id: r.edited_sha256 for r in winnow.edit_likeness(make(rows)).collect()}
    order = sorted((x for x in rows if x[0] is not None and x[0] > -(2**63)), reverse=True)
    for (i, t), (_, n) in zip(order, order[1:], strict=False):
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    assert len(got) == len(rows)


def test_fingerprint_plan_is_native(make, corpus):
    plan = winnow.edit_likeness(make(corpus))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 10: SimHash ---


def plain_simhash(text, k=3):
    w = SPACE.findall((text or "").encode().lower())
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, tau):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= tau:
                parent[find(a)] = find(b)
    least = {}
    for a, i in enumerate(ids):
        least[find(a)] = min(least.get(find(a), i), i)
    return {i: least[find(a)] for a, i in enumerate(ids)}


def test_near_duplicates(make, corpus):
    got = {r.doc_id: r for r in simhash.near_duplicates(make(corpus)).collect()}
    rows = rows_of(corpus)
    fps = [plain_simhash(t) for _, t in rows]
    want = plain_components([i for i, _ in rows], fps, 2)
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == {i: f for (i, _), f in zip(rows, fps, strict=True)}
    assert {i: r.component_id for i, r in got.items()} == want


def searched(spark, fps, tau, parts=None):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s, [s]) for s in signed], "node long, fps array<long>").repartition(3).cache()
    edges = simhash.links(nodes, parts or simhash.plan(nodes, 1, tau), tau)
    roots = {r.node: r.root for r in components.components(edges).collect()}
    return [roots.get(s, s) for s in signed]


def same_classes(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("hot", [False, True])
def test_links_of_a_ball(spark, monkeypatch, hot):
    """Fingerprints around a few centres, with buckets that must be split and without."""
    monkeypatch.setattr(simhash, "BUCKET", 8 if hot else 256)
    r = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            f = centre
            for _ in range(r.randint(0, 4)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    want = plain_components(list(range(len(fps))), fps, 2)
    assert same_classes(searched(spark, fps, 2), [want[i] for i in range(len(fps))])


@pytest.mark.parametrize("parts", [[(0, list(range(0, 32)), 2), (0, list(range(32, 64)), 0)], [(0, list(range(0, 21)), 0), (0, list(range(21, 42)), 0), (0, list(range(42, 64)), 0)]])
def test_any_allocation_finds_all_links(spark, parts):
    r = random.Random(9)
    fps = sorted({f ^ (1 << a) ^ (1 << b) for f in (r.getrandbits(64) for _ in range(40)) for a, b in ((0, 0), (r.randrange(64), r.randrange(64)), (r.randrange(64), r.randrange(64)))})
    want = plain_components(list(range(len(fps))), fps, 2)
    assert same_classes(searched(spark, fps, 2, parts), [want[i] for i in range(len(fps))])


def test_chains_across_the_parts_of_a_bucket(spark, monkeypatch):
    """One bucket of random walks: links between members of different parts that aren't leaders."""
    monkeypatch.setattr(simhash, "BUCKET", 8)
    r = random.Random(21)
    fps = set()
    for _ in range(12):
        f = r.getrandbits(48)
        for _ in range(40):
            fps.add(f)
            for b in r.sample(range(48), 4):
                f ^= 1 << b
    fps = sorted(fps)
    want = plain_components(list(range(len(fps))), fps, 4)
    assert same_classes(searched(spark, fps, 4, [(0, list(range(48, 64)), 0)]), [want[i] for i in range(len(fps))])


def test_allocation_is_the_cheapest():
    shares = [np.array([0.5, 0.1, 0.1, 0.3]), np.array([0.01, 0.1, 0.1, 0.79]), np.array([0.02, 0.1, 0.1, 0.78])]
    cost, _, t = simhash.allocate(shares, [3, 3, 3], 1000, 0)
    each = {-1: 0.0, 0: 1000.0, 2: 4000.0}
    price = lambda ts: sum(each[x] + (5e5 * s[: x + 1].sum() / 20 if x >= 0 else 0) for x, s in zip(ts, shares, strict=True))
    options = [(a, b, c) for a in each for b in each for c in each if a + b + c >= 0]
    assert cost == pytest.approx(min(map(price, options))) and price(t) == pytest.approx(cost) and t[0] == -1


def test_distance_shares():
    r = np.random.default_rng(0)
    x = r.integers(0, 256, 400)
    counts = np.zeros((8, 256), int)
    counts[0] = np.bincount(x, minlength=256)
    apart = np.bitwise_count((x[:, None] ^ x[None]) & 0b111).ravel()
    assert np.allclose(simhash.distance_shares(counts, range(0, 3)), np.bincount(apart, minlength=4) / len(apart))


def plain_jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("bucket", [8, 256])
def test_one_of_each_group_stays(spark, make, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(11)
    rows, group = {}, {}
    for g in range(40):
        base = words(r, r.randint(120, 300)).split()
        for c in range(1 if g % 2 else 12):
            i = g + 100 * c
            w = list(base)
            for _ in range(c % 3):
                w[r.randrange(len(w))] = words(r, 1)
            rows[i], group[i] = " ".join(w), g
    out = simhash.without_near_duplicates(make(rows).withColumn("node", F.lit(1)))
    kept = [x.doc_id for x in out.collect()]
    assert sorted(kept) == list(range(40)) and out.columns[-1] == "node"


@pytest.mark.parametrize("kind", ["appended", "inserted", "scattered"])
def test_pairs_over_the_bound_share_a_key(kind):
    r = random.Random(13)
    shared = 0
    for _ in range(300):
        base = words(r, r.randint(100, 250)).split()
        if kind == "scattered":
            w = list(base)
            while plain_jaccard(" ".join(base), " ".join(w)) > 0.85:
                w[r.randrange(len(w))] = words(r, 1)
        else:
            at = len(base) if kind == "appended" else r.randrange(len(base))
            w = [*base[:at], *words(r, round(len(base) * 0.18)).split(), *base[at:]]
        keys = [simhash.band_keys(np.unique(simhash.shingle_hashes(" ".join(x).encode().split(), 5)), simhash.bands(0.8)) for x in (base, w)]
        shared += any(a == b for a, b in zip(*keys, strict=True))
    assert shared >= 299


@pytest.mark.parametrize("bucket", [8, 256])
def test_pairs_within_the_radius_go_without_a_band_key(make, monkeypatch, bucket):
    """The pigeonhole search over SimHash bits finds these by itself: no two texts share a band key here."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    alone = iter(range(1 << 40))
    monkeypatch.setattr(simhash, "band_keys", lambda hashes, n: [int(x) for x in np.random.default_rng(int(hashes.sum() % (1 << 62)) if len(hashes) else next(alone)).integers(-(1 << 62), 1 << 62, n)])
    r = random.Random(15)
    rows, pairs = {}, []
    for i in range(60):
        w = words(r, r.randint(900, 1100)).split()
        rows[i] = " ".join(w)
        w[r.randrange(len(w))] = words(r, 1)
        rows[100 + i] = " ".join(w)
        fps = [simhash.majority(np.unique(simhash.shingle_hashes(t.lower().encode().split(), 5))) for t in (rows[i], rows[100 + i])]
        pairs += [i] if (fps[0] ^ fps[1]).bit_count() <= simhash.RADIUS else []
    kept = {x.doc_id for x in simhash.without_near_duplicates(make(rows)).collect()}
    assert len(pairs) > 30 and kept >= set(range(60)) and not kept & {100 + i for i in pairs}
    assert kept == set(rows) - {100 + i for i in pairs}


def test_copies_with_appended_text_go(make):
    r = random.Random(14)
    rows = {i: words(r, r.randint(150, 250)) for i in range(100)}
    for i in range(100):
        rows[100 + i] = rows[i] + " " + words(r, round(len(rows[i].split()) * 0.12))  # a similarity of some 0.89
    kept = {x.doc_id for x in simhash.without_near_duplicates(make(rows)).collect()}
    assert kept >= set(range(100)) and len(kept) <= 103


def test_texts_that_only_share_words_stay(make):
    r = random.Random(12)
    vocabulary = [words(r, 1) for _ in range(60)]
    rows = {i: " ".join(r.choice(vocabulary) for _ in range(150)) for i in range(60)}
    assert simhash.without_near_duplicates(make(rows)).count() == 60


def test_near_duplicates_odd_tables(make):
    assert simhash.near_duplicates(make({})).count() == 0 and simhash.without_near_duplicates(make({})).count() == 0
    got = simhash.near_duplicates(make([(5, None), (4, ""), (3, "  "), (9, "a b c"), (9, "a b c"), (None, "q r s t")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, None), (3, 3), (4, 3), (5, 3), (9, 9), (9, 9)]
    assert simhash.without_near_duplicates(make([(9, "a b c"), (9, "a b c"), (8, "other words here"), (None, "q r s t"), (None, None)])).count() == 5


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[501] == 500
    assert components.components(edges.limit(0)).count() == 0


# --- 5: substring dedup ---


def plain_removal(rows):
    """{id: (words, removed, sha256)} of [(id, text)], each id once."""
    first = {}
    split = {i: SPACE.findall((t or "").encode()) for i, t in rows}
    for i in sorted(split):
        for j in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][j : j + 13]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substring_dedup(make, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(make(corpus)).collect()}
    assert got == plain_removal(rows_of(corpus))
    assert sum(n for _, n, _ in got.values()) > 1000


@pytest.mark.parametrize("uneven", [False, True])
def test_substring_dedup_of_mixed_passages(make, monkeypatch, uneven):
    if uneven:  # every shard of more than two pieces is built several times
        monkeypatch.setattr(substring_dedup, "PIECES", 2)
        monkeypatch.setattr(substring_dedup, "UNEVEN", 0)
    # few words, so that windows stand in many documents in many orders, and anchors' owners often lack them
    r = random.Random(4)
    blocks = [" ".join(r.choice("abcdef") for _ in range(r.randint(5, 20))) for _ in range(12)]
    rows = {i: " ".join(r.choice(blocks) for _ in range(r.randint(1, 8))) for i in range(80)}
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.digests(make(rows)).collect()}
    assert got == plain_removal(list(rows.items()))


def test_substring_dedup_odd_tables(make):
    assert substring_dedup.digests(make({})).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.digests(make([(1, text), (1, text), (1, "other " + text), (None, text), (3, text), (2, None)])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in got) == [(-1, 30, 0), (1, 30, 0), (1, 30, 0), (1, 31, 0), (2, 0, 0), (3, 30, 30)]


def test_texts_without_repeats(make):
    text = " ".join(f"w{i}" for i in range(30))
    out = substring_dedup.without_repeats(make({1: text + "  tail", 2: "head\n" + text + " end", 3: None, 4: "a  b"}))
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (text + "  tail", len(text) + 6), 2: ("head end", 8), 3: (None, None), 4: ("a  b", 4)} and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("steps", [0, 5, 160])
@settings(max_examples=40, deadline=None)
@given(data=st.data())
def test_fm_index(steps, data):
    fm_index.STEPS = steps
    r = random.Random(data.draw(st.integers(0, 10**6)))
    segments = [[r.randint(1, 3) for _ in range(r.randint(1, 25))] for _ in range(r.randint(1, 6))]
    owners = [r.randint(0, 4) for _ in segments]
    text = np.array([x for s in segments for x in [*s, 0]])
    index = fm_index.FMIndex(text, np.concatenate([np.full(len(s) + 1, o) for s, o in zip(segments, owners, strict=True)]))
    patterns = [np.array([r.randint(-1, 4) for _ in range(r.randint(1, 20))]) for _ in range(6)] + [np.array(segments[0])]
    most = np.array([r.randint(-1, 5) for _ in patterns])
    hit, first = fm_index.long_matches(index, patterns, most, 4)
    for p, m, a in zip(patterns, most, first, strict=True):
        got = hit[a : a + max(0, len(p) - 3)]
        has = lambda w, m=m: any(o <= m and any(s[j : j + 4] == w for j in range(len(s) - 3)) for s, o in zip(segments, owners, strict=True))
        assert got.tolist() == [has(p[i : i + 4].tolist()) for i in range(max(0, len(p) - 3))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array(text):
    assert fm_index.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


# --- 6: licences ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def template(label, short=False):
    return sorted((x for name, _, x in license_scan.TEMPLATES if name == label), key=len)[0 if short else -1]


def test_licences(make, corpus):
    bsd = template("bsd").split()
    extra = {200: "Released under the MIT License. And UNDER THE MIT-LICENSE again", 201: "Licensed under the Apache License, Version 2.0.", 202: "Licensed under CC BY-NC 4.0, cc by nc", 203: template("bsd") + " more", 204: "under the mit", 205: "apache license version 2 apache license version 2", 206: "under the mit license cc by nc"}
    extra |= {207: "Licensed under the Apache License, Version 1.1", 208: " ".join([*bsd[:10], *bsd[:5], *bsd[10:]]), 209: f"{template('mit')} text between {template('isc')}", 210: template("bsd-3"), 211: template("bsd-2"), 212: template("mit").replace("copyright notice", "notice of copyright").replace("TORT", "tort law")}
    extra |= {213: f"{template('mit')} then {template('mit')}", 214: template("gpl-3").replace("version 3", "version 2"), 215: "word " * 60_000 + template("zlib"), 216: template("gpl-3").replace("Public", "Public Private")}
    rows = corpus | extra
    docs = make([*rows.items(), (210, extra[210])]).withColumnsRenamed({"lang": "labels", "source": "spans"})
    found = license_scan.scan(docs).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + 1
    for i, t in rows.items():
        w = WORD.findall((t or "").translate(LOWER))
        hits = [(j, label) for p, label in license_scan.PHRASES.items() for n in [len(p.split())] for j in range(len(w) - n + 1) if w[j : j + n] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
    want = {203: "bsd", 204: "", 206: "cc-by-nc,mit", 207: "", 208: "bsd", 209: "isc,mit", 210: "bsd-3", 211: "bsd-2", 212: "mit", 213: "mit", 214: "gpl-2", 215: "zlib", 216: "gpl-3"}
    assert {i: got[i].labels for i in want} == want
    assert got[208].score == 1.0 and [(s.label, s.start, s.end) for s in got[208].spans] == [("bsd", 0, len(bsd) + 5)]
    assert len(got[213].spans) == 2 and got[215].spans[0].start == 60_000 and 0.6 < got[212].score < 1
    assert all(got[i].labels == "" for i in range(60))
    assert license_scan.scan(make({})).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=4, max_size=14), min_size=1, max_size=3), st.lists(st.sampled_from("abcd"), max_size=28), st.integers(0, 3))
def test_chains_cover_the_most(templates, text, gap):
    """Anchors are all maximal runs at all their places; no other sequence of them covers more."""
    license_scan.GAP, was = gap, license_scan.GAP
    try:
        scanner = license_scan.Scanner([(str(i), t[0], " ".join(t)) for i, t in enumerate(templates)], {})
        words_, words_of = [w.encode() for w in text], [[w.encode() for w in t] for t in templates]
        anchors = scanner.automaton.anchors(scanner.automaton.scan(words_)[0])
        longest = [max((n for n in range(i + 2) for t in words_of for j in range(len(t) - n + 1) if words_[i + 1 - n : i + 1] == t[j : j + n]), default=0) for i in range(len(words_))]
        ends = [i + 1 for i, n in enumerate(longest) if n >= 4 and (i + 1 == len(longest) or longest[i + 1] != n + 1)]
        for k, t in enumerate(words_of):
            want = [(e, j + longest[e - 1], longest[e - 1]) for e in ends for j in range(len(t) - longest[e - 1] + 1) if t[j : j + longest[e - 1]] == words_[e - longest[e - 1] : e]]
            assert sorted(anchors.get(k, [])) == sorted(want)

            def most(covered, last, left):
                out = covered
                for i, (e, p, n) in enumerate(left):
                    more = n if last is None else min(n, e - last[0], p - last[1])
                    if more > 0 and (last is None or last[0] >= e - n - gap):
                        out = max(out, most(covered + more, (e, p), left[i + 1 :]))
                return out

            if len(want) <= 9:
                total, chain = license_scan.best_chain(anchors.get(k, []))
                assert total == most(0, None, sorted(want)) and all(x in want for x in chain)
    finally:
        license_scan.GAP = was


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30))
def test_matching_statistics(templates, text):
    a = license_scan.Automaton(templates, [])
    held = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    longest = [max((n for n in range(i + 1) if tuple(text[i - n + 1 : i + 1]) in held or n == 0), default=0) for i in range(len(text))]
    longest = [max(n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in held) for i in range(len(text))]
    ends = {end: size for end, size, _ in a.scan(text)[0]}
    for i, n in enumerate(longest):
        if n >= license_scan.SHORTEST and (i + 1 == len(text) or longest[i + 1] != n + 1):
            assert ends[i + 1] == n
        else:
            assert i + 1 not in ends


# --- 7: language model ---


@pytest.mark.parametrize("head", [None, 20])
def test_language_model(spark, make, corpus, monkeypatch, head):
    if head:
        monkeypatch.setattr(class_lm, "HEAD", head)
        monkeypatch.setattr(class_lm, "UNITS", 1000)
    got = {r.doc_id: r for r in class_lm.score(make(corpus)).collect()}
    counts = collections.Counter()
    split = {i: SPACE.findall((t or "").encode().lower()) for i, t in corpus.items()}
    for i, w in split.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*w, None])
    n, v = sum(counts.values()), len(counts)
    for i, w in split.items():
        r, toks = got[i], [*w, None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks), sum(counts[x] > 0 for x in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in toks))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.score < 0
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def with_train(docs):
    return docs.withColumn("train", F.lit(True))


def test_model_probabilities_sum_to_one(make, corpus):
    """Over the known words of a class and its one symbol for all unseen ones."""
    model, counts, _ = class_lm.fit(with_train(make(corpus)))
    assert np.allclose((10**model.step).sum(1), 1)
    total = collections.Counter()
    for r in counts.collect():
        place = np.flatnonzero(model.head.hashes == r.h)
        c = int(model.class_of[place[0] if len(place) else model.head.limit + r.g])
        total[c] += (r.c - model.discount) / 10 ** model.class_size[c]
    for c, share in total.items():
        assert share + 10 ** (model.unseen[c] - model.class_size[c]) == pytest.approx(1)


@pytest.mark.parametrize(("head", "units"), [(None, None), (None, 5), (60, 20), (15, 1000)])
def test_scores_are_those_of_the_model(make, corpus, monkeypatch, head, units):
    """The score of each text, added up word by word from the model's own tables."""
    for name, value in (("HEAD", head), ("UNITS", units)):
        if value:
            monkeypatch.setattr(class_lm, name, value)
    docs = make(corpus).withColumn("train", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"))
    model, counts, _ = class_lm.fit(docs)
    c = {r.h: r for r in counts.collect()}
    place = {int(h): i for i, h in enumerate(model.head.hashes)}
    got = {r.doc_id: r.score for r in class_lm.score(make(corpus)).collect()}
    for i, t in corpus.items():
        before, total = int(model.class_of[-1]), 0.0
        for w in SPACE.findall((t or "").encode().lower()):
            h = class_lm.word_hash(w)
            k = int(model.class_of[place.get(h, model.head.limit + class_lm.shape(w))])
            seen = math.log10(c[h].c - model.discount) if h in c else float(model.unseen[k])
            total += float(model.step[before, k]) - float(model.class_size[k]) + seen
            before = k
        total += float(model.step[before, int(model.class_of[-1])])
        assert got[i] == pytest.approx(total)


def test_rounds_choose_the_best_class_of_each_word(make, monkeypatch):
    """Each word beyond the units goes where plain counting over all texts says the likelihood gains most."""
    monkeypatch.setattr(class_lm, "UNITS", 4)
    r = random.Random(2)
    vocabulary = [words(r, 1) for _ in range(30)]
    texts = {i: " ".join(r.choice(vocabulary[i % 3 :: 2]) for _ in range(25)) for i in range(40)}
    docs = with_train(make(texts))
    counts = class_lm.word_counts(docs).orderBy(F.desc("c"), "h").toPandas()
    head = class_lm.Head(counts["h"].to_numpy(), counts["c"].to_numpy(), counts["g"].to_numpy().astype(int), 20)
    head = class_lm.Head(head.hashes[:20], head.counts[:20], head.groups[:20], 20)
    codes = class_lm.encoded(docs, head)
    of = np.arange(head.end + 1) % 5
    of[-1] = 5
    table = class_lm.bigrams(codes, of)
    got = class_lm.reassigned(codes, of, table)
    pairs = class_lm.bigrams(codes, np.arange(head.end + 1))
    assert np.array_equal(pairs.sum(0)[:20], head.counts)
    for u in range(head.end):
        if u < 4 or not pairs[u].sum() + pairs[:, u].sum():
            assert got[u] == of[u]
            continue
        value = []
        for k in range(5):
            moved = of.copy()
            moved[u] = k
            one = np.eye(6)[moved]
            value.append(class_lm.likelihood(one.T @ pairs @ one))
        assert value[got[u]] == pytest.approx(max(value))


def likelihood(pairs, of, classes):
    one = np.zeros((len(of), classes))
    one[np.arange(len(of)), of] = 1
    t = one.T @ pairs @ one
    h = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return h(t) - h(t.sum(0)) - h(t.sum(1))


def test_exchange_ends_where_no_move_helps():
    r = np.random.default_rng(0)
    pairs = np.zeros((13, 13))
    for _ in range(4000):  # units of two kinds, which mostly follow the other kind; the last unit is the end
        a, b = int(r.integers(0, 6)) * 2, int(r.integers(0, 6)) * 2 + 1
        pairs[a, b] += 1
        pairs[(b, a) if r.random() < 0.8 else (b, int(r.integers(0, 13)))] += 1
    of = class_lm.exchange(pairs, 4, 50)
    best = likelihood(pairs, of, 4)
    start = np.append(np.arange(12) % 3, 3)
    assert of[12] == 3 and best > likelihood(pairs, start, 4)
    for u in range(12):
        for c in range(3):
            moved = of.copy()
            moved[u] = c
            assert likelihood(pairs, moved, 4) <= best + 1e-6


def test_language_model_odd_tables(make):
    assert class_lm.score(make({})).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = class_lm.score(make({held: "never seen"})).first()  # nothing to learn from
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0) and math.isfinite(r.score)
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "a"), (3, "long " * 50_000)]
    got = class_lm.score(make(rows).withColumnsRenamed({"lang": "train", "source": "h", "n_chars": "codes"})).collect()
    learnt = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 or i is None]
    assert len(got) == 5 and {x.train_tokens for x in got} == {sum(len((t or "").split()) + 1 for t in learnt)}
    assert {x.n_tokens for x in got} == {3, 1, 2, 50_001} and len({x.score for x in got if x.doc_id == 1}) == 1


# --- 9: packing, 3: token counts ---

VOCABULARY = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def slow():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_tokens(corpus, slow):
    fast = tokens.Tokens(VOCABULARY)
    assert fast.fast is not None
    for t in [*corpus.values(), "a<|endoftext|>b", "  spaces   and\r\n\tends. "]:
        assert fast.encode(t).tolist() == slow.encode(t or "", add_special_tokens=False).ids
    assert 50256 not in tokens.Tokens(VOCABULARY, special=False).encode("a<|endoftext|>b").tolist()


def test_both_libraries_agree_on_every_code_point(slow):
    fast = tokens.Tokens(VOCABULARY)
    assert fast.fast is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 512):
        part = [chr(c) for c in points[lo : lo + 512]]
        for t in ("".join(part), " ".join(part), "".join(f"a{c}1{c}." for c in part), "".join(f"  {c}{c}\n" for c in part)):
            assert fast.encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids, hex(points[lo])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_both_libraries_agree(text):
    fast = tokens.tokens(VOCABULARY)
    assert fast.encode(text).tolist() == fast.slow.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids


def plain_cost(at, penalty, cuts, limit, powers):
    total, prev = 0, 0
    for c in cuts:
        n = c - prev
        assert 0 < n <= limit
        total += (0 if n in powers else limit - n) + penalty[at.index(c)]
        prev = c
    assert prev == at[-1]
    return total


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 9)), min_size=1, max_size=14))
def test_cuts_are_the_cheapest(steps):
    at, penalty = [0], [0]
    for gap, p in steps:
        at.append(at[-1] + gap)
        penalty.append(p)
    limit, powers = 12, (2, 4, 8)
    best = [0] + [math.inf] * len(steps)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= limit:
                best[j] = min(best[j], best[i] + (0 if n in powers else limit - n) + penalty[j])
    assert plain_cost(at, penalty, packing.best_cuts(at, penalty, limit, powers), limit, powers) == best[-1]


@pytest.mark.parametrize("block", [None, 3000])
def test_packing(spark, make, corpus, slow, monkeypatch, block):
    if block:
        monkeypatch.setattr(packing.Packer.__init__, "__defaults__", (packing.LIMIT, block))
    rows = [r for r in packing.pack(make(corpus), with_ids=True).collect()]
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    assert docs.keys() == corpus.keys()
    for i, t in corpus.items():
        want = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in got) == want.tobytes() and {r.doc_tokens for r in got} == {len(want)}
        assert [r.start for r in got] == np.cumsum([0, *[r.length for r in got]])[:-1].tolist()
    size = {}
    for s, parts in sequences.items():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        size[s] = sum(r.length for r in parts)
        assert size[s] <= 1024 and {r.sequence_tokens for r in parts} == {size[s]}
    total = sum(size.values())
    pad = sum(1024 - n for n in size.values() if n & (n - 1))
    assert pad < 0.05 * total + 3 * 1024  # at most one more window for each of three partitions


def test_packing_odd_tables(make):
    assert packing.pack(make({})).count() == 0
    got = packing.pack(make([(1, None), (1, ""), (None, "a")], 1)).collect()
    assert sorted(r.doc_tokens for r in got) == [1, 1, 2] and len({r.sequence_id for r in got}) == 1


def test_token_counts(make, corpus, slow, monkeypatch):
    monkeypatch.setattr(token_counts.write_token_blocks, "__defaults__", (None, 64, token_counts.SEPARATOR))
    got = {r.doc_id: r.n_tokens for r in token_counts.count(make(corpus | {900: "a<|endoftext|>b"})).collect()}
    slow.encode_special_tokens = True
    try:
        assert got == {i: len(slow.encode(t or "", add_special_tokens=False).ids) for i, t in (corpus | {900: "a<|endoftext|>b"}).items()}
    finally:
        slow.encode_special_tokens = False
    assert token_counts.count(make({})).count() == 0


def test_token_counts_odd_tables(spark, make, tmp_path, monkeypatch):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d e"), (2, None), (3, ""), (4, "word " * 60_000)]
    docs = make(rows).withColumnsRenamed({"lang": "file", "source": "ids", "n_chars": "ordinal"})
    got = token_counts.count(docs).collect()
    size = lambda t: len(tokens.Tokens(VOCABULARY, special=False).encode(t))
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, size(t)) for i, t in rows)
    many = spark.range(0, 100_000, 1, 2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("").alias("text"))
    assert token_counts.count(many).agg(F.count("*"), F.sum("n_tokens"), F.count_distinct("file", "ordinal")).first()[:] == (100_000, 33_334, 100_000)
    wide = json.load(open(VOCABULARY))  # a vocabulary whose ids need more than two bytes
    wide["added_tokens"] = [{**wide["added_tokens"][0], "content": "<far>", "id": 70_000, "special": False}]
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(wide))
    assert token_counts.width_of(str(path)) == "<u4" and token_counts.width_of(VOCABULARY) == "<u2"
    assert [r.n_tokens for r in token_counts.count(make({5: "a <far> b"}), str(path)).collect()] == [len(tokens.Tokens(str(path), special=False).encode("a <far> b"))]


def test_a_block_of_separators_alone(spark):
    n = token_counts.BLOCK_IDS
    df = spark.createDataFrame([(1, 0, np.zeros(n, "<u2").tobytes())], "file long, block long, ids binary")
    out = token_counts.scan(df, 0).agg(F.count("*"), F.sum("n_tokens"), F.min("start"), F.max("start"), F.count_distinct("ordinal")).first()
    assert out[:] == (n, 0, 0, n - 1, n)


@pytest.mark.parametrize("group", [1, 3, 1024])
@pytest.mark.parametrize("block", [1, 4, 7, 50, 1000])
def test_separator_scan(spark, monkeypatch, group, block):
    monkeypatch.setattr(token_counts, "GROUP", group)
    r = np.random.default_rng(block)
    rows, want = [], []
    for file, n in ((3, 200), (8, 1), (9, 64)):
        ids = r.integers(0, 6, n).astype("<u2")
        ids[20:70] = 4
        if file == 9:
            ids[-1] = 0
        start = ordinal = 0
        for i in np.flatnonzero(ids == 0):
            want.append((file, ordinal, int(i) - start, start, True))
            start, ordinal = int(i) + 1, ordinal + 1
        if start < n:
            want.append((file, ordinal, n - start, start, False))
        rows += [(file, k, ids[lo : lo + block].tobytes()) for k, lo in enumerate(range(0, n, block))]
    df = spark.createDataFrame(rows, "file long, block long, ids binary").repartition(4)
    assert sorted(map(tuple, token_counts.scan(df, 0).collect())) == sorted(want)


def test_flat_files(spark, tmp_path):
    ids = np.array([5, 6, 0, 7, 0, 0, 8, 9], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_counts.scan(token_counts.read_flat_files(spark, str(tmp_path), 3), 0).collect()
    assert sorted((r.ordinal, r.n_tokens, r.start, r.ended) for r in got) == [(0, 2, 0, True), (1, 1, 3, True), (2, 0, 5, True), (3, 2, 6, False)]
    broken = spark.createDataFrame([(1, 0, b"abc")], "file long, block long, ids binary")
    with pytest.raises(Exception, match="whole ids"):
        token_counts.scan(broken).collect()


# --- 2: decontamination ---


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=90), st.text(alphabet="abc", max_size=60))
def test_myers(item, text):
    item, text = item.encode(), text.encode()
    want = plain_distance(item, text)
    got, end = decontaminate.least_distance(item, text, len(item))
    assert got == want
    if end >= 0:
        assert plain_distance(item, text[:end]) == want


def test_contaminated(spark, make):
    r = random.Random(6)
    items = {k: words(r, 35) for k in range(12)}
    items[12], items[13], items[14], items[15] = "short item", None, "", items[0]
    rows = {i: words(r, 150) for i in range(60)}

    def planted(i, text):
        w = rows[i].split()
        rows[i] = " ".join([*w[:40], text, *w[40:]])

    def edited(text, edits):
        t = list(text)
        for _ in range(edits):
            t[r.randrange(len(t))] = r.choice("nopqrst")
        return "".join(t)

    planted(3, items[1])
    planted(4, items[2].upper().replace(" ", ",\n"))
    planted(5, edited(items[3], int(len(items[3]) * decontaminate.RATE)))
    planted(6, edited(items[4], len(items[4]) // 3))
    planted(7, "a Short, item here")
    planted(8, "shorter short items")  # no whole words
    planted(9, items[0])
    rows |= {100: None, 101: "", 102: items[5]}
    df = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(make(rows), df).collect()}
    want = {}
    for i, t in rows.items():
        for k, item in items.items():
            body = decontaminate.folded(item)
            if body:
                d = plain_distance(body, decontaminate.folded(t))
                if d <= int((len(body) - 2) * decontaminate.RATE):
                    want[i, k] = d
    assert got == want and {3, 4, 5, 7, 9, 102} == {i for i, _ in got}
    left = decontaminate.without_contaminated(make(rows), df)
    assert {x.doc_id for x in left.collect()} == rows.keys() - {3, 4, 5, 7, 9, 102} and left.columns == make(rows).columns


def test_items_of_every_length_have_the_same_rate(spark, make):
    r = random.Random(16)
    items = {n: "".join(r.choice("abcdefgh") for _ in range(n)) for n in range(1, 60)}
    docs = {}
    for n, item in items.items():
        for e in range(4):
            changed = list(item)
            for at in r.sample(range(n), min(n, e)):
                changed[at] = "z"
            docs[10 * n + e] = f"some words {''.join(changed)} and more words"
    df = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.distance, x.item_bytes) for x in decontaminate.contaminated(make(docs), df).collect()}
    for n in items:
        for e in range(4):
            d = plain_distance(f" {items[n]} ", f" {docs[10 * n + e]} ")  # words alone, as they are folded to themselves
            assert got.get((10 * n + e, n)) == ((d, n) if d <= int(n * decontaminate.RATE) else None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=40), max_size=5), st.lists(st.text(alphabet="ab .", max_size=60), max_size=6), st.sampled_from([16, 1 << 20]))
def test_pieces_miss_no_item(items, texts, at_a_time):
    decontaminate.SEARCHED, was = at_a_time, decontaminate.SEARCHED
    try:
        found = decontaminate.Finder(list(enumerate(items))).find_all(texts)
    finally:
        decontaminate.SEARCHED = was
    for t, got in zip(texts, found, strict=True):
        want = {}
        for i, item in enumerate(items):
            body = decontaminate.folded(item)
            d = plain_distance(body, decontaminate.folded(t)) if body else None
            if body and decontaminate.folded(t) and d <= int((len(body) - 2) * decontaminate.RATE):
                want[i] = d
        assert {i: d for i, _, d, _ in got} == want and len(got) == len(want)


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="abcd", min_size=30, max_size=160), st.lists(st.text(alphabet="abcd", max_size=30), max_size=6), st.integers(0, 12), st.randoms(use_true_random=False))
def test_stretches_hold_all_passages(item, others, edits, r):
    most = int(len(item) * decontaminate.RATE)
    near = list(item)
    for _ in range(min(edits, most)):
        at = r.randrange(len(near) + 1)
        r.choice([lambda at: near.insert(at, "c"), lambda at: near.__setitem__(slice(at, at + 1), "a"), lambda at: near.__setitem__(slice(at, at + 1), "")])(at)
    parts = [*others, "".join(near) if edits < 9 else item[: len(item) // 2]]
    r.shuffle(parts)
    item, text = item.encode(), "".join(parts).encode()
    stretches = decontaminate.likely(item, text, most)
    assert all(b < c for (_, b), (c, _) in zip(stretches, stretches[1:], strict=False))
    want = decontaminate.least_distance(item, text, most)
    found = [(d, a + e) for a, b in stretches for d, e in [decontaminate.least_distance(item, text[a:b], most)] if d <= most]
    assert (min(found, key=lambda x: x[0]) if found else (most + 1, -1)) == want


def test_shared_phrases_take_no_distances(monkeypatch):
    """Texts that share many pieces with long items, but no passage: runs are counted, and no distance is taken."""
    r = random.Random(23)
    items = [(k, words(r, 2500)) for k in range(3)]
    text = " ".join(words(r, 20) + items[k % 3][1][at : at + 40] for k, at in enumerate(r.sample(range(9000), 120)))
    taken, plain = [], decontaminate.least_distance
    monkeypatch.setattr(decontaminate, "least_distance", lambda item, text, most: taken.append(len(text)) or plain(item, text, most))
    finder = decontaminate.Finder(items)
    assert sum(1 for _ in finder._hits(decontaminate.folded(text) + bytes(decontaminate.KEY))) > 100
    assert finder.find_all([text]) == [[]] and not taken
    assert [x[0] for x in finder.find_all([text + " " + items[1][1]])[0]] == [1] and sum(taken) < 2 * len(items[1][1])


def test_contamination_odd_tables(spark, make):
    item = "granite columns of the northern quarry stand in long rows"
    df = spark.createDataFrame([(1, item, 0)], "item_id long, text string, doc_id long")
    rows = [(1, f"a {item} b"), (1, f"a {item} b"), (None, item), (2, "word " * 100_000 + item + " word" * 100_000), (3, None)]
    docs = make(rows).withColumnsRenamed({"lang": "item_id", "source": "distance"})
    got = decontaminate.contaminated(docs, df).collect()
    assert sorted((x.doc_id or -1, x.item_id, x.distance) for x in got) == [(-1, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0)]
    assert [x.doc_id for x in decontaminate.without_contaminated(docs, df).collect()] == [3]


def test_contamination_in_blocks_and_of_nothing(spark, make, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    r = random.Random(8)
    items = [(k, words(r, 12)) for k in range(5)]
    df = spark.createDataFrame(items, "item_id long, text string")
    docs = make({k: f"before {t} after" for k, t in items})
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, df).collect()} == {(k, k) for k, _ in items}
    assert decontaminate.without_contaminated(docs, df).count() == 0 and decontaminate.without_contaminated(docs, df.limit(0)).count() == 5
    assert decontaminate.contaminated(docs, df.limit(0)).count() == 0 and decontaminate.contaminated(make({}), df).count() == 0


def test_entry_registers_all():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) < set(names)
    json.dumps(__spark_entry__.oracle_sql())


def test_temporary_tables_go(spark, make, corpus, tmp_path, monkeypatch):
    import os
    import shutil

    from quarry.llm import common

    monkeypatch.setattr(common, "scratch_dir", lambda s: str(tmp_path))
    out = simhash.near_duplicates(make(corpus))
    assert sorted(n.split("-")[0] for n in os.listdir(tmp_path)) == ["fingerprints", "keys"] and out.count() == len(corpus)
    for n in os.listdir(tmp_path):
        shutil.rmtree(tmp_path / n)
    out = substring_dedup.digests(make(corpus))
    assert sorted(n.split("-")[0] for n in os.listdir(tmp_path)) == ["spans"] and out.count() == len(corpus)
