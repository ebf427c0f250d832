"""Chains of licence words: the same as by taking the best chain again and again, in time in proportion to the text."""

from __future__ import annotations

import random
import time

from quarry.llm import license_scan as L


def again_and_again(anchors, least):
    """Every chain of the anchors that are left is found anew for each one taken."""
    left, out = list(anchors), []
    while left:
        total, back = [], []
        for j, (end, place, size) in enumerate(left):
            most, before = size, -1
            for i in range(j - 1, -1, -1):
                e, p, _ = left[i]
                if e < end - size - L.GAP:
                    break
                more = min(size, end - e, place - p)
                if more > 0 and total[i] + more > most:
                    most, before = total[i] + more, i
            total.append(most)
            back.append(before)
        j = max(range(len(left)), key=lambda k: (total[k], -k))
        if total[j] < least:
            break
        chain, i = [], j
        while i >= 0:
            chain.append(left[i])
            i = back[i]
        out.append((total[j], chain[::-1]))
        start, end = min(e - n for e, _, n in chain), left[j][0]
        left = [a for a in left if a[0] <= start or a[0] - a[2] >= end]
    return out


def pieces(r, texts):
    words = []
    for _ in range(r.randint(1, 12)):
        t = r.choice(texts)
        i = 0 if r.random() < 0.4 else r.randrange(len(t))
        part = list(t[i:] if r.random() < 0.4 else t[i : i + r.randint(3, 60)])
        for _ in range(r.randint(0, 3)):
            part[r.randrange(len(part))] = b"zzz"
        words += part + [b"x"] * r.choice([0, 0, 1, 3, 13])
    return words


def test_chains_of_edited_and_repeated_licences():
    scanner = L.Scanner(L.TEMPLATES, L.PHRASES)
    texts, r = [L.words_of(t) for _, _, t in L.TEMPLATES], random.Random(7)
    for _ in range(400):
        runs, _ = scanner.automaton.scan(pieces(r, texts))
        for t, anchors in scanner.automaton.anchors(runs).items():
            least = L.COVERED * scanner.automaton.sizes[t]
            assert list(L.Chains(anchors).best(least)) == again_and_again(anchors, least)


def test_time_grows_with_the_text():
    scanner = L.Scanner(L.TEMPLATES, L.PHRASES)
    for text in (min((L.words_of(t) for _, _, t in L.TEMPLATES), key=len), max((L.words_of(t) for _, _, t in L.TEMPLATES), key=len)):
        took = {}
        for n in (4000, 8000):
            began = time.process_time()
            assert len(scanner.find(list(text) * n)[1]) == n
            took[n] = time.process_time() - began
        assert took[8000] < 2.5 * took[4000] + 0.2 and took[8000] < 4


def test_disjoint_spans():
    r, spans, plain = random.Random(2), L.Disjoint(), []
    for _ in range(500):
        lo = r.randrange(400)
        hi = lo + r.randint(1, 9)
        free = all(hi <= a or b <= lo for a, b in plain)
        assert spans.add(lo, hi) == free
        plain += [(lo, hi)] if free else []
