"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows):
    """(number of shingles, smallest reachable id) by doc_id."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def contained(docs, items, percent=75):
    pairs = set()
    for d, text in docs:
        mine = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and 100 * len(mine & want) >= percent * len(want):
                pairs.add((d, i, len(want), len(mine & want)))
    return pairs


def without_copies(rows, least):
    """Text after line dedup by (doc_id, text): the longest run from each line that occurs earlier goes."""
    unique = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    texts = [[(i, x, len(WORD.findall(x))) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for _, _, t in unique]
    starts, gone = defaultdict(list), defaultdict(set)
    for d, lines in enumerate(texts):
        for p, line in enumerate(lines):
            starts[line[1]].append((d, p))
    for d, lines in enumerate(texts):
        for p in range(len(lines)):
            best = 0
            for e, q in starts[lines[p][1]]:
                if (e, q) >= (d, p):
                    break
                n = 0
                while p + n < len(lines) and q + n < len(texts[e]) and lines[p + n][1] == texts[e][q + n][1]:
                    n += 1
                best = max(best, n)
            if sum(x[2] for x in lines[p : p + best]) >= least:
                gone[d] |= {x[0] for x in lines[p : p + best]}
    return {(None if none else i, t): "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d]) for d, (none, i, t) in enumerate(unique)}


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def base_spans(text):
    """Sorted (start, kind, end) of the base rules."""
    text, found = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def mcd(x, floors, fraction=0.75):
    """Squared robust distances of the rows of ``x`` (in thousandths), and the most steps a start took to its fixed point."""
    x = np.asarray(x) / 1000

    def fit(z):
        return z.mean(0), np.cov(z.T, bias=True) + np.diag(np.square(floors))

    def distance(m, c):
        return np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)

    def rank(m, c):
        return np.floor(np.log1p(distance(m, c)) * 1000)

    def scale(m, c):
        return max((np.exp(np.median(rank(m, c)) / 1000) - 1) / 4.351, 1.0)

    middle, ends, most = np.median(x, 0), [], 0
    mad = 1.4826 * np.median(abs(x - middle), 0)
    for m, c in (fit(x), (middle, np.diag(mad**2 + np.square(floors)))):
        before, steps = None, 0
        while True:
            r, steps = rank(m, c), steps + 1
            near = r <= np.percentile(r, 100 * fraction)
            m, c = fit(x[near])
            if before is not None and (near == before).all():
                break
            before = near
        ends.append((round(np.linalg.slogdet(c)[1], 9), len(ends), m, c))
        most = max(most, steps)
    _, _, m, c = min(ends, key=lambda e: e[:2])
    m, c = fit(x[distance(m, c) <= 12.83 * scale(m, c)])
    return distance(m, c) / scale(m, c), most
