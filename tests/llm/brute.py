"""Plain versions of the operators that tests hold the Spark ones against."""

from __future__ import annotations

from itertools import combinations


def classes(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_duplicates(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    links = []
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            inter = len(x & y)
            if 100 * inter >= percent * (len(x) + len(y) - inter):
                links.append((a, b))
    root = classes(sets, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def repeated(docs, width):
    """doc -> (bytes removed, spans, kept bytes)."""
    data = {d: (t or "").encode() for d, t in docs}
    seen = {}
    for d, b in data.items():
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            seen[s] = seen.get(s, 0) + 1
    out = {}
    for d, b in data.items():
        cover = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                cover[i : i + width] = b"\x01" * width
        spans = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out[d] = (len(b), sum(cover), spans, bytes(x for x, c in zip(b, cover, strict=True) if not c))
    return out
