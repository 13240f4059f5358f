"""Plain versions of the corpus operators, text by text and pair by pair."""

import hashlib
from collections import Counter


def near(docs, w, num, den):
    sets = {}
    for d, t in docs:
        x = (t or "").encode().lower().split()
        sets[d] = {tuple(x[i : i + w]) for i in range(len(x) - w + 1)} if len(x) >= w else ({tuple(x)} if x else set())
    lists = {}
    for d, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        common = Counter(e for x in s for e in lists[x] if e < d)
        for e, n in common.items():
            if den * n >= num * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}


def byte_repeats(docs, size):
    seen, out = set(), set()
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone, runs = [False] * len(b), 0
        for i in range(len(b) - size + 1):
            if b[i : i + size] in seen:
                gone[i : i + size] = [True] * size
            seen.add(b[i : i + size])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.add((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def word_repeats(docs, size):
    seen, out = set(), set()
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.add((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
