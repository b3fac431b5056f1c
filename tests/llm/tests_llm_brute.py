"""Brute-force versions that tests share."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def brute_windows(rows, k=13):
    """(id, words, removed, digest of what is kept) by a dictionary of all windows."""
    first = {}
    key = lambda i: LAST if i is None else i
    for i, t, *_ in sorted(rows, key=lambda r: key(r[0])):
        w = WORD.findall(t or "")
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), key(i))
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < key(i):
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_classes(rows):
    """(id, smallest id of its class) by comparing all pairs."""
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for i in range(len(rows)):
        low[find(i)].append(rows[i][0])
    return sorted(((rows[i][0], min((x for x in low[find(i)] if x is not None), default=None)) for i in range(len(rows))), key=repr)
