"""Plain Python versions of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def substrings(docs, window=50):
    """doc_id -> (n_words, n_removed, kept); docs: (doc_id, text)."""
    words = [WORD.findall(t or "") for _, t in docs]
    first = {}
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def suffixes(docs, window=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept)."""
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for (d, _), r in zip(docs, raw):
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(r) else 0
        out.append((d, len(r), int(gone.sum()), spans, np.frombuffer(r, dtype=np.uint8)[~gone].tobytes()))
    return out


def jaccard(docs, percent=75, size=5):
    """(doc_id, n_shingles, component_id)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, where = [], defaultdict(list)
    for i, (_, t) in enumerate(docs):
        w = WORD.findall((t or "").translate(lower))
        s = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        sets.append(s)
        for x in s:
            where[x].append(i)
    both = Counter()
    for group in where.values():
        for a in range(len(group)):
            for b in range(a):
                both[group[b], group[a]] += 1
    links = [p for p, n in both.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    roots = components(len(docs), links)
    least = defaultdict(list)
    for i, r in enumerate(roots):
        least[r].append(docs[i][0])
    return [(d, len(sets[i]), min(least[roots[i]])) for i, (d, _) in enumerate(docs)]


def targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """source -> target, for source -> size; None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        now = {s: most * sizes[s] if s in full else rest * weight[s] / open_ for s in names} if open_ else {s: most * sizes[s] for s in names}
        over = {s for s in names if s not in full and now[s] >= most * sizes[s]}
        if not over:
            return now
        full |= over


def top(ids, vectors, queries, k=20):
    out = []
    for q in queries:
        scores = sorted((-int(np.dot(vectors[q], vectors[j])), ids[j]) for j in range(len(ids)) if ids[j] != ids[q])
        out += [(ids[q], r + 1, v, -s) for r, (s, v) in enumerate(scores[:k])]
    return out


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def personal(text):
    """Lists of (start, end) for email, ip, card, phone."""
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(only(m.group())) <= 19 and luhn(only(m.group()))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(only(m.group())) <= 15],
    ]


def personal_row(doc, text):
    found = personal(text)
    names = ",".join(f"{k}:{a}:{b}" for k, s in zip(("email", "ip", "card", "phone"), found) for a, b in s)
    return (doc, *map(len, found), sha(names))
