"""Plain versions of operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def jaccard_components(rows, n=5):
    """(doc_id, set size, smallest doc_id of the component) of (doc_id, text) rows."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g] if j < k)
        for j, o in shared.items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                a, b = find(rows[k][0]), find(rows[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets))


def repeated_bytes(rows, length=400):
    """(doc_id, bytes, removed bytes, spans, sha256 of the rest) of (doc_id, text) rows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def without_repeats(rows, length):
    """(doc_id, text) rows without their repeated bytes; rows of which nothing is left go."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = set()
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone.update(range(p, p + length))
        left = bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")
        if left or not gone:
            out.append((i, left if gone else b.decode()))
    return out


def near_copies_gone(rows):
    """The rows whose document is the smallest of its component."""
    root = {i: r for i, _, r in jaccard_components(rows)}
    return [(i, t) for i, t in rows if root[i] == i]
