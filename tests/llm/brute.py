"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACES = re.compile("[\x20\x09-\x0d]")
WORDS = re.compile("[^\x20\x09-\x0d]+")


def smallest_reachable(ids, linked):
    """For each node, the smallest id (None last) that links lead to."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in linked:
        root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, d in enumerate(ids):
        groups[find(i)].append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(ids))]


def exact_groups(docs):
    """{row: (keep_id, size, kept, sha)} for (doc_id, text) rows."""
    groups = defaultdict(list)
    for i, (_, text) in enumerate(docs):
        groups[SPACES.sub("", text or "")].append(i)
    out = {}
    for norm, rows in groups.items():
        best = min(rows, key=lambda i: (-len(docs[i][1] or ""), docs[i][0] is None, docs[i][0] or 0))
        for i in rows:
            out[i] = (docs[best][0], len(rows), i == best, hashlib.sha256(norm.encode()).hexdigest())
    return out


def simhash(text, n=4):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def jaccard(a, b, n):
    x, y = (
        {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}
        for w in (WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in (a, b))
    )
    return len(x & y) / len(x | y)


def simhash_components(docs, n=4, radius=4):
    prints = [simhash(t, n) for _, t in docs]
    links = [
        (i, j)
        for i in range(len(docs))
        for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= radius
    ]
    return prints, smallest_reachable([d for d, _ in docs], links)


def embedding_links(rows, threshold=0.98):
    """(n_links, component) of (vec_id, vector, label) rows."""

    def usable(v, label):
        return label is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)

    links = []
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la == lb and usable(a, la) and usable(b, lb) and len(a) == len(b):
                x, y = np.array(a, np.float64), np.array(b, np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links.append((i, j))
    degree = Counter(e for pair in links for e in pair)
    return [degree[i] for i in range(len(rows))], smallest_reachable([r[0] for r in rows], links)


PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def private_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PRIVATE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def disclosing(texts, names, share=0.9, chance=0.01, kin=0.4):
    """{(entity, term)} of texts and their sets of entities; texts of that similarity, or chains of them, are one witness."""
    n = len(texts)
    terms = [set(re.findall(r"[^\W\d_]{3,}", (t or "").lower())) for t in texts]
    held = Counter(t for ts in terms for t in ts)

    def shingles(text):
        words = WORDS.findall(text or "")
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for t in texts]
    found = set()
    for e in set().union(*names):
        rows = [i for i in range(n) if e in names[i]]
        linked = [
            (a, b)
            for a in range(len(rows))
            for b in range(a)
            if len(sets[rows[a]] & sets[rows[b]]) >= kin * len(sets[rows[a]] | sets[rows[b]])
        ]
        family = dict(zip(rows, smallest_reachable(list(range(len(rows))), linked), strict=True))
        xe, ne = len(set(family.values())), len(rows)
        for t in set().union(*(terms[i] for i in rows)):
            both = [i for i in rows if t in terms[i]]
            xet = len({family[i] for i in both})
            if xet < 2:
                continue
            ways = math.log(xe - 1) - math.log(xet - 1) + (xet < xe)
            others = held[t] - (len(both) - xet) - 1
            likely = (xet - 1) * (max(ways, 0) + math.log(others / max(1, len({t or "" for t in texts}) - 1)))
            known = -math.log2(ne / n)
            if known > 0 and math.log2(n * len(both) / (ne * held[t])) >= share * known and likely <= math.log(chance):
                found.add((e, t))
    return found


def without_repeats(docs, length=200):
    """(n_bytes, n_removed, n_spans, sha) of each text."""
    raws = [(t or "").encode() for t in docs]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def first_passages(docs, length=20):
    """{doc_id: (n_words, n_removed, sha)} of (doc_id, text) rows with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            window = tuple(words[p : p + length])
            if window in seen:
                gone[p : p + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def targets(sizes):
    """{source: target} of {source: words}, by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), list(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] <= weight[s] * level]
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4
