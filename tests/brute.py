"""Plain-Python answers for small fixtures."""

from __future__ import annotations

import math
import re
from collections import Counter


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]{2,}", text)


def idf(docs: list[str]) -> dict[str, float]:
    df = Counter(t for d in docs for t in set(words(d)))
    return {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}


def cosine(a: str, b: str, weights: dict[str, float]) -> float:
    def vector(text: str) -> dict[str, float]:
        tf = Counter(w for w in words(text) if w in weights)
        v = {t: n * weights[t] for t, n in tf.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else {}

    x, y = vector(a), vector(b)
    return sum(w * y.get(t, 0.0) for t, w in x.items())


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [ch for ch, u in zip(b, used) if u]
    half = sum(x != y for x, y in zip(hits, other)) // 2
    m = len(hits)
    plain = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return plain + 0.1 * prefix * (1 - plain) if plain > 0.7 else plain


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
