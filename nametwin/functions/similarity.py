"""Pair similarities.

Levenshtein and both cosines are JVM expressions. Spark has no Jaro-Winkler:
the higher-order-function form of it took 92 us per pair on names of 25
characters, the Arrow form below 8.5 us, so it is the one place Python runs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship the few helpers below with the function, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of the character matrix worked on at once; bounds task memory on long texts.
_CELLS = 1_000_000
_BITS = 64  # characters of a name whose places fit a whole number


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`."""
    return F.transform(F.array(value), body)[0]


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points plus one, padded with 0, one row per text."""
    width = max(1, max(map(len, texts)))
    out = np.zeros((len(texts), width), np.uint32)
    for row, text in enumerate(texts):
        if text:
            out[row, : len(text)] = np.frombuffer(text.encode("utf-32-le"), np.uint32) + 1
    return out


def _codes_once(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the different texts, and the row that each text has among them."""
    row = {text: i for i, text in enumerate(dict.fromkeys(texts))}
    return _codes([*row]), np.fromiter(map(row.__getitem__, texts), np.intp, len(texts))


def _matched_near(
    a: np.ndarray,
    b: np.ndarray,
    reach: np.ndarray,
    chars: np.ndarray,
    a_of: np.ndarray | None = None,
    b_of: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Which characters match, from left to right in `a`, each the first free one within `reach` in `b`.

    For texts of at most 64 characters: the places of each of the `chars` in a row of `b`
    are the bits of a number, and so are the free places and the window. `a_of` and `b_of`
    say which rows a pair takes, where texts repeat; what depends on one text is made once.
    """
    a_of, b_of = (np.arange(len(reach)) if of is None else of for of in (a_of, b_of))
    one = np.uint64(1)
    a_kind, b_kind = np.searchsorted(chars, a), np.searchsorted(chars, b)
    a_kind[chars[np.minimum(a_kind, len(chars) - 1)] != a] = 0
    rows, places = np.arange(len(b)), np.zeros((len(b), len(chars)), np.uint64)
    for j in range(b.shape[1]):
        places[rows, b_kind[:, j]] |= one << np.uint64(j)
    places[:, 0] = 0  # of what pads a row
    places, begin = places.ravel(), b_of * len(chars)
    free = np.full(len(a_of), ~np.uint64(0))
    window = (one << (reach + 1).astype(np.uint64)) - one
    a_hit = np.zeros((a.shape[1], len(a_of)), bool)
    for i in range(a.shape[1]):
        fits = places[begin + a_kind[:, i][a_of]] & free & window
        first = fits & (~fits + one)
        free ^= first
        a_hit[i] = first > 0
        window = window << one | (i + 1 <= reach)
    b_hit = (free >> np.arange(b.shape[1], dtype=np.uint64)[:, None] & one) == 0
    return a_hit.T, b_hit.T


def _matched_far(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for long texts.

    The places of a character in a row of `b` are a queue: a place leaves it when it is
    matched, or when the window has passed it. So its head is the first one that can match,
    and each step costs a look at the heads, not at the window.
    """
    rows = np.arange(len(a))
    a_hit, b_hit = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    b_row, b_at = np.nonzero(b)
    if not len(b_row):
        return a_hit, b_hit
    key = b_row << 22 | b[b_row, b_at].astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, b_row, at = key[order], b_row[order], b_at[order].astype(np.int32)
    begins = np.r_[True, key[1:] != key[:-1]]
    queue = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0)).astype(np.int32)
    place = np.full(b.T.shape, -1, np.int32)  # of each character of b among the sorted ones
    place[at, b_row] = np.arange(len(key))
    a_row, a_at = np.nonzero(a)
    wanted = a_row << 22 | a[a_row, a_at].astype(np.int64)
    found = np.searchsorted(key, wanted)
    known = key[np.minimum(found, len(key) - 1)] == wanted
    asks = np.full(a.T.shape, -1, np.int32)  # the queue of each character of a
    asks[a_at[known], a_row[known]] = found[known]
    head = np.arange(len(key), dtype=np.int32)
    queue, at = np.append(queue, np.int32(-1)), np.append(at, np.int32(0))
    for i in range(a.shape[1]):
        gone = i - 1 - reach
        r = rows[(gone >= 0) & (gone < b.shape[1])]
        p = place[gone[r], r]
        p = p[p >= 0]
        q = queue[p]
        left = head[q] == p
        head[q[left]] += 1
        r = np.flatnonzero(asks[i] >= 0)
        q = asks[i, r]
        p = head[q]
        fits = (queue[p] == q) & (at[p] <= i + reach[r])
        r, q, p = r[fits], q[fits], p[fits]
        head[q] = p + 1
        a_hit[r, i] = True
        b_hit[r, at[p]] = True
    return a_hit, b_hit


def _jaro_winkler_block(a_texts: list[str], b_texts: list[str]) -> np.ndarray:
    (a_own, a_of), (b_own, b_of) = _codes_once(a_texts), _codes_once(b_texts)
    la, lb = (a_own > 0).sum(1)[a_of], (b_own > 0).sum(1)[b_of]
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    width = b_own.shape[1]
    rows = np.arange(len(a_of))
    chars = np.unique(np.append(b_own, np.uint32(0)))
    a, b = a_own[a_of], b_own[b_of]
    if max(a.shape[1], width) <= _BITS and len(chars) * len(b_own) <= 4 * _CELLS:
        a_hit, b_hit = _matched_near(a_own, b_own, reach, chars, a_of, b_of)
    else:
        a_hit, b_hit = _matched_far(a, b, reach)
    m = a_hit.sum(1)
    # matched characters of both sides, in order, row after row
    moved = a[a_hit] != b[b_hit]
    owner = np.repeat(rows, m)
    half = np.bincount(owner[moved], minlength=len(a)) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = (m / la + m / lb + (m - half) / m) / 3.0
    plain = np.where(m > 0, plain, 0.0)
    lead = min(4, a.shape[1], width)
    same = (a[:, :lead] == b[:, :lead]) & (a[:, :lead] > 0)
    prefix = np.logical_and.accumulate(same, axis=1).sum(1)
    return np.where(plain > 0.7, plain + prefix * 0.1 * (1.0 - plain), plain)


def jaro_winkler_arrays(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler of aligned texts, similar lengths worked on together."""
    size = np.maximum([len(x) for x in a], [len(x) for x in b])
    order = np.argsort(size, kind="stable")
    wide = np.maximum(1, size[order])
    out = np.zeros(len(a))
    start = 0
    while start < len(order):
        cells = np.arange(1, len(order) - start + 1) * wide[start:]  # of a block that ends there; they only grow
        stop = start + max(1, int(np.searchsorted(cells, _CELLS, "right")))
        block = order[start:stop]
        out[block] = _jaro_winkler_block([a[k] for k in block], [b[k] for k in block])
        start = stop
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity of two strings; null counts as "".

    Greedy left-to-right matching inside the usual window, half the mismatches
    as transpositions, and a prefix boost of 0.1 per shared leading character
    (four at most) when the plain similarity exceeds 0.7. An empty side gives 0.
    """
    return pd.Series(jaro_winkler_arrays(a.fillna("").tolist(), b.fillna("").tolist()))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two term-to-weight maps; terms on one side only add 0."""
    return F.aggregate(
        F.map_entries(a),
        F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)),
    )


def dense_dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda p, q: p * q)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def dense_cosine(a: Column, b: Column, lengths: Column | None = None) -> Column:
    """Cosine of two numeric arrays of equal length; a zero vector gives 0.

    `lengths` is the product of both lengths, where it is known.
    """
    if lengths is None:
        lengths = F.sqrt(dense_dot(a, a)) * F.sqrt(dense_dot(b, b))
    return bind(lengths, lambda norm: F.when(norm == 0.0, F.lit(0.0)).otherwise(dense_dot(a, b) / norm))
