"""Stretches of words that repeat with a period, by longest common extensions.

A run is a maximal stretch of words in which words `period` apart are the same, with the
smallest such period and at least two of them. Every run of period q covers two
neighbouring multiples of q, so the pairs (i, i + q) of multiples of q, for each q, meet
every run: a harmonic grid of n ln n pairs for n words. The extension of a pair to the
right and to the left gives the run.

Extensions take constant time. Positions whose residue modulo 13 lies in the difference
cover {0, 1, 3, 9} are sampled; only their suffixes are sorted, by their first 13 words
and then by doubling, which leads from sample to sample. Of any two positions, the same
step below 13 leads to samples, so a few words are compared, and the rest is the least
common prefix between two neighbours in sorted order: a range minimum, read off a sparse
table. To the left the same is done on the reversed words.

Documents are taken in groups of like length, laid end to end between marks that occur
once, so no extension leaves its document. A pair of the grid is looked at further only
if six words around it agree, which every run has, and a group without such pairs needs
no suffixes. Nothing is shuffled; a document is one row of work. What a task holds grows
with a group of GROUP_BYTES, or with the one text that is longer.

Null, empty or blank text: no words, no runs, nothing collapsed. Null ids and repeated
rows count as documents of their own. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.llm.common import SPACE

LEAST_WORDS = 12  # of a run
COVER, SPAN = (0, 1, 3, 9), 13  # any residue is a difference of two members
GROUP_BYTES = 1 << 21  # of text laid end to end
CHUNK = 1 << 18  # pairs looked at in one go
AROUND = 6  # words that agree around a pair of a run: a run has max(12 - q, q) of them at least

LONGS = ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
WHOLE = {"runs": RUNS, "collapsed": pa.string()}
DIGESTS = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string()}



def _sync() -> np.ndarray:
    """The least step that leads from residues i and j into the cover."""
    step = np.zeros((SPAN, SPAN), np.int64)
    for i in range(SPAN):
        for j in range(SPAN):
            step[i, j] = next(s for s in range(SPAN) if (i + s) % SPAN in COVER and (j + s) % SPAN in COVER)
    return step


SYNC = _sync()


def _names(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


class Extensions:
    """Longest common extension to the right of any two positions of `ids`.

    `ids` are at least 0; the last one must occur once.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.words = np.concatenate([ids.astype(np.int64) + 1, np.zeros(2 * SPAN, np.int64)])
        at = np.flatnonzero(np.isin(np.arange(n) % SPAN, COVER))
        self.slot = np.full(n + 1, -1, np.int32)
        self.slot[at] = np.arange(len(at))
        levels = self._sort(at)
        self.rank = levels[-1].astype(np.int32)
        self.table = self._minima(self._neighbours(at, levels))

    def _sort(self, at: np.ndarray) -> list[np.ndarray]:
        """Names of the samples by their first SPAN words, twice as many, and so on until all differ."""
        wide = int(self.words.max()) + 1
        fit = max(1, (62 - len(at).bit_length()) // wide.bit_length())  # words added to a name at a time
        name = np.ones(len(at), np.int64)
        for first in range(0, SPAN, fit):
            for w in range(first, min(SPAN, first + fit)):
                name = name * wide + self.words[at + w]
            name = _names(name)
        levels, ahead, n = [name], SPAN, len(self.slot) - 1
        while len(at) and name.max() < len(at):
            later = self.slot[np.minimum(at + ahead, n)]
            name = _names(name * (len(at) + 1) + np.where(later >= 0, name[later], 0))
            levels.append(name)
            ahead *= 2
        return levels

    def _neighbours(self, at: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sampled suffix and the next in order."""
        order = np.empty(len(at), np.int64)
        order[levels[-1] - 1] = np.arange(len(at))
        x, y = at[order[:-1]], at[order[1:]]
        start, n = x.copy(), len(self.slot) - 1
        for k in range(len(levels) - 2, -1, -1):
            a, b = self.slot[np.minimum(x, n)], self.slot[np.minimum(y, n)]
            step = np.where((a >= 0) & (b >= 0) & (levels[k][a] == levels[k][b]), SPAN << k, 0)
            x, y = x + step, y + step
        same = np.ones(len(x), bool)
        for _ in range(SPAN):
            same &= self.words[x] == self.words[y]
            x, y = x + same, y + same
        return (x - start).astype(np.int32)

    @staticmethod
    def _minima(lcp: np.ndarray) -> np.ndarray:
        """Row k: least of 2**k values from each place on."""
        table = np.empty((max(1, len(lcp).bit_length()), len(lcp)), np.int32)
        table[0] = lcp
        for k in range(1, len(table)):
            half = 1 << k - 1
            table[k] = table[k - 1]
            np.minimum(table[k - 1][:-half], table[k - 1][half:], out=table[k][:-half])
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = SYNC[i % SPAN, j % SPAN]
        out = np.zeros(len(i), np.int64)
        on = np.ones(len(i), bool)
        for t in range(SPAN - 1):
            on &= (t >= step) | (self.words[i + np.minimum(t, step)] == self.words[j + np.minimum(t, step)])
            out += on & (t < step)
        far = np.flatnonzero(on)
        a, b = (self.rank[self.slot[p[far] + step[far]]].astype(np.int64) - 1 for p in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp(high - low)[1] - 1
        out[far] += np.minimum(self.table[k, low], self.table[k, high - (1 << k.astype(np.int64))])
        return out


def grid_pairs(words: np.ndarray, doc: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q): multiples i of q up to half the longest document, where AROUND words agree with those q later."""

    def agreeing(i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = doc[i] == doc[i + q]
        i, q = i[keep], q[keep]
        agree = np.ones(len(i), np.int64)
        for side in (1, -1):
            on = np.arange(len(i))
            for t in range(1, AROUND):
                x, y = i[on] + side * t, i[on] + q[on] + side * t
                inside = (x >= 0) & (y < len(words))
                on, x, y = on[inside], x[inside], y[inside]
                on = on[words[x] == words[y]]
                agree[on] += 1
        keep = agree >= AROUND
        return i[keep], q[keep]

    def looked_at() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        waiting, n = [], 0
        for q in range(1, longest // 2 + 1):
            every = words[::q]
            hits = np.flatnonzero(every[1:] == every[:-1])
            if len(hits):
                waiting.append((hits * q, np.full(len(hits), q)))
                n += len(hits)
            if waiting and (n >= CHUNK or q == longest // 2):
                i, period = (np.concatenate(c) for c in zip(*waiting, strict=True))
                for at in range(0, n, CHUNK):
                    yield agreeing(i[at : at + CHUNK], period[at : at + CHUNK])
                waiting, n = [], 0

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for pair in looked_at():
        waiting.append(pair)
        n += len(pair[0])
        if n >= CHUNK:
            yield tuple(np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*waiting, strict=True))


def _distinct(runs: np.ndarray) -> np.ndarray:
    """Rows (start, stop, period), one for each stretch, with its smallest period."""
    runs = runs[np.lexsort(runs.T[::-1])]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def find_runs(documents: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each document, given as ids of its words, rows (start, stop, period) in order."""
    marks = max((int(d.max()) for d in documents if len(d)), default=0) + 1
    sizes = np.array([len(d) for d in documents], np.int64)

    def laid(which: np.ndarray) -> np.ndarray:
        """Documents end to end, each after a mark of its own, and one at the end."""
        parts = [p for d in which.tolist() for p in (np.array([marks + d]), documents[d])]
        return np.concatenate([*parts, np.array([marks + len(documents)])])

    def starts(which: np.ndarray) -> np.ndarray:
        return np.cumsum(sizes[which] + 1) - sizes[which]

    every = np.arange(len(documents))
    flat, begin = laid(every), starts(every)
    doc = np.repeat(np.append(every, len(every)), np.append(sizes + 1, 1))
    found = np.zeros((0, 3), np.int64)
    held, right, left, moved = np.zeros(0, np.int64), None, None, begin
    for i, q in grid_pairs(flat.astype(np.int32), doc, int(sizes.max(initial=0))):
        needed = np.unique(doc[i])
        if not np.isin(needed, held).all():
            held = needed
            part = laid(held)
            right, left = Extensions(part), Extensions(part[::-1])
            moved = np.zeros(len(documents), np.int64)
            moved[held] = starts(held)
        size = len(right.slot) - 1
        for at in range(0, len(i), CHUNK):
            x, p = i[at : at + CHUNK], q[at : at + CHUNK]
            shift = moved[doc[x]] - begin[doc[x]]
            a, b = x + shift, x + shift + p
            start, stop = x - left(size - a, size - b), x + p + right(a, b)
            fine = stop - start >= np.maximum(least, 2 * p)
            found = _distinct(np.concatenate([found, np.stack([start, stop, p], axis=1)[fine]]))
    cuts = np.searchsorted(found[:, 0], np.append(begin, len(flat)))
    return [found[cuts[d] : cuts[d + 1]] - np.array([begin[d], begin[d], 0]) for d in every]


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by size, in groups of GROUP_BYTES."""
    order = np.argsort(sizes, kind="stable")
    whole = np.cumsum(sizes[order])
    first = 0
    while first < len(order):
        base = whole[first] - sizes[order[first]]
        stop = max(first + 1, int(np.searchsorted(whole, base + GROUP_BYTES, "right")))
        yield order[first:stop]
        first = stop


def _row(words: np.ndarray, known: list[bytes], runs: np.ndarray, digest: bool) -> tuple:
    kept = words
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 1], -1)
        kept = words[np.cumsum(edges[:-1]) == 0]
    collapsed = b" ".join([known[w] for w in kept.tolist()])
    triples = [(s, e - s, q) for s, e, q in runs.tolist()]
    top = min(triples, key=lambda r: (-r[1], r[0], r[2])) if triples else (None, None, None)
    exponent = 1000 * top[1] // top[2] if triples else None
    if digest:
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(triples, key=lambda r: (r[0], r[2])))
        out = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
    else:
        ordered = sorted(triples, key=lambda r: (r[0], r[2]))
        out = ([{"start": s, "length": n, "period": q} for s, n, q in ordered], collapsed.decode())
    return (len(words), len(triples), *top, exponent, *out)


def _work(least: int, digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = dict.fromkeys(LONGS, pa.int64()) | (DIGESTS if digest else WHOLE)
    for b in batches:
        texts = b.column(1)
        sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
        rows: list[tuple] = [()] * len(texts)
        for group in _groups(sizes):
            ids: defaultdict[bytes, int] = defaultdict(count().__next__)
            documents = []
            for r in group.tolist():
                words = texts[r].as_buffer().to_pybytes().split() if sizes[r] else []
                documents.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            known = list(ids)
            for r, words, runs in zip(group.tolist(), documents, find_runs(documents, least), strict=True):
                rows[r] = _row(words, known, runs, digest)
        columns = [b.column(0), *(list(zip(*rows, strict=True)) or [()] * (len(kinds) - 1))]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed) of each document.

    The four describe the longest run, ties to the smallest start, then period; without
    runs they are null. `runs` lists all by start, then period. `collapsed` is the text
    without the words that a run holds beyond its first period, words parted by one
    space. With `digest` their SHA-256 stands in for the last two. `least_words` is 12
    or more.
    """
    if least_words < 2 * AROUND:
        raise ValueError(f"least_words must be {2 * AROUND} or more")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = "runs_sha256 string, collapsed_sha256 string" if digest else (
        "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    longs = ", ".join(f"{name} long" for name in LONGS)
    return texts.mapInArrow(partial(_work, least_words, digest), f"{longs}, {made}")


def with_cycles(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where a tenth of the texts, chosen by id, goes round in a cycle from some word on.

    With h the CRC-32 of the decimal id and g its tenth, a text with h % 10 = 0 and n > 0
    words takes, from word a = g % n on, words a to a + p - 1 in turn, where
    p = 1 + (n - a) // (3 + g % 8). Null ids: unchanged.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col("text").cast("string"), f"[{SPACE}]+"), lambda w: w != "")

    def cycled(w: Column) -> Column:
        n = F.size(w)
        a = g % F.nullif(n, F.lit(0))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)),
            lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
        )
        return F.array_join(place, " ")

    made = F.get(F.transform(F.array(words), cycled), F.lit(0))  # the outer list names the words, so they are cut once
    text = F.when(h % 10 == 0, F.coalesce(made, F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))
