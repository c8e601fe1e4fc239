"""Repeated windows of L units over all documents, whole and by content alone.

Units are bytes or words. Every window has an anchor: the leftmost gram of least rolling
hash in it. Consecutive windows with one anchor are a phrase, L - 1 units longer than
it has windows, so phrases cover a document and overlap by L - 1. A phrase depends on
nothing outside itself, so equal windows have equal anchors at the same place.

1. Anchors are counted; a window whose anchor gram occurs once has no copy.
2. Phrases with a repeated anchor are kept: (fingerprint, anchor, document, place).
   Equal phrases are one entry of the dictionary; all windows of a phrase that occurs
   again have copies, without a look at each.
3. Entries that share an anchor but differ are cut into their windows, and these are
   grouped: the only step whose rows are single windows.

Fingerprints have 128 bits: XXH3-128 of the bytes of a window or phrase, or of the 128
bits of each of a phrase's words; a window of words adds these up with random factors.
The rolling hash only picks anchors, so its collisions change no result.
Every grouping starts with partial sums, so an anchor, phrase or window that a third of
all documents hold is a row per task. Joins of rows back to such keys are left to
adaptive skew handling, which splits them.

What occurs twice is first found by 64 bits alone. A bitmap of bounded size then keeps
all else from being shuffled with its place; where keys are too many for it, a join does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametwin.llm.common import Bitmap, bitmap, settled
from nametwin.operators.keep import release

LAST = (1 << 63) - 1  # orders a null id after all others
MULTIPLIER = 0x9E3779B97F4A7C15  # odd
MIX = np.uint64(0xBF58476D1CE4E5B9)
STRETCH = 1 << 20  # windows of a text worked on at a time
FILTERED = 1 << 10  # texts filtered at a time
CUT = 1 << 15  # single windows of a text worked on at a time
_ONES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the lowest n bytes

Strip = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
# of a text: a hash for each unit, and bytes of a fixed width for each unit
Units = Callable[[bytes], tuple[np.ndarray, memoryview, int]]


@cache
def _values() -> np.ndarray:
    return np.random.default_rng(20240).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of a multiplier and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.steps = (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))
        self.known = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.known[0]):
            size = max(1 << 16, 1 << (n - 1).bit_length())
            made = []
            for step in self.steps:
                p = np.full(size, step, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            self.known = (made[0], made[1])
        return self.known[0][:n], self.known[1][:n]


@cache
def _powers() -> _Powers:
    return _Powers(MULTIPLIER)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any stretch of a sequence of unit values, by sums before each place."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _powers()(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def byte_units(text: bytes) -> tuple[np.ndarray, memoryview, int]:
    return _values()[np.frombuffer(text, np.uint8)], memoryview(text), 1


def word_units(text: bytes) -> tuple[np.ndarray, memoryview, int]:
    """128 bits for each word: no two words of up to 15 bytes share them, longer ones by XXH3-128.

    A short word is its bytes and its length, which four rounds of a Feistel network then
    mix without loss.
    """
    raw = np.zeros(len(text) + 16, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    bare = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13))])
    bare[len(text) + 1 :] = True
    edge = np.flatnonzero(bare[1:] != bare[:-1])
    start, stop = edge[::2], edge[1::2]
    size = stop - start
    eight = np.ndarray(len(text) + 9, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    low = eight[start] & _ONES[np.minimum(size, 8)]
    high = eight[start + 8] & _ONES[np.clip(size - 8, 0, 7)] | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    for i in np.flatnonzero(size > 15).tolist():
        low[i], high[i] = np.frombuffer(xxhash.xxh3_128_digest(text[start[i] : stop[i]]), np.uint64)
    for key in _values()[:4:2]:
        low = low ^ mix(high + key)
        high = high ^ mix(low ^ key)
    held = np.stack([low, high], axis=1)
    return low, memoryview(held.view(np.uint8).reshape(-1)), 16


def fingerprints(held: memoryview, width: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each stretch of units."""
    digest = xxhash.xxh3_128_digest
    ends = zip((start * width).tolist(), (stop * width).tolist(), strict=True)
    both = np.frombuffer(b"".join([digest(held[a:b]) for a, b in ends]), np.uint64)
    return both[::2], both[1::2]


def phrases(units: tuple[np.ndarray, memoryview, int], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, windows, anchor) of each phrase of a document, stretch by stretch.

    An anchor depends on its window alone, so a border between stretches does no more
    than part a phrase.
    """
    hashes = units[0]
    for first in range(0, len(hashes) - length + 1, STRETCH):
        u = hashes[first : first + STRETCH + length - 1]
        n, one = len(u), Rolling(u)
        at = np.arange(n - gram + 1)
        grams = one(at, at + gram)
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        width = length - gram + 1
        pad = -len(keys) % width
        blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - length + 1], ahead[width - 1 : width + n - length])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([place, [len(anchor)]]))
        yield place + first, count, grams[anchor[place]]


def _batch(columns: list[np.ndarray], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names.split()
    )


def _text(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _gather(made: Iterator[list[np.ndarray]], names: str, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Small column lists joined to batches."""
    waiting: list[list[np.ndarray]] = []
    n = 0
    for columns in made:
        waiting.append(columns)
        n += len(columns[0])
        if n >= rows:
            yield _batch([np.concatenate(c) for c in zip(*waiting, strict=True)], names)
            waiting, n = [], 0
    if n:
        yield _batch([np.concatenate(c) for c in zip(*waiting, strict=True)], names)


def _find(units: Units, length: int, gram: int, wanted: Bitmap | None, anchors_only: bool, batches: Iterator[pa.RecordBatch]):
    def each() -> Iterator[list[np.ndarray]]:
        for b in batches:
            d, k = (b.column(i).to_numpy() for i in (0, 1))
            for row, text in enumerate(b.column(2)):
                u = units(_text(text))
                for place, count, anchor in phrases(u, length, gram):
                    if anchors_only:
                        yield [anchor]
                        continue
                    if wanted is not None:
                        hit = wanted.holds(anchor)
                        place, count, anchor = place[hit], count[hit], anchor[hit]
                    one, two = fingerprints(u[1], u[2], place, place + count + length - 1)
                    same = np.ones(len(place), np.int64)
                    yield [one, two, anchor, same * d[row], same * k[row], place, count]

    return _gather(each(), "a" if anchors_only else "g1 g2 a d k place n")


@cache
def _factors(length: int) -> np.ndarray:
    made = np.random.default_rng(length).integers(0, 1 << 63, (2, length), dtype=np.uint64)
    return made * np.uint64(2) + np.uint64(1)


def window_prints(units: tuple[np.ndarray, memoryview, int], length: int, at: np.ndarray, half: int) -> np.ndarray:
    """64 bits of each window; `half` 0 and 1 together make 128.

    Windows of words add up half the bits of each word, times a random odd factor
    of its place: they have no structure that factors could cancel.
    """
    if units[2] == 1:
        return fingerprints(units[1], 1, at, at + length)[half]
    digests = np.frombuffer(units[1], np.uint64)[half::2]
    return digests[at[:, None] + np.arange(length)] @ _factors(length)[half]


def _cut(units: Units, length: int, wanted: Bitmap | None, hashes_only: bool, batches: Iterator[pa.RecordBatch]):
    def windows(runs: pa.StructArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, asks) of the windows of runs, CUT of them at a time."""
        start, n, asks = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("place", "n", "asks"))
        ends = np.cumsum(n)
        for low in range(0, int(ends[-1]), CUT):
            at = np.arange(low, min(low + CUT, int(ends[-1])))
            run = np.searchsorted(ends, at, "right")
            yield at - (ends - n)[run] + start[run], asks[run]

    def each() -> Iterator[list[np.ndarray]]:
        for b in batches:
            d, k = (b.column(i).to_numpy() for i in (0, 1))
            for row, text in enumerate(b.column(2)):
                u = units(_text(text))
                for at, asks in windows(b.column(3)[row].values):
                    one = window_prints(u, length, at, 0)
                    if hashes_only:
                        yield [one]
                        continue
                    if wanted is not None:
                        hit = wanted.holds(one)
                        one, at, asks = one[hit], at[hit], asks[hit]
                    two, same = window_prints(u, length, at, 1), np.ones(len(at), np.int64)
                    yield [one, two, same * d[row], same * k[row], at, asks.astype(bool)]

    return _gather(each(), "h1" if hashes_only else "h1 h2 d k place asks")


def keyed(docs: DataFrame) -> DataFrame:
    """(d, k, text, doc_id): an order of ids, null last; a hash of id and text; the text and the id."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    hashed = F.shiftrightunsigned(F.xxhash64(doc_id, text), 2)
    null_last = F.shiftleft(doc_id.isNull().cast("long"), 62)
    return docs.select(
        F.coalesce(doc_id, F.lit(LAST)).alias("d"),
        hashed.bitwiseOR(null_last).alias("k"),
        text.alias("text"),
        doc_id.alias("doc_id"),
    )


def _having(held: Bitmap, inside: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), FILTERED):  # copies a part at a time
            b = whole.slice(at, FILTERED)
            hit = held.holds(b.column("k").to_numpy().view(np.uint64))
            yield b.filter(pa.array(hit if inside else ~hit))


def _with(held: Bitmap | None, texts: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Texts that may have `runs`, with them. Only those are shuffled."""
    able = texts if held is None else texts.mapInArrow(partial(_having, held, True), texts.schema)
    return able.join(runs, ["d", "k"], how)


def _bare(held: Bitmap, strip: Strip, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = pa.list_(pa.struct([("place", pa.int64()), ("n", pa.int64())]))

    def rest() -> Iterator[pa.RecordBatch]:
        for b in _having(held, False, batches):
            columns = [b.column("doc_id"), b.column("text"), pa.nulls(len(b), none)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "runs"])

    return strip(rest())


def stripped(texts: DataFrame, runs: DataFrame, strip: Strip, rows: str) -> DataFrame:
    """`strip` over (doc_id, text, runs) of every text; those without runs stay where they are read."""
    held = bitmap(runs.select("k"))
    found = _with(held, texts, runs, "left").select("doc_id", "text", "runs").mapInArrow(strip, rows)
    return found if held is None else found.unionByName(texts.mapInArrow(partial(_bare, held, strip), rows))


def repeated(texts: DataFrame, units: Units, length: int, gram: int, spare_first: bool) -> DataFrame:
    """(d, k, runs): per document, runs (place, n) of window starts that have a copy.

    With `spare_first`, of equal windows the first by (d, k, place) is left out.
    """
    texts = texts.select("d", "k", "text")
    find = partial(_find, units, length, gram)
    anchors = texts.mapInArrow(partial(find, None, True), "a long")
    common = settled(anchors.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("a"))
    wanted = bitmap(common)
    every = texts.mapInArrow(
        partial(find, wanted, False), "g1 long, g2 long, a long, d long, k long, place long, n long"
    )
    found = settled(every if wanted is not None else every.join(common, "a", "left_semi"))
    release(common)
    first = F.min(F.struct("d", "k", "place")).alias("first")
    entries = settled(
        found.groupBy("g1", "g2").agg(
            F.count(F.lit(1)).alias("c"), first, F.first("n").alias("n"), F.first("a").alias("a")
        )
    )

    def apart(frame: DataFrame) -> DataFrame:
        """All copies, or all but the first."""
        if not spare_first:
            return frame
        return frame.filter(F.struct("d", "k", "place") != F.col("first"))

    again = settled(entries.filter("c > 1").select("g1", "g2", "first"))
    whole = settled(apart(found.join(again, ["g1", "g2"])).select("d", "k", "place", "n"))

    shared = settled(entries.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("a"))
    open_ = entries.join(shared, "a")
    # of entries that occur again all windows are in already, unless the first is spared
    asks = F.lit(True) if spare_first else F.col("c") == 1
    run = F.struct("first.place", "n", asks.alias("asks"))
    by_text = settled(open_.groupBy("first.d", "first.k").agg(F.collect_list(run).alias("runs")))
    release(found, entries, shared, again)
    cut = _with(bitmap(by_text.select("k")), texts, by_text, "inner")
    cut = settled(cut.select("d", "k", "text", "runs").dropDuplicates(["d", "k"]))
    release(by_text)
    alone = cut.mapInArrow(partial(_cut, units, length, None, True), "h1 long")
    twice = settled(alone.groupBy("h1").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h1"))
    wanted = bitmap(twice)
    singles = cut.mapInArrow(
        partial(_cut, units, length, wanted, False), "h1 long, h2 long, d long, k long, place long, asks boolean"
    )
    singles = settled(singles if wanted is not None else singles.join(twice, "h1", "left_semi"))
    release(cut, twice)
    counts = [F.count(F.lit(1)).alias("c"), F.max("asks").alias("asked"), *([first] if spare_first else [])]
    double = settled(singles.groupBy("h1", "h2").agg(*counts).filter("c > 1 AND asked").drop("c", "asked"))
    single = apart(singles.filter("asks").join(double, ["h1", "h2"])).select(
        "d", "k", "place", F.lit(1).cast("long").alias("n")
    )
    runs = settled(whole.unionByName(single).groupBy("d", "k").agg(F.collect_list(F.struct("place", "n")).alias("runs")))
    release(whole, singles, double)
    return runs


def covered(runs: pa.ListScalar, size: int, length: int) -> np.ndarray:
    """Which of `size` units lie in a window that a run starts."""
    edges = np.zeros(size + 1, np.int64)
    if runs.is_valid:
        start = np.asarray(runs.values.field("place"))
        np.add.at(edges, start, 1)
        np.add.at(edges, start + np.asarray(runs.values.field("n")) + length - 1, -1)
    return np.cumsum(edges[:-1]) > 0
