"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into segments. Of two fingerprints at most `radius`
bits apart, some segment differs in few bits: with m segments and radius = m*a + b, one
of the first b + 1 in at most a, or one of the others in at most a - 1. So each
fingerprint enumerates, within each segment, the values that its Hamming ball reaches
by setting bits; two segments d bits apart meet at their union, which takes d set bits
of both together. Whoever meets there is compared in full. Two pairs need never both be
checked: equal fingerprints are one class from the start, tasks pass on a spanning
forest of the links they find, and components are those of the forests.

A table entry that many fingerprints share is cut into a grid of tiles, so no task
compares more than two tiles of it.

Null, empty or blank text: fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence is the one shingle. Null doc_id: compared like any other;
component_id is the smallest id reachable, null where there is none. Repeated rows are
copies of each other. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.llm.common import located
from nametwin.llm.components import components, stars
from nametwin.operators.keep import settle

WORDS = 4
RADIUS = 4
SEED = 42
TILE = 4096
KEY_COST = 50  # comparisons that shuffling one key is worth


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned; the bits set in over half the hashes of the shingles."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # bytes know the same six spaces and A-Z only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(0)], np.uint64)
            names = [*batch.schema.names[1:], "fp"]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], names=names)

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry, fp): a row a document; fp holds the 64 bits as a signed long."""
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in rest.dtypes)
    texts = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long").alias("doc_id"), *carry)
    return texts.mapInArrow(_fingerprints(words), f"{schema}, fp long")


def plan(n: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(first bit, bits, ball) of the segments that cost least for n fingerprints."""

    def segments(m: int) -> list[tuple[int, int, int]]:
        a, b = divmod(radius, m)
        cuts = [64 * i // m for i in range(m + 1)]
        balls = [a if i <= b else a - 1 for i in range(m)]
        return [(cuts[i], cuts[i + 1] - cuts[i], balls[i]) for i in range(m) if balls[i] >= 0]

    def cost(segs: list[tuple[int, int, int]]) -> float:
        keys = sum(comb(bits // 2, k) for _, bits, ball in segs for k in range(ball + 1))
        met = sum(n / 2.0**bits * comb(bits, k) for _, bits, ball in segs for k in range(ball + 1))
        return keys * KEY_COST + met

    return min((segments(m) for m in range(2, max(2, radius) + 1)), key=cost)


def entries(classes: DataFrame, segs: list[tuple[int, int, int]]) -> DataFrame:
    """(key, ups, fp): the values each fingerprint reaches in each segment by setting `ups` bits."""

    one = F.lit(1).cast("long")

    def set_one(e: Column, bits: int) -> Column:
        """Every value with one more bit set, below the last one set."""
        free = F.filter(
            F.sequence(F.lit(0), F.lit(bits - 1)),
            lambda i: (i < e["below"]) & (F.call_function("shiftright", e["v"], i).bitwiseAND(one) == 0),
        )
        return F.transform(
            free,
            lambda i: F.struct(
                (e["ups"] + 1).alias("ups"),
                e["v"].bitwiseOR(F.call_function("shiftleft", one, i)).alias("v"),
                i.alias("below"),
            ),
        )

    def reached(first: int, bits: int, ball: int) -> Column:
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        found = F.array(F.struct(F.lit(0).alias("ups"), value.alias("v"), F.lit(bits).alias("below")))
        every = found
        for _ in range(ball):
            found = F.flatten(F.transform(found, lambda e: set_one(e, bits)))
            every = F.concat(every, found)
        return every

    parts = [
        classes.select("fp", F.explode(reached(*s)).alias("e")).select(
            (F.col("e.v") * F.lit(16) + F.lit(i)).alias("key"), F.col("e.ups").alias("ups"), "fp"
        )
        for i, s in enumerate(segs)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _compare(radius: int, balls: tuple[int, ...]):
    """Links among the rows of each run of equal (key, i, j), as stars."""

    def links(key: np.ndarray, run: np.ndarray, ups: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ball = np.array(balls)[key % 16]
        found_a, found_b = [], []
        on, step = np.arange(len(run)), 1
        while True:
            on = on[on + step < len(run)]
            on = on[run[on] == run[on + step]]
            if not len(on):
                break
            a, b = on, on + step
            near = ups[a] + ups[b] <= ball[a]
            a, b = a[near], b[near]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            found_a.append(fp[a[near]])
            found_b.append(fp[b[near]])
            step += 1
            if step % 256 == 0:
                pairs = stars(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b = [pairs[0]], [pairs[1]]
        if not found_a:
            return fp[:0], fp[:0]
        return stars(np.concatenate(found_a), np.concatenate(found_b))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, i, j, ups, fp = columns
            change = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
            run = np.concatenate([[0], np.cumsum(change)])
            a, b = links(key, run, ups, fp.view(np.uint64))
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            whole = new if rest is None else [np.concatenate(p) for p in zip(rest, new, strict=True)]
            last = np.ones(len(whole[0]), bool)
            for c in whole[:3]:
                last &= c == c[-1]
            cut = int(np.argmax(last))  # the last run may go on in the next batch
            if cut:
                yield out([c[:cut] for c in whole])
            rest = [c[cut:] for c in whole]
        if rest is not None:
            yield out(rest)

    return compare


def links(classes: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): a forest with the components of all fingerprints at most `radius` bits apart."""
    segs = plan(n, radius)
    rows = entries(classes, segs)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = settle(sizes.filter(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).cast("int").alias("t")))
    if large.isEmpty():
        gridded = rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "ups", "fp")
    else:
        t = F.coalesce("t", F.lit(1))
        mine = F.pmod(F.xxhash64("fp"), t).cast("int")
        copies = rows.join(large, "key", "left").select(
            "key", "ups", "fp", mine.alias("s"), F.explode(F.sequence(F.lit(0), t - 1)).alias("o")
        )
        gridded = copies.select("key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "ups", "fp")
    by_run = gridded.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return by_run.mapInArrow(_compare(radius, tuple(s[2] for s in segs)), "a long, b long")


def labels(marked: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, label): the same label for fingerprints that links lead from one to the other."""
    classes = settle(marked.select("fp").distinct())
    joined = components(links(classes, classes.count(), radius, tile)).withColumnRenamed("id", "fp")
    return settle(classes.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("label")))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): a row a document."""
    marked = settle(fingerprints(docs, words))
    labelled = labels(marked, radius, tile)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(labelled, "fp")
    smallest = least.groupBy("label").agg(F.min("least").alias("component_id"))
    answer = settle(labelled.join(smallest, "label").select("fp", "component_id"))
    return marked.join(answer, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, of a component's only the one with the smallest id, null last.

    Rows are told apart by where they lie, so ids may repeat or be null.
    """
    placed = located(docs)
    rows = placed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "file", "at")
    marked = settle(fingerprints(rows, words, ("file", "at")))
    order = F.struct(F.col("doc_id").isNull().alias("null_last"), "doc_id", "file", "at")
    first = marked.groupBy("fp").agg(F.min(order).alias("first")).join(labels(marked, radius), "fp")
    kept = first.groupBy("label").agg(F.min("first").alias("first")).select("first.file", "first.at")
    return placed.join(settle(kept), ["file", "at"], "left_semi").select("row.*")
