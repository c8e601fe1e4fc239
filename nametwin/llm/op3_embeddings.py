"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class. The classes of a label are dealt to tiles, and
every pair of tiles is one group of rows. A unit vector x is written as s*q + r, with q
in int8 and s its largest component over 127. Then x.y differs from s*s'*(q.q') by at
most |r| + |r'| + |r|*|r'|, with each vector's own |r|. A product of int8 matrices thus
decides most pairs; those whose interval holds the threshold are computed again from
the full vectors in double precision. The products are sums of integers below 2**24,
taken in blocks of 1024 components, so single precision holds them exactly.

A group passes on, for each of its classes, how many vectors it links to, and one edge
of a spanning forest; never a pair list.

Null label, null vector, a null, NaN or infinite component, or length zero: linked with
nothing. Vectors of different length never link. Null vec_id: compared like others; the
component is the smallest id reachable, null where there is none. Repeated rows are
vectors of their own. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.llm.components import components, stars
from nametwin.operators.keep import settle

THRESHOLD = 0.98
TILE = 2048
BLOCK = 512  # rows of a product held at a time
DEPTH = 1024  # components whose int8 products a float adds up exactly
SLACK = 1e-12  # rounding of the bounds themselves


def usable(vector: Column) -> Column:
    """True where a cosine is defined."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which is exact, so that no square overflows or vanishes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, error): int8 rows, their scale, and the length of what rounding leaves."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - scale[:, None] * q, axis=1)
    return q, scale, error


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], DEPTH):
        part = slice(at, at + DEPTH)
        out += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return out


def tile_links(
    left: np.ndarray, right: np.ndarray, threshold: float, same: bool
) -> tuple[list[tuple[int, np.ndarray]], int]:
    """Blocks (first row, link matrix) of left against right, and how many pairs were computed again."""
    norms = [np.linalg.norm(v, axis=1) for v in (left, right)]
    qa, sa, ea = quantise(left / norms[0][:, None])
    qb, sb, eb = quantise(right / norms[1][:, None])
    blocks, again = [], 0
    for at in range(0, len(left), BLOCK):
        rows = slice(at, at + BLOCK)
        near = _product(qa[rows], qb) * sa[rows, None] * sb[None, :]
        bound = ea[rows, None] + eb[None, :] + ea[rows, None] * eb[None, :] + SLACK
        link = near - bound >= threshold
        i, j = np.nonzero((near + bound >= threshold) & ~link)
        if same:
            i, j = i[at + i < j], j[at + i < j]
        for k in range(0, len(i), 1 << 16):
            x, y = at + i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            cosine = np.einsum("nd,nd->n", left[x], right[y]) / (norms[0][x] * norms[1][y])
            link[x - at, y] = cosine >= threshold
        again += len(i)
        if same:
            link &= (at + np.arange(len(link)))[:, None] < np.arange(len(right))[None, :]
        blocks.append((at, link))
    return blocks, again


def _tile(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        tile = group.column("tile").to_numpy()
        ids = group.column("cid").to_numpy()
        copies = group.column("copies").to_numpy().astype(np.float64)
        flat = group.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64)
        vectors = scaled(flat.reshape(len(ids), -1))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        a = np.flatnonzero(tile == i)
        b = a if i == j else np.flatnonzero(tile == j)
        linked = np.zeros(len(ids))
        ends: tuple[np.ndarray, np.ndarray] = (ids[:0], ids[:0])
        if len(a) and len(b):
            for at, link in tile_links(vectors[a], vectors[b], threshold, i == j)[0]:
                rows = a[at : at + len(link)]
                linked[rows] += link @ copies[b]
                linked[b] += copies[rows] @ link
                x, y = np.nonzero(link)
                new = stars(ids[rows[x]], ids[b[y]])
                ends = stars(*(np.concatenate(p) for p in zip(ends, new, strict=True)))
        root = dict(zip(ends[0].tolist(), ends[1].tolist(), strict=True))
        on = np.flatnonzero(linked)
        return pa.table(
            {
                "cid": pa.array(ids[on], pa.int64()),
                "links": pa.array(linked[on].astype(np.int64)),
                "root": pa.array([root.get(c, c) for c in ids[on].tolist()], pa.int64()),
            }
        )

    return run


def classes_of(vectors: DataFrame) -> DataFrame:
    """(cid, label, embedding, least, copies): a row for each distinct usable vector of a label."""
    rows = vectors.filter(F.col("label").isNotNull() & usable(F.col("embedding")))
    grouped = rows.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    return settle(grouped.withColumn("cid", F.monotonically_increasing_id()))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id): a row for each row of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    classes = classes_of(rows)
    shape = ["label", F.size("embedding").alias("dim")]
    sizes = classes.groupBy(*shape).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    dealt = classes.withColumn("dim", F.size("embedding")).join(settle(sizes), ["label", "dim"])
    mine = F.pmod(F.xxhash64("cid"), "tiles").cast("int")
    copies = dealt.withColumn("tile", mine).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    gridded = copies.select(
        "label",
        "dim",
        F.least("tile", "other").alias("i"),
        F.greatest("tile", "other").alias("j"),
        "tile",
        "cid",
        "copies",
        "embedding",
    )
    found = settle(
        gridded.groupBy("label", "dim", "i", "j").applyInArrow(
            _tile(threshold), "cid long, links long, root long"
        )
    )
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    labelled = settle(
        classes.drop("embedding", "label")
        .join(counts, "cid", "left")
        .join(joined.withColumnRenamed("id", "cid"), "cid", "left")
        .select(
            "cid",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "cid").alias("root"),
        )
    )
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = labelled.join(smallest, "root").select("cid", "n_links", "component_id")
    by_vector = settle(classes.join(answer, "cid").select("label", "embedding", "n_links", "component_id"))
    good = F.col("label").isNotNull() & usable(F.col("embedding"))
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    grouped = rows.filter(good).join(by_vector, ["label", "embedding"])
    return grouped.select("vec_id", "n_links", "component_id").unionByName(alone)
