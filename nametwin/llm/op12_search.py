"""Exact k best inner products by branch and bound over blocks of dimensions.

Vectors are held by dimension: a tile of candidates is a matrix with a row for each
dimension, a column for each vector. A query reads it in blocks of dimensions, those in
which it has the most mass first, and adds up partial products. What the dimensions not
yet read can add is at most the product of the lengths left on both sides (Cauchy and
Schwarz), so a candidate whose partial product plus that bound lies below the k-th best
known score leaves; the survivors are compacted and only they are read on. The k-th
best known score starts from full products with the candidates that lead after the
first block, and rises with the k-th best lower bound.

Components become floor(scale * x). Partial products are whole numbers below 2**53, held
exactly in double precision; a group that could pass this is computed in Python's
integers, in full. Scores beyond a long are cut off there, then ranked. Candidates that
might tie with the k-th score stay until the end, so ties go to the smaller id.

Queries and candidates meet in blocks: a group holds QUERIES queries and one tile. Each
group passes on k candidates a query, of which the k best remain. The work grows with
queries times candidates, as any exact answer without assumptions on the data does;
tiles are dealt by row, so equal vectors spread like others.

Null vectors and vectors with null, NaN or infinite components neither ask nor answer.
Vectors of different length never meet. A row is no candidate of its own, rows that
repeat it are. Null ids never ask and lose ties. No rows: no rows. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nametwin.operators.keep import settle

K = 5
SCALE = 256
BLOCK = 8  # dimensions read before survivors are compacted
QUERIES = 512  # in a group
TILE_VALUES = 1 << 18  # components of a tile
EXACT = 1 << 53
LONG = (1 << 63) - 1
LEAD = 4  # times k candidates get full products first


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def best(columns: np.ndarray, query: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
    """(candidates, scores, components read): all that can be among the k best, in whole numbers as doubles.

    `columns` has a row for each dimension. `own` is left out.
    """
    alive = np.flatnonzero(np.arange(columns.shape[1]) != own)
    if len(alive) <= k:
        return alive, query @ columns[:, alive], columns.size
    order = np.argsort(-np.abs(query), kind="stable")
    partial_, read, floor = np.zeros(len(alive)), 0, -np.inf
    mass = np.einsum("dn,dn->n", columns, columns)[alive]
    left = float(query @ query)
    for at in range(0, len(query), BLOCK):
        dims = order[at : at + BLOCK]
        part = columns[np.ix_(dims, alive)]
        read += part.size
        partial_ += query[dims] @ part
        if at + BLOCK >= len(query):
            break
        mass = mass - np.einsum("dn,dn->n", part, part)
        left -= float(query[dims] @ query[dims])
        if at == 0:
            lead = alive[np.argpartition(-partial_, min(LEAD * k, len(alive)) - 1)[: LEAD * k]]
            floor = np.partition(query @ columns[:, lead], -k)[-k]
        room = np.sqrt(np.maximum(mass, 0) * max(left, 0)) * (1 + 1e-12)
        floor = max(floor, np.partition(partial_ - room, -k)[-k])
        stay = partial_ + room >= floor
        alive, partial_, mass = alive[stay], partial_[stay], mass[stay]
    return alive, partial_, read


def _first(scores, ids, uids, k: int) -> list[int]:
    """Places of the k best scores; ties to the smaller id, null last."""
    return sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0, uids[i]))[:k]


def _whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as Python integers."""
    split = lambda x: x.as_integer_ratio()
    return np.array([[n * scale // d for n, d in map(split, row)] for row in vectors.tolist()], object)


def _search(k: int, scale: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("asks").to_numpy()
        uid, vec = group.column("uid").to_numpy(), group.column("vec_id").to_pylist()
        flat = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = flat.reshape(len(uid), -1)
        queries, tile = np.flatnonzero(asks), np.flatnonzero(~asks)
        with np.errstate(over="ignore"):
            scaled = np.floor(vectors * scale)
        most = float(np.abs(scaled).max(initial=0))
        exact = most * most * max(1, vectors.shape[1]) < EXACT
        place = {u: i for i, u in enumerate(uid[tile].tolist())}
        columns = np.ascontiguousarray(scaled[tile].T) if exact else _whole(vectors[tile], scale).T
        out: list[tuple] = []
        for q in queries.tolist():
            own = place.get(int(uid[q]), -1)
            if exact:
                found, scores, _ = best(columns, scaled[q], k, own)
                if len(found) > k:  # those tied with the k-th are settled below
                    near = scores >= np.partition(scores, -k)[-k]
                    found, scores = found[near], scores[near]
                values = scores.astype(np.int64).tolist()
            else:
                found = np.array([i for i in range(len(tile)) if i != own], np.int64)
                asked = _whole(vectors[[q]], scale)[0]
                sums = (sum(a * b for a, b in zip(asked, columns[:, i], strict=True)) for i in found.tolist())
                values = [max(-LONG - 1, min(LONG, s)) for s in sums]
            rows = tile[found]
            ids, uids = [vec[r] for r in rows.tolist()], uid[rows].tolist()
            for i in _first(values, ids, uids, k):
                out.append((int(uid[q]), vec[q], ids[i], uids[i], values[i]))
        names = ("quid", "query_id", "vec_id", "uid", "score")
        columns_ = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns_, strict=True)})

    return run


def top_products(
    vectors: DataFrame,
    asks: Column,
    k: int = K,
    scale: int = SCALE,
    queries: int = QUERIES,
    tile_values: int = TILE_VALUES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row of (vec_id, embedding) for which `asks` holds."""
    rows = settle(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
        .filter(usable(F.col("embedding")))
        .withColumns({"asks": F.coalesce(asks, F.lit(False)), "dim": F.size("embedding")})
        .withColumn("uid", F.monotonically_increasing_id())
    )
    tile_rows = F.greatest(F.lit(1), F.floor(F.lit(tile_values) / F.greatest("dim", F.lit(1))))
    sizes = settle(
        rows.groupBy("dim").agg(
            F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"),
            F.greatest(F.lit(1), F.ceil(F.count_if("asks") / queries)).cast("int").alias("blocks"),
        )
    )
    dealt = rows.join(sizes, "dim")  # as many rows as lengths
    h = F.xxhash64("uid")
    asking = dealt.filter("asks").select(
        "dim", F.pmod(h, "blocks").cast("int").alias("block"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"),
        "asks", "uid", "vec_id", "embedding",
    )
    asked = dealt.select(
        "dim", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(h, "tiles").cast("int").alias("tile"),
        F.lit(False).alias("asks"), "uid", "vec_id", "embedding",
    )
    groups = asking.unionByName(asked).groupBy("dim", "block", "tile")
    found = groups.applyInArrow(_search(k, scale), "quid long, query_id long, vec_id long, uid long, score long")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
