"""Similarity of names by given vectors: a fourth feature beside the three of the spelling.

Vectors come as a table, from whatever encoder made them; none runs here. A name without
a usable vector, or two vectors of different length, give a similarity of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.config import DENSE
from nametwin.functions.similarity import dense_cosine, dense_dot
from nametwin.functions.text import normalize
from nametwin.operators.keep import settle
from nametwin.operators.tfidf import settled_cosine
from nametwin.operators.tiling import TILE_ROWS, tiled_join


def vector_table(vectors: DataFrame) -> DataFrame:
    """(norm, vector) of rows (name, vector): the smallest vector of names that are cleaned to the same.

    Vectors that are null or empty, or hold null or what is not finite, are left out.
    """
    vector = F.col("vector").cast("array<double>")
    fine = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(fine).select(normalize(F.col("name")).alias("norm"), vector.alias("vector"))
    return settle(rows.groupBy("norm").agg(F.min("vector").alias("vector")))


def fetch(rows: DataFrame, vectors: DataFrame, norm: str, row_id: str, out: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """`rows` plus column `out`, the vector of the name in `norm`, null where it has none.

    `row_id` tells rows of the same name apart, so that a frequent name is cut into tiles.
    `rows` are read twice.
    """
    known = vectors.select(F.col("norm").alias(norm), F.col("vector").alias(out))
    whole = settle(rows.select(norm).distinct().join(known, norm, "left"))
    return tiled_join(rows, whole, [norm], row_id, norm, tile_rows)


def vector_length(vector: Column) -> Column:
    return F.sqrt(dense_dot(vector, vector))


def similarity(a: Column, b: Column, lengths: Column | None = None) -> Column:
    """Settled cosine; `lengths` is the product of both lengths, where it is known."""
    cosine = F.when(F.size(a) == F.size(b), dense_cosine(a, b, lengths))
    return settled_cosine(F.coalesce(F.nanvl(cosine, F.lit(0.0)), F.lit(0.0)))


def with_dense(pairs: DataFrame, vectors: DataFrame, row_id: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """`pairs` (A_norm, B_norm and more) plus the similarity of their vectors; a row a pair."""
    kept = settle(pairs)
    one = fetch(kept, vectors, "A_norm", row_id, "_A_vector", tile_rows)
    two = fetch(one, vectors, "B_norm", row_id, "_B_vector", tile_rows)
    return two.select(*pairs.columns, similarity(F.col("_A_vector"), F.col("_B_vector")).alias(DENSE))
