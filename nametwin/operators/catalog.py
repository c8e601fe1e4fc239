"""Catalog entries: one row per (request, side, position)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametwin.functions.text import is_valid, normalize

REFERENCE, SUPPLIER = "A", "B"


def explode_requests(requests: DataFrame) -> DataFrame:
    """(request_id, side, pos, name) from requests that hold both lists in arrays."""
    sides = F.array(
        F.struct(F.lit(REFERENCE).alias("side"), F.col("referenceCatalog").alias("names")),
        F.struct(F.lit(SUPPLIER).alias("side"), F.col("inputCatalog").alias("names")),
    )
    one_side = requests.select("request_id", F.explode(sides).alias("s"))
    return one_side.select("request_id", "s.side", F.posexplode("s.names").alias("pos", "name"))


def usable(entries: DataFrame) -> DataFrame:
    """Entries that can be matched, with `norm`; the raw name decides validity."""
    return entries.filter(is_valid(F.col("name"))).select(
        "request_id", "side", "pos", normalize(F.col("name")).alias("norm")
    )


def distinct_names(usable_entries: DataFrame) -> DataFrame:
    """(request_id, side, norm, copies): repeats collapse before anything is paired."""
    return usable_entries.groupBy("request_id", "side", "norm").agg(F.count("*").alias("copies"))


def pair_counts(entries: DataFrame) -> DataFrame:
    """Size of each request's candidate product, from its two factors.

    The product itself is never built: all pairs = |A| * |B|, and the pairs
    with two usable names = usable |A| * usable |B|.
    """
    a, ok = F.col("side") == REFERENCE, is_valid(F.col("name"))
    sizes = entries.groupBy("request_id").agg(
        F.count_if(a).alias("n_a"),
        F.count_if(~a).alias("n_b"),
        F.count_if(a & ok).alias("ok_a"),
        F.count_if(~a & ok).alias("ok_b"),
    )
    return sizes.select(
        "request_id",
        (F.col("n_a") * F.col("n_b")).alias("n_pairs"),
        (F.col("ok_a") * F.col("ok_b")).alias("n_valid_pairs"),
    )
