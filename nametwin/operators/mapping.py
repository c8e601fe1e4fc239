"""Accepted name pairs turned back into positions, and into JSON replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametwin.operators.catalog import REFERENCE, SUPPLIER
from nametwin.operators.keep import settle
from nametwin.operators.tiling import TILE_ROWS, tiled_join

# One output row holds at most this many positions of either side.
A_TILE, B_TILE = 1024, 4096


def match_counts(names: DataFrame, accepted: DataFrame) -> DataFrame:
    """(request_id, n_matches): accepted position pairs, counted from copies without listing them."""
    copies = names.select("request_id", "side", "norm", "copies")
    a, b = (
        copies.filter(F.col("side") == side).select(
            "request_id", F.col("norm").alias(f"{side}_norm"), F.col("copies").alias(f"{side}_copies")
        )
        for side in (REFERENCE, SUPPLIER)
    )
    counted = accepted.join(a, ["request_id", "A_norm"]).join(b, ["request_id", "B_norm"])
    return counted.groupBy("request_id").agg(
        F.sum(F.col("A_copies") * F.col("B_copies")).alias("n_matches")
    )


def positional_mapping(
    usable_entries: DataFrame, accepted: DataFrame, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """(request_id, A_pos, B_tile, B_pos array): supplier positions per reference position.

    Positions ascend. A row lists positions of one B tile of 4096; catalogs up
    to that size give one row per reference position, a larger one gives more
    rows instead of an unbounded array. Unmatched references have no row.
    """
    named = usable_entries.withColumn("B_tile", F.floor(F.col("pos") / B_TILE).cast("long"))
    b_lists = (
        named.filter(F.col("side") == SUPPLIER)
        .groupBy("request_id", F.col("norm").alias("B_norm"), "B_tile")
        .agg(F.collect_list("pos").alias("B_list"))
    )
    a_rows = named.filter(F.col("side") == REFERENCE).select(
        "request_id", F.col("norm").alias("A_norm"), F.col("pos").alias("A_pos")
    )
    # a name has few lists, so adaptive skew handling can split its accepted pairs
    with_lists = accepted.select("request_id", "A_norm", "B_norm").join(
        b_lists, ["request_id", "B_norm"]
    )
    # all lists of one reference name and tile, joined before its copies multiply them
    by_name = settle(
        with_lists.groupBy("request_id", "A_norm", "B_tile").agg(
            F.array_sort(F.flatten(F.collect_list("B_list"))).alias("B_pos")
        )
    )
    spread = tiled_join(by_name, a_rows, ["request_id", "A_norm"], "B_tile", "A_pos", tile_rows)
    return spread.select("request_id", "A_pos", "B_tile", "B_pos")


def replies(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """(request_id, part, positional_mapping, error), one JSON object per request.

    Keys are reference positions as strings. A request without matches gives
    {}, a failed one its error. Only a request with more than 1024 x 4096
    positions spreads over several rows, told apart by `part`.
    """
    part = F.concat_ws("-", F.floor(F.col("A_pos") / A_TILE), F.col("B_tile"))
    objects = (
        mapping.groupBy("request_id", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("A_pos", "B_pos"))).alias("rows"))
        .select(
            "request_id",
            "part",
            F.to_json(
                F.map_from_entries(
                    F.transform("rows", lambda r: F.struct(r["A_pos"].cast("string"), r["B_pos"]))
                )
            ).alias("positional_mapping"),
        )
    )
    return requests.join(objects, "request_id", "left").select(
        "request_id",
        F.coalesce("part", F.lit("0-0")).alias("part"),
        F.when(F.col("error").isNull(), F.coalesce("positional_mapping", F.lit("{}"))).alias(
            "positional_mapping"
        ),
        "error",
    )
