"""Equi-join that splits a hot key over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.operators.keep import settle

# Rows of one side that one key may bring to one task, so a task compares at most
# TILE_ROWS * TILE_ROWS = 4 million pairs of a key.
TILE_ROWS = 2_000
MAX_HOT_KEYS = 500_000  # bound on the broadcast table of the hottest keys


def key_sizes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_left, n_right), combined map-side, so a hot key costs a row per task."""

    def count(side: DataFrame, mine: str, other: str) -> DataFrame:
        n = side.groupBy(*keys).agg(F.count("*").alias(mine))
        return n.withColumn(other, F.lit(0).cast("long"))

    both = count(left, "n_left", "n_right").unionByName(count(right, "n_right", "n_left"))
    return both.groupBy(*keys).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def tiled_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: str,
    right_id: str,
    tile_rows: int = TILE_ROWS,
    max_hot_keys: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Inner join of `left` and `right` on `keys`, whole, however skewed the keys are.

    A key with more than `tile_rows` rows on a side is cut into a grid: each
    left row goes to one grid row (by hash of its id) and to all grid columns,
    each right row the other way round, so every pair still meets exactly once
    and no task gets more than a tile of either side.

    Rows learn their grid in one of two ways. At most total / limit keys exceed
    a limit, so the keys above total / max_hot_keys are few enough to broadcast.
    Any other large key holds too small a share to skew a shuffle, so the rest
    of the grids is joined by shuffle, if there are any. Both inputs are read
    twice: keep them if they are costly.
    """
    sizes = settle(key_sizes(left, right, keys).filter(F.greatest("n_left", "n_right") > tile_rows))
    largest = F.greatest("n_left", "n_right")
    total = sizes.agg(F.sum(F.col("n_left") + F.col("n_right"))).first()[0]
    if total is None:
        return left.join(right, keys)

    def tiles(rows: str) -> Column:
        return F.ceil(F.col(rows) / tile_rows).cast("int")

    hottest = max(tile_rows, total // max_hot_keys)
    paired = sizes.filter((F.col("n_left") > 0) & (F.col("n_right") > 0))
    grids = paired.select(*keys, tiles("n_left").alias("t_left"), tiles("n_right").alias("t_right"), largest.alias("rows"))
    hot = grids.filter(F.col("rows") > hottest).drop("rows")
    warm = grids.filter((F.col("rows") > tile_rows) & (F.col("rows") <= hottest)).drop("rows")

    def with_grid(side: DataFrame, row_id: str) -> DataFrame:
        known = side.join(F.broadcast(hot), keys, "left")
        if hottest == tile_rows:
            return known
        # rows of hot keys carry a hash here, so they spread and meet no warm grid
        salt = F.when(F.col("t_left").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(row_id))
        marked = warm.select(
            *keys,
            F.lit(0).cast("long").alias("_salt"),
            F.col("t_left").alias("w_left"),
            F.col("t_right").alias("w_right"),
        )
        joined = known.withColumn("_salt", salt).join(marked, [*keys, "_salt"], "left")
        return joined.withColumns(
            {f"t_{s}": F.coalesce(f"t_{s}", f"w_{s}") for s in ("left", "right")}
        ).drop("_salt", "w_left", "w_right")

    def spread(side: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        own_tiles, other_tiles = (F.coalesce(f"t_{s}", F.lit(1)) for s in (own, other))
        return (
            with_grid(side, row_id)
            .withColumn(f"_tile_{own}", F.pmod(F.xxhash64(row_id), own_tiles).cast("int"))
            .withColumn(f"_tile_{other}", F.explode(F.sequence(F.lit(0), other_tiles - 1)))
            .drop("t_left", "t_right")
        )

    grid = [*keys, "_tile_left", "_tile_right"]
    joined = spread(left, left_id, "left", "right").join(
        spread(right, right_id, "right", "left"), grid
    )
    return joined.drop("_tile_left", "_tile_right")
