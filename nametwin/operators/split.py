"""Train/validation/test split that no partitioning or row order can change."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nametwin.functions.hashing import unit

PARTS = ("train", "val", "test")
_HISTOGRAM = 65_536  # ranks are exact; this only sets how many rows get ranked


def check_fractions(train: float, val: float) -> None:
    if train <= 0 or val <= 0:
        raise ValueError("train and validation fractions must be positive")
    if train + val >= 1.0:
        raise ValueError("train and validation fractions must add up to less than 1.0")


def part_sizes(n: int, train: float, val: float) -> tuple[int, int, int]:
    """Exact sizes: each of the two cuts rounds its held-out side up."""
    test = 1.0 - train - val
    held_out = math.ceil(n * (val + test))
    n_test = math.ceil(held_out * (test / (val + test)))
    return n - held_out, held_out - n_test, n_test


def assign_by_hash(rows: DataFrame, key: Column, train: float, val: float, seed: int) -> DataFrame:
    """Add `part` by cutting the hash of the key; sizes are right on average, no shuffle."""
    check_fractions(train, val)
    u = unit(key, F.lit(seed))
    part = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    return rows.withColumn("part", part)


def assign_exact(rows: DataFrame, key: Column, train: float, val: float, seed: int) -> DataFrame:
    """Add `part` with exactly the sizes of `part_sizes`; `key` must be unique.

    Rows rank by (hash, key). A 65536-bin histogram of the hash tells which bins
    hold the two cuts; only rows of those bins are ranked, so no task sees more
    than about 1/65536 of the rows whatever the table's size.
    """
    check_fractions(train, val)
    u = unit(key, F.lit(seed))
    keyed = rows.withColumns({"_u": u, "_key": key, "_bin": F.floor(u * _HISTOGRAM).cast("int")})
    bins = sorted((r["_bin"], r["n"]) for r in keyed.groupBy("_bin").agg(F.count("*").alias("n")).collect())
    n_train, n_val, _ = part_sizes(sum(n for _, n in bins), train, val)
    before, cut_bins, starts = 0, [], {}
    for b, n in bins:
        if any(before < cut < before + n for cut in (n_train, n_train + n_val)):
            cut_bins.append(b)
        starts[b] = before
        before += n
    # a bin without a cut lies in one part as a whole
    def whole(b: int) -> str:
        return PARTS[(starts[b] >= n_train) + (starts[b] >= n_train + n_val)]

    by_bin = {b: whole(b) for b in starts if b not in cut_bins}
    first = {p: min((b for b, q in by_bin.items() if q == p), default=None) for p in PARTS}
    plain = F.lit("train")
    for p in ("val", "test"):
        if first[p] is not None:
            plain = F.when(F.col("_bin") >= first[p], p).otherwise(plain)
    if not cut_bins:
        return keyed.select(*rows.columns, plain.alias("part"))
    in_cut = F.col("_bin").isin(cut_bins)
    start = F.lit(0)
    for b in cut_bins:
        start = F.when(F.col("_bin") == b, starts[b]).otherwise(start)
    rank = start + F.row_number().over(Window.partitionBy("_bin").orderBy("_u", "_key"))
    ranked = F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test")
    return (
        keyed.filter(~in_cut)
        .select(*rows.columns, plain.alias("part"))
        .unionAll(keyed.filter(in_cut).select(*rows.columns, ranked.alias("part")))
    )


def split(
    rows: DataFrame, key: Column, train: float, val: float, seed: int = 42, exact: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three disjoint parts of `rows`."""
    assign = assign_exact if exact else assign_by_hash
    parted = assign(rows, key, train, val, seed)
    return tuple(parted.filter(F.col("part") == p).drop("part") for p in PARTS)


def deduplicate(pairs: DataFrame) -> DataFrame:
    """One row per (A, B, match), with a `pair_id` that depends on the content only."""
    fields = ["A", "B", "match"]
    rows = pairs.select(*fields).distinct()
    key = F.sha2(F.to_json(F.struct(*fields)), 256)
    return rows.withColumn("pair_id", key)
