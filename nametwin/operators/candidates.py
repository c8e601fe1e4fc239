"""Name pairs a decision could accept, found without building the product.

A decision states necessary conditions (`Bounds`) that every pair it accepts
meets. A pair above a cosine bound shares a word, and a weight bound says which
words are enough to look at: an exact index, not a sampling heuristic. Pairs
below it, if the decision accepts any, are found by their spelling: segments for
few edits, character signatures for other bounds (`spelling`). Only a decision
without any bound on the spelling makes names be compared tile by tile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.config import DENSE
from nametwin.functions.similarity import jaro_winkler, levenshtein, sparse_dot
from nametwin.operators.catalog import REFERENCE, SUPPLIER
from nametwin.operators.dense import fetch, similarity, vector_length, with_dense
from nametwin.operators.keep import settle
from nametwin.operators.spelling import bounds_something, segment_pairs, signature_pairs
from nametwin.operators.tfidf import Idf, profiles, settled_cosine
from nametwin.operators.tiling import TILE_ROWS, tiled_join

MAX_BANDED = 2.0**31  # a finite edit bound cuts the distance matrix to a band
MAX_SEGMENT_EDITS = 5  # beyond, segments of names are too short to tell them apart
_SLACK = 1e-9  # room for rounding, so a pair exactly on a bound is kept


@dataclass(frozen=True)
class Box:
    max_levenshtein: float = float("inf")
    min_jaro_winkler: float = 0.0
    min_dense: float = float("-inf")  # of the vectors, where names have any

    @property
    def bounds_dense(self) -> bool:
        return self.min_dense > float("-inf")

    def holds(self) -> Column:
        if not self.bounds_dense:
            return self.holds_spelling()
        return self.holds_spelling() & (F.col(DENSE) >= self.min_dense - _SLACK)

    @property
    def bounds_spelling(self) -> bool:
        return self.max_levenshtein < float("inf") or self.min_jaro_winkler > 0

    def holds_spelling(self) -> Column:
        alike = F.col("jaro_winkler_similarity") >= self.min_jaro_winkler - _SLACK
        if self.max_levenshtein == float("inf"):
            return alike
        return (F.col("levenshtein_distance") <= F.lit(self.max_levenshtein)) & alike


@dataclass(frozen=True)
class Bounds:
    """What every accepted pair meets.

    With a cosine of `min_cosine` or more it lies in `above`; with that or a
    smaller one in `below`, and None says no such pair is accepted. A cut can lie
    on a value that pairs have, so pairs within the slack of it may lie in either.
    """

    min_cosine: float = 0.0
    above: Box = Box()
    below: Box | None = None

    def holds(self) -> Column:
        return self.holds_above() | self.holds_below()

    def holds_above(self) -> Column:
        return (F.col("cosine_similarity") >= self.min_cosine - _SLACK) & self.above.holds()

    def holds_below(self) -> Column:
        if self.below is None:
            return F.lit(False)
        return (F.col("cosine_similarity") <= self.min_cosine + _SLACK) & self.below.holds()


def prefix_terms(terms: Column, profile: Column, min_cosine: float) -> Column:
    """The rarest terms of a name, until the rest is too light to reach `min_cosine`.

    Two unit vectors that share no prefix term have all their common terms in
    the tail of one of them, so their cosine is at most that tail's length. All
    names order terms alike (rarest first), which makes the argument symmetric.
    """
    limit = max(0.0, min_cosine - _SLACK) ** 2

    def step(acc: Column, w: Column) -> Column:
        open_ = acc["tail"] >= limit
        return F.struct(
            (acc["tail"] - w * w).alias("tail"),
            (acc["n"] + open_.cast("int")).alias("n"),
        )

    # a profile lists its weights in the order of the terms
    scan = F.aggregate(
        F.map_values(profile), F.struct(F.lit(1.0 + _SLACK).alias("tail"), F.lit(0).alias("n")), step
    )
    return F.slice(terms, F.lit(1), scan["n"])


def _side(names: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return names.filter(F.col("side") == side).select(
        "request_id", *[F.col(c).alias(f"{side}_{c}") for c in columns]
    )


def _lengths_fit(box: Box) -> Column:
    """Edit distance is at least the difference of the lengths."""
    return F.abs(F.length("A_norm") - F.length("B_norm")) <= F.lit(box.max_levenshtein)


def sharing_names(
    names: DataFrame, idf: Idf, bounds: Bounds, tile_rows: int = TILE_ROWS, ready: DataFrame | None = None
) -> DataFrame:
    """(request_id, A_norm, B_norm, cosine_similarity) with cosine >= bounds.min_cosine > 0.

    The join key is (request, prefix term). Frequent words are light, so they
    rarely are prefix terms; where one is, the join cuts it into tiles. A pair
    that meets under several terms is kept at the first of them only, which
    needs no distinct. `ready` are the names with their profiles, where they are known.
    """
    if bounds.min_cosine <= 0:
        raise ValueError("an index on shared words needs a positive cosine bound")
    ready = _profiled(names, idf) if ready is None else ready
    prefix = prefix_terms(F.col("terms"), F.col("profile"), bounds.min_cosine)
    a, b = (
        _side(ready.withColumn("prefix", prefix), side, ["norm", "profile", "prefix"]).withColumn("term", F.explode(f"{side}_prefix"))
        for side in (REFERENCE, SUPPLIER)
    )
    met = tiled_join(a, b, ["request_id", "term"], "A_norm", "B_norm", tile_rows)
    first = F.get(F.array_intersect("A_prefix", "B_prefix"), F.lit(0)) == F.col("term")
    return (
        met.filter(first & _lengths_fit(bounds.above))
        .select(
            "request_id",
            "A_norm",
            "B_norm",
            settled_cosine(sparse_dot(F.col("A_profile"), F.col("B_profile"))).alias("cosine_similarity"),
        )
        .filter(F.col("cosine_similarity") >= bounds.min_cosine - _SLACK)
    )


def _profiled(names: DataFrame, idf: Idf) -> DataFrame:
    """(request_id, side, norm, terms, profile) of all names, those without known words among them."""
    weighed = profiles(names, ["request_id", "side", "norm"], idf, every=True)
    no_terms = F.create_map().cast("map<string,double>")
    return settle(weighed.withColumn("profile", F.coalesce("profile", no_terms)))


def _cosine() -> Column:
    return settled_cosine(sparse_dot(F.col("A_profile"), F.col("B_profile"))).alias("cosine_similarity")


def compared_names(
    names: DataFrame, idf: Idf, box: Box, tile_rows: int = TILE_ROWS, vectors: DataFrame | None = None
) -> DataFrame:
    """The same columns for pairs in the box, whether or not they share a word; with `vectors` their similarity too.

    The last resort: a request's distinct names are compared tile by tile. Each task
    holds a tile of either side, and pairs that fail a bound die in the task that made
    them. None is shuffled, and names bring their vectors along, so no pair has to fetch one.
    """
    ready, columns = _profiled(names, idf), ["norm", "profile"]
    if vectors is not None:
        row = F.xxhash64("request_id", "side").alias("_row")
        found = fetch(ready.select("*", row), vectors, "norm", "_row", "vector", tile_rows)
        ready = settle(found.withColumn("length", vector_length(F.col("vector"))))
        columns += ["vector", "length"]
    a, b = (_side(ready, side, columns) for side in (REFERENCE, SUPPLIER))
    met = tiled_join(a, b, ["request_id"], "A_norm", "B_norm", tile_rows)
    if box.max_levenshtein < float("inf"):
        met = met.filter(_lengths_fit(box))
    wanted = ["request_id", "A_norm", "B_norm", _cosine()]
    if vectors is None:
        return met.select(*wanted)
    a, b = (F.col(f"{side}_vector") for side in (REFERENCE, SUPPLIER))
    alike = similarity(a, b, F.col("A_length") * F.col("B_length")).alias(DENSE)
    compared = met.select(*wanted, alike)
    return compared.filter(F.col(DENSE) >= box.min_dense - _SLACK) if box.bounds_dense else compared


def spelled_names(
    names: DataFrame,
    idf: Idf,
    box: Box,
    tile_rows: int = TILE_ROWS,
    vectors: DataFrame | None = None,
    ready: DataFrame | None = None,
) -> DataFrame:
    """Pairs in the box, by way of their spelling, with the features; that of `vectors` where no spelling is bounded.

    Few edits go by segments, any other bound on edits or on Jaro-Winkler by character
    signatures. Distances come first, so weights are fetched for the pairs in the box only.
    """
    if box.max_levenshtein < 0:  # no pair is that near
        return _with_distances(compared_names(names.limit(0), idf, box, tile_rows), box)
    if not bounds_something(box):
        return _with_distances(compared_names(names, idf, box, tile_rows, vectors), box)
    if box.max_levenshtein < MAX_SEGMENT_EDITS + 1:
        near = segment_pairs(names, int(box.max_levenshtein), tile_rows)
    else:
        near = signature_pairs(names, box, tile_rows)
    near = settle(_with_distances(near, box))
    ready = _profiled(names, idf) if ready is None else ready
    a, b = (_side(ready, side, ["norm", "profile"]) for side in (REFERENCE, SUPPLIER))
    half = tiled_join(near, a, ["request_id", "A_norm"], "B_norm", "A_norm", tile_rows)
    both = tiled_join(settle(half), b, ["request_id", "B_norm"], "A_norm", "B_norm", tile_rows)
    return both.select("request_id", "A_norm", "B_norm", _cosine(), "levenshtein_distance", "jaro_winkler_similarity")


def _with_distances(pairs: DataFrame, box: Box) -> DataFrame:
    """Levenshtein on all pairs, within the box's bound only; Jaro-Winkler on those it leaves."""
    distance = levenshtein(F.col("A_norm"), F.col("B_norm"))
    if box.max_levenshtein < MAX_BANDED:
        near = F.levenshtein("A_norm", "B_norm", max(0, int(box.max_levenshtein)))
        distance = F.when(near >= 0, near)
    pairs = pairs.withColumn("levenshtein_distance", distance)
    if box.max_levenshtein < float("inf"):  # without a bound, a filter would only take each distance twice
        pairs = pairs.filter(F.col("levenshtein_distance") <= F.lit(box.max_levenshtein))
    pairs = pairs.withColumn("jaro_winkler_similarity", jaro_winkler("A_norm", "B_norm"))
    return pairs.filter(box.holds_spelling()) if box.bounds_spelling else pairs


def acceptable_names(
    names: DataFrame, idf: Idf, bounds: Bounds, tile_rows: int = TILE_ROWS, vectors: DataFrame | None = None
) -> DataFrame:
    """All name pairs within the bounds, with the three features, and the fourth with `vectors`."""

    def finished(pairs: DataFrame, box: Box) -> DataFrame:
        if vectors is None or DENSE in pairs.columns:
            return pairs
        row = F.xxhash64("request_id", "A_norm", "B_norm").alias("_row")
        return with_dense(pairs.select("*", row), vectors, "_row", tile_rows).drop("_row").filter(box.holds())

    if bounds.min_cosine <= 0:
        return finished(spelled_names(names, idf, bounds.above, tile_rows, vectors), bounds.above)
    ready = _profiled(names, idf)
    shared = sharing_names(names, idf, bounds, tile_rows, ready)
    pairs = finished(_with_distances(shared, bounds.above), bounds.above)
    if bounds.below is None:
        return pairs
    rest = spelled_names(names, idf, bounds.below, tile_rows, vectors, ready).filter(
        F.col("cosine_similarity") <= bounds.min_cosine + _SLACK
    )
    # a pair on the cut that lies in both boxes is in the first part already
    return pairs.unionByName(finished(rest, bounds.below).filter(~bounds.holds_above()))
