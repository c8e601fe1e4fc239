"""Names that are spelled alike, found without comparing all names of a request.

Two indexes, both exact. `segment_pairs` serves small edit distances, `signature_pairs`
any bound on edits or on Jaro-Winkler.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.operators.catalog import REFERENCE, SUPPLIER
from nametwin.operators.keep import settle
from nametwin.operators.tiling import TILE_ROWS, key_sizes, tiled_join

GROUPS = 4  # of characters, by code point; their counts make the classes of names
LEVELS, CELLS = 4, 16  # of a fine signature: counts up to 4 for 16 groups in 64 bits
WORDS = 2  # longs of a fine signature, so 32 groups
LEAD = 4  # characters that boost Jaro-Winkler, by BOOST each
BOOST, BOOSTED = 0.1, 0.7
_SLACK = 1e-9


def _sides(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(
        names.filter(F.col("side") == side).select("request_id", F.col("norm").alias(f"{side}_norm"))
        for side in (REFERENCE, SUPPLIER)
    )


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(start, size) of the i-th of `parts` segments of nearly equal size, longer ones last."""
    base, over = F.floor(length / parts), length % parts
    longer = F.greatest(F.lit(0), i - (parts - over))
    return i * base + longer, base + (i >= parts - over).cast("int")


def segment_pairs(names: DataFrame, edits: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(request_id, A_norm, B_norm) of all names at most `edits` edits apart.

    Cut one name into edits + 1 segments: the edits leave one of them whole, and the
    other name holds it near the same place. With i segments before it, the place shifts
    by at most i edits seen from the left, and by as many as remain seen from the right.
    So each A-name is listed under its segments, each B-name asks for the few substrings
    that could be one, and every pair that meets is verified in the task where it does.
    Rows are linear in names: edits + 1 for an A-name, some (2 edits + 1)(edits + 1)
    substrings for a B-name. A frequent segment is cut into tiles.

    Names no longer than `edits` have no segments. They can only match names of twice
    that length, and those are compared in tiles.
    """
    parts = edits + 1
    a, b = (side.withColumn("n", F.length(side.columns[1])) for side in _sides(names))
    long_a = a.filter(F.col("n") > edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    start, size = _segment(F.col("n"), F.col("i"), parts)
    listed = long_a.select(
        "request_id", "A_norm", F.xxhash64("n", "i", F.substring("A_norm", start + 1, size)).alias("key")
    )
    lengths = F.sequence(F.greatest(F.col("n") - edits, F.lit(parts)), F.col("n") + edits)
    asking = b.filter(F.col("n") + edits >= parts).withColumn("l", F.explode(lengths))
    asking = asking.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(edits))))
    start, size = _segment(F.col("l"), F.col("i"), parts)
    shift, left, right = F.col("n") - F.col("l"), F.col("i"), edits - F.col("i")
    first = F.greatest(F.lit(0), start - left, start + shift - right)
    last = F.least(F.col("n") - size, start + left, start + shift + right)
    places = F.when(first <= last, F.sequence(first, last))
    asked = (
        asking.withColumns({"size": size, "at": F.explode(places)})
        .select("request_id", "B_norm", F.xxhash64("l", "i", F.substring("B_norm", F.col("at") + 1, F.col("size"))).alias("key"))
        .distinct()
    )
    near = F.levenshtein("A_norm", "B_norm", edits) >= 0
    met = tiled_join(settle(listed), settle(asked), ["request_id", "key"], "A_norm", "B_norm", tile_rows)
    found = met.filter(near).select("request_id", "A_norm", "B_norm").distinct()
    short_a = a.filter(F.col("n") <= edits).drop("n")
    short_b = b.filter(F.col("n") <= 2 * edits).drop("n")
    short = tiled_join(settle(short_a), settle(short_b), ["request_id"], "A_norm", "B_norm", tile_rows)
    return found.unionByName(short.filter(near).select("request_id", "A_norm", "B_norm"))


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _count(codes: Column, group: int, groups: int) -> Column:
    return F.size(F.filter(codes, lambda c: c % groups == group))


def _fine(codes: Column, word: int) -> Column:
    """64 bits: for each of 16 groups, as many ones as the name has characters of it, 4 at most."""
    bits = F.lit(0).cast("long")
    for cell in range(CELLS):
        held = F.least(_count(codes, word * CELLS + cell, WORDS * CELLS), F.lit(LEVELS))
        ones = F.element_at(F.lit([0, 1, 3, 7, 15]), held + 1).cast("long")
        bits = bits.bitwiseOR(F.shiftleft(ones, cell * LEVELS))
    return bits


def signatures(names: DataFrame) -> DataFrame:
    """`names` with n, g0.., the class (counts of character groups), and the fine signature s0.., over.

    The longest common part of two names, in any order, is at most the sum of the lesser
    counts, group by group; `over` is what a fine signature leaves out.
    """
    coded = names.withColumn("codes", _codes(F.col("norm")))
    counts = {f"g{g}": _count(F.col("codes"), g, GROUPS) for g in range(GROUPS)}
    fine = {f"s{w}": _fine(F.col("codes"), w) for w in range(WORDS)}
    held = sum((F.bit_count(f"s{w}") for w in range(WORDS)), F.lit(0))
    signed = coded.withColumns(counts | fine | {"n": F.size("codes")}).withColumn("over", F.col("n") - held)
    return signed.withColumn("lead", F.substring("norm", 1, LEAD)).drop("codes")


def can_be_near(common: Column, m: Column, n: Column, box, lead: Column | float = float(LEAD)) -> Column:
    """False where names of lengths m and n with at most `common` shared characters lie outside the box.

    Jaro is at most (common / m + common / n + 1) / 3, since transpositions only lower it,
    and `lead` shared first characters lift what exceeds 0.7. An edit distance is at least
    the longer length less the shared characters.
    """
    fits = F.greatest(m, n) - common <= F.lit(box.max_levenshtein)
    jaro = F.when((m > 0) & (n > 0) & (common > 0), (common / m + common / n + 1) / 3).otherwise(0.0)
    winkler = F.when(jaro > BOOSTED - _SLACK, jaro + lead * BOOST * (1 - jaro)).otherwise(jaro)
    return fits & (winkler >= box.min_jaro_winkler - _SLACK)


def bounds_something(box) -> bool:
    """Whether a signature can rule out a pair: with no shared character Jaro is 0, with few above 1/3."""
    return math.isfinite(box.max_levenshtein) or box.min_jaro_winkler > 1 / 3


def signature_pairs(names: DataFrame, box, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(request_id, A_norm, B_norm) of all name pairs that can lie in the box, and some that do not.

    A request of at most `tile_rows` names a side is one tile: its names meet in one task
    and only they are shuffled. In a larger one, names with equal counts of characters in
    GROUPS groups are one class. Classes of a request, a number that grows with name lengths
    rather than with names, are compared by their upper bound; names meet only where their
    classes can. Then the fine signature and the first characters give a sharper bound, in a
    few JVM instructions a pair, before any distance is taken.
    """
    signed = settle(signatures(names.select("request_id", "side", "norm")))
    groups = [f"g{g}" for g in range(GROUPS)]
    sides = (signed.filter(F.col("side") == side) for side in (REFERENCE, SUPPLIER))
    sizes = key_sizes(*sides, ["request_id"])
    # at most one for each tile_rows names
    large = settle(sizes.filter(F.greatest("n_left", "n_right") > tile_rows).select("request_id"))
    common = sum((F.least(f"A_{g}", f"B_{g}") for g in groups), F.lit(0))
    can = can_be_near(common, F.col("A_n"), F.col("B_n"), box)
    own = ["norm", "n", "over", "lead", *[f"s{w}" for w in range(WORDS)]]

    def side(rows: DataFrame, side: str, columns: list[str]) -> DataFrame:
        picked = [F.col(c).alias(f"{side}_{c}") for c in columns]
        return rows.filter(F.col("side") == side).select("request_id", *picked)

    def sharper(pairs: DataFrame) -> DataFrame:
        return pairs.filter(_fine_bound(box)).select("request_id", "A_norm", "B_norm")

    few = signed.join(F.broadcast(large), "request_id", "left_anti")
    a, b = (side(few, s, [*own, *groups]) for s in (REFERENCE, SUPPLIER))
    found = sharper(a.join(b, "request_id").filter(can))
    if large.isEmpty():
        return found
    keyed = signed.join(F.broadcast(large), "request_id", "left_semi").withColumn("cls", F.xxhash64(*groups))
    classes = (settle(side(keyed, s, [*groups, "n", "cls"]).distinct()) for s in (REFERENCE, SUPPLIER))
    met = tiled_join(*classes, ["request_id"], "A_cls", "B_cls", tile_rows)
    able = settle(met.filter(can).select("request_id", "A_cls", "B_cls"))
    a, b = (side(keyed, s, [*own, "cls"]) for s in (REFERENCE, SUPPLIER))
    half = tiled_join(a, able, ["request_id", "A_cls"], "A_norm", "B_cls", tile_rows).drop("A_cls")
    pairs = tiled_join(settle(half), b, ["request_id", "B_cls"], "A_norm", "B_norm", tile_rows)
    return found.unionByName(sharper(pairs))


def _fine_bound(box) -> Column:
    """False where the fine signatures and first characters of A_ and B_ rule a pair out."""
    shared = sum((F.bit_count(F.col(f"A_s{w}").bitwiseAND(F.col(f"B_s{w}"))) for w in range(WORDS)), F.lit(0))
    common = F.least(shared + F.least("A_over", "B_over"), "A_n", "B_n")
    same = F.lit(True)
    lead = F.lit(0)
    for i in range(1, LEAD + 1):  # characters alike from the start on
        a, b = F.substring("A_lead", i, 1), F.substring("B_lead", i, 1)
        same = same & (a == b) & (a != "")
        lead = lead + same.cast("int")
    return can_be_near(common, F.col("A_n"), F.col("B_n"), box, lead)
