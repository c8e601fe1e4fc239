"""Spelling indexes against comparing all names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from nametwin.functions.similarity import jaro_winkler_arrays
from nametwin.operators import candidates, spelling
from nametwin.operators.candidates import Bounds, Box, acceptable_names, spelled_names
from nametwin.operators.keep import settle
from nametwin.operators.spelling import segment_pairs, signature_pairs
from nametwin.operators.tfidf import fit_idf
from tests import brute


def edited(rng, name, edits, letters):
    chars = list(name)
    for _ in range(edits):
        at, what = rng.randrange(len(chars) + 1), rng.choice("ids")
        if what == "i":
            chars.insert(at, rng.choice(letters))
        elif at < len(chars):
            chars[at : at + 1] = [] if what == "d" else [rng.choice(letters)]
    return "".join(chars)


def spelled(seed, letters="ab", longest=14, n=70):
    """Names of two requests, many a few edits from others, empty and one-letter names among them."""
    rng = random.Random(seed)
    rows = set()
    for request, count in (("many", n), ("few", 8)):
        stems = ["".join(rng.choices(letters, k=rng.randrange(longest))) for _ in range(count // 2)]
        for side in "AB":
            rows |= {(request, side, edited(rng, rng.choice(stems), rng.randrange(7), letters)) for _ in range(count)}
            rows |= {(request, side, ""), (request, side, letters[0]), (request, side, letters[0] * 40)}
    return sorted(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "request_id string, side string, norm string, copies long")


def every_pair(rows):
    return [(r, a, b) for r, s, a in rows if s == "A" for q, t, b in rows if t == "B" and q == r]


@pytest.mark.parametrize(
    ("edits", "letters", "tile_rows"),
    [(0, "ab", 9), (1, "ab", 20_000), (2, "ab", 20_000), (3, "abcdefgh ", 7), (2, "é\U0001f600x", 20_000), (5, "abc", 20_000)],
)
def test_segments_find_exactly_the_names_within_the_edits(spark, edits, letters, tile_rows):
    rows = spelled(edits, letters)
    got = sorted(map(tuple, segment_pairs(frame(spark, rows), edits, tile_rows).collect()))
    assert got == sorted(p for p in every_pair(rows) if brute.levenshtein(p[1], p[2]) <= edits)


@pytest.mark.parametrize(
    ("box", "letters", "tile_rows"),
    [
        (Box(min_jaro_winkler=0.9), "abcdefghij ", 20_000),
        (Box(min_jaro_winkler=0.9), "abcdefghij ", 9),
        (Box(min_jaro_winkler=0.6), "abc", 20_000),
        (Box(8.5), "abcdef", 20_000),
        (Box(6, 0.8), "é\U0001f600xyz", 20_000),
        (Box(min_jaro_winkler=1.0), "ab", 20_000),
    ],
)
def test_signatures_keep_every_pair_of_the_box(spark, box, letters, tile_rows):
    rows = spelled(3, letters, 20)
    found = list(map(tuple, signature_pairs(frame(spark, rows), box, tile_rows).collect()))
    assert len(found) == len(set(found))
    pairs = every_pair(rows)
    winkler = jaro_winkler_arrays([a for _, a, _ in pairs], [b for _, _, b in pairs])
    inside = {p for p, w in zip(pairs, winkler, strict=True) if w >= box.min_jaro_winkler and brute.levenshtein(p[1], p[2]) <= box.max_levenshtein}
    assert inside <= set(found) and inside
    if box.min_jaro_winkler >= 0.9 and len(letters) > 5:
        assert len(found) < len(pairs) / 4  # most pairs never met


@pytest.mark.parametrize(
    ("min_cosine", "below"),
    [(0.7, Box(2)), (0.7, Box(min_jaro_winkler=0.85)), (0.0, Box(9.0, 0.7)), (0.7, Box(-1.0)), (0.0, Box())],
)
def test_pairs_within_bounds_equal_those_of_all_names(spark, below, min_cosine):
    rows = spelled(5, "abcd ", 20, 40)
    names = frame(spark, rows)
    idf = fit_idf(names, F.col("norm"))
    bounds = Bounds(min_cosine, Box(), below) if min_cosine else Bounds(0.0, below)
    key = ["request_id", "A_norm", "B_norm"]
    found = sorted(map(tuple, acceptable_names(names, idf, bounds).select(key).collect()))
    every = acceptable_names(names, idf, Bounds())
    assert every.count() == len(every_pair(rows))
    assert found == sorted(map(tuple, every.filter(bounds.holds()).select(key).collect()))


def test_no_names(spark):
    names = frame(spark, [("r", "A", "x")])
    idf = fit_idf(frame(spark, [("r", "A", "some words")]), F.col("norm"))
    for box in (Box(2), Box(min_jaro_winkler=0.8), Box()):
        assert spelled_names(names, idf, box).count() == spelled_names(names.limit(0), idf, box).count() == 0


def test_small_requests_write_only_names_and_pairs_in_the_box(spark, monkeypatch):
    """Pairs that fail a bound die where they are made: none is written or fetches its weights."""
    written = []

    def watched(table):
        kept = settle(table)
        written.append((set(kept.columns), kept.count()))
        return kept

    for module in (candidates, spelling):
        monkeypatch.setattr(module, "settle", watched)
    rows = spelled(11, "abcdefgh ", 20, 60)
    names, box = frame(spark, rows), Box(min_jaro_winkler=0.85)
    idf = fit_idf(names, F.col("norm"))
    found = spelled_names(names, idf, box).count()
    pairs = every_pair(rows)
    winkler = jaro_winkler_arrays([a for _, a, _ in pairs], [b for _, _, b in pairs])
    assert found == sum(w >= box.min_jaro_winkler for w in winkler)
    of_pairs = [n for columns, n in written if any(c.startswith("B_") for c in columns)]
    assert of_pairs and max(of_pairs) == found
    assert max(n for _, n in written) <= max(found, len(rows))
