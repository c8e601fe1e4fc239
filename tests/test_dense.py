"""Given vectors as the fourth feature: joined, trained on, bounded and indexed."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from nametwin.config import DENSE, FEATURES, BoostParams, Settings
from nametwin.operators import candidates, catalog, dense
from nametwin.operators.candidates import Bounds, Box, acceptable_names
from nametwin.operators.dense import vector_table, with_dense
from nametwin.operators.keep import settle
from nametwin.operators.tfidf import fit_idf
from nametwin.plans import catalogue
from nametwin.plans.catalogue import _letter_vectors
from nametwin.plans.matching import Rule, accept, match_entries
from nametwin.plans.model import run_model
from nametwin.plans.training import train
from nametwin.plans.trees import model_features, score_by_boxes, split_counts, tree_nodes
from nametwin.sources import registry
from nametwin.sources.synthetic import labelled_pairs
from tests.test_matching import random_catalogs

FEW = Settings(boost=BoostParams(max_iter=6), min_precision=0.6)


def cosine(a, b):
    if not a or not b or len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


@pytest.mark.parametrize("tile_rows", [3, 2000])
def test_similarity_of_vectors_against_brute_force(spark, tile_rows):
    rng = random.Random(1)
    given = {f"n{i}": [rng.uniform(-1, 1) for _ in range(5)] for i in range(12)}
    given |= {"zero": [0.0] * 5, "short": [1.0, 2.0], "": [1.0] * 5}
    bad = [("n99", None), ("n98", []), ("n97", [float("nan")] * 5), ("n96", [None] * 5), ("n95", [float("inf")] * 5)]
    rows = [*given.items(), *bad, ("N0!", [9.0] * 5)]  # cleaned to a name that has a smaller one
    vectors = vector_table(spark.createDataFrame(rows, "name string, vector array<double>"))
    names = ["n0"] * 6 + [n for n, _ in rows[:-1]] + ["unknown"]
    pairs = [(i, rng.choice(names), rng.choice(names), "x") for i in range(150)]
    frame = spark.createDataFrame(pairs, "id long, A_norm string, B_norm string, vector string")
    found = with_dense(frame, vectors, "id", tile_rows)
    assert found.columns == [*frame.columns, DENSE]
    got = {r["id"]: r[DENSE] for r in found.collect()}
    given["n0"] = min(given["n0"], [9.0] * 5)
    assert got == pytest.approx({i: cosine(given.get(a), given.get(b)) for i, a, b, _ in pairs})
    assert with_dense(frame.limit(0), vectors, "id").count() == 0
    assert {r[DENSE] for r in with_dense(frame, vectors.limit(0), "id").collect()} == {0.0}


def test_rules_on_vectors_find_what_comparing_all_pairs_finds(spark):
    rows = random_catalogs(11, 25)
    entries = spark.createDataFrame(rows, "request_id string, side string, pos long, name string")
    names = settle(catalog.distinct_names(catalog.usable(entries)))
    idf = fit_idf(names, F.col("norm"))
    vectors = _letter_vectors(entries).filter("norm <> 'room'")
    every = settle(acceptable_names(names, idf, Bounds(), vectors=vectors))
    key = ["request_id", "A_norm", "B_norm"]
    for bounds in (
        Bounds(0.0, Box(min_dense=0.8)), Bounds(0.4, Box(min_dense=0.5), Box(min_dense=0.9)),
        Bounds(0.4, Box(), Box(max_levenshtein=4.0, min_dense=0.7)),
    ):
        rule = Rule(idf, bounds, bounds.holds(), vectors)
        got = sorted(map(tuple, match_entries(entries, rule, 4).accepted.select(key).collect()))
        assert got == sorted(map(tuple, accept(every, rule).select(key).collect())) and got, bounds


def test_a_model_of_four_features(spark, tmp_path):
    pairs = labelled_pairs(spark, 700, 0.5)
    vectors = _letter_vectors(pairs.select(F.explode(F.array("A", "B")).alias("name")))
    trained = train(pairs, FEW, vectors=vectors)
    matcher = trained.matcher
    assert model_features(matcher.pipeline) == (*FEATURES, DENSE)
    assert {r["feature"] for r in split_counts(spark, matcher.pipeline).collect()} == {*FEATURES, DENSE}
    scored = settle(run_model(pairs, "pair_id", matcher).withColumnRenamed("proba", "other"))
    assert scored.filter("decision").count() > 0 and scored.filter(F.col("decision") & ~matcher.bounds.holds()).count() == 0
    again = score_by_boxes(scored, tree_nodes(spark, matcher.pipeline), model_features(matcher.pipeline))
    assert again.filter(F.abs(F.col("proba") - F.col("other")) < 1e-12).count() == scored.count()
    registry.publish(spark, str(tmp_path), trained, FEW)
    loaded = registry.load(spark, str(tmp_path))
    assert loaded.bounds == matcher.bounds
    sides = [pairs.limit(30).select(F.lit("r").alias("request_id"), F.lit(s).alias("side"), "pair_id", F.col(s).alias("name")) for s in "AB"]
    entries = settle(sides[0].unionByName(sides[1]).withColumn("pos", F.xxhash64("pair_id")))
    matched = match_entries(entries, loaded)
    every = acceptable_names(settle(matched.names), loaded.idf, Bounds(), vectors=loaded.vectors)
    key = ["request_id", "A_norm", "B_norm"]
    got = sorted(map(tuple, matched.accepted.select(key).collect()))
    assert got == sorted(map(tuple, accept(every, loaded).select(key).collect()))


def test_letters_are_counted_once_a_name(spark, monkeypatch):
    """What asks whether a vector is fine must not clean the name and count its letters again."""
    written = []
    monkeypatch.setattr(catalogue, "settle", lambda f: written.append(settle(f)) or written[-1])
    vectors = _letter_vectors(spark.createDataFrame([("Ab-a1",), ("aba1",), (None,)], "name string"))
    got = {r["norm"]: r["vector"] for r in vectors.collect()}
    assert set(got) == {"", "aba1"} and got["aba1"] == [2.0, 1.0, *[0.0] * 25, 1.0, *[0.0] * 8]
    assert [w.columns for w in written] == [["name", "vector"]]


def test_comparing_all_names_fetches_no_vector_for_a_pair(spark, monkeypatch):
    """Names bring their vectors along: no table of pairs is written to fetch them, and the cosines are the same."""
    written = []

    def watched(table):
        written.append(table.columns)
        return settle(table)

    for module in (candidates, dense):
        monkeypatch.setattr(module, "settle", watched)
    rows = [("r", "A", "big room"), ("r", "A", "none"), ("r", "A", "odd"), ("r", "B", "big flat"), ("r", "B", "zero")]
    names = spark.createDataFrame(rows, "request_id string, side string, norm string")
    known = [("big room", [3.0, 4.0]), ("odd", [1.0]), ("big flat", [4.0, 3.0]), ("zero", [0.0, 0.0])]
    vectors = spark.createDataFrame(known, "norm string, vector array<double>")
    found = candidates.acceptable_names(names, fit_idf(names, F.col("norm")), candidates.Bounds(), vectors=vectors)
    got = {(r["A_norm"], r["B_norm"]): r[DENSE] for r in found.collect()}
    assert got == {(a, b): 0.96 if (a, b) == ("big room", "big flat") else 0.0 for a in ("big room", "none", "odd") for b in ("big flat", "zero")}
    assert written and not any("A_norm" in columns for columns in written)
