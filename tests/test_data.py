"""Generator, split and TF-IDF."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

import pytest
from pyspark.sql import functions as F

from nametwin.operators import tfidf
from nametwin.operators.features import feature_table
from nametwin.operators.split import assign_by_hash, deduplicate, part_sizes, split
from nametwin.operators.tfidf import fit_idf, profiles
from nametwin.operators.tiling import tiled_join
from nametwin.sources import synthetic
from nametwin.sources.synthetic import draw_pairs, labelled_pairs
from tests import brute


def test_generator_size_and_ratio(spark):
    pairs = labelled_pairs(spark, 10_000, 0.2)
    n, rate = pairs.agg(F.count("*"), F.avg(F.col("match").cast("double"))).first()
    assert n == 10_000 and rate == pytest.approx(0.2, rel=0.1)


def test_generator_ignores_partitioning(spark):
    one = labelled_pairs(spark, 300, 0.5).orderBy("pair_id").collect()
    ids = spark.range(0, 300, 1, 7).withColumnRenamed("id", "pair_id").repartition(5)
    assert draw_pairs(ids, 0.5).orderBy("pair_id").collect() == one
    other = labelled_pairs(spark, 300, 0.5, seed=8).orderBy("pair_id").collect()
    assert other != one


def test_generator_rates(spark):
    rows = [r.asDict() for r in labelled_pairs(spark, 6000, 0.5).collect()]
    loud = sum(r["A"] == r["A"].upper() for r in rows) / len(rows)
    assert loud == pytest.approx(synthetic.P_UPPER, abs=0.02)
    articles = sum(r["A"].lower().split(" ")[0] in synthetic.ARTICLES for r in rows) / len(rows)
    assert articles == pytest.approx(2 / 12, abs=0.03)
    properties = {w for g in synthetic.PROPERTIES for w in g} - {"executive"}
    bare = sum(not any(p in r["A"].lower() for p in properties) for r in rows) / len(rows)
    assert bare == pytest.approx((2 / 3) ** 2, abs=0.06)
    assert all(r["A"] == r["A"].strip() for r in rows)


def test_matching_pairs_share_their_size_group(spark):
    group = {w: i for i, g in enumerate(synthetic.SIZES) for w in g}
    rows = labelled_pairs(spark, 2000, 1.0).collect()
    same = known = 0
    for r in rows:
        a = {group[w] for w in r["A"].lower().split() if w in group and w != "spacious"}
        b = {group[w] for w in r["B"].lower().split() if w in group and w != "spacious"}
        if len(a) == len(b) == 1:
            known += 1
            same += a == b
    assert known > 1500 and same / known > 0.97


def test_accents_only_add_accents(spark):
    plain = labelled_pairs(spark, 500, 0.5).orderBy("pair_id").collect()
    accented = labelled_pairs(spark, 500, 0.5, accents=True).orderBy("pair_id").collect()
    back = str.maketrans(synthetic.ACCENTED, synthetic.PLAIN)
    assert [r["A"].translate(back) for r in accented] == [r["A"] for r in plain]
    assert any(x["A"] != y["A"] for x, y in zip(plain, accented))


@pytest.mark.parametrize(
    "n, train, val, sizes", [(100, 0.7, 0.15, (69, 15, 16)), (2000, 0.6, 0.3, (1200, 599, 201))]
)
def test_split_sizes_are_exact(spark, n, train, val, sizes):
    assert part_sizes(n, train, val) == sizes
    rows = spark.range(n)
    parts = split(rows, F.col("id").cast("string"), train, val)
    ids = [sorted(r["id"] for r in p.collect()) for p in parts]
    assert tuple(map(len, ids)) == sizes
    assert sorted(sum(ids, [])) == list(range(n))
    again = split(rows.repartition(13), F.col("id").cast("string"), train, val)
    assert [sorted(r["id"] for r in p.collect()) for p in again] == ids


def test_exact_split_agrees_with_a_global_rank(spark):
    import hashlib

    n = 500
    rank = sorted(
        range(n), key=lambda i: (int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:8], 16), str(i))
    )
    train, val, test = split(spark.range(n), F.col("id").cast("string"), 0.6, 0.3)
    a, b, _ = part_sizes(n, 0.6, 0.3)
    assert {r["id"] for r in train.collect()} == set(rank[:a])
    assert {r["id"] for r in val.collect()} == set(rank[a : a + b])


def test_hash_split_is_about_right(spark):
    parts = assign_by_hash(spark.range(5000), F.col("id"), 0.7, 0.15, 42)
    n = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert n["train"] == pytest.approx(3500, rel=0.05) and sum(n.values()) == 5000


@pytest.mark.parametrize("train, val", [(0.8, 0.3), (0.9, 0.1), (0.5, -0.1), (0.0, 0.5)])
def test_split_rejects_bad_fractions(spark, train, val):
    with pytest.raises(ValueError):
        split(spark.range(10), F.col("id"), train, val)


def test_deduplicate(spark):
    rows = [("a", "b", True), ("a", "b", True), ("a", "b", False), (None, "b", True)]
    got = deduplicate(spark.createDataFrame(rows, "A string, B string, match boolean"))
    assert got.count() == 3 and got.select("pair_id").distinct().count() == 3


TEXTS = [
    ("big room", "room with big big balcony"),
    ("small suite", "small suite"),
    ("a b c", "loft"),
    ("studio loft", "open plan"),
]


def test_features_match_the_definition(spark):
    idf = brute.idf([t for pair in TEXTS for t in pair])
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEXTS)], "k int, A string, B string")
    model = fit_idf(rows, F.col("A"), F.col("B"))
    assert {r["term"]: r["idf"] for r in model.terms.collect()} == pytest.approx(idf)
    table = feature_table(rows, "k", model).orderBy("k").collect()
    for row, (a, b) in zip(table, TEXTS):
        assert row["cosine_similarity"] == pytest.approx(brute.cosine(a, b, idf))
        assert row["jaro_winkler_similarity"] == pytest.approx(brute.jaro_winkler(a, b))


def test_features_of_null_and_unknown_names(spark):
    known = spark.createDataFrame([("big room",)], "t string")
    model = fit_idf(known, F.col("t"))
    rows = spark.createDataFrame(
        [(1, "", None), (2, None, ""), (3, "zzz", "zzz"), (4, "room zzz", "room qqq")],
        "k int, A string, B string",
    )
    got = {r["k"]: r for r in feature_table(rows, "k", model).collect()}
    for k in (1, 2):
        assert tuple(got[k])[3:] == (0.0, 0, 0.0)
    assert got[3]["cosine_similarity"] == 0.0 and got[3]["jaro_winkler_similarity"] == 1.0
    assert got[4]["cosine_similarity"] == pytest.approx(1.0)


def test_a_frequent_term_weighs_one_when_in_every_text(spark):
    rows = spark.createDataFrame([("room",), ("room",), ("room suite",)], "t string")
    idf = {r["term"]: r["idf"] for r in fit_idf(rows, F.col("t")).terms.collect()}
    assert idf["room"] == pytest.approx(1.0) and idf["suite"] == pytest.approx(1.6931471805599454)


def test_profiles_have_unit_length_and_rare_terms_first(spark):
    rows = spark.createDataFrame([("room suite room",), ("room",), ("a",)], "norm string")
    got = {r["norm"]: r for r in profiles(rows, ["norm"], fit_idf(rows, F.col("norm"))).collect()}
    assert set(got) == {"room suite room", "room"}
    assert got["room suite room"]["terms"] == ["suite", "room"]
    assert sum(w * w for w in got["room suite room"]["profile"].values()) == pytest.approx(1.0)


def test_tasks_that_count_words_are_as_many_as_the_texts_need(spark, monkeypatch):
    """Merging by the size of packed texts would give a task a large part of all words."""
    monkeypatch.setattr(tfidf, "PART_BYTES", 1000)
    rows = spark.createDataFrame([(i, "room suite " * 5) for i in range(1000)], "k int, norm string")
    assert tfidf._dealt(rows, "k", "norm").rdd.getNumPartitions() == 55


def test_a_pair_key_may_be_null_or_repeat(spark):
    rows = spark.createDataFrame([(None, "room suite", "room"), (1, "room", "room"), (1, "room", "room")], "k int, A string, B string")
    model = fit_idf(rows, F.col("A"), F.col("B"))
    got = {r["k"]: r["cosine_similarity"] for r in feature_table(rows, "k", model).collect()}
    assert set(got) == {None, 1} and got[1] == pytest.approx(1.0) and 0 < got[None] < 1


def test_a_large_vocabulary_is_joined_by_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEXTS * 9)], "k int, A string, B string")
    model = fit_idf(rows, F.col("A"), F.col("B"))
    assert model.n_bytes > 64 * model.n_terms
    expected = feature_table(rows, "k", model).orderBy("k").collect()
    model = replace(model, broadcast_bytes=0)
    monkeypatch.setattr(tfidf, "tiled_join", partial(tiled_join, tile_rows=4, max_hot_keys=2))
    got = feature_table(rows, "k", model).orderBy("k").collect()
    assert [r["cosine_similarity"] for r in got] == pytest.approx([r["cosine_similarity"] for r in expected])


def test_fit_needs_a_vocabulary(spark):
    with pytest.raises(ValueError):
        fit_idf(spark.createDataFrame([("a b",)], "t string"), F.col("t"))
