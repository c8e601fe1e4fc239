from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nametwin.functions import similarity, text
from tests import brute


@pytest.mark.parametrize(
    "raw, norm, valid",
    [
        (None, "", False),
        ("", "", False),
        ("!!", "", True),
        ("A", "a", False),
        ("\t a \n", "\t a \n", False),
        ("　 x ", "　 x ", False),
        ("a b", "a b", True),
        ("Café-Bar", "cafbar", True),
        ("big  room", "big  room", True),
        ("a b c", "a b c", True),
        ("Pet-Friendly ROOM 12", "petfriendly room 12", True),
    ],
)
def test_normalize_and_validity(spark, raw, norm, valid):
    row = spark.createDataFrame([(raw,)], "name string").select(
        text.normalize(F.col("name")).alias("norm"), text.is_valid(F.col("name")).alias("valid")
    )
    assert tuple(row.first()) == (norm, valid)


def test_normalize_keeps_all_unicode_whitespace(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = spark.createDataFrame([(f"a{s}b",) for s in spaces], "name string")
    kept = rows.select(text.normalize(F.col("name")).alias("n"), "name").collect()
    assert len(kept) == 29 and all(r["n"] == r["name"] for r in kept)


def test_normalize_and_strip_treat_every_character_as_defined(spark):
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, chr(c)) for c in points], "c int, s string")
    got = rows.select(
        "c",
        "s",
        text.normalize(F.col("s")).alias("norm"),
        text.strip(F.concat("s", F.lit("ab"), "s")).alias("stripped"),
    ).collect()
    for r in got:
        ch = r["s"]
        kept = "".join(x for x in ch.lower() if x in "abcdefghijklmnopqrstuvwxyz0123456789" or x.isspace())
        assert r["norm"] == kept, hex(r["c"])
        assert r["stripped"] == (ch + "ab" + ch).strip(), hex(r["c"])


def test_tokens_need_two_characters(spark):
    row = spark.createDataFrame([("a 5 big  room12 x9 big",)], "n string")
    assert row.select(text.tokens(F.col("n"))).first()[0] == ["big", "room12", "x9", "big"]


def test_capitalize_and_drop_char(spark):
    row = spark.createDataFrame([("oPEN plan", "")], "s string, e string").select(
        text.capitalize(F.col("s")),
        text.capitalize(F.col("e")),
        text.drop_char(F.col("s"), F.lit(0)),
        text.drop_char(F.col("s"), F.lit(8)),
        text.drop_char(F.col("e"), F.lit(0)),
    )
    assert list(row.first()) == ["Open plan", "", "PEN plan", "oPEN pla", ""]


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("martha", "marhta", 0.961111),
        ("dixon", "dicksonx", 0.813333),
        ("abcd", "axyz", 0.5),
        ("", "", 0.0),
        ("", "abc", 0.0),
        ("a", "a", 1.0),
        ("ab", "ba", 0.0),
    ],
)
def test_jaro_winkler_goldens(a, b, expected):
    assert similarity.jaro_winkler_arrays([a], [b])[0] == pytest.approx(expected, abs=1e-6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc é", max_size=12), st.text("abc é", max_size=12)), min_size=1))
def test_jaro_winkler_equals_the_scalar_definition(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    expected = [brute.jaro_winkler(x, y) for x, y in pairs]
    assert np.allclose(similarity.jaro_winkler_arrays(a, b), expected, atol=1e-12)


def test_jaro_winkler_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(similarity, "_CELLS", 500)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdef ", k=rng.randrange(0, 400))) for _ in range(40)]
    other = ["".join(rng.choices("abcdef ", k=rng.randrange(0, 400))) for _ in range(40)]
    expected = [brute.jaro_winkler(x, y) for x, y in zip(texts, other)]
    assert np.allclose(similarity.jaro_winkler_arrays(texts, other), expected, atol=1e-12)


def test_jaro_winkler_of_long_texts_looks_at_no_window(monkeypatch):
    """Each step may touch a few places a row, not all within reach: the work grows with the text, not its square."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=n)) for n in (1, 64, 65, 66, 300, 2000)]
    expected = [brute.jaro_winkler(x, y) for x in texts for y in texts]
    a, b = [x for x in texts for _ in texts], texts * len(texts)
    assert np.allclose(similarity.jaro_winkler_arrays(a, b), expected, atol=1e-12)
    one, two = (similarity._codes([x] * 2) for x in (texts[3], texts[4]))
    hits = similarity._matched_far(one, two, np.array([149, 149]))
    assert [h.sum() for h in hits] == [hits[0].sum()] * 2 and (hits[1][0] == hits[1][1]).all()


def test_both_ways_of_matching_characters_agree():
    rng = random.Random(6)
    a, b = (similarity._codes(["".join(rng.choices("abé\U0001d11e ", k=rng.randrange(0, 65))) for _ in range(300)]) for _ in "ab")
    reach = np.maximum(0, np.maximum((a > 0).sum(1), (b > 0).sum(1)) // 2 - 1)
    near = similarity._matched_near(a, b, reach, np.unique(np.append(b, np.uint32(0))))
    far = similarity._matched_far(a, b, reach)
    assert all((x == y).all() for x, y in zip(near, far, strict=True))


def test_jaro_winkler_column_handles_null(spark):
    rows = spark.createDataFrame([(None, "abc"), ("abc", "abc")], "a string, b string")
    got = [r[0] for r in rows.select(similarity.jaro_winkler("a", "b")).collect()]
    assert got == [0.0, 1.0]


def test_dense_cosine(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>"
    )
    got = [r[0] for r in rows.select(similarity.dense_cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([2**-0.5, 0.0])


def test_each_text_of_a_batch_is_encoded_once(monkeypatch):
    encoded, codes = [], similarity._codes
    monkeypatch.setattr(similarity, "_codes", lambda texts: encoded.extend(texts) or codes(texts))
    a, b = zip(*[(x, y) for x in ("martha", "dixon", "a\0b") for y in ("marhta", "dicksonx")] * 50, strict=True)
    got = similarity.jaro_winkler_arrays([*a], [*b])
    assert got[:4].round(6).tolist() == [0.961111, got[1].round(6), got[2].round(6), 0.813333]
    assert sorted(encoded) == sorted(["martha", "dixon", "a\0b", "marhta", "dicksonx"])
