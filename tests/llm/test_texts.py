"""Repeated passages, personal data and languages."""

from __future__ import annotations

import random
from collections import Counter
from itertools import pairwise, product

import pytest
from pyspark.sql import functions as F

from nametwin.llm import common, op5_privacy, op7_substrings, op8_passages, op10_langid, windows
from tests.llm import brute
from tests.llm.conftest import WORDS


@pytest.mark.parametrize(("length", "gram"), [(200, 32), (40, 8), (12, 12)])
def test_substrings(docs, rows, length, gram):
    found = op7_substrings.without_repeats(docs, length, gram, digest=True).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept.hex()) for r in found)
    want = brute.without_repeats([t for _, t in rows], length)
    assert got == sorted((str(d), *w) for (d, _), w in zip(rows, want, strict=True))


def test_substrings_of_repeated_rows(docs, no_docs):
    long = docs.filter("length(text) > 900").limit(1).persist()
    found = op7_substrings.without_repeats(long.union(long)).collect()
    assert [r.n_removed for r in found] == [r.n_bytes for r in found] and len(found) == 2
    assert all(r.kept == b"" for r in found)
    assert op7_substrings.without_repeats(no_docs).count() == 0


@pytest.mark.parametrize(("length", "gram"), [(20, 4), (6, 2), (3, 3)])
def test_passages(docs, rows, length, gram):
    found = op8_passages.first_only(docs, length, gram, digest=True).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.hex()) for r in found}
    assert got == brute.first_passages(rows, length) and len(found) == len(rows)


def test_passages_of_repeated_rows(docs, no_docs):
    long = docs.filter("length(text) > 900").limit(1).persist()
    found = op8_passages.first_only(long.union(long)).collect()
    assert [r.n_removed for r in found] == [found[0].n_removed] * 2
    assert op8_passages.first_only(no_docs).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_passages_with_words_that_defeat_polynomials(spark):
    words = " ".join(f"w{i}" for i in range(19))
    texts = [f"{words} {thue_morse(1024)}", f"{words} {thue_morse(1024, 'b', 'a')}", f"{words} {thue_morse(1024)}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in op8_passages.first_only(frame).collect()}
    assert found == {0: 0, 1: 0, 2: 20}


def test_substrings_that_defeat_polynomials(spark):
    texts = [thue_morse(256) + "x" * 30, thue_morse(256, "b", "a") + "y" * 30, thue_morse(2000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op7_substrings.without_repeats(frame, digest=True).orderBy("doc_id").collect()
    want = brute.without_repeats(texts)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept.hex()) for r in found] == want


def test_the_largest_id_and_none(spark):
    last, text = (1 << 63) - 1, " ".join(f"w{i}" for i in range(70))
    rows = [(last, text, 1), (None, text, 2), (5, "short", 3), (None, None, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    assert {(r.doc_id, r.n_removed) for r in op8_passages.first_only(frame).collect()} == {(last, 0), (None, 70), (5, 0), (None, 0)}
    lost = [(r.doc_id, r.n_removed) for r in op7_substrings.without_repeats(frame).collect()]
    assert sorted(lost, key=str) == sorted([(last, len(text)), (None, len(text)), (5, 0), (None, 0)], key=str)


def test_phrases_of_stretches_have_the_same_anchors(monkeypatch):
    units = windows.byte_units(random.Random(1).randbytes(900) + b"z" * 200)

    def anchors():
        pieces = list(windows.phrases(units, 40, 8))
        return [(p + i, a) for place, n, anchor in pieces for p, c, a in zip(place, n, anchor, strict=True) for i in range(c)]

    whole = anchors()
    assert [p for p, _ in whole] == list(range(1100 - 39))
    monkeypatch.setattr(windows, "STRETCH", 64)
    assert anchors() == whole


def test_windows_without_bitmaps(docs, rows, monkeypatch):
    monkeypatch.setattr(common, "MOST_BITS", 0)
    found = op7_substrings.without_repeats(docs, 40, 8, digest=True).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept.hex()) for r in found)
    assert got == sorted((str(d), *w) for (d, _), w in zip(rows, brute.without_repeats([t for _, t in rows], 40), strict=True))
    found = op8_passages.first_only(docs, 6, 2, digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept.hex()) for r in found} == brute.first_passages(rows, 6)


TRICKY = [
    "a@b.c@d.e x@y.zz.. @q.com a.b@c a@b.c_d@e.f%g@h.i-j.k +++@a.b",
    "1.2.3.4.5.6.7.8 256.1.1.1 010.0.0.00255 1.2.3 9999999999999999999999.1.1.1 0.0.0.0.",
    "4111-1111 1111  1111 4111 1111 1111 1111 5 4111111111111111 378282246310005-0 1-2-3",
    "+1 (377) 555-0271. +49 30 123456789012345 +(12) +1-2 +12345678 9 +1234567890+1234567890",
    "é\U0001f600 mail ü@x.de, ä.b@c-d.org " + "z" * 3000 + " " + "7" * 3000,
    "+1 650 253 0000 4012888888881881 is 10.1.2.3 for é@é.é bob@host.example.com",
]


def test_base_spans(spark, docs, rows):
    texts = [t for _, t in rows] + TRICKY
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    found = op5_privacy.private_spans(frame).collect()
    got = {r.doc_id: [(s.start, s.rank, s.stop, s.kind) for s in r.base] for r in found}
    assert got == {i: brute.private_spans(t) for i, t in enumerate(texts)}
    assert Counter(s[3] for v in got.values() for s in v).keys() == set(brute.PRIVATE)
    assert all(set(r.base) <= set(r.spans) for r in found)


def disclosing_corpus():
    rng = random.Random(3)
    common = ["lorem", "ipsum", "dolor", "amet", "elit", "sed"]
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [fill(30) for _ in range(200)]
    for i in range(5):
        texts[i] = f"{fill(3 + i)} Wilma {fill(2)} wilma.f@example.org {fill(4)}. Sed WILMA {fill(3)}."
    texts[5] = f"{fill(5)} Fred lives near fred@example.org"
    texts[6] = f"Wilma alone {fill(4)}"
    return texts


def test_disclosing_terms(spark):
    texts = disclosing_corpus()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in op5_privacy.private_spans(frame).collect()}
    for i in range(5):
        terms = [texts[i][s.start : s.stop] for s in found[i].spans if s.kind == "term"]
        assert terms == ["Wilma", "WILMA"]
    assert not any(s.kind == "term" for i in range(5, 200) for s in found[i].spans)
    clean = {r.doc_id: r.text for r in op5_privacy.sanitised(frame).collect()}
    assert "ilma" not in clean[0].lower() and "<email>" in clean[0] and "<name>" in clean[0]
    assert clean[6] == texts[6] and len(clean) == 200


def test_disclosing_terms_need_several_texts(spark):
    texts = disclosing_corpus()
    texts[1:5] = [texts[0]] * 4
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any(s.kind == "term" for r in op5_privacy.private_spans(frame).collect() for s in r.spans)


def test_disclosing_terms_of_two_texts_and_far_from_the_entity(spark):
    texts = disclosing_corpus()
    far = " ".join(["dolor"] * 40)
    texts[20] = f"Barney {far} b.r@example.net"
    texts[21] = f"b.r@example.net {far} lorem Barney"
    texts[22] = f"Dino {far} d.o@example.net"
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in op5_privacy.private_spans(frame).collect()}
    shown = {i: [texts[i][s.start : s.stop] for s in found[i] if s.kind == "term"] for i in found}
    assert shown[20] == shown[21] == ["Barney"] and shown[22] == []


def planted_names():
    """Texts of a long-tailed vocabulary; (email, name) of those whose own name stands in independent texts."""
    rng = random.Random(12)
    vocabulary = [w + x for w in WORDS for x in WORDS]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fill = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))

    def letter(name, email):
        return f"{fill(rng.randint(20, 60))} {name} {fill(rng.randint(0, 30))} {email} {fill(rng.randint(5, 20))}"

    texts = [fill(rng.randint(20, 90)) for _ in range(700)]
    truth = set()
    for i in range(40):
        name, email = "Zq" + "".join(rng.choice("aeiou") + rng.choice("kmprst") for _ in range(3)), f"p{i}@example.org"
        written = [letter(name, email) for _ in range(rng.randint(2, 6) if i < 25 else 1)]
        if i < 25:
            truth.add((f"email:{email}", name.lower()))
        if i % 3 == 0:  # near copies of a letter are no further witnesses
            words = written[0].split()
            for k in range(8):
                changed = list(words)
                changed[k] = f"changed{'xyz'[k % 3]}"
                written.append(" ".join(changed))
        texts += written
    page = " ".join(f"d{i}@example.net {fill(2)}" for i in range(60))
    texts += [page, f"{fill(40)} d1@example.net d2@example.net {fill(9)}", "", None, texts[-1]]
    return texts, truth


@pytest.mark.parametrize("most", [op5_privacy.MAX_WANTED, -1])
def test_disclosing_terms_against_brute_force_and_planted_names(spark, most, monkeypatch):
    monkeypatch.setattr(op5_privacy, "MAX_WANTED", most)
    texts, truth = planted_names()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op5_privacy.entities(frame)
    got = {tuple(r) for r in op5_privacy.disclosing(frame, found).select("entity", "term").collect()}
    names = [{f"{s[3]}:{t[s[0] : s[2]].lower()}" for s in brute.private_spans(t)} for t in texts]
    assert got == brute.disclosing(texts, names)
    assert truth <= got and len(truth) == 25
    assert got - truth == {(f"email:d{i}@example.net", "net") for i in (1, 2)}  # a rare part of the addresses


def test_near_copies_are_one_witness(spark):
    texts = [t for t in planted_names()[0] if t][:700]
    rng = random.Random(4)
    words = [f"w{rng.choice('abcdefgh') * 3}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    for _ in range(40):  # a word in twelve differs from copy to copy
        texts.append(" ".join(["q@example.org", *[w if rng.random() > 1 / 12 else rng.choice(words) for w in words]]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any(s.kind == "term" for r in op5_privacy.private_spans(frame).collect() for s in r.spans)


def test_privacy_report_and_empty(docs, no_docs):
    report = op5_privacy.report(op5_privacy.private_spans(docs))
    row = report.filter("n_card = 1").first()
    assert (row.n_email, row.n_ip, row.n_phone) == (1, 1, 1) and row.spans.count(",") >= 3
    assert op5_privacy.report(op5_privacy.private_spans(no_docs)).count() == 0
    assert op5_privacy.sanitised(docs).columns == docs.columns


SYLLABLES = {
    "aa": ["ka", "lo", "mi", "tu", "re"],
    "bb": ["sch", "auf", "ein", "ung", "ver"],
    "cc": ["eux", "ois", "que", "ent", "lle"],
}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(6)
    rows = [(i, speech(rng, "aabbcc"[i % 3 * 2 :][:2], rng.randint(3, 60)), "aabbcc"[i % 3 * 2 :][:2], 1) for i in range(300)]
    rows += [(1000, None, "aa", 1), (1001, "", "aa", 1), (1002, "12 !? 3", "bb", 1), (None, rows[1][1], "bb", 1)]
    rows += [(1003, "x" * 3_000_000, None, 1), (1004, speech(rng, "bb", 5000), None, 1), (5, rows[5][1], rows[5][2], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_languages(spoken):
    found = op10_langid.languages(spoken).collect()
    assert len(found) == spoken.count()
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    held = [r for r in found if r.held_out and r.doc_id < 1000]
    assert len(held) > 40 and all(r.held_out == (brute.crc(r.doc_id) == 2) for r in found if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1004].lang_pred == "bb" and by_id[None].held_out is False
    assert all(0 <= r.score <= 1 for r in found)


def test_language_never_learns_from_held_out(spoken):
    held = op10_langid.remainder(F.col("doc_id")) == op10_langid.HELD
    wrong = spoken.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    one, two = (op10_langid.languages(d).orderBy("doc_id", "score").collect() for d in (spoken, wrong))
    assert one == two


def test_language_follows_a_switch(spoken):
    field = op10_langid.learn(spoken)
    rng = random.Random(9)
    words = op10_langid.read_words((speech(rng, "aa", 20) + " " + speech(rng, "cc", 20)).encode())
    scores = field.scores(words)[None]
    found = op10_langid._posterior(scores, field.moves, op10_langid.np.array([40]))[0]
    labels = [field.labels[i] for i in found.argmax(axis=1)]
    assert labels == ["aa"] * 20 + ["cc"] * 20
    assert (field.moves.diagonal() > field.moves.max(axis=1, initial=-9, where=~op10_langid.np.eye(3, dtype=bool))).all()


def test_language_without_labels(spoken, no_docs):
    nothing = spoken.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in op10_langid.languages(nothing).collect()} == {"und"}
    assert op10_langid.languages(no_docs).count() == 0


def test_language_sample_is_bounded_and_not_crowded_out(spark):
    hot = spark.range(3000).select(F.lit(4).cast("long").alias("doc_id"), F.lit("bo bo bo").alias("text"), F.lit("bb").alias("lang"))
    few = [(i, f"ba {i}", "bb") for i in range(100, 140)] + [(i, f"ca {i}", "cc") for i in range(200, 900)]
    docs = hot.union(spark.createDataFrame([*few, (None, "x", "cc"), (901, None, "cc")], "doc_id long, text string, lang string"))
    learned = op10_langid.remainder(F.col("doc_id")) != op10_langid.HELD
    want = docs.filter(learned).filter("text is not null").select("lang", "text").distinct()
    found = [(r.lang, r.text) for r in op10_langid.sample(docs, 60).collect()]
    assert len(set(found)) == len(found) and Counter(lang for lang, _ in found)["cc"] == 60
    assert {f for f in found if f[0] == "bb"} == {tuple(r) for r in want.filter("lang = 'bb'").collect()}


@pytest.mark.parametrize("labels", [2, 3])
def test_chain_probabilities_against_all_labellings(labels):
    np = op10_langid.np
    rng = np.random.default_rng(labels)
    lengths = np.array([6, 4, 1])
    scores, moves = rng.normal(0, 2, (3, 6, labels)), rng.normal(0, 2, (labels, labels))
    each, steps = np.zeros((3, 6, labels)), np.zeros((labels, labels))
    for n, length in enumerate(lengths):
        paths = list(product(range(labels), repeat=int(length)))
        weight = np.array(
            [np.exp(sum(scores[n, t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in pairwise(p))) for p in paths]
        )
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for t, y in enumerate(p):
                each[n, t, y] += w
            for a, b in pairwise(p):
                steps[a, b] += w
    found, moved = op10_langid.forward_backward(scores, moves, lengths)
    posterior = op10_langid._posterior(scores, moves, lengths)
    for n, length in enumerate(lengths):
        assert np.allclose(found[n, :length], each[n, :length]) and np.allclose(posterior[n, :length], each[n, :length])
    assert np.allclose(moved, steps)
