"""Periodic runs of words against enumeration."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from nametwin.llm import op11_periods as op
from nametwin.llm.queries import QUERIES
from tests.llm.brute import WORDS


def brute_runs(words, least=12):
    """(start, stop, period) of every run, by trying all periods."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        t = 0
        while t < n - q:
            if words[t] != words[t + q]:
                t += 1
                continue
            start = t
            while t < n - q and words[t] == words[t + q]:
                t += 1
            if t + q - start >= max(least, 2 * q):
                found.setdefault((start, t + q), q)
    return sorted((s, e, q) for (s, e), q in found.items())


def cycled(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(words, least=12):
    runs = brute_runs(words, least)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(((s, e - s, q) for s, e, q in runs), key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, runs, kept)


def random_documents(rng):
    out = []
    for _ in range(rng.randint(1, 9)):
        n, kinds = rng.choice([0, 1, 11, 12, 30, 80, 180]), rng.choice([1, 2, 2, 3, 5, 40])
        words = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5 and n > 5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        out.append(words)
    return out


def test_runs_equal_enumeration():
    rng = random.Random(2)
    for _ in range(150):
        documents = random_documents(rng)
        found = op.find_runs([np.array(d, np.int64) for d in documents], 12)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(d) for d in documents]


def test_runs_of_strings_full_of_them():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    found = op.find_runs([np.array(b), np.array(thue), np.zeros(3000, np.int64)], 12)
    assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(b), brute_runs(thue), [(0, 3000, 1)]]


def test_pairs_in_small_chunks(monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 50)
    documents = random_documents(random.Random(8)) + [[i % 3 for i in range(200)]]
    found = op.find_runs([np.array(d, np.int64) for d in documents], 12)
    assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(d) for d in documents]


def test_extensions_equal_comparison():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 6):
        ids = np.append(rng.integers(0, kinds, 300), kinds)
        ids[150:260] = ids[20:130]
        common = op.Extensions(ids)
        i, j = rng.integers(0, 301, (2, 2000))
        i, j = i[i != j], j[i != j]
        want = [next(t for t in range(301) if max(x, y) + t > 300 or ids[x + t] != ids[y + t]) for x, y in zip(i, j, strict=True)]
        assert common(i, j).tolist() == want


def test_cover_meets_every_difference():
    assert {(a - b) % op.SPAN for a in op.COVER for b in op.COVER} == set(range(op.SPAN))


EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n\v\f\r "),
    (4, "a b " * 6),
    (4, "a b " * 6),
    (None, "so " * 40 + "end"),
    (6, "   xé " * 20),
    (7, "one two three " * 4000 + "four"),
    (8, "z" * 200_000 + " " + "q r s t " * 3),
    (9, "a b c d e f g h i j k " * 2),
]


def test_edge_cases(spark, no_docs):
    frame = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in EDGES], "doc_id long, text string, runs string, n_words int, start int")
    found = sorted(map(tuple, op.periodic_runs(frame).collect()), key=str)
    want = []
    for d, t in EDGES:
        words = WORDS.findall(t or "")
        n, *top, runs, kept = brute_row(words)
        want.append((d, len(words), n, *top, [(s, e - s, q) for s, e, q in sorted(runs, key=lambda r: (r[0], r[2]))], kept))
    assert found == sorted(want, key=str)
    assert op.periodic_runs(no_docs).count() == 0 == op.periodic_runs(no_docs, digest=True).count()
    with pytest.raises(ValueError, match="least_words"):
        op.periodic_runs(frame, 5)


def test_query_equals_enumeration(spark, small):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' WHERE length(text) < 8000").fetchall()
    found = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, small).collect()}
    many = 0
    for doc_id, text in rows:
        n, *top, runs, kept = brute_row(cycled(doc_id, WORDS.findall(text or "")))
        listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
        r = found[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (n, *top)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        many += n > 0
    assert many > len(rows) / 20


def test_cycles_of_edge_cases(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 45))) for i in range(400)] + [(None, "a b"), (30, None), (31, " \n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made = op.with_cycles(frame).collect()
    got = sorted((str(r.doc_id), WORDS.findall(r.text or "")) for r in made)
    assert got == sorted((str(d), cycled(d, WORDS.findall(t or ""))) for d, t in rows)
