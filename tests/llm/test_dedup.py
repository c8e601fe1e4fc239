"""Exact, SimHash and embedding duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nametwin.llm import op2_dedup, op3_embeddings, op4_simhash
from nametwin.llm.components import components, stars
from tests.llm import brute


def test_exact_groups(docs, rows):
    found = op2_dedup.dedup_groups(docs).withColumn("sha", F.lower(F.hex("digest"))).collect()
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.sha) for r in found)
    want = brute.exact_groups(rows)
    assert got == sorted((str(rows[i][0]), *w) for i, w in want.items())


def test_exact_groups_with_colliding_digests(docs, rows):
    found = op2_dedup.dedup_groups(docs, bits=8).collect()
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in found)
    assert got == sorted((str(rows[i][0]), *w[:3]) for i, w in brute.exact_groups(rows).items())


def test_exact_state_goes_on(spark, docs, rows, tmp_path):
    placed = op2_dedup.arrivals(op2_dedup.located(docs))
    state, folder = str(tmp_path / "state"), str(tmp_path / "in")
    for half in range(2):
        placed.filter(F.pmod("doc_id", F.lit(2)) == half).write.mode("append").parquet(folder)
        op2_dedup.feed(spark.readStream.schema(placed.schema).parquet(folder), state)
    held = {r.digest: r.n for r in op2_dedup.held(spark, state).collect()}
    want = {}
    for i, w in brute.exact_groups([r for r in rows if r[0] is not None]).items():
        want[bytes.fromhex(w[3])] = w[1]
    assert held == want


def test_exact_repeated_rows_and_empty(spark, docs, no_docs):
    twice = docs.filter("doc_id = 3").union(docs.filter("doc_id = 3"))
    kept = op2_dedup.dedup_groups(twice).collect()
    assert sorted(r.kept for r in kept) == [False, True] and {r.group_size for r in kept} == {2}
    assert op2_dedup.deduplicated(twice).columns == docs.columns
    assert op2_dedup.deduplicated(twice).count() == 1
    assert op2_dedup.dedup_groups(no_docs).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "clique", "mixed"])
def test_components(spark, shape):
    rng = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(200)],
        "clique": [(i, j) for i in range(20) for j in range(20)],
        "mixed": [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)],
    }[shape]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({e for pair in edges for e in pair})
    at = {n: i for i, n in enumerate(nodes)}
    want = dict(zip(nodes, brute.smallest_reachable(nodes, [(at[a], at[b]) for a, b in edges]), strict=True))
    alone = {n for n in nodes if n not in got}
    assert all(want[n] == n for n in alone) and got == {n: c for n, c in want.items() if n not in alone}


def test_stars_keep_components():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 100, 80), rng.integers(0, 100, 80)
    x, y = stars(a, b)
    before = brute.smallest_reachable(range(100), list(zip(a, b, strict=True)))
    assert before == brute.smallest_reachable(range(100), list(zip(x, y, strict=True)))
    assert len(x) == len(set(x.tolist()))


def _simhash(found):
    return sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found.collect())


@pytest.mark.parametrize(("words", "radius", "tile"), [(4, 4, 4096), (5, 4, 3), (4, 9, 4096), (2, 2, 2)])
def test_simhash(docs, rows, words, radius, tile):
    prints, least = brute.simhash_components(rows, words, radius)
    want = sorted((str(d), f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, least, strict=True))
    assert _simhash(op4_simhash.near_duplicates(docs, words, radius, tile)) == want


@pytest.mark.parametrize("segments", [2, 3, 4])
@pytest.mark.parametrize("tile", [4096, 40])
def test_simhash_links_of_dense_groups(spark, monkeypatch, segments, tile):
    rng = random.Random(8)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            p = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    a, b = divmod(4, segments)
    cuts = [64 * i // segments for i in range(segments + 1)]
    segs = [(cuts[i], cuts[i + 1] - cuts[i], a if i <= b else a - 1) for i in range(segments)]
    monkeypatch.setattr(op4_simhash, "plan", lambda n, radius: segs)
    frame = spark.createDataFrame([((p + (1 << 63)) % (1 << 64) - (1 << 63),) for p in prints], "fp long")
    at = {p: i for i, p in enumerate(prints)}
    found = [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in op4_simhash.links(frame, len(prints), 4, tile).collect()]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    ids = list(range(len(prints)))
    assert brute.smallest_reachable(ids, found) == brute.smallest_reachable(ids, near)


def test_simhash_plan_grows_with_the_table():
    assert len(op4_simhash.plan(1000)) == 4 and len(op4_simhash.plan(10**10)) == 2


def test_simhash_one_of_each(docs, no_docs, rows):
    _, least = brute.simhash_components(rows)
    kept = op4_simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted({str(c) for c in least})
    assert op4_simhash.near_duplicates(no_docs).count() == 0


def test_simhash_rows_with_one_id_or_none(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 0, "m"), (1, "another text of some words", 1, "m"), (1, text, 2, "m"), (None, "third text here", 3, "m")]
    rows += [(None, "third text here", 4, "m"), (None, text, 5, "m"), (7, "", 6, "m"), (None, None, 7, "m")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, at int, _metadata string").repartition(3)
    kept = op4_simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    places = sorted(r["at"] for r in kept.collect())
    assert len(places) == 4 and 1 in places and 6 in places
    assert len({0, 2} & set(places)) == 1 == len({3, 4} & set(places))


def vectors():
    rng = np.random.default_rng(2)
    out = []
    for label in (0, 1, None):
        for _ in range(4):
            centre = rng.normal(size=16)
            for _ in range(8):
                v = centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 0.3])
                out.append((v * rng.uniform(0.1, 9)).astype(np.float32).tolist() + [label])
    rows = [(i, v[:-1], v[-1]) for i, v in enumerate(out)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)]
    return rows + [(None, rows[0][1], 0), (n + 50, rows[1][1], 1), (n + 51, [1e30] * 16, 0), (n + 52, [1e-30] * 16, 0)]


@pytest.mark.parametrize("tile", [2048, 7])
def test_embeddings(spark, tile):
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, tile string, cid int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in op3_embeddings.near_duplicates(frame, tile_rows=tile).collect())
    links, least = brute.embedding_links(rows)
    want = sorted((str(r[0]), n, r[0] if c is None else c) for r, n, c in zip(rows, links, least, strict=True))
    assert got == want
    assert sum(links) > 20 and op3_embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_quantisation_bound_holds_and_decides():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    x[1] = x[0] * (1 + 1e-9)
    blocks, again = op3_embeddings.tile_links(x, x, 0.3, True)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.triu(unit @ unit.T >= 0.3, 1)
    assert np.array_equal(np.concatenate([b for _, b in blocks]), want)
    assert 0 < again < want.size / 50


def test_rows_that_hit_are_never_missed(spark):
    rows = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    wanted = rows.filter("id % 20 = 0").select("digest")
    found = [r.id for r in op2_dedup.hitting(rows, wanted).select("id").collect()]
    assert len(set(found)) == len(found) < 4000 and set(range(0, 20_000, 20)) <= set(found)
    assert op2_dedup.hitting(rows, wanted.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e200, 1e-200])
def test_embeddings_of_extreme_length(spark, size):
    frame = spark.createDataFrame(
        [(1, [size, size], 0), (2, [2 * size, 2 * size], 0), (3, [size, -size], 0), (4, [3.0, 3.0], 0)],
        "vec_id long, embedding array<double>, label int",
    )
    found = {r.vec_id: (r.n_links, r.component_id) for r in op3_embeddings.near_duplicates(frame).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}
