"""The registered queries over a whole folder, against SQL or brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from nametwin.llm.queries import ORACLES, QUERIES
from tests.check_oracle import difference, sql_rows
from tests.llm import brute


@pytest.fixture(scope="module")
def table(small):
    return duckdb.sql(f"SELECT * FROM '{small}/documents.parquet' ORDER BY doc_id").df()


def rows_of(spark, small, name, key="doc_id"):
    frame = QUERIES[name](spark, small).toPandas()
    return frame.sort_values(key).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert difference(QUERIES[name](spark, small).toPandas(), sql_rows(small, ORACLES[name])) is None


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(name, texts):
    model = Tokenizer.from_file(public_tokenizers.path(name))
    model.encode_special_tokens = True
    return [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_token_records(spark, small, table):
    found = rows_of(spark, small, "op1_token_records")
    ids = [i + [0] for i in encoded("byte_bpe_50k.json", table.text.tolist())]
    assert found.n_tokens.tolist() == [len(i) for i in ids] and found.ids_crc32.tolist() == [crc(i) for i in ids]
    assert found.start.tolist() == np.cumsum([0] + [len(i) for i in ids])[:-1].tolist()


def test_simhash(spark, small, table):
    found = rows_of(spark, small, "op4_simhash_dedup")
    prints, least = brute.simhash_components(list(zip(table.doc_id, table.text, strict=True)))
    assert found.fingerprint.tolist() == [f"{p:016x}" for p in prints] and found.component_id.tolist() == least


def test_private_spans(spark, small, table):
    import hashlib

    found = rows_of(spark, small, "op5_private_spans")
    for row, text in zip(found.itertuples(), table.text, strict=True):
        want = brute.private_spans(text)
        counts = Counter(s[3] for s in want)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [counts[k] for k in brute.PRIVATE]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(row.spans.split(","))


def test_substrings(spark, small, table):
    found = rows_of(spark, small, "op7_substring_dedup")
    want = brute.without_repeats(table.text.tolist())
    assert list(found[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == want


def test_packing(spark, small, table):
    found = QUERIES["op9_pack_sequences"](spark, small).toPandas()
    ids = {d: i + [2] for d, i in zip(table.doc_id, encoded("word_bpe_49k.json", table.text.tolist()), strict=True)}
    for doc_id, own in found.sort_values("start").groupby("doc_id"):
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.ids_crc32 == crc(ids[doc_id][at : at + p.length])
            at += p.length
        assert at == len(ids[doc_id]) == p.doc_tokens
    assert set(found.doc_id) == set(ids)
    lengths = found.groupby("sequence_id").length.sum()
    padded = [0 if n & (n - 1) == 0 else 4096 - n for n in lengths]
    assert max(lengths) <= 4096 and sum(padded) == 0


def test_language(spark, small, table):
    found = rows_of(spark, small, "op10_language_id")
    held = found.held_out.to_numpy()
    assert held.tolist() == [brute.crc(d) == 2 for d in table.doc_id]
    assert (found.lang_pred == table.lang)[held].mean() >= 0.95


def documents(spark, folder):
    """Documents in two languages with exact and near copies, written as a folder."""
    rng = random.Random(4)
    sound = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "auf", "ein", "ung", "ver"]}

    def speech(lang, n):
        return " ".join("".join(rng.choice(sound[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))

    rows = []
    for i in range(120):
        lang = "aabb"[i % 2 * 2 :][:2]
        rows.append([i, speech(lang, rng.randint(20, 300)), lang, f"s{i % 5}" if i % 7 else None])
    near = rows[1][1].split()
    for i in range(4):
        changed = speech("bb", 1).split() + near
        rows.append([200 + i, " ".join(changed), "bb", "s1"])
    rows += [[300 + i, rows[2][1] + " " * i, "aa", "s2"] for i in range(30)]
    rows += [[400, None, "aa", "s0"], [401, "123 ...", "bb", "s0"], [402, "", None, None], [403, rows[3][1], "bb", None]]
    frame = spark.createDataFrame([[*r, len(r[1] or "")] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = documents(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, out = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or made.columns == columns, name
        made.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out.append(docs.collect())
    text = {r[0]: r[1] for r in rows}

    named = [(r.doc_id, r.text) for r in out[0]]
    assert {d for d, _ in named} == {r[0] for r in rows} - {400, 401, 402}
    groups = brute.exact_groups(named)
    exact = {named[i][0] for i, g in groups.items() if g[2]}
    assert sorted(r.doc_id for r in out[1]) == sorted(exact)
    left = sorted((d, text[d]) for d in exact)
    _, least = brute.simhash_components(left)
    stay = sorted(set(least))
    assert sorted(r.doc_id for r in out[2]) == stay
    assert len(stay) < len(left)  # near copies

    source = {r[0]: r[3] for r in rows}
    size = {r.doc_id: len(brute.WORDS.findall(r.text)) for r in out[2]}
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, n in size.items():
        sizes[source[d]] += n
    for r in out[3]:
        taken[source[r.doc_id]] += size[r.doc_id]
    times = Counter(r.doc_id for r in out[3])
    assert set(times.values()) <= {1, 2}
    assert all(abs(taken[s] - t) < max(size.values()) for s, t in brute.targets(dict(sizes)).items())

    tokens = {d: len(i) + 1 for d, i in zip(text, encoded("word_bpe_49k.json", [t or "" for t in text.values()]), strict=True)}
    packed = Counter()
    for p in out[4]:
        packed[p.doc_id] += p.length
    assert packed == {d: n * tokens[d] for d, n in times.items()}
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(again) == sorted(out[4])


def test_pipeline_of_nothing(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
