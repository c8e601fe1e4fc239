"""Token records, packing and mixing."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nametwin.llm import op1_records, op6_mixing, op9_packing
from nametwin.llm.tokens import Encoder
from nametwin.operators.keep import scratch_folder
from tests.llm import brute

NAMES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
ODD = [
    "a  b\n\n c \t d", "  x", "x  ", "\n", " ", "a ", "a\n b  \n", "don't  I'll\x1cgo 　é ́a <|endoftext|> b",
    "ΣΑΣ ΣΑΣ.\x85z", "word.\nNext one,two x.. y,) İstanbul ŒUVRE", "it's, He'LL 's a.'s b", "a \xa0b \r\n",
    ". ., a ,b b. c.,. .d", "x" * 5000, "<|endoftext|>", "a  <|endoftext|><|endoftext|> \n b<|startoftext|>C <|EndOfText|>", "世界 \U0001f600\U0001f600 ﬁ ǅ ½²",
]


def reference_ids(kind, texts, end):
    model = Tokenizer.from_file(public_tokenizers.path(NAMES[kind]))
    return [e.ids + [end] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind", NAMES)
def test_encoder_gives_the_ids_of_whole_texts(rows, kind):
    texts = ODD + [t for _, t in rows]
    encoder = Encoder(public_tokenizers.path(NAMES[kind]), kind, entries=50)
    for _ in range(2):
        got = [np.frombuffer(encoder.encode(t), "<u2").tolist() for t in texts]
        assert got == [i[:-1] for i in reference_ids(kind, texts, 0)]


def test_checksum_of_known_strings():
    zeros, count, text = bytes(32), bytes(range(32)), b"123456789"
    got = op1_records.crc32c([zeros, count, text, text * 200])
    assert got[:3].tolist() == [0x8A9136AA, 0x46DD794E, 0xE3069283]
    assert op1_records.crc32c([text * 200])[0] == got[3]


@pytest.fixture(scope="module")
def written(spark, docs):
    folder = scratch_folder(spark)
    return folder, op1_records.write_records(docs, folder, public_tokenizers.path(NAMES["byte"]))


def test_records_round_trip(spark, written, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = reference_ids("byte", [t for _, t in ordered], 0)
    starts = np.cumsum([0] + [len(i) for i in ids])
    want = {d: (int(s), len(i), crc(i)) for (d, _), i, s in zip(ordered, ids, starts, strict=False)}
    got = op1_records.read_records(spark, *written).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(rows)


def test_records_by_index_in_any_order(written, rows):
    folder, manifest = written
    texts = dict(rows)
    for shard in manifest.collect():
        for number in reversed(range(shard.n_records)):
            doc_id, ids = op1_records.parse(op1_records.read_payload(folder, shard.shard, number))
            assert ids.tolist() == reference_ids("byte", [texts[doc_id]], 0)[0]


def test_a_changed_byte_is_found(spark, written, tmp_path):
    folder, manifest = written
    first = manifest.orderBy("shard").filter("n_records > 0").first()
    path = op1_records.filesystem(folder)[1]
    raw = bytearray(open(f"{path}/part-{first.shard:05d}.rec", "rb").read())
    raw[20] ^= 1
    (tmp_path / "part-00000.rec").write_bytes(raw)
    (tmp_path / "part-00000.idx").write_bytes(open(f"{path}/part-{first.shard:05d}.idx", "rb").read())
    with pytest.raises(ValueError, match="checksum"):
        op1_records.read_payload(str(tmp_path), 0, 0)


def test_records_of_nothing_and_of_repeated_rows(spark, docs, no_docs):
    path = public_tokenizers.path(NAMES["byte"])
    folder = scratch_folder(spark)
    none = op1_records.write_records(no_docs, folder, path)
    assert op1_records.read_records(spark, folder, none).count() == 0
    folder = scratch_folder(spark)
    twice = op1_records.write_records(docs.union(docs), folder, path)
    assert op1_records.read_records(spark, folder, twice).count() == 2 * docs.count()


def check_packing(pieces, texts_by_id, capacity, copies=1):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == texts_by_id.keys()
    for doc_id, own in by_doc.items():
        ids = reference_ids("word", [texts_by_id[doc_id]], 2)[0]
        assert sum(p.length for p in own) == copies * len(ids)
        if copies == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == crc(ids[at : at + p.length])
                at += p.length
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity and at & (at - 1) == 0


@pytest.mark.parametrize(("capacity", "shard_tokens"), [(4096, 1_000_000), (64, 2000)])
def test_packing(docs, rows, capacity, shard_tokens):
    path = public_tokenizers.path(NAMES["word"])
    found = op9_packing.pack_documents(docs, path, capacity=capacity, shard_tokens=shard_tokens).collect()
    check_packing(found, dict(rows), capacity)


def test_packing_of_nothing_and_of_repeated_rows(docs, no_docs, rows):
    path = public_tokenizers.path(NAMES["word"])
    assert op9_packing.pack_documents(no_docs, path).count() == 0
    check_packing(op9_packing.pack_documents(docs.union(docs), path).collect(), dict(rows), 4096, 2)


def test_equal_rows_spread_over_shards(spark):
    path = public_tokenizers.path(NAMES["word"])
    same = spark.range(0, 6000, 1, 3).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    found = op9_packing.pack_documents(same, path, shard_tokens=2000).collect()
    tokens = defaultdict(int)
    for p in found:
        tokens[p.sequence_id // op9_packing.SHARD_SPAN] += p.length
    assert sum(tokens.values()) == 24_000 and len(tokens) > 8 and max(tokens.values()) < 4000


def test_packing_balances_cost():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 900, 600))[::-1]
    cost = defaultdict(float)
    for _, _, n, sequence, _ in op9_packing.assign(lengths):
        cost[sequence] += n + op9_packing.QUADRATIC * n * n
    full = [cost[s] for s in range(int(lengths.sum()) // 4096)]
    assert max(full) < 1.1 * min(full)


def test_mixing(docs, rows):
    size = {d: len(brute.WORDS.findall(t or "")) for d, t in rows}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = defaultdict(int)
    for d, s in source.items():
        sizes[s] += size[d]
    want = brute.targets(dict(sizes))
    for block in (1024, 50, 7):
        found = op6_mixing.taken_words(docs, block).collect()
        assert len(found) == len(rows)
        taken = defaultdict(int)
        for r in found:
            assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
            assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-12) and 0 <= r.taken <= 2 * r.size
            taken[source[r.doc_id]] += r.taken
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = op6_mixing.taken_words(docs.repartition(5), 7).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in found}


def test_schedule_is_even_and_whole(spark):
    owing = spark.createDataFrame([(0, 3000), (1, 900), (2, 1), (3, 0)], "sid long, owed long")
    slots = op6_mixing.schedule(owing, 10).orderBy("slot", "rank").collect()
    ranks = defaultdict(list)
    for s in slots:
        ranks[s.sid].append(s.rank)
    assert {s: sorted(r) for s, r in ranks.items()} == {0: list(range(300)), 1: list(range(90)), 2: [0]}
    for upto in range(50, 391, 50):
        seen = sum(1 for s in slots[:upto] if s.sid == 1)
        assert abs(seen - upto * 90 / 391) < 4


def test_mixed_documents(docs, no_docs):
    mixed = op6_mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times.values()) <= {1, 2} and max(times.values()) == 2
    assert op6_mixing.mixed_documents(no_docs).count() == 0 and op6_mixing.taken_words(no_docs).count() == 0
    twice = op6_mixing.taken_words(docs.union(docs))
    assert twice.count() == 2 * docs.count() and twice.filter("taken > 2 * size").count() == 0


def test_mixed_documents_with_one_id_and_text_in_two_sources(spark):
    rows = [(1, "a b c", "x", 10, "t"), (1, "a b c", "y", 20, "t"), (2, "d e f g", "y", 30, "t"), (3, "h i", "x", 40, "t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _time int, _shuffle string")
    mixed = op6_mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    found = [tuple(r) for r in mixed.collect()]
    assert set(found) <= set(rows) and max(map(found.count, rows)) <= 2
    words = {s: sum(len(r[1].split()) for r in found if r[2] == s) for s in "xy"}
    for source, target in brute.targets({"x": 5, "y": 7}).items():
        assert abs(words[source] - target) < 4


def test_running_sums_by_levels(spark):
    from nametwin.llm.common import running

    frame = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 65521).alias("o"), F.lit(2).cast("long").alias("v"))
    found = running(frame, "k", "o", "v", "before", 17).collect()
    for k in range(3):
        own = sorted((r.o, r.before) for r in found if r.k == k)
        assert [b for _, b in own] == [2 * i for i in range(len(own))]
