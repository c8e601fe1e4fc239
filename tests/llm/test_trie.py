"""The prefix trie of conversations against plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from nametwin.llm import op13_trie as op
from tests.llm.brute import WORDS


def built(rows, lend=True):
    """{conversation: turns} of (conv_id, turn, role, text) rows; ties by the digest the operator uses."""

    def key(r):
        role, text = r[2] or "", r[3] or ""
        digest = hashlib.sha256(f"{len(role.encode())}\n{role}\n{text}".encode()).hexdigest()
        return r[1] is not None, r[1] or 0, digest

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    if not lend:
        return dict(own)
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(conversations.items()):
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        words = len(WORDS.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * words
    return sorted(
        (
            (m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
            for n, m in members.items()
        ),
        key=str,
    )


SCHEMA = "conv_id long, turn long, role string, text string, depth int, words string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)


def found(turns):
    return sorted(map(tuple, op.trie(turns).collect()), key=str)


def conversations(rng):
    """Few distinct turns, so prefixes are shared; copies, gaps, null turns and ids."""
    rows = []
    for c in range(-25, 120):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            text = rng.choice(["", "yes", "no way", "a b c", None, " x\ty\n z "])
            rows.append((c * 3, t - 1 if t else None, rng.choice(["user", "bot", None]), text))
    rows += [(700 + i, t, "user", f"same {t} turn") for i in range(50) for t in range(4)]
    rows += [(900, t, "user", "w " * (t % 5)) for t in range(150)]
    rows += [(901, t, "user", "w " * (t % 5)) for t in range(149, -1, -1)]
    rows += [(None, 0, "user", "lost"), (55, 2, "a", "one"), (55, 2, "b", "two"), (55, 2, "b", "two")]
    return rows


def test_trie_of_rebuilt_conversations(spark):
    rows = conversations(random.Random(1))
    assert found(op.shared_openings(frame_of(spark, rows))) == brute(built(rows))


def test_trie_without_rebuilding(spark):
    rows = conversations(random.Random(2))
    assert found(op.ordered(frame_of(spark, rows))) == brute(built(rows, lend=False))


def test_conversation_without_turns_left(spark):
    rows = [(c, 0, "user", f"hi {c}") for c in range(41, 60)]  # no conversation 40: nothing to lend
    want = brute(built(rows))
    root = next(r for r in want if r[1] == 0)
    assert root[3] == 19 and any(not t for t in built(rows).values())
    assert found(op.shared_openings(frame_of(spark, rows))) == want


def test_nothing(spark):
    empty = frame_of(spark, [(1, 1, "", "")]).limit(0)
    assert found(op.shared_openings(empty)) == []
    assert found(op.ordered(frame_of(spark, [(None, 1, "a", "b")]))) == []


def test_hot_parent_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_CHILDREN", 10)
    monkeypatch.setattr(op, "MAX_HOT", 5)
    rows = [(i, 0, "u", f"t{i % 300}") for i in range(900)] + [(i, 1, "u", f"t{i % 7}") for i in range(600)]
    assert found(op.ordered(frame_of(spark, rows))) == brute(built(rows, lend=False))


@pytest.mark.parametrize("ids", [1, 3, 70_000])
def test_ids_in_strings(ids):
    import pyarrow as pa

    keys = [b"a"] * 4 + [b"b"] * ids
    values = list(range(len(keys)))
    parts = [slice(0, 2), slice(2, 5), slice(5, len(keys))]
    batches = [pa.record_batch([pa.array(keys[p], pa.binary()), pa.array(values[p], pa.int64())], names=["id", "c"]) for p in parts]
    strings = [b for b in op._joined_ids(iter(batches)) if b.num_rows]
    out = [r for b in op._hashed_ids(iter(strings)) for r in b.to_pylist()]
    want = {k: hashlib.sha256(",".join(str(v) for x, v in zip(keys, values, strict=True) if x == k).encode()).hexdigest() for k in (b"a", b"b")}
    assert {r["id"]: r["ends_sha256"] for r in out} == want


def test_sums_over_random_trees(spark):
    rng = random.Random(4)
    trees = [[(i, i - 1 if i else None) for i in range(90)]]  # a chain
    trees.append([(i, 0 if i else None) for i in range(90)])  # a star
    trees.append([(i, rng.randrange(max(0, i - 4), i) if i else None) for i in range(150)])
    trees.append([(0, None)])
    for tree in trees:
        value = {i: rng.randrange(100) for i, _ in tree}
        total = dict(value)
        for i, parent in reversed(tree):
            if parent is not None:
                total[parent] += total[i]
        frame = spark.createDataFrame([(i, p, value[i], 1) for i, p in tree], "id long, parent long, v long, w long")
        sums = {r.id: r.v for r in op.subtree_sums(frame, ["v", "w"]).collect()}
        assert sums == total
