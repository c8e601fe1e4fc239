"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns; the root is the empty one. Turns are put in
order by one range shuffle on (conversation, turn), so a conversation of any length is
spread over tasks, and are numbered from counts per conversation and range. A prefix is
named by the sum, in eight lanes, of SHA-256 digests over (position, role, text): a sum
before a row is a sum within its range plus the ranges before, and the parent's name is
the sum without the last turn. Texts never move; nodes come from one partial aggregation.

Totals come from contraction. A phase compresses, then rakes. Compress takes every
chain of nodes with one child: pointers double until all of the chain point past its
end, in as many join rounds as the logarithm of its length, and the node below takes the
chain's place with the chain's sum on its edge. Rake takes all leaves at once and adds
them to their parents. After compress every inner node has two children or more, so a
phase halves the tree. Removed nodes are then expanded in reverse: a raked node knew its
total, a compressed one adds its sum to the total of the node it points to. Children
count by partial sums, so a node may have any number of them; joins are on nodes, which
are unique on both sides.

Turns go by `turn`, null first, then by the digest of role and text; null role or text is
the empty string. Rows without conv_id belong to no conversation. Repeated rows are turns of their
own. Conversations that are equal share all nodes. No rows: no nodes, not even the root.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nametwin.llm.common import SPACE
from nametwin.operators.keep import settle

LANES = 8  # of 32 bits each; sums of fewer than 2**31 of them fit a long
ROOT = hashlib.sha256(b"").digest()
NOBODY = hashlib.sha256(b"").hexdigest()
HOT_CHILDREN = 2_000  # of a parent, for its children to learn of it by broadcast
MAX_HOT = 100_000  # bound on such parents
CHUNK_IDS = 1 << 16  # ids of a node's members joined in one string

Turns = tuple[DataFrame, DataFrame]


def ordered(conversations: DataFrame) -> Turns:
    """(c, part, pos, digest, words) of every turn, and (c, n) of every conversation."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat_ws("\n", F.octet_length(role), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("words"),
    ).filter("c IS NOT NULL")
    keys = ("c", "turn", "digest")
    spread = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys, "row")
    placed = settle(
        spread.sortWithinPartitions(*keys, "row")
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id())
        .drop("row", "turn")
    )
    sizes = settle(placed.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("c", "part").orderBy("at")) - 1
    numbered = placed.join(starts, ["c", "part"]).withColumn("pos", F.col("start") + inside)
    whole = sizes.groupBy("c").agg(F.sum("n").alias("n"))
    return settle(numbered.select("c", "part", "pos", "digest", "words")), whole


def relent(turns: Turns, base: Column, lent: Column, most: int) -> Turns:
    """Turns of conversations whose first `lent` turns, at most `most`, become those of conversation `base`.

    All if `base` has fewer, none if there is no such conversation. `base` and `lent` are
    expressions over c, and neither is null.
    """
    rows, whole = turns
    heads = rows.filter(F.col("pos") < most).groupBy(F.col("c").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("head")
    )
    nothing = F.array().cast("array<struct<pos:long,digest:string,words:long>>")
    facts = settle(
        whole.withColumns({"base": base, "h": lent})
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h").cast("int")))
        .withColumn("m", F.size("head"))
    )
    parts = rows.select("c", "part").distinct()  # facts go to rows by range, so a long conversation stays spread
    by_part = parts.join(facts.select("c", "h", "m"), "c")
    own = rows.join(by_part, ["c", "part"]).filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("m"))
    borrowed = facts.select("c", F.lit(-1).alias("part"), F.inline("head"))
    columns = ["c", "part", "pos", "digest", "words"]
    left = F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    return settle(own.select(columns).unionByName(borrowed.select(columns))), facts.select("c", left.alias("n"))


def _name(depth: Column, lanes: list[Column]) -> Column:
    known = F.unhex(F.sha2(F.concat_ws(",", depth, *lanes), 256))
    return F.when(depth == 0, F.lit(ROOT)).otherwise(known)


def prefixes(turns: Turns) -> DataFrame:
    """(id, parent, depth, c, words, ends): the nodes each conversation passes, without the root."""
    rows, whole = turns
    digest = F.sha2(F.concat_ws(",", "pos", "digest"), 256)
    valued = rows.withColumn("value", digest).withColumns(
        {f"v{i}": F.conv(F.substring("value", 8 * i + 1, 8), 16, 10).cast("long") for i in range(LANES)}
    )
    lanes = [f"v{i}" for i in range(LANES)]
    sums = settle(valued.groupBy("c", "part").agg(*[F.sum(v).alias(v) for v in lanes]))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "c", "part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"s{i}") for i, v in enumerate(lanes)]
    )
    by_part = starts.join(whole, "c")
    inside = Window.partitionBy("c", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    after = [F.col(f"s{i}") + F.sum(v).over(inside) for i, v in enumerate(lanes)]
    summed = valued.join(by_part, ["c", "part"]).withColumns({f"a{i}": a for i, a in enumerate(after)})
    depth = F.col("pos") + 1
    return summed.select(
        _name(depth, [F.col(f"a{i}") for i in range(LANES)]).alias("id"),
        _name(F.col("pos"), [F.col(f"a{i}") - F.col(f"v{i}") for i in range(LANES)]).alias("parent"),
        depth.alias("depth"),
        "c",
        "words",
        (depth == F.col("n")).alias("ends"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _doubled(chain: DataFrame, values: list[str]) -> DataFrame:
    """(id, to, values): for each node of chains (id, to, values), the end it leads to and the sum on the way.

    `values` of a row are what is added from `id` down to just above `to`; an end is a
    `to` that is no `id`.
    """
    while True:
        ahead = chain.select(F.col("id").alias("to"), F.col("to").alias("_to"), *[F.col(v).alias(f"_{v}") for v in values])
        sums = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
        jumped = settle(
            chain.join(ahead, "to", "left").select(
                "id", F.coalesce("_to", "to").alias("to"), *sums, F.col("_to").isNotNull().alias("jumped")
            )
        )
        chain = jumped.drop("jumped")
        if jumped.filter("jumped").isEmpty():
            return chain


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(id, values): sums of the columns `values`, longs, over the subtree of each node of (id, parent, values).

    The root has a null parent; every other parent is a node.
    """
    live = settle(tree.select("id", "parent", *values, *[F.lit(0).cast("long").alias(f"up_{v}") for v in values]))
    raked: list[DataFrame] = []
    chained: list[DataFrame] = []
    while True:
        kids = live.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").alias("child"), *[f"up_{v}" for v in values])).alias("only")
        )
        known = settle(live.join(kids, "id", "left"))

        # compress: a node with one child, the root apart, leads to it
        single = known.filter("n = 1 AND parent IS NOT NULL")
        below = [(F.col(v) + F.col(f"only.up_{v}")).alias(v) for v in values]
        ups = [f"up_{v}" for v in values]
        links = settle(single.select("id", "parent", F.col("only.child").alias("to"), *below, *ups))
        rest = known.filter("n IS NULL OR n > 1 OR parent IS NULL").drop("only")
        if not links.isEmpty():
            ends = _doubled(links.select("id", "to", *values), values)
            chained.append(ends)
            tops = links.join(links.select(F.col("id").alias("parent")), "parent", "left_anti")
            moved = tops.select("id", F.col("parent").alias("_parent"), *ups).join(ends, "id").select(
                F.col("to").alias("id"), "_parent", *[(F.col(v) + F.col(f"up_{v}")).alias(f"_{v}") for v in values]
            )
            rest = rest.join(moved, "id", "left").withColumns(
                {f"up_{v}": F.coalesce(f"_{v}", f"up_{v}") for v in values}
            )
            rest = rest.withColumn("parent", F.coalesce("_parent", "parent")).drop("_parent", *[f"_{v}" for v in values])
        rest = settle(rest)

        # rake: leaves pass what they hold to their parents
        leaf = F.col("n").isNull()
        raked.append(rest.filter(leaf).select("id", *values))
        given = rest.filter(leaf & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
            *[F.sum(F.col(v) + F.col(f"up_{v}")).alias(f"_{v}") for v in values]
        )
        gains = {v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}
        live = settle(rest.filter(~leaf).join(given, "id", "left").withColumns(gains).select(live.columns))
        if live.isEmpty():
            break
    totals = raked
    for ends in reversed(chained):
        below = _union(totals).select(F.col("id").alias("to"), *[F.col(v).alias(f"_{v}") for v in values])
        sums = [(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]
        totals = [*totals, settle(ends.join(below, "to").select("id", *sums))]
    return _union(totals)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, c) in order to (id, first, ids): ids of a node, comma-joined, up to CHUNK_IDS in a row."""
    node, ids = None, []

    def row() -> pa.RecordBatch:
        columns = [pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])]
        return pa.RecordBatch.from_arrays(columns, names=["id", "first", "ids"])

    for b in batches:
        made = []
        for key, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key != node or len(ids) == CHUNK_IDS:
                if ids:
                    made.append(row())
                node, ids = key, []
            ids.append(c)
        if made:
            yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    if ids:
        yield row()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, first, ids) in order to (id, ends_sha256): SHA-256 of all ids of a node."""
    node, running = None, hashlib.sha256()

    def batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        keys, digests = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], names=["id", "ends_sha256"])

    for b in batches:
        done = []
        for key, ids in zip(b.column(0).to_pylist(), b.column(2), strict=True):
            if key == node:
                running.update(b",")
            else:
                if node is not None:
                    done.append((node, running.hexdigest()))
                node, running = key, hashlib.sha256()
            running.update(ids.as_buffer())
        if done:
            yield batch(done)
    if node is not None:
        yield batch([(node, running.hexdigest())])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of rows (id, c): ids of conversations ascending, comma-joined, hashed.

    SHA-256 reads its input in order, so the strings of a node meet in one task; what
    they are made of is joined before, in ranges of (node, conversation).
    """
    spread = ends.repartitionByRange("id", "c").sortWithinPartitions("id", "c")
    strings = spread.mapInArrow(_joined_ids, "id binary, first long, ids string")
    return strings.repartition("id").sortWithinPartitions("id", "first").mapInArrow(
        _hashed_ids, "id binary, ends_sha256 string"
    )


def _with_parent(nodes: DataFrame, kids: DataFrame) -> DataFrame:
    """Adds parent_conv_id. Parents of very many children, a bounded number, are broadcast; others are joined."""
    total = nodes.count()
    hot = kids.filter(F.col("n_children") > max(HOT_CHILDREN, total // MAX_HOT)).select("id")
    names = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    few = F.broadcast(settle(names.join(hot.withColumnRenamed("id", "parent"), "parent")))
    marked = nodes.join(few, "parent", "left")
    rest = marked.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(names, "parent", "left")
    return marked.filter("parent_conv_id IS NOT NULL").unionByName(rest)


def trie(turns: Turns) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    conv_id is the smallest conversation that starts with the node's turns, n_convs how
    many do. Over its subtree, n_leaves counts the nodes without children, saved_tokens
    adds up the words of each node's last turn times the conversations that need not
    hold them again. ends_sha256 is of the conversations that end there.
    """
    whole = turns[1]
    passed = settle(prefixes(turns))
    inner = passed.groupBy("id").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("c").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.first("words").alias("words"),
    )
    zero = F.lit(0).cast("long")
    root = whole.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), "conv_id", "n_convs",
        zero.alias("words"),
    )
    nodes = settle(inner.unionByName(root))
    kids = settle(
        nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    )
    counted = settle(_with_parent(nodes, kids).join(kids, "id", "left").fillna(0, ["n_children"]))
    weighed = counted.select(
        "id",
        "parent",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = subtree_sums(weighed, ["n_leaves", "saved_tokens"])
    silent = whole.filter("n = 0").select(F.lit(ROOT).alias("id"), "c")
    ends = ends_digest(passed.filter("ends").select("id", "c").unionByName(silent))
    return (
        counted.join(totals, "id")
        .join(ends, "id", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
        )
    )


def shared_openings(conversations: DataFrame) -> Turns:
    """Turns where each conversation opens with those of the first of its twenty.

    Conversation c takes the first h turns of conversation c - c % 20, then its own from
    turn h on; h is the CRC-32 of the decimal c modulo 4.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 4
    return relent(ordered(conversations), F.col("c") - F.col("c") % 20, h, 3)
