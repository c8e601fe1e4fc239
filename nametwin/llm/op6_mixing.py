"""Mixing sources to target weights on a low-discrepancy schedule.

Sources in code point order, null last, weigh 3, 1, 2, repeating, and share `budget`
times all words. A target stops at `most` times the words of its source; the excess is
shared again by weight until none is above. That is one level for all unsaturated
sources, found by a running sum over the sources in order of limit by weight.

The documents of a source, shuffled by hash and laid end to end as often as needed, are
cut into blocks of equal words. Slot k of the schedule takes the fraction k times the
golden ratio; the sources' shares laid end to end say which source that is; the rank of
the slot among those of its source is the block it takes. Slots beyond what a source
owes are left out and missing ones follow at the end, so every source gives its target
to the word. A stream taken up to twice its length holds no document more than twice.

Null text: no words, nothing taken. Null source: a source of its own. Ties in the
shuffle: by doc_id, and rows alike in both are interchangeable. Repeated rows count as
documents of their own. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nametwin.llm.common import SPACE, located, running
from nametwin.operators.keep import settle

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
BLOCK_WORDS = 1024
GOLDEN = 2654435769  # 2**32 divided by the golden ratio
UNIT = 1 << 32
CELLS = 256


def words(text: Column) -> Column:
    """Number of runs of characters other than the six spaces."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(sid, source, source_size, target, owed): a row for each source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    known = by_source.withColumn("sid", F.row_number().over(named) - 1)
    choice = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod("sid", F.lit(len(WEIGHTS))) + 1).cast("int"))
    limits = known.withColumns({"weight": choice, "limit": F.col("source_size") * MOST})
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spent = F.coalesce(F.sum("limit").over(before), F.lit(0))
    passed = F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(BUDGET) - spent) / (
        F.sum("weight").over(everything) - passed
    )
    levels = limits.withColumn("level", level)
    full = F.col("limit") / F.col("weight") <= F.col("level")
    shared = levels.withColumn("open", F.max(F.when(~full, F.col("level"))).over(everything))
    target = F.when(full, F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("open"))
    return shared.withColumn("target", target).select(
        "sid", "source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("owed")
    )


def schedule(owing: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, sid, rank): which block of which source is taken when."""
    blocks = F.ceil(F.col("owed") / block_words).cast("long")
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ends = (
        owing.withColumn("blocks", blocks)
        .filter("blocks > 0")
        .withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
        .withColumn("n", F.sum("blocks").over(everything))
        .select(
            "sid",
            "blocks",
            F.floor(F.col("first") / F.col("n") * UNIT).alias("low"),
            F.floor((F.col("first") + F.col("blocks")) / F.col("n") * UNIT).alias("high"),
        )
    )
    spark = owing.sparkSession
    n = ends.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    width = UNIT // CELLS
    cells = ends.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
    )
    slots = spark.range(n).select(
        F.col("id").alias("slot"),
        F.pmod(F.pmod("id", F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(UNIT)).alias("point"),
    )
    dealt = (
        slots.withColumn("cell", F.floor(F.col("point") / width))
        .join(cells, "cell")
        .filter("point >= low and point < high")
        .select("slot", "sid", "blocks", F.lit(1).cast("long").alias("one"))
    )
    ranked = running(dealt, "sid", "slot", "one", "rank", max(1, int(n).bit_length()))
    given = ranked.filter("rank < blocks").select("slot", "sid", "rank")
    have = dealt.groupBy("sid").agg(F.count("*").alias("have"))
    short = ends.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    missing = short.filter("have < blocks").select(
        F.lit(n).cast("long").alias("slot"), "sid", F.explode(F.expr("sequence(have, blocks - 1)")).alias("rank")
    )
    return given.unionByName(missing)


def shuffle_place(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text, which SQL engines have too."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def sized_documents(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, shuffle, carry): a row a document, settled."""
    texts = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), *carry
    )
    place = shuffle_place(F.col("doc_id"), F.col("text"))
    return settle(
        texts.select("doc_id", "source", words(F.col("text")).alias("size"), place.alias("shuffle"), *carry)
    )


def mix(
    sized: DataFrame, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces); both have the columns `carry` of the documents.

    Documents carry sid, source_size, target and `at`, their place in their source.
    Pieces (slot, sid, rank, doc_id, shuffle, at, round, first_word, n_words) say what
    each slot takes of a document; round 1 is the second time through the source.
    """
    owing = settle(targets(sized))
    both = sized.join(owing, sized["source"].eqNullSafe(owing["source"])).select(
        "doc_id", sized["source"], "size", "shuffle", "sid", "source_size", "target", "owed", *carry
    )
    placed = settle(running(both, "sid", "shuffle", "size", "at", 60, ("doc_id",)))
    rounds = placed.filter("size > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("round")
    )
    start = F.col("round") * F.col("source_size") + F.col("at")
    taken = rounds.withColumns({"start": start, "stop": F.least(start + F.col("size"), F.col("owed"))})
    cut = taken.filter("start < stop").withColumn(
        "rank",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("stop") - 1) / block_words))),
    )
    low = F.greatest("start", F.col("rank") * block_words)
    high = F.least("stop", (F.col("rank") + 1) * block_words)
    pieces = cut.select(
        "sid",
        "rank",
        "doc_id",
        "shuffle",
        "at",
        "round",
        (low - F.col("start")).alias("first_word"),
        (high - low).alias("n_words"),
        *carry,
    )
    return placed, pieces.join(schedule(owing, block_words), ["sid", "rank"])


def taken_words(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken): a row a document."""
    placed, pieces = mix(sized_documents(docs), block_words)
    given = pieces.groupBy("sid", "at", "shuffle").agg(F.sum("n_words").alias("taken"))
    # documents without words share their place with the next one and take nothing
    key = F.when(F.col("size") > 0, F.col("at")).alias("at")
    known = placed.select("sid", key, "shuffle", "doc_id", "size", "source_size", "target")
    return known.join(given, ["sid", "at", "shuffle"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of `docs`: whole documents, once for each time they begin in it.

    A document whose first word a slot takes is in the mix; so each source's words
    differ from its target by less than a document.
    """
    placed = located(docs)  # rows are told apart by where they lie, so whatever they share they stay apart
    key = ("file", "line")
    rows = placed.select("row.doc_id", "row.source", "row.text", "file", F.col("at").alias("line"))
    _, pieces = mix(sized_documents(rows, key), carry=key)
    times = pieces.filter("first_word = 0").groupBy(*key).agg(F.count("*").alias("times"))
    taken = placed.withColumnRenamed("at", "line").join(times, list(key))
    return taken.select("row", F.explode(F.expr("sequence(1L, times)")).alias("time")).select("row.*")
