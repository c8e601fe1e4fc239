"""Exact deduplication as a stateful stream, by JVM operators alone.

Texts are equal when they are identical after deleting space, tab, line feed, vertical
tab, form feed and carriage return. A stream of arrivals (digest, stable id, length,
locator) feeds keyed state on disk (RocksDB) that never expires. For each digest the
state keeps how many arrived and, of the best one so far, id and locator. Partial sums
go before the shuffle, so a digest that a third of all rows share is a row per task.
The state is read back as a table. Rows that hit a digest already held, and hardly any
other, are checked on full bytes: a digest whose smallest and largest normalised text
differ has collided, and its rows are grouped by the text itself. Which rows to check a
broadcast bitmap of at most 16 MB says; beyond 17 million repeated digests it lets more
and more rows through, never fewer.

Of equal texts the row with the most code points stays, then the smallest doc_id, null
ids last, then the first by locator. Null text: empty. Repeated rows: one of them
stays. No rows: no rows. Other columns are carried by `deduplicated` and else ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nametwin.llm.common import located
from nametwin.operators.keep import scratch_folder, settle

DELETED = " \t\n\x0b\x0c\r"  # fixed value
STATE = {  # small stores by the hundred: no space set aside, changes saved rather than snapshots
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
FILES_A_BATCH = 1000
LEAST_BITS, MOST_BITS = 16, 27  # of a bitmap, as powers of two
ROOM = 8  # bits for each digest, so that of other rows an eighth passes


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), DELETED, "")


def digest_of(text: Column, bits: int = 256) -> Column:
    """Binary SHA-256, cut to its first `bits` bits."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, bits // 8)


def arrivals(placed: DataFrame, bits: int = 256) -> DataFrame:
    """(digest, doc_id, n_chars, file, at) of each row of a batch or a stream from `located`."""
    text = F.col("row.text").cast("string")
    return placed.select(
        digest_of(normalised(text), bits).alias("digest"),
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).alias("n_chars"),
        "file",
        "at",
    )


def best() -> Column:
    """The row that stays, as the smallest struct."""
    return F.min(
        F.struct(
            (-F.col("n_chars")).alias("less"),
            F.col("doc_id").isNull().alias("unnamed"),
            F.col("doc_id").alias("id"),
            F.col("file").alias("in_file"),
            F.col("at").alias("in_row"),
        )
    )


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def feed(stream: DataFrame, state: str) -> None:
    """Take in all arrivals that a stream has now; `state` is its checkpoint folder.

    Run again with more arrivals and the same folder, it goes on where it stopped.
    """
    spark = stream.sparkSession
    held = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best().alias("best"))
    with _state_on_disk(spark):
        (
            held.writeStream.format("noop")
            .outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", state)
            .start()
            .awaitTermination()
        )


def held(spark: SparkSession, state: str) -> DataFrame:
    """(digest, n, best) as the state has it."""
    with _state_on_disk(spark):
        rows = spark.read.format("statestore").load(state)
    count, least = rows.schema["value"].dataType.names
    if rows.schema["value"].dataType[count].dataType.typeName() != "long":
        count, least = least, count
    return rows.select(
        F.col("key.digest").alias("digest"),
        F.col("value")[count].alias("n"),
        F.col("value")[least].alias("best"),
    )


def hitting(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """`rows` whose digest is among `digests`, and some of the others; none if there are no digests."""
    n = digests.count()
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (ROOM * n).bit_length()))
    bit = F.pmod(F.xxhash64("digest"), F.lit(size)) + 1  # buckets count from 1
    maps = digests.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits")
    )
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "_bucket")
    at = F.bitmap_bit_position(bit)
    octet = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    return met.filter(F.getbit(octet, F.pmod(at, F.lit(8)).cast("int")) == 1).select(rows.columns)


def collided(placed: DataFrame, repeated: DataFrame, bits: int = 256) -> DataFrame:
    """Digests of more than one text, by comparing full bytes of all that share one of `repeated`."""
    text = normalised(F.col("row.text").cast("string"))
    texts = hitting(placed.select(digest_of(text, bits).alias("digest"), text.alias("t")), repeated)
    ends = texts.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return ends.filter("a <> b").select("digest")


def _groups(placed: DataFrame, bits: int) -> DataFrame:
    """(digest, doc_id, n_chars, file, at, n, best) of every row."""
    spark = placed.sparkSession
    base = scratch_folder(spark)
    taken, state = f"{base}/arrivals", f"{base}/state"
    batch = arrivals(placed, bits)
    batch.write.parquet(taken)
    rows = spark.read.schema(batch.schema).parquet(taken)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(taken)
    feed(stream, state)
    groups = settle(held(spark, state))
    hit = settle(collided(placed, groups.filter("n > 1").select("digest"), bits))
    if hit.isEmpty():
        return rows.join(groups, "digest")
    # rows of a collided digest are grouped by their text
    text = normalised(F.col("row.text").cast("string"))
    own = placed.select(digest_of(text, bits).alias("digest"), text.alias("t"), "file", "at").join(hit, "digest")
    apart = rows.join(own, ["digest", "file", "at"])
    by_text = apart.groupBy("digest", "t").agg(F.count(F.lit(1)).alias("n"), best().alias("best"))
    whole = apart.join(by_text, ["digest", "t"]).drop("t")
    return rows.join(hit, "digest", "left_anti").join(groups, "digest").unionByName(whole)


def _kept() -> Column:
    return (F.col("file") == F.col("best.in_file")) & (F.col("at") == F.col("best.in_row"))


def dedup_groups(docs: DataFrame, bits: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): a row for each row of `docs`."""
    return _groups(located(docs), bits).select(
        "doc_id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), _kept().alias("kept"), "digest"
    )


def deduplicated(docs: DataFrame, bits: int = 256) -> DataFrame:
    """The rows of `docs` that stay."""
    placed = located(docs)
    stay = _groups(placed, bits).filter(_kept()).select("file", "at")
    return placed.join(stay, ["file", "at"], "left_semi").select("row.*")
