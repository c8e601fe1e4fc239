"""What several operators share."""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nametwin.operators.keep import settle, shared_folder

LEAST_BITS, MOST_BITS = 16, 27  # of a bitmap, as powers of two; 16 MB at most
ROOM = 8  # bits for each key, so that of other keys an eighth passes

SPACE = r"\x20\x09-\x0D"  # fixed value: the six characters that part words


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a folder driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def located(rows: DataFrame) -> DataFrame:
    """(row, file, at): each row as a struct, and where it lies; written out first if it lies nowhere."""

    def placed(frame: DataFrame) -> DataFrame:
        where = frame.metadataColumn("_metadata")  # a column of that name may be among the others
        return frame.select(
            F.struct(*[frame[c] for c in frame.columns]).alias("row"),
            where["file_path"].alias("file"),
            where["row_index"].alias("at"),
        )

    try:
        return placed(rows)
    except AnalysisException:
        if shared_folder(rows.sparkSession) is None:
            raise RuntimeError("rows that lie in no file need spark.checkpoint.dir") from None
        return placed(settle(rows))


def settled(frame: DataFrame) -> DataFrame:
    """`settle`, then let go of the shuffle files behind it.

    Spark deletes the files of a shuffle when the driver's JVM collects what refers to
    it, which a driver with little to do may not get to before the disks are full.
    """
    done = settle(frame)
    gc.collect()
    frame.sparkSession.sparkContext._jvm.System.gc()
    return done


def running(
    rows: DataFrame, key: str, order: str, value: str, out: str, bits: int, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Sum of `value` over the rows of the same `key` before a row, by `order`, then `ties`.

    `order` is a long in [0, 2**bits). A key may hold all rows: sums of ranges of
    `order` are added up first, level by level, and no window sees more than the
    rows of a range or the ranges of a larger one.
    """
    from pyspark.sql import Window

    def before(frame: DataFrame, by: list[str], sort: list, what: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn("_in", F.coalesce(F.sum(what).over(w), F.lit(0).cast("long")))

    def level(frame: DataFrame, left: int, sort: list, what: str) -> DataFrame:
        if left <= 8:
            return before(frame, [key], sort, what).withColumn("_all", F.col("_in")).drop("_in")
        upper = F.shiftright("_o", 8)
        sums = frame.groupBy(key, upper.alias("_o")).agg(F.sum(what).alias("_w"))
        sums = level(sums, left - 8, ["_o"], "_w")
        starts = sums.select(key, F.col("_o").alias("_u"), F.col("_all").alias("_start"))
        inner = before(frame.withColumn("_u", upper), [key, "_u"], sort, what)
        joined = inner.join(starts, [key, "_u"])
        return joined.withColumn("_all", F.col("_in") + F.col("_start")).drop("_in", "_u", "_start")

    n = rows.count()
    keep = max(8, min(bits, 8 * -(-max(1, n - 1).bit_length() // 8)))
    low = max(0, bits - keep)  # ranges so fine that few rows share one
    marked = rows.withColumn("_o", F.shiftright(order, low))
    done = level(marked, keep, ["_o", order, *ties], value)
    return done.withColumnRenamed("_all", out).drop("_o")


@dataclass(frozen=True)
class Bitmap:
    """Tells of a 64-bit key that it is not among some keys, or that it may be."""

    words: object  # a broadcast array of 64-bit words

    def holds(self, keys: np.ndarray) -> np.ndarray:
        words = self.words.value
        bit = keys & np.uint64(64 * len(words) - 1)
        return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(keys: DataFrame) -> Bitmap | None:
    """Bitmap of the one long column of `keys`; None if they are too many for its bounded size.

    What comes to the driver and goes to the executors is the bitmap, never a key.
    """
    n = keys.count()
    power = max(LEAST_BITS, (ROOM * n).bit_length())
    if power > MOST_BITS:
        return None
    bits = keys.select(F.col(keys.columns[0]).bitwiseAND((1 << power) - 1).alias("bit"))
    ones = F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("ones")
    rows = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(ones).toArrow()
    words = np.zeros(1 << (power - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("ones").to_numpy().view(np.uint64)
    return Bitmap(keys.sparkSession.sparkContext.broadcast(words))
