"""Catalogs and labelled pairs read from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nametwin.operators.catalog import REFERENCE, SUPPLIER


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(source: DataFrame) -> DataFrame:
    """A source with fewer splits than cores, dealt out to all cores.

    For work that costs far more than reading, such as matching expressions over
    whole texts. A source of many files or row groups comes back as it is.
    """
    spark = source.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return source if _file_splits(spark, source.inputFiles(), cores) >= cores else source.repartition(cores)


def _file_splits(spark: SparkSession, files: list[str], enough: int) -> int:
    """Splits that a scan of `files` has, counted from file sizes alone, up to `enough`."""
    if len(files) >= enough:
        return len(files)
    size = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes").removesuffix("b") + "b"
    ))
    hadoop = spark._jsc.hadoopConfiguration()
    splits = 0
    for file in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        splits += -(-path.getFileSystem(hadoop).getFileStatus(path).getLen() // size)
    return splits


def _renderings(parts: DataFrame) -> DataFrame:
    """Every part as the reference catalog and as the supplier catalog write it."""
    return parts.select(
        "p_partkey",
        "p_brand",
        F.concat_ws(" ", "p_name", "p_type", F.lit("size"), "p_size").alias("A"),
        F.concat(
            F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit(", "), F.col("p_size")
        ).alias("B"),
    )


def part_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One request per brand and thousand keys; both catalogs list its parts, in own words."""
    both = F.explode(
        F.array(
            F.struct(F.lit(REFERENCE).alias("side"), F.col("A").alias("name")),
            F.struct(F.lit(SUPPLIER).alias("side"), F.col("B").alias("name")),
        )
    ).alias("e")
    shown = _renderings(table(spark, folder, "part")).select("p_brand", "p_partkey", both)
    request = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 1000))
    return shown.select(
        request.alias("request_id"), "e.side", F.col("p_partkey").alias("pos"), "e.name"
    )


def part_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled pairs: a part with itself (match) and with the next part (no match)."""
    shown = _renderings(table(spark, folder, "part"))
    same = shown.select("A", "B", F.lit(True).alias("match"))
    following = shown.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("B").alias("B"))
    other = shown.select("p_partkey", "A").join(following, "p_partkey")
    return same.unionAll(other.select("A", "B", F.lit(False).alias("match")))


def conversation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(pair_id, A, B): every turn with the one after it, whoever speaks; the last with null."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    key = F.concat_ws("-", "conv_id", "turn").alias("pair_id")
    turns = table(spark, folder, "conversations")
    return turns.select(key, F.col("text").alias("A"), following.alias("B"))


def text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(pair_id, A, B): conversation pairs and both renderings of every part."""
    shown = _renderings(table(spark, folder, "part"))
    key = F.concat(F.lit("part-"), F.col("p_partkey")).alias("pair_id")
    return conversation_pairs(spark, folder).unionAll(spread(shown).select(key, "A", "B"))


def conversation_requests(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines (column `value`): sentences of a turn against those of the next, or none."""
    none = F.array().cast("array<string>")
    sentences = {c: F.coalesce(F.split(c, r"[.\n]"), none) for c in ("A", "B")}
    body = F.struct(
        F.col("pair_id").alias("request_id"),
        sentences["A"].alias("referenceCatalog"),
        sentences["B"].alias("inputCatalog"),
    )
    return conversation_pairs(spark, folder).select(F.to_json(body).alias("value"))


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, A, B, match, proba): document length as a score for the quality label."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("lang").alias("A"),
        F.col("source").alias("B"),
        (F.col("quality") == 1).alias("match"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(4000.0))).alias("proba"),
    )
