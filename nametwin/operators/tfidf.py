"""TF-IDF as relations: an idf table, pair cosines and per-name profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.functions.text import tokens
from nametwin.operators.keep import settle
from nametwin.operators.tiling import tiled_join

# An idf table is broadcast only when its terms, at TERM_BYTES beside their letters, are
# counted to take at most this much; a larger one is shuffled.
BROADCAST_BYTES = 100_000_000
TERM_BYTES = 64
PART_BYTES = 2_000_000  # of texts whose words one task counts


@dataclass(frozen=True)
class Idf:
    """`terms` is (term, df, idf); `n_terms` and `n_bytes` are its counted sizes."""

    terms: DataFrame
    n_docs: int
    n_terms: int
    n_bytes: int
    broadcast_bytes: int = BROADCAST_BYTES

    def attach(self, rows: DataFrame, row_id: str) -> DataFrame:
        """Rows whose `term` is known, with its `idf`; frequent terms cannot skew this."""
        weights = self.terms.select("term", "idf")
        if self.n_bytes <= self.broadcast_bytes:
            return rows.join(F.broadcast(weights), "term")
        return tiled_join(settle(rows), weights, ["term"], row_id, "term")


def document_frequencies(texts: DataFrame, *columns: Column) -> DataFrame:
    """(term, df) over the given normalized columns; repeats of a text count.

    One scan, combined before the shuffle: a term found in every text costs one
    row per task.
    """
    text = texts.select(F.explode(F.array(*columns)).alias("text"))
    terms = text.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def weigh(frequencies: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    return frequencies.select("term", "df", idf.alias("idf"))


def settled_cosine(cosine: Column) -> Column:
    """To 12 decimals, so that the order in which a sum was taken cannot move a pair over a cut."""
    return F.round(cosine, 12)


def fit_idf(texts: DataFrame, *columns: Column, broadcast_bytes: int = BROADCAST_BYTES) -> Idf:
    """Fit on normalized text columns; each column of each row is one document."""
    n_docs = texts.count() * len(columns)
    terms = settle(weigh(document_frequencies(texts, *columns), F.lit(float(n_docs))))
    n_terms, n_bytes = terms.agg(
        F.count(F.lit(1)), F.sum(F.octet_length("term") + F.lit(TERM_BYTES))
    ).first()
    if n_terms == 0:
        raise ValueError("cannot fit TF-IDF: no text holds a token of two characters")
    return Idf(terms, n_docs, n_terms, n_bytes, broadcast_bytes)


def _dealt(texts: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows dealt out by `key` so that a task gets about PART_BYTES of the given columns.

    Words are counted where the texts lie, and take many times the room of the texts. The
    number of parts is fixed by the size, as adaptive merging sees the packed texts only.
    """
    n_bytes = texts.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(0)).cast("long"))).first()[0] or 0
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // PART_BYTES))
    return texts.select(key, *columns).repartition(parts, key)


def pair_features(pairs: DataFrame, key: str, idf: Idf, carry: dict[str, Column]) -> DataFrame:
    """(key, carry, cosine_similarity) of the columns A_norm and B_norm; a row a pair.

    Terms the model does not know are ignored; a pair without a common known term has
    cosine 0. Texts and what is carried are written out first, so each is made once.
    Words are counted after one shuffle on the pair key, in rows of key, word and two
    counts; what is carried meets the sums of its pair. No word or name is ever a shuffle
    key, so a frequent one cannot skew it.
    """
    columns = [c.alias(f"_c{i}") for i, c in enumerate(carry.values())]
    kept = settle(pairs.select(F.col(key).alias("_key"), "A_norm", "B_norm", *columns))
    sides = F.explode(
        F.array(
            F.struct(F.lit(1).alias("is_a"), tokens(F.col("A_norm")).alias("words")),
            F.struct(F.lit(0).alias("is_a"), tokens(F.col("B_norm")).alias("words")),
        )
    ).alias("side")
    words = _dealt(kept, "_key", "A_norm", "B_norm").select("_key", sides)
    words = words.select("_key", "side.is_a", F.explode("side.words").alias("term"))
    is_a = F.col("is_a")
    counts = words.groupBy("_key", "term").agg(F.sum(is_a).alias("tf_a"), F.sum(1 - is_a).alias("tf_b"))
    weighted = idf.attach(counts, "_key").select(
        F.col("_key").alias("_own"), (F.col("tf_a") * F.col("idf")).alias("a"), (F.col("tf_b") * F.col("idf")).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    sums = weighted.groupBy("_own").agg(F.sum(a * b).alias("dot"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    packed = F.struct(F.lit(0).alias("_"), *[F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)])
    whole = kept.groupBy("_key").agg(F.first(packed).alias("_carry"))
    cosine = settled_cosine(F.col("dot") / (F.sqrt("aa") * F.sqrt("bb")))
    return whole.join(sums, F.col("_key").eqNullSafe(F.col("_own")), "left").select(
        F.col("_key").alias(key),
        *[F.col("_carry")[n].alias(n) for n in carry],
        F.when(F.col("dot") > 0, cosine).otherwise(0.0).alias("cosine_similarity"),
    )


def pair_cosine(pairs: DataFrame, key: str, idf: Idf) -> DataFrame:
    """(key, cosine_similarity) of pairs with a common known term."""
    return pair_features(pairs, key, idf, {}).filter("cosine_similarity > 0")


def profiles(names: DataFrame, keys: list[str], idf: Idf, every: bool = False) -> DataFrame:
    """(keys, terms, profile) of the column `norm`, which is one of the keys.

    `terms` lists the known terms, rarest first; `profile` maps each to its
    weight, the weights having unit length. A name without known terms has no
    row, or nulls if `every` name is asked for. Words travel with a digest of the
    keys, not with the keys.
    """
    row = F.unhex(F.sha2(F.to_json(F.struct(*keys)), 256))
    kept = settle(names.select(*keys).distinct().withColumn("_row", row))
    words = _dealt(kept, "_row", "norm").select("_row", F.explode(tokens(F.col("norm"))).alias("term"))
    counts = words.groupBy("_row", "term").agg(F.count("*").alias("tf"))
    weighted = idf.attach(counts, "_row").select(
        "_row",
        (F.col("tf") * F.col("idf")).alias("w"),
        F.struct((-F.col("idf")).alias("order"), "term").alias("ranked"),
    )
    grouped = weighted.groupBy("_row").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"),
        F.array_sort(F.collect_list(F.struct("ranked", "w"))).alias("entries"),
    )
    return kept.join(grouped, "_row", "left" if every else "inner").select(
        *keys,
        F.transform("entries", lambda e: e["ranked"]["term"]).alias("terms"),
        F.map_from_entries(
            F.transform(
                "entries",
                lambda e: F.struct(e["ranked"]["term"], e["w"] / F.col("size")),
            )
        ).alias("profile"),
    )
