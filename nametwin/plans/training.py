"""Labelled pairs in, evaluated matcher out."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nametwin.config import DECISION, PROBA, Settings
from nametwin.operators.features import feature_table, normalize_pairs
from nametwin.operators.keep import settle
from nametwin.operators.metrics import evaluate, find_threshold, take_decision
from nametwin.operators.split import assign_exact, deduplicate
from nametwin.operators.tfidf import Idf, fit_idf
from nametwin.plans.model import Matcher, acceptance_bounds, add_probability, fit_boosted
from nametwin.sources.synthetic import labelled_pairs

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Trained:
    matcher: Matcher
    scored_test: DataFrame
    metrics: DataFrame  # (metric, value), the threshold included


@dataclass(frozen=True)
class Prepared:
    idf: Idf
    features: DataFrame  # all pairs with their features and `part`

    def part(self, name: str) -> DataFrame:
        return self.features.filter(F.col("part") == name).drop("part")


def prepare(pairs: DataFrame, settings: Settings = Settings(), vectors: DataFrame | None = None) -> Prepared:
    """Deduplicate, split, fit TF-IDF on the training part, add features to all parts.

    With `vectors` (`dense.vector_table`), a fourth one is theirs.
    """
    unique = settle(deduplicate(pairs))
    parted = settle(
        assign_exact(
            unique,
            F.col("pair_id"),
            settings.train_fraction,
            settings.val_fraction,
            settings.split_seed,
        )
    )
    known = normalize_pairs(parted.filter(F.col("part") == "train"))
    idf = fit_idf(known, F.col("A_norm"), F.col("B_norm"))
    return Prepared(idf, settle(feature_table(parted, "pair_id", idf, texts=False, vectors=vectors)))


def train(
    pairs: DataFrame, settings: Settings = Settings(), early_stop: bool = False, vectors: DataFrame | None = None
) -> Trained:
    """Fit on train, take the threshold from val, evaluate on test."""
    spark = pairs.sparkSession
    ready = prepare(pairs, settings, vectors)
    pipeline = fit_boosted(
        ready.part("train"), "pair_id", settings.boost, ready.part("val") if early_stop else None
    )
    threshold = find_threshold(add_probability(ready.part("val"), pipeline), settings.min_precision)
    scored = settle(
        add_probability(ready.part("test"), pipeline).withColumn(
            DECISION, take_decision(F.col(PROBA), threshold)
        )
    )
    metrics = evaluate(scored, settings.min_average_precision)
    chosen = spark.range(1).select(F.lit("threshold").alias("metric"), F.lit(threshold).alias("value"))
    bounds = acceptance_bounds(spark, pipeline, threshold)
    matcher = Matcher(pipeline, ready.idf, threshold, bounds, vectors)
    return Trained(matcher, scored, settle(metrics.unionAll(chosen)))


def train_on_generated(spark: SparkSession, settings: Settings = Settings()) -> Trained:
    pairs = labelled_pairs(spark, settings.n_rows, settings.match_ratio, settings.seed)
    return train(pairs, settings)


def quality_gate(metrics: DataFrame) -> bool:
    """True when the average precision on test is good enough; warns otherwise."""
    values = {r["metric"]: r["value"] for r in metrics.collect()}  # nine rows
    passed = values["passed"] == 1.0
    if not passed:
        log.warning("model performs poorly: average precision %.4f", values["average_precision_score"])
    return passed
