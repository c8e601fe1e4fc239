"""Evaluation of scored pairs (columns `match` boolean, `proba` double, `decision` boolean).

Nothing here ranks raw rows in one task: scores are grouped first, and running
sums are taken inside score ranges plus range offsets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nametwin.operators.keep import settle

GRID = 101  # thresholds 0.00, 0.01 .. 1.00
QUANTILES = (0.25, 0.5, 0.75)
RANGE_ROWS = 200_000  # distinct scores one range may hold


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def running_counts(scored: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(proba, n, tp, cum_n, cum_tp) per distinct score, cumulated from the highest down."""
    by_score = settle(
        scored.groupBy("proba").agg(
            F.count("*").alias("n"), F.count_if(F.col("match")).alias("tp")
        )
    )
    n_ranges = -(-by_score.count() // range_rows)
    if n_ranges > 1:
        # cuts at quantiles of the distinct scores, so ranges hold about equally many
        at = [i / n_ranges for i in range(1, n_ranges)]
        cuts = sorted(set(by_score.approxQuantile("proba", at, 0.2 / n_ranges)))
        splits = [float("-inf"), *cuts, float("inf")]
        by_score = Bucketizer(splits=splits, inputCol="proba", outputCol="range").transform(by_score)
    else:
        by_score = by_score.withColumn("range", F.lit(0.0))
    # one row for each range_rows distinct scores, so one task holds them
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        by_score.groupBy("range")
        .agg(F.sum("n").alias("range_n"), F.sum("tp").alias("range_tp"))
        .select(
            "range",
            F.coalesce(F.sum("range_n").over(above), F.lit(0)).alias("n_above"),
            F.coalesce(F.sum("range_tp").over(above), F.lit(0)).alias("tp_above"),
        )
    )
    inside = Window.partitionBy("range").orderBy(F.desc("proba")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return by_score.join(offsets, "range").select(
        "proba",
        "n",
        "tp",
        (F.col("n_above") + F.sum("n").over(inside)).alias("cum_n"),
        (F.col("tp_above") + F.sum("tp").over(inside)).alias("cum_tp"),
    )


def average_precision(curve: DataFrame) -> DataFrame:
    """One row: sum over scores of recall step times precision."""
    positives = F.sum("tp")
    steps = F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n"))
    return curve.agg(_ratio(steps, positives).alias("average_precision_score"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """One row: chance that a positive outranks a negative, ties count half."""
    negatives = F.col("n") - F.col("tp")
    wins = F.sum(negatives * (F.col("cum_tp") - F.col("tp") / 2))
    return curve.agg(_ratio(wins, F.sum("tp") * F.sum(negatives)).alias("roc_auc_score"))


def score_quantiles(curve: DataFrame) -> DataFrame:
    """(metric, value) of the 0.25, 0.5 and 0.75 quantiles, interpolated linearly.

    Exact, and read off the running counts: no task sees all scores.
    """
    total = curve.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        raise ValueError("no scores to take quantiles of")
    # rank 0 is the smallest score; a score covers the ranks [total - cum_n, total - cum_n + n)
    low = F.lit(total) - F.col("cum_n")
    parts = []
    for q in QUANTILES:
        at = (total - 1) * q
        base = int(at)
        for rank, weight in ((base, 1 - (at - base)), (min(base + 1, total - 1), at - base)):
            covered = (low <= rank) & (low + F.col("n") > rank)
            parts.append(
                F.struct(
                    F.lit(f"test_q{q}").alias("metric"),
                    F.when(covered, F.col("proba") * weight).alias("value"),
                )
            )
    return (
        curve.select(F.explode(F.array(*parts)).alias("p"))
        .filter(F.col("p.value").isNotNull())
        .groupBy("p.metric")
        .agg(F.sum("p.value").alias("value"))
    )


def confusion_columns() -> list[Column]:
    """Accuracy, precision and recall of `decision`; an empty denominator gives 0."""
    hit, truth = F.col("decision"), F.col("match")
    both = F.count_if(hit & truth)
    return [
        _ratio(F.count_if(hit == truth), F.count("*")).alias("accuracy_score"),
        _ratio(both, F.count_if(hit)).alias("precision_score"),
        _ratio(both, F.count_if(truth)).alias("recall_score"),
    ]


def confusion_counts() -> list[Column]:
    """Counts that add up over parts of the rows; `confusion_from_counts` makes scores of them."""
    hit, truth = F.col("decision"), F.col("match")
    return [
        F.count("*").alias("n"),
        F.count_if(hit == truth).alias("n_right"),
        F.count_if(hit & truth).alias("n_both"),
        F.count_if(hit).alias("n_hit"),
        F.count_if(truth).alias("n_true"),
    ]


def confusion_from_counts() -> list[Column]:
    """`confusion_columns` of the rows that were counted."""
    return [
        _ratio(F.sum("n_right"), F.sum("n")).alias("accuracy_score"),
        _ratio(F.sum("n_both"), F.sum("n_hit")).alias("precision_score"),
        _ratio(F.sum("n_both"), F.sum("n_true")).alias("recall_score"),
    ]


def confusion_metrics(scored: DataFrame) -> DataFrame:
    """One row of `confusion_columns`."""
    return scored.agg(*confusion_columns())


def grid_index(proba: Column) -> Column:
    """Highest i with proba >= i * 0.01 as doubles, 100 at most; -1 below 0."""
    guess = F.least(F.lit(GRID - 1), F.floor(proba * 100).cast("int"))

    def holds(i: Column) -> Column:
        return proba >= i.cast("double") * F.lit(0.01)

    return (
        F.when((guess + 1 < GRID) & holds(guess + 1), guess + 1)
        .when(holds(guess), guess)
        .otherwise(guess - 1)
    )


def threshold_table(scored: DataFrame) -> DataFrame:
    """(threshold, precision) for all 101 thresholds, from one pass over the scores."""
    # 101 buckets at most reach the window
    buckets = (
        scored.groupBy(grid_index(F.col("proba")).alias("i"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("match")).alias("tp"))
        .filter(F.col("i") >= 0)
    )
    steps = scored.sparkSession.range(GRID).select(F.col("id").cast("int").alias("i"))
    full = steps.join(F.broadcast(buckets), "i", "left").fillna(0)
    up = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.select(
        (F.col("i").cast("double") * F.lit(0.01)).alias("threshold"),
        _ratio(F.sum("tp").over(up), F.sum("n").over(up)).alias("precision"),
    )


def min_precision_threshold(scored: DataFrame, min_precision: float) -> DataFrame:
    """One row: the smallest grid threshold that reaches the precision, or null."""
    table = threshold_table(scored)
    return table.agg(
        F.min(F.when(F.col("precision") >= min_precision, F.col("threshold"))).alias("threshold")
    )


def find_threshold(scored: DataFrame, min_precision: float) -> float:
    found = min_precision_threshold(scored, min_precision).first()["threshold"]
    if found is None:
        raise ValueError(f"no threshold reaches a precision of {min_precision}")
    return found


def take_decision(proba: Column, threshold: float | None) -> Column:
    if threshold is None:
        raise ValueError("a decision needs a threshold")
    return proba >= F.lit(float(threshold))


def evaluate(scored: DataFrame, min_average_precision: float) -> DataFrame:
    """(metric, value): five scores, three quantiles and `passed` (1.0 or 0.0)."""
    curve = settle(running_counts(scored))
    ap = average_precision(curve)
    gate = ap.select(
        F.lit("passed").alias("metric"),
        (F.col("average_precision_score") >= min_average_precision).cast("double").alias("value"),
    )
    single = [ap, roc_auc(curve), confusion_metrics(scored)]
    rows = [one.unpivot([], one.columns, "metric", "value") for one in single]
    out = score_quantiles(curve).unionAll(gate)
    for part in rows:
        out = out.unionAll(part)
    return out


def examples(scored: DataFrame, positive: bool, key: str, limit: int = 20) -> DataFrame:
    """The first true positives (or true negatives) by key: columns A and B."""
    hit = F.lit(positive)
    kept = scored.filter((F.col("decision") == hit) & (F.col("match") == hit))
    return kept.orderBy(key).limit(limit).select("A", "B")


def sample_by_label(pairs: DataFrame, matching: bool, key: str, limit: int = 20) -> DataFrame:
    """A reproducible random sample of one class."""
    kept = pairs.filter(F.col("match") == F.lit(matching))
    return kept.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(limit)


def match_rate(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(F.col("match").cast("double")).alias("match_rate"))
