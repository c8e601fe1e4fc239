"""The trained matcher: fit, score, and what its trees can accept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nametwin.config import DECISION, FEATURES, PROBA, TARGET, BoostParams
from nametwin.operators.candidates import Bounds, Box
from nametwin.operators.features import feature_table, features_of
from nametwin.operators.keep import use_checkpoint_folder
from nametwin.operators.metrics import take_decision
from nametwin.operators.tfidf import Idf
from nametwin.plans.trees import model_features, tree_cuts, tree_nodes

NOTHING = Box(max_levenshtein=-1.0)  # no pair has a negative distance
FIT_ROWS_PER_PARTITION = 100_000


@dataclass(frozen=True)
class Matcher:
    pipeline: PipelineModel
    idf: Idf
    threshold: float
    bounds: Bounds
    vectors: DataFrame | None = None  # (norm, vector), if the model has a fourth feature


def settled(features: DataFrame, key: str) -> DataFrame:
    """Training rows in a layout and order that depend on the data only.

    Boosting runs hundreds of short jobs, so small data must not be spread thin.
    """
    parts = max(1, -(-features.count() // FIT_ROWS_PER_PARTITION))
    return features.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)


def fit_boosted(
    train: DataFrame, key: str, params: BoostParams, validation: DataFrame | None = None
) -> PipelineModel:
    """Boosted trees on the feature columns and `match`; all rounds run.

    With `validation`, the first rounds that do best on it are kept. A fourth feature
    comes with fewer bins, so that the cells between the cuts are no more than of three.
    """
    names = features_of(train)
    bins = int(params.max_bins ** (len(FEATURES) / len(names)))
    use_checkpoint_folder(train.sparkSession)
    columns = [key, *names, F.col(TARGET).cast("double").alias("label")]
    rows = train.select(*columns)
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        lossType="logistic",
        maxIter=params.max_iter,
        stepSize=params.step_size,
        maxDepth=params.max_depth,
        maxBins=bins,
        minInstancesPerNode=params.min_instances_per_node,
        subsamplingRate=params.subsampling_rate,
        featureSubsetStrategy=params.feature_subset,
        seed=params.seed,
    )
    assembler = VectorAssembler(inputCols=list(names), outputCol="features")
    kept = settled(rows, key)
    try:
        fitted = Pipeline(stages=[assembler, trees]).fit(kept)
    finally:
        kept.unpersist()
    if validation is None:
        return fitted
    losses = prefix_losses(fitted, validation)
    return first_rounds(fitted, losses.index(min(losses)) + 1)


def prefix_losses(pipeline: PipelineModel, validation: DataFrame) -> list[float]:
    """Log loss on labelled features after the first round, after two, and so on; one pass over the rows."""
    labelled = validation.withColumn("label", F.col(TARGET).cast("double"))
    assembler, trees = pipeline.stages
    return [x / 2 for x in trees.evaluateEachIteration(assembler.transform(labelled))]  # Spark's is twice the log loss


def first_rounds(pipeline: PipelineModel, rounds: int) -> PipelineModel:
    """The model that boosting would have ended with after `rounds`: later trees never change earlier ones."""
    assembler, trees = pipeline.stages
    context, java = SparkContext._active_spark_context, trees._java_obj
    jvm = context._jvm.org.apache.spark.ml
    kept = context._gateway.new_array(jvm.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    every = java.trees()
    for i in range(rounds):
        kept[i], weights[i] = every[i], float(trees.treeWeights[i])
    short = jvm.classification.GBTClassificationModel(
        trees.uid, kept, weights, java.numFeatures(), java.numClasses()
    )
    return PipelineModel([assembler, GBTClassificationModel(java.copyValues(short, java.extractParamMap()))])


def add_probability(features: DataFrame, pipeline: PipelineModel) -> DataFrame:
    """Input columns plus `proba`, the probability of a match."""
    scored = pipeline.transform(features)
    proba = vector_to_array(F.col("probability"))[1]
    return scored.select(*features.columns, proba.alias(PROBA))


def run_model(pairs: DataFrame, key: str, matcher: Matcher) -> DataFrame:
    """Features, `proba` and `decision` for pairs (A, B) identified by `key`."""
    features = feature_table(pairs, key, matcher.idf, vectors=matcher.vectors)
    scored = add_probability(features, matcher.pipeline)
    return scored.withColumn(DECISION, take_decision(F.col(PROBA), matcher.threshold))


def acceptance_bounds(spark: SparkSession, pipeline: PipelineModel, threshold: float) -> Bounds:
    """The boxes of feature values outside of which the model never accepts.

    Trees are constant between their cuts, so one point per grid cell covers
    every possible pair. The grid has at most max_bins values per feature; it is
    laid out and scored as a distributed range and only the corners come back.
    """
    names = model_features(pipeline)
    cuts = dict(enumerate(tree_cuts(tree_nodes(spark, pipeline), len(names))))
    low = {i: [float("-inf"), *c] for i, c in cuts.items()}
    high = {i: [*c, float("inf")] for i, c in cuts.items()}
    inside = {i: [*c, (c[-1] if c else 0.0) + 1.0] for i, c in cuts.items()}

    def at(values: list[float], index: Column) -> Column:
        return F.get(F.lit(values), index)

    n_cells, position = 1, {}
    for i in range(len(names)):
        position[i] = F.pmod(F.floor(F.col("id") / n_cells), F.lit(len(inside[i]))).cast("int")
        n_cells *= len(inside[i])
    cells = spark.range(n_cells).select(
        *[at(inside[i], position[i]).alias(name) for i, name in enumerate(names)],
        at(low[0], position[0]).alias("cosine_from"),
        at(high[1], position[1]).alias("distance_to"),
        at(low[2], position[2]).alias("winkler_from"),
        (at(low[3], position[3]) if len(names) > len(FEATURES) else F.lit(float("-inf"))).alias("dense_from"),
    )
    accepted = add_probability(cells, pipeline).filter(take_decision(F.col(PROBA), threshold))
    # the lowest cosine cell holds the pairs without a common word
    corners = accepted.groupBy((F.col("cosine_from") == float("-inf")).alias("wordless")).agg(
        F.min("cosine_from").alias("cosine"),
        F.max("distance_to").alias("distance"),
        F.greatest(F.min("winkler_from"), F.lit(0.0)).alias("winkler"),
        F.min("dense_from").alias("dense"),
    )
    found = {r["wordless"]: r for r in corners.collect()}  # two rows at most
    box = {k: Box(r["distance"], r["winkler"], r["dense"]) for k, r in found.items()}
    if False not in found:
        # nothing is accepted above any cosine a pair can have
        return Bounds(2.0, below=box.get(True)) if cuts[0] else Bounds(0.0, box.get(True, NOTHING))
    cosine = found[False]["cosine"]
    if cosine <= 0:
        boxes = box.values()
        return Bounds(
            0.0,
            Box(
                max(b.max_levenshtein for b in boxes),
                min(b.min_jaro_winkler for b in boxes),
                min(b.min_dense for b in boxes),
            ),
        )
    return Bounds(cosine, box[False], box.get(True))
