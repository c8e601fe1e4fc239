"""A fitted model as relations: its nodes, the boxes of its leaves, scores by them.

Spark saves a tree as a table of nodes. Read back, it needs no parsing, and what the trees
say can be joined and counted like any other data. Every table here is bounded by rounds
and depth, not by the rows that were fitted.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nametwin.config import FEATURES, PROBA
from nametwin.operators.keep import scratch_folder, settle


def model_features(pipeline: PipelineModel) -> tuple[str, ...]:
    """What the model was fitted on, in its order."""
    return tuple(pipeline.stages[0].getInputCols())


def tree_nodes(spark: SparkSession, pipeline: PipelineModel) -> DataFrame:
    """(tree, id, value, rows, gain, left, right, feature, cut) of every node.

    `value` is what the tree adds to the margin for a row that ends there. Leaves have
    no left, right, feature or cut.
    """
    model, path = pipeline.stages[-1], f"{scratch_folder(spark)}/model"
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    # one row a round
    weights = spark.createDataFrame(list(enumerate(map(float, model.treeWeights))), "tree int, weight double")
    node = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    return node.join(F.broadcast(weights), "tree").select(
        "tree",
        "id",
        (F.col("prediction") * F.col("weight")).alias("value"),
        F.col("impurityStats")[0].alias("rows"),
        "gain",
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("cut"),
    )


def _named(spark: SparkSession, pipeline: PipelineModel) -> DataFrame:
    return spark.createDataFrame(list(enumerate(model_features(pipeline))), "index int, feature string")


def split_counts(spark: SparkSession, pipeline: PipelineModel) -> DataFrame:
    """(feature, importance): how often the trees split on each feature, most used first."""
    used = tree_nodes(spark, pipeline).filter("left IS NOT NULL").groupBy(F.col("feature").alias("index"))
    counted = _named(spark, pipeline).join(used.agg(F.count("*").alias("n")), "index", "left")
    table = counted.select("feature", F.coalesce("n", F.lit(0)).cast("long").alias("importance"))
    return table.orderBy(F.desc("importance"), "feature")


def gain_shares(spark: SparkSession, pipeline: PipelineModel) -> DataFrame:
    """(feature, share): gain times rows over all splits, as a share of the whole."""
    nodes = tree_nodes(spark, pipeline).filter("left IS NOT NULL")
    sums = nodes.groupBy(F.col("feature").alias("index")).agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    joined = _named(spark, pipeline).join(sums, "index", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    whole = F.sum("g").over(Window.partitionBy())  # a row a feature
    return joined.select("feature", F.coalesce(F.try_divide("g", whole), F.lit(0.0)).alias("share"))


def tree_cuts(nodes: DataFrame, n: int = len(FEATURES)) -> list[list[float]]:
    """For each of `n` features, the sorted values at which any tree splits; at most max_bins of each."""
    rows = nodes.filter("left IS NOT NULL").groupBy("feature").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
    found = {r["feature"]: list(r["cuts"]) for r in rows.collect()}  # a row a feature
    return [found.get(i, []) for i in range(n)]


def leaf_boxes(nodes: DataFrame, n: int = len(FEATURES)) -> DataFrame:
    """(tree, low0, high0, .., value) of every leaf: it takes rows with low < feature <= high.

    Boxes of a tree part the space. They are cut level by level from the root down, a
    join for each level of depth.
    """
    lows, highs = [f"low{i}" for i in range(n)], [f"high{i}" for i in range(n)]
    ends = {c: F.lit(float("-inf")) for c in lows} | {c: F.lit(float("inf")) for c in highs}
    level = settle(nodes.filter("id = 0").withColumns(ends))
    leaves: list[DataFrame] = []
    while True:
        leaves.append(level.filter("left IS NULL").select("tree", *lows, *highs, "value"))
        inner = level.filter("left IS NOT NULL")
        if inner.isEmpty():
            break
        sides = []
        for child, ends_there in (("left", highs), ("right", lows)):
            moved = {e: F.when(F.col("feature") == i, F.col("cut")).otherwise(F.col(e)) for i, e in enumerate(ends_there)}
            sides.append(inner.withColumns(moved).select("tree", F.col(child).alias("id"), *lows, *highs))
        level = settle(sides[0].unionByName(sides[1]).join(nodes, ["tree", "id"]))
    boxes = leaves[0]
    for more in leaves[1:]:
        boxes = boxes.unionByName(more)
    return boxes


def _cell(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below a value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.lit(cuts), lambda c: c < value))


def score_by_boxes(features: DataFrame, nodes: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Input columns plus `proba`, from the leaf boxes alone.

    Rows whose features lie between the same cuts get the same score, so rows go to cells
    first, each occupied cell meets one box of every tree, and the scores go back to the
    rows. Boxes number rounds times leaves; they are broadcast.
    """
    nodes = settle(nodes)
    cuts = tree_cuts(nodes, len(names))
    cells = [f"_cell{i}" for i in range(len(names))]
    placed = settle(features.withColumns({c: _cell(F.col(f), cuts[i]) for i, (c, f) in enumerate(zip(cells, names, strict=True))}))
    # the upper end of a cell stands for all of it
    ends = {f"_x{i}": F.get(F.lit([*cuts[i], float("inf")]), F.col(c)) for i, c in enumerate(cells)}
    occupied = placed.select(cells).distinct().withColumns(ends)
    inside = F.lit(True)
    for i in range(len(names)):
        inside = inside & (F.col(f"low{i}") < F.col(f"_x{i}")) & (F.col(f"_x{i}") <= F.col(f"high{i}"))
    boxes = F.broadcast(settle(leaf_boxes(nodes, len(names))))
    margins = occupied.join(boxes, inside).groupBy(cells).agg(F.sum("value").alias("_margin"))
    scored = placed.join(margins, cells)
    return scored.select(*features.columns, (1 / (1 + F.exp(-2 * F.col("_margin")))).alias(PROBA))
