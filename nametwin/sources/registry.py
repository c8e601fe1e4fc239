"""Published models: versioned folders plus a manifest, all on shared storage.

Layout under one folder: `model/<id>` (pipeline, idf, vectors, meta, example, lengths), `metrics`,
`params`, and `manifest/<number>.json`, a file a version. Paths and run ids are random,
and a version's number exists in the manifest alone, which is written last: a reader
sees a version only when all of it is there.

Numbers are given by optimistic concurrency: a publisher creates the file of the next
number only if there is none, and tries the one after that if another was faster. No two
get the same number, no lock is held, and a publisher that dies leaves at most a gap.
Before it asks for a number, a model is read back and must score five matching and five
other pairs as it did in memory.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nametwin.config import Settings
from nametwin.operators.candidates import Bounds, Box
from nametwin.operators.tfidf import Idf
from nametwin.plans.model import Matcher, run_model
from nametwin.plans.monitoring import length_histogram, overall_shares
from nametwin.plans.training import Trained
from nametwin.sources.synthetic import labelled_pairs

SMOKE_PAIRS = 5  # of either kind
_COMMIT = "version long, run_id string, path string"


class BrokenModel(RuntimeError):
    """A model that does not score after being written and read back; it gets no number."""


_META = (
    "threshold double, n_docs long, n_terms long, n_bytes long, "
    "min_cosine double, max_levenshtein double, min_jaro_winkler double, "
    "below_levenshtein double, below_jaro_winkler double, "
    "min_dense double, below_dense double, has_vectors boolean"
)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the session's storage."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(version, run_id, path) of what is published; a number claimed but not filled in is not."""
    files, target = _hadoop(spark, f"{folder}/manifest")
    if not files.exists(target):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(f"{folder}/manifest").filter("run_id IS NOT NULL")


def claimed(spark: SparkSession, folder: str) -> int:
    """The highest number that any publisher has claimed; 0 without any."""
    files, target = _hadoop(spark, f"{folder}/manifest")
    if not files.exists(target):
        return 0
    names = (s.getPath().getName() for s in files.listStatus(target))  # a file a version
    return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file unless there is one; false if there is.

    Hadoop's create without overwriting is atomic on shared storage. On a local disk it
    looks first and creates then, so there the operating system's exclusive open is used.
    """
    files, target = _hadoop(spark, path)
    files.mkdirs(target.getParent())
    if files.getScheme() == "file":
        try:
            with open(unquote(target.toUri().getPath()), "x") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = files.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def commit(spark: SparkSession, folder: str, run_id: str, path: str) -> int:
    """Give a run the next free number."""
    version = claimed(spark, folder) + 1
    while True:
        row = json.dumps({"version": version, "run_id": run_id, "path": path})
        if _create(spark, f"{folder}/manifest/{version:010d}.json", row):
            return version
        version += 1


def latest_version(spark: SparkSession, folder: str) -> int | None:
    return manifest(spark, folder).agg(F.max("version")).first()[0]


def best_version(spark: SparkSession, folder: str, metric: str = "average_precision_score") -> int | None:
    """The published version with the highest value of a metric; the newest of equals."""
    runs = manifest(spark, folder).join(metrics(spark, folder), "run_id")
    rank = F.struct("value", "version")
    return runs.filter(F.col("metric") == metric).agg(F.max_by("version", rank)).first()[0]


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, f"{folder}/metrics", "run_id string, metric string, value double")


def params(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, f"{folder}/params", "run_id string, param string, value string")


def _logged_params(settings: Settings) -> list[tuple[str, str]]:
    flat = asdict(settings)
    flat.update(flat.pop("boost"))
    return [(k, str(v)) for k, v in flat.items()]


def publish(
    spark: SparkSession,
    folder: str,
    trained: Trained,
    settings: Settings,
    example: DataFrame | None = None,
    names: DataFrame | None = None,
) -> int:
    """Write a new version with all that belongs to it; returns its number.

    `example` has pairs (A, B) for `smoke_prediction`; `names` has the training names,
    whose length shares (`name_shares`) the drift check compares against.
    """
    matcher, run_id = trained.matcher, uuid.uuid4().hex
    path = f"{folder}/model/{run_id}"
    matcher.pipeline.write().save(f"{path}/pipeline")
    matcher.idf.terms.write.parquet(f"{path}/idf")
    b = matcher.bounds
    meta = [
        (
            matcher.threshold, matcher.idf.n_docs, matcher.idf.n_terms, matcher.idf.n_bytes,
            b.min_cosine, b.above.max_levenshtein, b.above.min_jaro_winkler,
            b.below.max_levenshtein if b.below else None,
            b.below.min_jaro_winkler if b.below else None,
            b.above.min_dense, b.below.min_dense if b.below else None, matcher.vectors is not None,
        )
    ]
    spark.createDataFrame(meta, _META).coalesce(1).write.parquet(f"{path}/meta")
    if matcher.vectors is not None:
        matcher.vectors.write.parquet(f"{path}/vectors")
    if example is not None:
        example.write.parquet(f"{path}/example")
    if names is not None:
        lengths = length_histogram(names.select("name", F.lit(0).alias("all")), "all")
        overall_shares(lengths).coalesce(1).write.parquet(f"{path}/lengths")
    run = F.lit(run_id).alias("run_id")
    trained.metrics.select(run, "metric", "value").coalesce(1).write.mode("append").parquet(
        f"{folder}/metrics"
    )
    logged = spark.createDataFrame(_logged_params(settings), "param string, value string")
    logged.select(run, "*").coalesce(1).write.mode("append").parquet(f"{folder}/params")
    smoke(spark, path, matcher)
    return commit(spark, folder, run_id, path)


def smoke_pairs(spark: SparkSession) -> DataFrame:
    """Five generated pairs that match and five that do not."""
    five = [labelled_pairs(spark, SMOKE_PAIRS, ratio, seed=11) for ratio in (1.0, 0.0)]
    key = F.concat_ws("-", F.col("match").cast("string"), "pair_id")
    return five[0].unionByName(five[1]).withColumn("pair_id", key)


def smoke(spark: SparkSession, path: str, matcher: Matcher) -> None:
    """Raise `BrokenModel` unless what lies under `path` scores as `matcher` does."""

    def scores(model: Matcher) -> dict[str, tuple]:
        rows = run_model(smoke_pairs(spark), "pair_id", model).select("pair_id", "proba", "decision").collect()
        return {r["pair_id"]: (r["proba"], r["decision"]) for r in rows}  # ten rows

    try:
        written = scores(_read(spark, path))
    except Exception as error:
        raise BrokenModel(f"{path} cannot be read back") from error
    if len(written) != 2 * SMOKE_PAIRS or any(p is None or not 0 <= p <= 1 for p, _ in written.values()):
        raise BrokenModel(f"{path} does not score {2 * SMOKE_PAIRS} pairs with probabilities")
    if written != scores(matcher):
        raise BrokenModel(f"{path} scores otherwise than the model that was written")


def _path(spark: SparkSession, folder: str, version: int | None) -> str:
    version = version or latest_version(spark, folder)
    if version is None:
        raise LookupError(f"no model published in {folder}")
    return manifest(spark, folder).filter(F.col("version") == version).first()["path"]


def smoke_prediction(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version's own input example scored by it, to see after publishing that it works."""
    example = spark.read.parquet(f"{_path(spark, folder, version)}/example")
    keyed = example.withColumn("pair_id", F.sha2(F.to_json(F.struct("A", "B")), 256))
    return run_model(keyed, "pair_id", load(spark, folder, version)).drop("pair_id")


def name_shares(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(bucket, share) of the lengths of the names a version was trained on."""
    return spark.read.schema("bucket int, share double").parquet(f"{_path(spark, folder, version)}/lengths")


def load(spark: SparkSession, folder: str, version: int | None = None) -> Matcher:
    """The given version, or the newest published one."""
    return _read(spark, _path(spark, folder, version))


def _least(bound: float | None) -> float:
    """None in versions from before there were vectors."""
    return float("-inf") if bound is None else bound


def _read(spark: SparkSession, path: str) -> Matcher:
    meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
    above = Box(meta["max_levenshtein"], meta["min_jaro_winkler"], _least(meta["min_dense"]))
    below = None
    if meta["below_levenshtein"] is not None:
        below = Box(meta["below_levenshtein"], meta["below_jaro_winkler"], _least(meta["below_dense"]))
    terms = spark.read.parquet(f"{path}/idf")
    return Matcher(
        PipelineModel.load(f"{path}/pipeline"),
        Idf(terms, meta["n_docs"], meta["n_terms"], meta["n_bytes"]),
        meta["threshold"],
        Bounds(meta["min_cosine"], above, below),
        spark.read.parquet(f"{path}/vectors") if meta["has_vectors"] else None,
    )
