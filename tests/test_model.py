"""Training, publishing, matching with the model, streaming and tuning."""

from __future__ import annotations

import json
import math
import os
import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from nametwin.config import FEATURES, BoostParams, Settings
from nametwin.operators import catalog
from nametwin.operators.candidates import Bounds, Box, acceptable_names
from nametwin.operators.features import check_features
from nametwin.operators.keep import keep, release, releasing, settle
from nametwin.operators.metrics import take_decision
from nametwin.plans.matching import match_catalogs, match_entries
from nametwin.plans.model import acceptance_bounds, add_probability, first_rounds, fit_boosted, prefix_losses, run_model
from nametwin.plans.monitoring import length_drift, length_histogram, unseen_term_rate
from nametwin.plans.training import quality_gate, train, train_on_generated
from nametwin.plans.trees import leaf_boxes, score_by_boxes, split_counts, tree_nodes
from nametwin.plans import tuning
from nametwin.plans.training import Prepared
from nametwin.plans.tuning import best_params
from nametwin.sources import registry
from nametwin.sources.requests import read_requests, write_replies
from nametwin.sources.synthetic import labelled_pairs
from nametwin.streaming.job import start_matching
from tests.test_matching import NULLS, SMALL

def normalized(text):
    return "".join(c for c in (text or "").lower() if c.isspace() or c.isascii() and c.isalnum())


FEW = Settings(boost=BoostParams(max_iter=8))


@pytest.fixture(scope="module")
def trained(spark):
    return train_on_generated(spark, FEW)


@pytest.fixture(scope="module")
def metric(trained):
    return {r["metric"]: r["value"] for r in trained.metrics.collect()}


def test_metrics_are_better_than_chance(trained, metric):
    assert set(metric) == {
        "average_precision_score", "roc_auc_score", "accuracy_score", "precision_score", "recall_score",
        "test_q0.25", "test_q0.5", "test_q0.75", "passed", "threshold",
    }
    assert metric["average_precision_score"] > 0.58 and metric["roc_auc_score"] > 0.6
    assert metric["threshold"] == trained.matcher.threshold
    assert quality_gate(trained.metrics) is False  # 0.98 is out of reach on this data


def test_sizes_of_the_test_part(trained):
    n = labelled_pairs(trained.scored_test.sparkSession, 2000, 0.5).select("A", "B", "match").distinct().count()
    assert trained.scored_test.count() == pytest.approx(n / 10, abs=2)


def test_training_does_not_depend_on_partitioning(spark, trained):
    pairs = labelled_pairs(spark, 2000, 0.5).repartition(11)
    again = train(pairs, FEW)
    assert again.matcher.threshold == trained.matcher.threshold
    assert again.matcher.bounds == trained.matcher.bounds


def test_importance_counts_every_inner_node(spark, trained):
    rows = split_counts(spark, trained.matcher.pipeline).collect()
    counts = [r["importance"] for r in rows]
    assert counts == sorted(counts, reverse=True)
    trees = trained.matcher.pipeline.stages[-1].trees
    assert sum(counts) == sum((t.numNodes - 1) // 2 for t in trees)


def test_scores_keep_null_rows_and_empty_frames(spark, trained):
    rows = spark.createDataFrame(
        [(1, "", None), (2, None, ""), (3, "small room", "huge room")], "k int, A string, B string"
    )
    got = run_model(rows, "k", trained.matcher)
    assert got.count() == 3 and got.filter("decision is null").count() == 0
    empty = run_model(rows.limit(0), "k", trained.matcher)
    assert empty.columns == got.columns and empty.count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.9])
def test_bounds_hold_for_every_accepted_pair(spark, trained, threshold):
    bounds = acceptance_bounds(spark, trained.matcher.pipeline, threshold)
    pairs = labelled_pairs(spark, 3000, 0.5, seed=99)
    scored = run_model(pairs, "pair_id", replace(trained.matcher, threshold=threshold))
    assert scored.filter(F.col("decision") & ~bounds.holds()).count() == 0


def test_nothing_is_accepted_above_all_scores(spark, trained):
    bounds = acceptance_bounds(spark, trained.matcher.pipeline, 1.5)
    names = spark.createDataFrame(
        [("r", "A", "big room", 1), ("r", "B", "big room", 1)],
        "request_id string, side string, norm string, copies long",
    )
    assert acceptable_names(names, trained.matcher.idf, bounds).count() == 0


def generated_entries(spark, n):
    pairs = labelled_pairs(spark, n, 0.5, seed=3)
    request = (F.col("pair_id") % 2).cast("string").alias("request_id")
    side = F.explode(
        F.array(
            F.struct(F.lit("A").alias("side"), F.col("A").alias("name")),
            F.struct(F.lit("B").alias("side"), F.col("B").alias("name")),
        )
    ).alias("e")
    return pairs.select(request, "pair_id", side).select(
        "request_id", "e.side", F.col("pair_id").alias("pos"), "e.name"
    )


@pytest.mark.parametrize("threshold", [0.45, 0.8])
@pytest.mark.parametrize("tile_rows", [9, 20_000])
def test_matching_equals_scoring_every_pair(spark, trained, threshold, tile_rows):
    bounds = acceptance_bounds(spark, trained.matcher.pipeline, threshold)
    matcher = replace(trained.matcher, threshold=threshold, bounds=bounds)
    entries = generated_entries(spark, 60)
    matched = match_entries(entries, matcher, tile_rows)
    whole = add_probability(
        acceptable_names(matched.names, matcher.idf, Bounds()), matcher.pipeline
    ).filter(take_decision(F.col("proba"), threshold))
    key = ["request_id", "A_norm", "B_norm"]
    got = sorted(matched.accepted.select(key).collect())
    assert got == sorted(whole.select(key).collect())
    positions = {
        (r["request_id"], r["A_pos"], b) for r in matched.mapping(tile_rows).collect() for b in r["B_pos"]
    }
    ready = matched.usable.collect()
    accepted = set(map(tuple, got))
    assert positions == {
        (a["request_id"], a["pos"], b["pos"])
        for a in ready
        for b in ready
        if a["side"] == "A" and b["side"] == "B" and a["request_id"] == b["request_id"]
        and (a["request_id"], a["norm"], b["norm"]) in accepted
    }


def test_publish_and_load(spark, trained, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(LookupError):
        registry.load(spark, store)
    example = labelled_pairs(spark, 1, 1.0).select("A", "B")
    assert registry.publish(spark, store, trained, FEW, example) == 1
    worse = replace(trained, metrics=trained.metrics.withColumn("value", F.col("value") / 2))
    assert registry.publish(spark, store, worse, FEW) == 2
    assert registry.latest_version(spark, store) == 2
    assert registry.best_version(spark, store) == 1
    assert registry.metrics(spark, store).count() == 20
    first = registry.manifest(spark, store).filter("version = 1").first()
    of_first = registry.params(spark, store).filter(F.col("run_id") == first["run_id"])
    logged = {r["param"]: r["value"] for r in of_first.collect()}
    scored = registry.smoke_prediction(spark, store, 1).collect()
    assert len(scored) == 1 and scored[0]["decision"] in (True, False)
    assert logged["max_iter"] == "8" and logged["n_rows"] == "2000"
    loaded = registry.load(spark, store)
    assert loaded.threshold == trained.matcher.threshold and loaded.bounds == trained.matcher.bounds
    for ratio in (1.0, 0.0):
        five = labelled_pairs(spark, 5, ratio, seed=11)
        a = run_model(five, "pair_id", trained.matcher).orderBy("pair_id").collect()
        assert run_model(five, "pair_id", loaded).orderBy("pair_id").collect() == a


def test_a_publisher_that_dies_leaves_nothing_in_the_way(spark, trained, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    with monkeypatch.context() as broken:
        broken.setattr(registry, "commit", lambda *_: 1 / 0)  # after the model, before the manifest
        with pytest.raises(ZeroDivisionError):
            registry.publish(spark, store, trained, FEW)
    assert registry.latest_version(spark, store) is None
    os.makedirs(f"{store}/manifest")
    open(f"{store}/manifest/0000000001.json", "x").close()  # another died after it claimed a number
    assert registry.latest_version(spark, store) is None
    assert registry.publish(spark, store, trained, FEW) == 2
    runs = registry.manifest(spark, store).join(registry.metrics(spark, store), "run_id")
    assert runs.count() == 10 and registry.best_version(spark, store) == 2


def test_publishers_at_once_get_different_numbers(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "a store")
    monkeypatch.setattr(registry, "claimed", lambda *_: 0)  # all see an empty manifest
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: registry.commit(spark, store, f"run{i}", f"path{i}"), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    rows = {(r["version"], r["run_id"]) for r in registry.manifest(spark, store).collect()}
    assert rows == {(n, f"run{i}") for i, n in enumerate(numbers)}


def test_a_broken_model_gets_no_number(spark, trained, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    nan = replace(trained, matcher=replace(trained.matcher, pipeline=first_rounds(trained.matcher.pipeline, 3)))
    real = registry._read

    def other(session, path):
        return replace(real(session, path), pipeline=trained.matcher.pipeline)

    with monkeypatch.context() as swapped:
        swapped.setattr(registry, "_read", other)
        with pytest.raises(registry.BrokenModel, match="otherwise"):
            registry.publish(spark, store, nan, FEW)
    with monkeypatch.context() as lost:
        lost.setattr(registry, "_read", lambda *_: 1 / 0)
        with pytest.raises(registry.BrokenModel, match="read back"):
            registry.publish(spark, store, trained, FEW)
    assert registry.latest_version(spark, store) is None and registry.claimed(spark, store) == 0


def test_leaf_boxes_part_the_space_and_score_like_the_model(spark, trained):
    nodes = settle(tree_nodes(spark, trained.matcher.pipeline))
    trees = trained.matcher.pipeline.stages[-1].trees
    assert nodes.count() == sum(t.numNodes for t in trees)
    boxes = leaf_boxes(nodes).collect()
    assert len(boxes) == sum((t.numNodes + 1) // 2 for t in trees)
    pairs = labelled_pairs(spark, 700, 0.5, seed=21)
    scored = settle(run_model(pairs, "pair_id", trained.matcher).withColumnRenamed("proba", "other"))
    for r in scored.limit(20).collect():
        x = [r[f] for f in FEATURES]
        hit = [b for b in boxes if all(b[f"low{i}"] < v <= b[f"high{i}"] for i, v in enumerate(x))]
        assert sorted(b["tree"] for b in hit) == list(range(len(trees)))
    again = score_by_boxes(scored, nodes)
    assert again.columns == [*scored.columns, "proba"]
    assert again.count() == 700 and again.filter(F.abs(F.col("proba") - F.col("other")) > 1e-12).count() == 0
    assert score_by_boxes(scored.limit(0), nodes).count() == 0


def test_first_rounds_are_the_model_of_so_many_rounds(spark):
    rows = train(labelled_pairs(spark, 600, 0.5), replace(FEW, min_precision=0.5))
    features = rows.scored_test.drop("proba", "decision")
    long, short = (fit_boosted(features, "pair_id", BoostParams(max_iter=n, subsampling_rate=0.8)) for n in (6, 4))
    cut = first_rounds(long, 4)
    one, two = (add_probability(features, m).orderBy("pair_id").collect() for m in (cut, short))
    assert one == two and cut.stages[-1].getNumTrees == 4
    losses = prefix_losses(long, features)
    assert len(losses) == 6 and losses[3] == pytest.approx(prefix_losses(short, features)[-1])
    by_hand = [-math.log(r["proba"] if r["match"] else 1 - r["proba"]) for r in one]
    assert losses[3] == pytest.approx(sum(by_hand) / len(by_hand))


def test_published_name_lengths_have_no_drift_against_themselves(spark, trained, tmp_path):
    names = labelled_pairs(spark, 50, 0.5).select(F.col("A").alias("name"))
    registry.publish(spark, str(tmp_path), trained, FEW, names=names)
    histogram = length_histogram(names.withColumn("g", F.lit("all")), "g")
    drift = length_drift(histogram, "g", registry.name_shares(spark, str(tmp_path))).first()
    assert drift["n_names"] == 50 and drift["psi"] == pytest.approx(0.0, abs=1e-12)


def pair_of_names(spark):
    names = [("r", "A", "big room alpha", 1), ("r", "B", "big room beta", 1)]
    return spark.createDataFrame(names, "request_id string, side string, norm string, copies long")


@pytest.mark.parametrize("step", [-1e-6, 0.0, 1e-6])
def test_a_pair_on_the_cosine_cut_is_kept_by_either_box(spark, trained, step):
    names = pair_of_names(spark)
    whole = acceptable_names(names, trained.matcher.idf, Bounds()).first()
    cosine, edits = whole["cosine_similarity"], whole["levenshtein_distance"]
    assert cosine > 0
    for above, below in ((Box(max_levenshtein=0), Box()), (Box(), Box(max_levenshtein=0)), (Box(), Box())):
        bounds = Bounds(cosine + step, above, below)
        got = acceptable_names(names, trained.matcher.idf, bounds)
        lies_above, lies_below = step <= 0, step >= 0
        fits = (lies_above and above.max_levenshtein >= edits) or (lies_below and below.max_levenshtein >= edits)
        assert got.count() == int(fits)
        assert got.filter(~bounds.holds()).count() == 0


def test_bounds_hold_when_a_cut_lies_on_a_value(spark, trained):
    scored = run_model(labelled_pairs(spark, 300, 0.5, seed=5), "pair_id", trained.matcher)
    for cut in [r[0] for r in scored.select("cosine_similarity").distinct().limit(5).collect() if r[0] > 0]:
        names = spark.createDataFrame(
            [("r", s, n, 1) for r in scored.filter(F.col("cosine_similarity") == cut).collect()
             for s, n in (("A", normalized(r["A"])), ("B", normalized(r["B"])))],
            "request_id string, side string, norm string, copies long",
        ).distinct()
        whole = acceptable_names(names, trained.matcher.idf, Bounds()).collect()
        split = acceptable_names(names, trained.matcher.idf, Bounds(cut, Box(), Box())).collect()
        key = lambda r: (r["A_norm"], r["B_norm"])
        assert sorted(map(key, split)) == sorted(map(key, whole))


def test_stream_equals_batch(spark, trained, tmp_path):
    source = tmp_path / "requests"
    source.mkdir()
    (source / "one.json").write_text(json.dumps(SMALL) + "\n" + json.dumps(NULLS) + "\n{broken\n")
    (source / "two.json").write_text(json.dumps({"request_id": "r5", "referenceCatalog": ["huge room"]}))
    batch = match_catalogs(read_requests(spark, str(source)), trained.matcher)
    expected = sorted(map(str, batch.collect()))
    assert len(expected) == 4
    write_replies(batch, str(tmp_path / "batch"))
    schema = "request_id string, part string, positional_mapping string, error string"
    back = spark.read.schema(schema).json(str(tmp_path / "batch"))
    assert sorted(map(str, back.collect())) == expected

    def stream():
        start_matching(
            spark, str(source), str(tmp_path / "replies"), str(tmp_path / "state"), trained.matcher, 1
        ).awaitTermination()
        out = spark.read.schema(schema).json(str(tmp_path / "replies"))
        return sorted(str(r) for r in out.select(*batch.columns).collect())

    assert stream() == expected
    assert stream() == expected  # a restart answers nothing twice
    (source / "three.json").write_text(json.dumps({**SMALL, "request_id": "late"}) + "\n" + json.dumps(SMALL))
    assert len(stream()) == 5  # the line that came before is not answered again


def test_kept_frames_are_released(spark):
    with releasing():
        inner, written = keep(spark.range(3)), settle(spark.range(4))
        assert inner.is_cached and written.count() == 4
        (file,) = {f.rsplit("/", 1)[0].removeprefix("file://") for f in written.inputFiles()}
        assert os.path.isdir(file)
    assert not inner.is_cached and not os.path.exists(file)


def test_a_frame_is_released_alone(spark):
    first, second = settle(spark.range(3)), settle(spark.range(4))
    release(first)
    release(first)  # nothing left to drop
    assert second.count() == 4
    with pytest.raises(Exception, match="NOT_EXIST|does not exist|FAILED_READ"):
        first.count()


def test_tuning_dry_run(spark):
    steps = (("max_depth", (5, 3)), ("subsampling_rate", (1.0, 0.8)))
    pairs = labelled_pairs(spark, 600, 0.5)
    best, trials = best_params(pairs, rounds=4, steps=steps)  # two trials of a step at a time
    assert [t[0] for t in trials] == ["start", "max_depth=3", "subsampling_rate=0.8"]
    _, rounds, loss = min(trials, key=lambda t: t[2])
    assert best["max_iter"] == rounds <= 4 and loss < 0.7
    again = train(pairs, Settings(min_precision=0.5, boost=BoostParams(**best)))
    assert again.matcher.pipeline.stages[-1].getNumTrees == rounds


def test_the_best_rounds_are_kept_although_later_ones_are_worse(spark):
    pairs = labelled_pairs(spark, 600, 0.5)
    settings = Settings(min_precision=0.5, boost=BoostParams(max_iter=30, step_size=1.0))
    stopped = train(pairs, settings, early_stop=True)
    assert len(stopped.matcher.pipeline.stages[-1].trees) < 30


def test_missing_features_are_reported(spark):
    with pytest.raises(ValueError):
        check_features(spark.range(1))


def test_unseen_terms(spark, trained):
    names = spark.createDataFrame([("big ROOM",), ("qwxyz room",)], "name string")
    assert unseen_term_rate(names, trained.matcher.idf).first()[0] == pytest.approx(0.25)


def test_first_trials_run_beside_the_start(spark, monkeypatch):
    """They do not depend on it; the answer and the order of trials are those of running one after another."""
    together = threading.Barrier(3)

    def tried(train, val, params):
        if params.max_depth == 5:
            together.wait(20)
        return {"all": 3, "0.67": 2, "onethird": 4}[params.feature_subset], params.max_depth - len(params.feature_subset)

    monkeypatch.setattr(tuning, "prepare", lambda pairs, settings: Prepared(None, pairs.withColumn("part", F.lit("train"))))
    monkeypatch.setattr(tuning, "trial", tried)
    steps = (("feature_subset", ("all", "0.67", "onethird")), ("max_depth", (3, 5)))
    best, trials = best_params(spark.range(1), rounds=4, steps=steps)
    assert trials == [("start", 3, 2), ("feature_subset=0.67", 2, 1), ("feature_subset=onethird", 4, -3), ("max_depth=3", 4, -5)]
    assert (best["feature_subset"], best["max_depth"], best["max_iter"]) == ("onethird", 3, 4)
