"""State that stays bounded, late labels, vocabulary sketches."""

from __future__ import annotations

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nametwin.operators.candidates import Bounds, Box
from nametwin.operators.metrics import confusion_columns
from nametwin.operators.tfidf import fit_idf
from nametwin.plans.matching import Rule
from nametwin.plans.monitoring import unseen_vocabulary, vocabulary_sketch
from nametwin.streaming.job import start_matching
from nametwin.streaming.labels import accuracy_so_far, start_accuracy

START = datetime(2024, 3, 1)


def write(spark, folder, rows, schema):
    """One more file of a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


class Labels:
    scored = "k long, at timestamp, decision boolean"
    labels = "k long, at timestamp, match boolean"

    def __init__(self, spark, work):
        self.spark, self.work = spark, str(work)

    def add(self, name, rows):
        shown = [(k, START + timedelta(days=day), value) for k, day, value in rows]
        write(self.spark, f"{self.work}/{name}", shown, getattr(self, name))

    def run(self, delay="1 day"):
        streams = [
            self.spark.readStream.schema(getattr(self, n)).option("maxFilesPerTrigger", 1).parquet(f"{self.work}/{n}")
            for n in ("scored", "labels")
        ]
        query = start_accuracy(*streams, "k", "10 days", delay, f"{self.work}/counts", f"{self.work}/state")
        query.awaitTermination()
        return query

    def days(self):
        rows = accuracy_so_far(self.spark, f"{self.work}/counts").collect()
        return {(r["day"] - START.date()).days: round(r["accuracy_score"], 6) for r in rows}


def test_a_day_is_updated_by_labels_that_come_later(spark, tmp_path):
    work = Labels(spark, tmp_path)
    work.add("scored", [(1, 0, True), (2, 0, False), (3, 1, True)])
    work.add("labels", [(1, 2, True)])
    work.run()
    assert work.days() == {0: 1.0}
    work.add("labels", [(3, 4, False), (2, 4, True), (9, 4, True)])
    work.run()
    assert work.days() == {0: 0.5, 1: 0.0}
    work.run()  # nothing new counts nothing twice
    assert work.days() == {0: 0.5, 1: 0.0}


def test_labels_before_their_decisions_and_too_late(spark, tmp_path):
    work = Labels(spark, tmp_path)
    work.add("labels", [(1, 3, True), (2, 3, True), (3, 30, True)])
    work.add("scored", [(1, 1, True), (2, 5, True), (3, 2, True)])
    work.run("100 days")
    assert work.days() == {1: 1.0}  # 2 was labelled before it was decided, 3 after the ten days


def test_state_of_the_labels_does_not_grow_with_time(spark, tmp_path):
    work, sizes = Labels(spark, tmp_path), []
    for day in range(0, 120, 20):
        work.add("scored", [(day * 10 + i, day, True) for i in range(20)])
        work.add("labels", [(day * 10 + i, day + 2, i % 2 == 0) for i in range(20)])
        progress = work.run().recentProgress
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]][-1])
    assert work.days() == {day: 0.5 for day in range(0, 120, 20)}
    assert max(sizes[2:]) <= 80  # of 240 rows


def test_stream_and_batch_scores_are_the_same_columns(spark, tmp_path):
    work = Labels(spark, tmp_path)
    rows = [(i, i % 3, i % 2 == 0, i % 5 < 2) for i in range(60)]
    work.add("scored", [(k, d, s) for k, d, s, _ in rows])
    work.add("labels", [(k, d + 1, m) for k, d, _, m in rows])
    work.run()
    batch = spark.createDataFrame(rows, "k long, d long, decision boolean, match boolean")
    want = {r["d"]: tuple(r)[1:] for r in batch.groupBy("d").agg(*confusion_columns()).collect()}
    found = accuracy_so_far(spark, f"{work.work}/counts").collect()
    assert {(r["day"] - START.date()).days: tuple(r)[1:] for r in found} == want


def test_answered_requests_are_remembered_for_a_time(spark, tmp_path):
    names = spark.createDataFrame([("big room",)], "norm string")
    rule = Rule(fit_idf(names, F.col("norm")), Bounds(0.5, Box()), F.lit(True))
    source = tmp_path / "requests"
    source.mkdir()

    def send(file, *ids):
        bodies = [{"request_id": i, "referenceCatalog": ["big room"], "inputCatalog": ["big room"]} for i in ids]
        (source / file).write_text("\n".join(map(json.dumps, bodies)))
        query = start_matching(
            spark, str(source), str(tmp_path / "replies"), str(tmp_path / "state"), rule, remember="4 seconds"
        )
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]

    sizes = []
    for i in range(4):
        sizes.append(send(f"{i}.json", *[f"r{i}-{j}" for j in range(10)]))
        time.sleep(5)
    send("repeat.json", "r0-0")  # long forgotten: answered anew, as documented
    replies = spark.read.json(str(tmp_path / "replies"))
    assert replies.filter("request_id LIKE 'r0-0:%'").count() == 2 and replies.count() == 41
    assert max(sizes) <= 20  # of 40 requests


@pytest.mark.parametrize(("n", "new"), [(50, 7), (60_000, 9_000), (0, 0)])
def test_unseen_words_by_sketches(spark, n, new):
    known = spark.range(max(n - new, 0)).select(F.concat(F.lit("word"), "id").alias("term"))
    names = spark.range(n).select(F.concat(F.lit("Word"), "id").alias("name"))
    halves = known.filter("hash(term) % 2 = 0"), known.filter("hash(term) % 2 <> 0")
    one, two = (vocabulary_sketch(h) for h in halves)
    merged = one.join(two.withColumnRenamed("sketch", "other")).select(F.theta_union("sketch", "other").alias("sketch"))
    for sketch in (vocabulary_sketch(known), merged):
        row = unseen_vocabulary(names, sketch).first()
        assert abs(row["n_unseen"] - new) <= row["error"] and abs(row["n_terms"] - n) <= 0.04 * n
        assert n < 1000 or 1 < row["error"] < n / 10
