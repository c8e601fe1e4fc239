"""The queries this package registers, each over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nametwin.config import DENSE, FEATURES, Settings
from nametwin.functions.similarity import dense_cosine, jaro_winkler, levenshtein
from nametwin.functions.text import is_valid, normalize, tokens
from nametwin.operators import catalog, mapping, metrics
from nametwin.operators.candidates import Bounds, Box, acceptable_names
from nametwin.operators.dense import vector_table
from nametwin.operators.features import feature_table, normalize_pairs
from nametwin.operators.keep import scratch_folder, settle
from nametwin.operators.split import assign_by_hash, assign_exact, deduplicate
from nametwin.operators.tfidf import document_frequencies, fit_idf, pair_cosine, weigh
from nametwin.plans import monitoring
from nametwin.plans.matching import Matched, Rule, accept, match_catalogs, match_entries
from nametwin.plans.model import Matcher, run_model
from nametwin.plans.training import Trained, quality_gate, train
from nametwin.plans.trees import gain_shares, score_by_boxes, split_counts, tree_nodes
from nametwin.plans.tuning import best_params
from nametwin.sources import registry, tables
from nametwin.sources.requests import parse_requests
from nametwin.sources.synthetic import draw_pairs
from nametwin.streaming.job import start_matching
from nametwin.streaming.labels import accuracy_so_far, start_accuracy

# The fixed rule of the rule_* queries and the bounds it implies.
RULE_COSINE, RULE_WINKLER = 0.8, 0.6
RULE_BOUNDS = Bounds(RULE_COSINE, Box(min_jaro_winkler=RULE_WINKLER))
# A second rule, which also takes near spellings without a common word.
NEAR_EDITS = 3
NEAR_BOUNDS = Bounds(RULE_COSINE, Box(), Box(max_levenshtein=NEAR_EDITS))
# A third, which takes those that Jaro-Winkler finds alike, however many the edits.
ALIKE_WINKLER = 0.78
ALIKE_BOUNDS = Bounds(RULE_COSINE, Box(), Box(min_jaro_winkler=ALIKE_WINKLER))
SETTINGS = Settings()
# What makes small tables take the ways of large ones.
SMALL_TILE, SMALL_RANGE = 50, 100
LABEL_FILES = 4  # of each stream of the late labels, read one at a time


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


# --- text ------------------------------------------------------------------


def normalize_names(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("name")
    )
    customers = tables.table(spark, folder, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    norm = normalize(F.col("name"))
    return tables.spread(docs.unionAll(customers)).select(
        "source",
        "id",
        F.md5(norm.cast("binary")).alias("norm_md5"),
        F.length(norm).cast("long").alias("norm_length"),
    )


def valid_names(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.explode(F.array(F.col("p_size").cast("string"), F.col("p_name"))).alias("name"),
    )
    docs = tables.table(spark, folder, "documents").select("doc_id", "text")
    return (
        parts.unionAll(docs)
        .groupBy(is_valid(F.col("name")).alias("valid"))
        .agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))
    )


def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, folder, "documents").select("text"))
    words = docs.select(F.explode(tokens(normalize(F.col("text")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


# --- catalogs and pairs ----------------------------------------------------


def usable_entries(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.usable(tables.part_entries(spark, folder))


def distinct_catalog_names(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.distinct_names(usable_entries(spark, folder))


def pair_counts_by_request(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.pair_counts(tables.part_entries(spark, folder))


def dedupe_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicate(tables.part_pairs(spark, folder)).select("A", "B", "match")


# --- features --------------------------------------------------------------


def _both_norms(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_pairs(tables.text_pairs(spark, folder))


def tfidf_idf(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _both_norms(spark, folder)
    counted = document_frequencies(pairs, F.col("A_norm"), F.col("B_norm"))
    return _rounded(weigh(counted, F.lit(float(2 * pairs.count()))), "idf")


def _settled_norms(pairs: DataFrame) -> DataFrame:
    """Cleaned names, which fitting reads twice and the features once more, made once."""
    return settle(normalize_pairs(pairs).select("pair_id", "A_norm", "B_norm"))


def tfidf_cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _settled_norms(tables.text_pairs(spark, folder))
    idf = fit_idf(pairs, F.col("A_norm"), F.col("B_norm"))
    return _rounded(pair_cosine(pairs, "pair_id", idf), "cosine_similarity")


def tfidf_cosine_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the weights joined by shuffle, as tables too large to broadcast are."""
    pairs = _settled_norms(tables.text_pairs(spark, folder))
    idf = fit_idf(pairs, F.col("A_norm"), F.col("B_norm"), broadcast_bytes=0)
    return _rounded(pair_cosine(pairs, "pair_id", idf), "cosine_similarity")


def levenshtein_pairs(spark: SparkSession, folder: str) -> DataFrame:
    distance = levenshtein(F.col("A_norm"), F.col("B_norm")).cast("long")
    return _both_norms(spark, folder).select("pair_id", distance.alias("levenshtein_distance"))


def jaro_winkler_pairs(spark: SparkSession, folder: str) -> DataFrame:
    similarity = jaro_winkler("A_norm", "B_norm").alias("jaro_winkler_similarity")
    pairs = _both_norms(spark, folder).select("pair_id", similarity)
    return _rounded(pairs, "jaro_winkler_similarity")


def embedding_cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    vectors = tables.table(spark, folder, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    cosine = dense_cosine(F.col("embedding"), F.col("next")).alias("cosine")
    return _rounded(vectors.join(following, "vec_id").select("vec_id", cosine), "cosine")


def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    pairs = tables.text_pairs(spark, folder)
    idf = fit_idf(_settled_norms(pairs), F.col("A_norm"), F.col("B_norm"))
    table = feature_table(pairs, "pair_id", idf, texts=False).withColumn(
        "levenshtein_distance", F.col("levenshtein_distance").cast("long")
    )
    return _rounded(table, "cosine_similarity", "jaro_winkler_similarity")


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _letter_vectors(names: DataFrame) -> DataFrame:
    """Vectors for a column `name`: how often it has each letter and digit."""
    norm = F.col("norm")
    counts = [F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit(""))) for c in LETTERS]
    cleaned = names.select("name").distinct().withColumn("norm", normalize(F.col("name")))
    # written out, as what asks whether vectors are fine would count all letters again
    return vector_table(settle(cleaned.select("name", F.array(*counts).alias("vector"))))


def dense_feature_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The feature of given vectors, here letter counts, among the others."""
    pairs = tables.text_pairs(spark, folder)
    vectors = _letter_vectors(pairs.select(F.explode(F.array("A", "B")).alias("name")))
    idf = fit_idf(_settled_norms(pairs), F.col("A_norm"), F.col("B_norm"))
    found = feature_table(pairs, "pair_id", idf, texts=False, vectors=vectors)
    return _rounded(found.select("pair_id", DENSE), DENSE)


# --- rule matching ---------------------------------------------------------


def _rule(entries: DataFrame, near: bool = False, **options) -> Rule:
    """The fixed rule with weights of the entries themselves."""
    idf = fit_idf(settle(entries.select(normalize(F.col("name")).alias("norm"))), F.col("norm"), **options)
    similar = (F.col("cosine_similarity") >= RULE_COSINE) & (
        F.col("jaro_winkler_similarity") >= RULE_WINKLER
    )
    if near:
        return Rule(idf, NEAR_BOUNDS, similar | (F.col("levenshtein_distance") <= NEAR_EDITS))
    return Rule(idf, RULE_BOUNDS, similar)


def _rule_matched(spark: SparkSession, folder: str) -> Matched:
    entries = tables.part_entries(spark, folder)
    return match_entries(entries, _rule(entries))


def rule_name_pairs(spark: SparkSession, folder: str) -> DataFrame:
    accepted = _rule_matched(spark, folder).accepted
    wanted = accepted.select(
        "request_id",
        "A_norm",
        "B_norm",
        "cosine_similarity",
        F.col("levenshtein_distance").cast("long").alias("levenshtein_distance"),
        "jaro_winkler_similarity",
    )
    return _rounded(wanted, "cosine_similarity", "jaro_winkler_similarity")


def rule_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Positions as text, so engines agree on how a list compares."""
    return _listed(_rule_matched(spark, folder).mapping())


def _listed(found: DataFrame) -> DataFrame:
    return found.select("request_id", "A_pos", "B_tile", F.array_join("B_pos", ",").alias("B_positions"))


def rule_mapping_tiled(spark: SparkSession, folder: str) -> DataFrame:
    """The same with keys cut into small tiles and weights joined by shuffle."""
    entries = tables.part_entries(spark, folder)
    matched = match_entries(entries, _rule(entries, broadcast_bytes=0), SMALL_TILE)
    return _listed(matched.mapping(SMALL_TILE))


def near_name_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A rule that also takes pairs without a common word, if few edits apart."""
    entries = tables.part_entries(spark, folder)
    accepted = match_entries(entries, _rule(entries, near=True)).accepted
    return accepted.select(
        "request_id", "A_norm", "B_norm", F.col("levenshtein_distance").cast("long").alias("levenshtein_distance")
    )


def similar_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """A rule that also takes pairs without a common word, if Jaro-Winkler finds them alike."""
    entries = tables.part_entries(spark, folder)
    rule = _rule(entries)
    alike = F.col("jaro_winkler_similarity") >= ALIKE_WINKLER
    either = Rule(rule.idf, ALIKE_BOUNDS, rule.condition | alike)
    accepted = match_entries(entries, either).accepted
    found = accepted.select("request_id", "A_norm", "B_norm", "jaro_winkler_similarity")
    return _rounded(found, "jaro_winkler_similarity")


def rule_match_counts(spark: SparkSession, folder: str) -> DataFrame:
    matched = _rule_matched(spark, folder)
    return mapping.match_counts(matched.names, matched.accepted)


def mapping_json(spark: SparkSession, folder: str) -> DataFrame:
    entries = tables.part_entries(spark, folder)
    requests = entries.select("request_id", F.lit(None).cast("string").alias("error")).distinct()
    return mapping.replies(requests, _rule_matched(spark, folder).mapping())


# --- requests --------------------------------------------------------------


def request_entries(spark: SparkSession, folder: str) -> DataFrame:
    """JSON round trip of conversation requests, down to catalog entries."""
    requests = parse_requests(tables.conversation_requests(spark, folder))
    entries = catalog.explode_requests(
        requests.select(F.col("request_name").alias("request_id"), "referenceCatalog", "inputCatalog")
    )
    return catalog.usable(entries).withColumn("pos", F.col("pos").cast("long"))


def request_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Good requests, prose instead of JSON, and requests that lack a catalog."""
    docs = tables.table(spark, folder, "documents")
    lines = (
        tables.conversation_requests(spark, folder)
        .unionAll(docs.select(F.col("text").alias("value")))
        .unionAll(docs.select(F.to_json(F.struct(F.array("lang").alias("referenceCatalog"))).alias("value")))
    )
    counted = parse_requests(lines).groupBy(F.coalesce("error", F.lit("none")).alias("error"))
    return counted.agg(F.count("*").alias("n"))


# --- split and generator ---------------------------------------------------


def split_assign(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.table(spark, folder, "orders").select("o_orderkey")
    return assign_by_hash(orders, F.col("o_orderkey").cast("string"), 0.6, 0.3, 42)


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.table(spark, folder, "orders").select("o_orderkey")
    parted = assign_exact(orders, F.col("o_orderkey").cast("string"), 0.6, 0.3, 42)
    return parted.groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def _generated(spark: SparkSession, folder: str, accents: bool = False) -> DataFrame:
    ids = tables.table(spark, folder, "orders").select(F.col("o_orderkey").alias("pair_id"))
    return draw_pairs(tables.spread(ids), 0.5, accents=accents)


def synthetic_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _generated(spark, folder)


def synthetic_accented(spark: SparkSession, folder: str) -> DataFrame:
    """How many descriptions the accent option changes."""
    accented = _generated(spark, folder, accents=True)
    changed = F.count_if(F.col("A") != F.regexp_replace("A", "[áéíóúñçÁÉÍÓÚÑÇ]", ""))
    return accented.groupBy("match").agg(F.count("*").alias("n"), changed.alias("n_accented"))


def synthetic_match_rate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.match_rate(_generated(spark, folder)), "match_rate")


# --- metrics ---------------------------------------------------------------

METRIC_THRESHOLD = 0.5


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    scored = tables.scored_documents(spark, folder)
    return scored.withColumn("decision", metrics.take_decision(F.col("proba"), METRIC_THRESHOLD))


def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.confusion_metrics(_decided(spark, folder))
    return _rounded(found, *found.columns)


def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    curve = metrics.running_counts(tables.scored_documents(spark, folder))
    return _rounded(metrics.average_precision(curve), "average_precision_score")


def average_precision_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The same over many score ranges."""
    curve = metrics.running_counts(tables.scored_documents(spark, folder), SMALL_RANGE)
    return _rounded(metrics.average_precision(curve), "average_precision_score")


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    curve = metrics.running_counts(tables.scored_documents(spark, folder))
    return _rounded(metrics.roc_auc(curve), "roc_auc_score")


def score_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    curve = metrics.running_counts(tables.scored_documents(spark, folder))
    return _rounded(metrics.score_quantiles(curve), "value")


def precision_by_threshold(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.threshold_table(tables.scored_documents(spark, folder))
    return _rounded(found, "threshold", "precision")


def min_precision_threshold(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.min_precision_threshold(tables.scored_documents(spark, folder), 0.7)
    return _rounded(found, "threshold")


def evaluation_report(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.evaluate(_decided(spark, folder), 0.98), "value")


def tp_examples(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.examples(_decided(spark, folder), True, "doc_id")


def tn_examples(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.examples(_decided(spark, folder), False, "doc_id")


def sample_matching(spark: SparkSession, folder: str) -> DataFrame:
    scored = tables.scored_documents(spark, folder)
    return metrics.sample_by_label(scored, True, "doc_id").select("doc_id", "A", "B")


def sample_nonmatching(spark: SparkSession, folder: str) -> DataFrame:
    scored = tables.scored_documents(spark, folder)
    return metrics.sample_by_label(scored, False, "doc_id").select("doc_id", "A", "B")


# --- monitoring ------------------------------------------------------------


def name_drift(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.table(spark, folder, "documents").select("source", F.col("text").alias("name"))
    histogram = monitoring.length_histogram(docs, "source")
    found = monitoring.length_drift(histogram, "source", monitoring.overall_shares(histogram))
    return _rounded(found, "psi")


def unseen_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the conversations that the documents never use."""
    docs = tables.table(spark, folder, "documents").select(normalize(F.col("text")).alias("norm"))
    talk = tables.table(spark, folder, "conversations").select(F.col("text").alias("name"))
    found = monitoring.unseen_term_rate(talk, fit_idf(docs, F.col("norm")))
    return _rounded(found, "unseen_rate")


def unseen_term_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the conversations that the documents never use, beside known words one edit away."""
    docs = tables.table(spark, folder, "documents").select(normalize(F.col("text")).alias("norm"))
    talk = tables.table(spark, folder, "conversations").select(F.col("text").alias("name"))
    return monitoring.unseen_spellings(talk, fit_idf(docs, F.col("norm")))


def accuracy_by_day(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.table(spark, folder, "orders")
    scored = orders.select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("day"),
        (F.col("o_totalprice") >= 200000.0).alias("decision"),
    )
    labels = orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("match"))
    found = monitoring.accuracy_by_day(scored, labels, "o_orderkey")
    return _rounded(found, "accuracy_score", "precision_score", "recall_score")


def late_label_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """The same from two streams of files, rows out of order, labels up to 59 days late."""
    work = scratch_folder(spark)
    orders = tables.table(spark, folder, "orders").withColumn("place", F.xxhash64("o_orderkey"))
    at = F.col("o_orderdate").cast("timestamp")
    late = F.make_interval(days=F.pmod("place", F.lit(60)).cast("int"))
    scored = orders.select("o_orderkey", at.alias("at"), (F.col("o_totalprice") >= 200000.0).alias("decision"), "place")
    labels = orders.select(
        "o_orderkey", (at + late).alias("at"), (F.col("o_orderstatus") == "F").alias("match"), F.reverse(F.col("place").cast("string")).alias("place")
    )
    streams = []
    for name, rows in (("scored", scored), ("labels", labels)):
        shuffled = rows.repartition(LABEL_FILES, "place").sortWithinPartitions("place").drop("place")
        shuffled.write.parquet(f"{work}/{name}")
        streams.append(spark.readStream.schema(shuffled.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/{name}"))
    span = orders.agg(F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")) + 60).first()[0] or 1  # nothing is too late here
    query = start_accuracy(
        *streams, "o_orderkey", "60 days", f"{span} days", f"{work}/counts", f"{work}/state"
    )
    query.awaitTermination()
    return _rounded(accuracy_so_far(spark, f"{work}/counts"), "accuracy_score", "precision_score", "recall_score")


def unseen_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct words of the conversations, those the documents never use, and whether sketches say so too."""
    docs = tables.table(spark, folder, "documents").select(normalize(F.col("text")).alias("norm"))
    talk = tables.table(spark, folder, "conversations").select(F.col("text").alias("name"))
    known = fit_idf(docs, F.col("norm")).terms
    sketched = monitoring.unseen_vocabulary(talk, monitoring.vocabulary_sketch(known))
    words = talk.select(F.explode(tokens(normalize(F.col("name")))).alias("term")).distinct()
    exact = words.join(known, "term", "left").agg(
        F.count("*").alias("n"), F.count_if(F.col("idf").isNull()).alias("n_new")
    )
    close = F.abs(F.col("n_new") - F.col("n_unseen")) <= F.col("error")
    return exact.join(sketched).select("n", "n_new", close.alias("sketch_agrees"))  # one row each


# --- model -----------------------------------------------------------------

_trained: dict[tuple[str, str], Trained] = {}


def _part_model(spark: SparkSession, folder: str) -> Trained:
    """Trained once per session and folder; the model queries share it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _trained:
        _trained[key] = train(tables.part_pairs(spark, folder), SETTINGS)
    return _trained[key]


def train_and_score(spark: SparkSession, folder: str) -> DataFrame:
    pairs = deduplicate(tables.part_pairs(spark, folder))
    return run_model(pairs, "pair_id", _part_model(spark, folder).matcher)


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    return split_counts(spark, _part_model(spark, folder).matcher.pipeline)


def scores_by_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with the features the model sees, and whether its leaf boxes score them as the model does."""
    matcher = _part_model(spark, folder).matcher
    pairs = deduplicate(tables.part_pairs(spark, folder))
    scored = settle(run_model(pairs, "pair_id", matcher).withColumnRenamed("proba", "by_model"))
    both = score_by_boxes(scored, tree_nodes(spark, matcher.pipeline))
    close = F.abs(F.col("proba") - F.col("by_model")) < 1e-9
    decided = (F.col("proba") >= matcher.threshold) == F.col("decision")
    on_edge = F.abs(F.col("proba") - matcher.threshold) < 1e-9
    found = both.select(
        "A", "B", "match", "cosine_similarity", F.col("levenshtein_distance").cast("long").alias("levenshtein_distance"),
        "jaro_winkler_similarity", (close & (decided | on_edge)).alias("agrees"),
    )
    return _rounded(found, "cosine_similarity", "jaro_winkler_similarity")


def importance_by_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the saved nodes add up to the importances that Spark reports, feature by feature."""
    pipeline = _part_model(spark, folder).matcher.pipeline
    reported = [(f, float(v)) for f, v in zip(FEATURES, pipeline.stages[-1].featureImportances.toArray(), strict=True)]
    other = spark.createDataFrame(reported, "feature string, reported double")
    nodes = tree_nodes(spark, pipeline)
    inner = nodes.agg(F.count_if(F.col("left").isNotNull()).alias("n_inner"), F.count_if(F.col("left").isNull()).alias("n_leaves"))
    counted = split_counts(spark, pipeline).agg(F.sum("importance").alias("n_counted"))
    whole = inner.join(counted).select(  # one row each
        ((F.col("n_counted") == F.col("n_inner")) & (F.col("n_leaves") == F.col("n_inner") + pipeline.stages[-1].getNumTrees)).alias("splits_agree")
    )
    same = F.abs(F.col("share") - F.col("reported")) < 1e-9
    return gain_shares(spark, pipeline).join(other, "feature").join(whole).select("feature", same.alias("gain_agrees"), "splits_agree")


def stream_equals_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of the model, and those that the stream and the batch do not give alike."""
    columns = ["request_id", "part", "positional_mapping", "error"]
    one, two = (settle(q(spark, folder).select(columns)) for q in (reply_by_model, stream_match))
    different = one.exceptAll(two).unionByName(two.exceptAll(one)).agg(F.count("*").alias("n_different"))
    return one.agg(F.count_distinct("request_id").alias("n_requests")).join(different)


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    trained = _part_model(spark, folder)
    quality_gate(trained.metrics)
    return trained.metrics


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Publish, reload and score again: pairs, and those scored otherwise than in memory."""
    store = scratch_folder(spark)
    trained = _part_model(spark, folder)
    pairs = settle(deduplicate(tables.part_pairs(spark, folder)))
    version = registry.publish(spark, store, trained, SETTINGS, pairs.select("A", "B"))
    here = run_model(pairs, "pair_id", trained.matcher).select("pair_id", "proba", "decision")
    there = run_model(pairs, "pair_id", registry.load(spark, store, version)).select(
        "pair_id", F.col("proba").alias("proba_loaded"), F.col("decision").alias("decision_loaded")
    )
    same = (F.col("proba") == F.col("proba_loaded")) & (F.col("decision") == F.col("decision_loaded"))
    counted = here.join(there, "pair_id", "full").agg(
        F.count("*").alias("n_pairs"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_different")
    )
    return counted.withColumn("version", F.lit(version).cast("long"))


def smoke_before_publishing(spark: SparkSession, folder: str) -> DataFrame:
    """Matching and other pairs scored by a published model read back, and its number."""
    store = scratch_folder(spark)
    version = registry.publish(spark, store, _part_model(spark, folder), SETTINGS)
    scored = run_model(registry.smoke_pairs(spark), "pair_id", registry.load(spark, store, version))
    fine = F.col("proba").between(0, 1) & F.col("decision").isNotNull()
    counted = scored.groupBy("match").agg(F.count("*").alias("n"), F.count_if(fine).alias("n_fine"))
    return counted.withColumn("version", F.lit(version).cast("long"))


def drift_from_training(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of customer names against those of the names a published model has seen."""
    store = scratch_folder(spark)
    names = tables.part_entries(spark, folder).select("name")
    registry.publish(spark, store, _part_model(spark, folder), SETTINGS, names=names)
    customers = tables.table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name")
    )
    histogram = monitoring.length_histogram(customers, "segment")
    return _rounded(monitoring.length_drift(histogram, "segment", registry.name_shares(spark, store)), "psi")


def published_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Two different models read back from the store, the better one marked."""
    store = scratch_folder(spark)
    shallow = replace(SETTINGS, boost=replace(SETTINGS.boost, max_depth=1))
    registry.publish(spark, store, _part_model(spark, folder), SETTINGS)
    registry.publish(spark, store, train(tables.part_pairs(spark, folder), shallow), shallow)
    best = registry.best_version(spark, store)
    runs = registry.manifest(spark, store).join(registry.metrics(spark, store), "run_id")
    return runs.select("version", (F.col("version") == best).alias("is_best"), "metric", "value")


def tuning_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Every step of the search: setting, its best number of rounds, and validation log loss with them."""
    _, trials = best_params(tables.part_pairs(spark, folder), SETTINGS)
    return spark.createDataFrame(trials, "setting string, rounds long, log_loss double")


def model_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted pairs outside the box the trees imply; there must be none."""
    matcher = _part_model(spark, folder).matcher
    scored = run_model(deduplicate(tables.part_pairs(spark, folder)), "pair_id", matcher)
    return scored.filter("decision").agg(
        F.count("*").alias("n_accepted"),
        F.count_if(~matcher.bounds.holds()).alias("n_outside"),
    )


def match_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: every brand's two catalogs matched by the trained model."""
    matcher = _part_model(spark, folder).matcher
    return match_entries(tables.part_entries(spark, folder), matcher).mapping()


def reply_by_model(spark: SparkSession, folder: str) -> DataFrame:
    requests = parse_requests(tables.conversation_requests(spark, folder))
    return match_catalogs(requests, _part_model(spark, folder).matcher)


def matching_equals_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Name pairs of all requests, and those the index decides otherwise than scoring every pair."""
    return _against_scoring(spark, folder, _part_model(spark, folder).matcher)


def dense_matching_equals_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a model of four features, one of them that of given vectors."""
    vectors = _letter_vectors(tables.part_entries(spark, folder))
    matcher = train(tables.part_pairs(spark, folder), SETTINGS, vectors=vectors).matcher
    return _against_scoring(spark, folder, matcher)


def _against_scoring(spark: SparkSession, folder: str, matcher: Matcher) -> DataFrame:
    matched = match_entries(tables.part_entries(spark, folder), matcher)
    names = settle(matched.names)
    # counting builds the pairs once more without their features, which is less than writing them with all
    every = acceptable_names(names, matcher.idf, Bounds(), vectors=matcher.vectors)
    key = ["request_id", "A_norm", "B_norm"]
    one = matched.accepted.select(*key, F.lit(True).alias("indexed"))
    two = accept(every, matcher).select(*key, F.lit(True).alias("scored"))
    different = one.join(two, key, "full").agg(
        F.count_if(F.col("indexed").isNull() | F.col("scored").isNull()).alias("n_different")
    )
    return every.agg(F.count("*").alias("n_pairs")).join(different)


def _conversation_rule(spark: SparkSession, folder: str) -> Rule:
    requests = parse_requests(tables.conversation_requests(spark, folder))
    return _rule(catalog.explode_requests(requests.filter(F.col("error").isNull())))


def _named(found: DataFrame) -> DataFrame:
    """Replies under the id that was sent, without the digest."""
    sent = F.substring_index("request_id", ":", 1).alias("request_id")
    return found.select(sent, "part", "positional_mapping", "error")


def reply_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Replies to all conversation requests, empty catalogs among them."""
    requests = parse_requests(tables.conversation_requests(spark, folder))
    return _named(match_catalogs(requests, _conversation_rule(spark, folder)))


def stream_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    return _named(_streamed(spark, folder, _conversation_rule(spark, folder)))


def stream_match(spark: SparkSession, folder: str) -> DataFrame:
    """The replies of the model from a stream over request files."""
    return _streamed(spark, folder, _part_model(spark, folder).matcher)


def _streamed(spark: SparkSession, folder: str, matcher) -> DataFrame:
    work = scratch_folder(spark)
    tables.conversation_requests(spark, folder).write.text(f"{work}/requests")
    query = start_matching(spark, f"{work}/requests", f"{work}/replies", f"{work}/state", matcher)
    query.awaitTermination()
    schema = "request_id string, part string, positional_mapping string, error string"
    return spark.read.schema(schema).json(f"{work}/replies").select(
        "request_id", "part", "positional_mapping", "error"
    )


QUERIES = {
    f.__name__: f
    for f in (
        normalize_names, valid_names, tokenize_counts,
        usable_entries, distinct_catalog_names, pair_counts_by_request, dedupe_pairs,
        tfidf_idf, tfidf_cosine_pairs, tfidf_cosine_shuffled, levenshtein_pairs, jaro_winkler_pairs,
        embedding_cosine_pairs, feature_rows, dense_feature_pairs,
        rule_name_pairs, rule_mapping, rule_match_counts, mapping_json,
        rule_mapping_tiled, near_name_pairs, similar_spellings,
        request_entries, request_errors,
        split_assign, split_sizes, synthetic_pairs, synthetic_accented, synthetic_match_rate,
        confusion_metrics, average_precision, average_precision_ranges, roc_auc, score_quantiles,
        precision_by_threshold, min_precision_threshold, evaluation_report,
        tp_examples, tn_examples, sample_matching, sample_nonmatching,
        name_drift, unseen_terms, unseen_term_spellings, unseen_vocabulary, accuracy_by_day, late_label_accuracy,
        train_and_score, scores_by_boxes, feature_importance, importance_by_gain, quality_report, model_roundtrip,
        smoke_before_publishing, published_metrics, model_bounds,
        match_by_model, matching_equals_scoring, dense_matching_equals_scoring, reply_by_model, reply_by_rule, stream_match, stream_by_rule,
        stream_equals_batch, drift_from_training, tuning_trials,
    )
}
