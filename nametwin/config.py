"""Settings, with the defaults the matcher is specified with."""

from __future__ import annotations

from dataclasses import dataclass, field

# Feature names and their order in the model vector.
FEATURES = (
    "cosine_similarity",
    "levenshtein_distance",
    "jaro_winkler_similarity",
)
DENSE = "embedding_cosine_similarity"  # the fourth feature, where names have vectors
TARGET = "match"
PROBA = "proba"
DECISION = "decision"

# Session settings that suit matching: its stages cost much CPU per byte, so small
# shuffles must not be merged down to a task or two.
SPARK_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


@dataclass(frozen=True)
class BoostParams:
    """Gradient-boosted tree settings; depth 5 gives at most 32 leaves per tree."""

    max_iter: int = 100
    step_size: float = 0.1
    max_depth: int = 5
    max_bins: int = 255
    min_instances_per_node: int = 20
    subsampling_rate: float = 1.0
    feature_subset: str = "all"
    seed: int = 7


@dataclass(frozen=True)
class Settings:
    seed: int = 7
    split_seed: int = 42
    train_fraction: float = 0.6
    val_fraction: float = 0.3
    min_precision: float = 0.8
    min_average_precision: float = 0.98
    n_rows: int = 2000
    match_ratio: float = 0.5
    boost: BoostParams = field(default_factory=BoostParams)
