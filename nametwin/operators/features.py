"""The features of a pair, in the order the model expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nametwin.config import DENSE, FEATURES
from nametwin.functions.similarity import jaro_winkler, levenshtein
from nametwin.functions.text import normalize
from nametwin.operators.dense import with_dense
from nametwin.operators.tfidf import Idf, pair_features


def normalize_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"A_norm": normalize(F.col("A")), "B_norm": normalize(F.col("B"))})


def features_of(table: DataFrame) -> tuple[str, ...]:
    """Three features, or four where there is that of the vectors."""
    return (*FEATURES, DENSE) if DENSE in table.columns else FEATURES


def feature_table(
    pairs: DataFrame, key: str, idf: Idf, texts: bool = True, vectors: DataFrame | None = None
) -> DataFrame:
    """Input columns plus the three features, and a fourth with `vectors`; `key` identifies a pair.

    Null names count as "". The frame comes back whole: a pair without common
    terms has cosine 0. Without `texts`, A and B stay behind and are not shuffled
    except as words. Both distances are taken where the pair is read.
    """
    kept = [c for c in pairs.columns if c != key and (texts or c not in ("A", "B"))]
    carry = {c: F.col(c) for c in kept} | {
        "levenshtein_distance": levenshtein(F.col("A_norm"), F.col("B_norm")),
        "jaro_winkler_similarity": jaro_winkler("A_norm", "B_norm"),
    }
    ready = normalize_pairs(pairs)
    if vectors is not None:
        ready = with_dense(ready, vectors, key)
        carry |= {DENSE: F.col(DENSE)}
    found = pair_features(ready, key, idf, carry)
    columns = [c for c in pairs.columns if c == key or c in kept]
    table = found.select(*columns, *features_of(found))
    check_features(table)
    return table


def check_features(table: DataFrame) -> None:
    missing = [f for f in FEATURES if f not in table.columns]
    if missing:
        raise ValueError(f"missing features {missing} in {table.columns}")
