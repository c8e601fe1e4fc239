"""Catalogs in, mapping out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nametwin.config import DECISION, PROBA
from nametwin.operators.candidates import Bounds, acceptable_names
from nametwin.operators.catalog import distinct_names, explode_requests, usable
from nametwin.operators.keep import settle
from nametwin.operators.mapping import positional_mapping, replies
from nametwin.operators.metrics import take_decision
from nametwin.operators.tfidf import Idf
from nametwin.operators.tiling import TILE_ROWS
from nametwin.plans.model import Matcher, add_probability


@dataclass(frozen=True)
class Matched:
    usable: DataFrame  # request_id, side, pos, norm
    names: DataFrame  # request_id, side, norm, copies
    accepted: DataFrame  # request_id, A_norm, B_norm, features and score

    def mapping(self, tile_rows: int = TILE_ROWS) -> DataFrame:
        return positional_mapping(self.usable, self.accepted, tile_rows)


@dataclass(frozen=True)
class Rule:
    """A fixed rule on the features; `bounds` must hold for whatever it accepts."""

    idf: Idf
    bounds: Bounds
    condition: Column
    vectors: DataFrame | None = None  # (norm, vector), where the rule asks for their similarity

    def accept(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn(DECISION, self.condition).filter(DECISION)


def match_entries(entries: DataFrame, matcher: Matcher | Rule, tile_rows: int = TILE_ROWS) -> Matched:
    """Match the two sides of every request with the trained model, or with a rule.

    Features depend on the two normalized names only, so each distinct pair of
    a request is scored once, however many positions carry the names.
    """
    ready = settle(usable(entries))
    names = distinct_names(ready)
    pairs = acceptable_names(names, matcher.idf, matcher.bounds, tile_rows, matcher.vectors)
    return Matched(ready, names, accept(pairs, matcher))


def accept(pairs: DataFrame, matcher: Matcher | Rule) -> DataFrame:
    """The pairs with features that a model or a rule takes."""
    if isinstance(matcher, Rule):
        return matcher.accept(pairs)
    scored = add_probability(pairs, matcher.pipeline)
    return scored.filter(take_decision(F.col(PROBA), matcher.threshold))


def match_catalogs(requests: DataFrame, matcher: Matcher | Rule, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Reply rows (request_id, part, positional_mapping, error) for parsed requests.

    A request given twice is answered once. The parsed requests are read twice, so they
    are written out first.
    """
    known = settle(requests.dropDuplicates(["request_id"]))
    matched = match_entries(explode_requests(known.filter(F.col("error").isNull())), matcher, tile_rows)
    return replies(known, matched.mapping(tile_rows))
