"""Rank, threshold and score expressions."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerlake import schema as S


@dataclass(frozen=True)
class Gate:
    """When a candidate counts as a hit. Distances rank as ``max_distance - d2``."""

    metric: str = "l2"
    threshold: float = 0.95
    threshold_long: float = 0.95
    cache_factor: float = 1.0
    max_distance: float = 4.0
    positive: bool = False
    short_text: int = S.SHORT_TEXT

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise ValueError("the similarity threshold lies in 0..1")
        if self.metric not in ("l2", "cosine"):
            raise ValueError(f"unknown metric {self.metric}")

    def rank(self, score: Column) -> Column:
        if self.metric == "cosine":
            return score
        return rank_distance(score, self.max_distance, self.positive)

    def cuts(self) -> tuple:
        """(short, long) least ranks."""
        if self.metric == "cosine":
            return F.lit(float(self.threshold)), F.lit(float(self.threshold))
        return tuple(scale_threshold(F.lit(float(t)), 0.0, self.max_distance, self.cache_factor)
                     for t in (self.threshold, self.threshold_long))

    def max_cost(self):
        """Squared distance (or negative cosine) beyond which no candidate can
        pass, None when any might."""
        if self.metric == "cosine":
            return -float(self.threshold)
        cuts = [min(max(self.max_distance * t * self.cache_factor, 0.0), self.max_distance)
                for t in (self.threshold, self.threshold_long)]
        if self.positive or min(cuts) <= 0:
            return None
        return self.max_distance - min(cuts)


COSINE = Gate(metric="cosine", threshold=0.9, threshold_long=0.9)


def rank_distance(distance: Column, max_distance: float = 4.0, positive: bool = False) -> Column:
    inside = F.least(F.greatest(distance, F.lit(0.0)), F.lit(float(max_distance)))
    return inside if positive else F.lit(float(max_distance)) - inside


def rank_exact(question: Column, stored: Column) -> Column:
    return F.when(question == stored, 1).otherwise(0)


def scale_threshold(threshold: Column, low: float = 0.0, high: float = 4.0,
                    cache_factor: float = 1.0) -> Column:
    return F.least(F.greatest(F.lit(float(high - low)) * threshold * F.lit(float(cache_factor)),
                              F.lit(float(low))), F.lit(float(high)))


def evaluated_question(deps: Column, other_deps: Column, question: Column) -> Column:
    """Question text to evaluate: the first dependent part when both sides carry
    dependent parts, else the plain question."""
    both = (F.coalesce(F.size(deps), F.lit(-1)) > 0) & (F.coalesce(F.size(other_deps), F.lit(-1)) > 0)
    return F.when(both, F.get(deps, F.lit(0))["data"]).otherwise(question)


def token_overlap(a: Column, b: Column) -> Column:
    """Share of common distinct tokens; the built-in pair scorer."""
    from answerlake.functions.text import tokens
    x, y = tokens(a), tokens(b)
    total = F.size(F.array_union(x, y))
    return F.when(total > 0, F.size(F.array_intersect(x, y)) / total).otherwise(0.0)
