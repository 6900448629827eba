"""From raw rating sheets to agreement with an interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.operators import ranking as rk
from gistmill.operators.bootstrap import paired_bootstrap

PLACES = ("p1", "p2", "p3", "p4", "p5")
CANDIDATES = ("a", "b", "c", "d", "e")
MODELS = ("a", "b", "c", "d")


def cleaned_ratings(raw: DataFrame, dropped: str = "e") -> DataFrame:
    """``(example, rater, a, b, c, d)`` ranks without the dropped candidate."""
    return rk.drop_and_rerank(rk.places_to_ranks(raw, PLACES, CANDIDATES), CANDIDATES, dropped)


def preferences(cleaned: DataFrame, raters: tuple, models: Sequence[str] = MODELS) -> DataFrame:
    return rk.paired_preferences(
        rk.pairwise_preferences(cleaned, ["example", "rater"], models), raters
    )


def agreement_interval(paired: DataFrame, models: Sequence[str] = MODELS, resamples: int = 1000) -> DataFrame:
    """Interval of the agreement; rows are numbered by example and relation."""
    relations = [f"{x}>{y}" for i, x in enumerate(models) for y in models[i + 1 :]]
    at = F.array_position(F.array(*[F.lit(r) for r in relations]), F.col("relation")) - 1
    keyed = paired.withColumn("row", F.col("example") * len(relations) + at)
    return paired_bootstrap(keyed, "rater1", "rater2", "row", resamples)
