"""Human rankings of candidate summaries: reshape, compare, agree."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions.rows import let
from gistmill.operators.order import md5_of


def places_to_ranks(df: DataFrame, places: Sequence[str], candidates: Sequence[str]) -> DataFrame:
    """Columns holding who came 1st, 2nd, ... become each candidate's rank."""
    sheet = F.array(*[F.col(p) for p in places])
    ranks = {c: F.nullif(F.array_position(sheet, c), F.lit(0)).cast("int") for c in candidates}
    return df.withColumns(ranks).drop(*places)


def drop_and_rerank(df: DataFrame, candidates: Sequence[str], dropped: str) -> DataFrame:
    """Take one candidate out and close the gaps in each row's ranks."""
    kept = [c for c in candidates if c != dropped]
    ranks = F.array_distinct(F.array(*[F.col(c) for c in kept]))

    def dense(rank: Column) -> Column:
        return F.size(F.filter(ranks, lambda r: r < rank)) + 1

    closed = {c: F.when(F.col(c).isNotNull(), dense(F.col(c))) for c in kept}
    return df.select(*[c for c in df.columns if c not in candidates], *[closed[c].alias(c) for c in kept])


def long_ranks(df: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), list(models), "model", "rank")


def pairwise_preferences(df: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """``(keys, relation, preferred)``: 1 when the first of the pair ranks
    better, 0 otherwise, ties included."""
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{x}>{y}").alias("relation"),
                F.coalesce((F.col(x) < F.col(y)).cast("int"), F.lit(0)).alias("preferred"),
            )
            for x, y in combinations(models, 2)
        ]
    )
    return df.select(*keys, F.inline(rows))


def paired_preferences(
    preferences: DataFrame, raters: tuple, example: str = "example", rater: str = "rater"
) -> DataFrame:
    """``(example, relation, rater1, rater2)`` where both raters answered."""

    def by(who) -> Column:
        return F.max(F.when(F.col(rater) == F.lit(who), F.col("preferred")))

    both = preferences.groupBy(example, "relation").agg(
        by(raters[0]).alias("rater1"), by(raters[1]).alias("rater2")
    )
    return both.where(F.col("rater1").isNotNull() & F.col("rater2").isNotNull())


def interrater_agreement(paired: DataFrame) -> DataFrame:
    agree = (F.col("rater1") == F.col("rater2")).cast("int")
    return paired.agg(
        F.sum(agree).alias("agreed"), F.count("*").alias("total"), F.avg(agree).alias("agreement")
    )


def rank_summary(ranks: DataFrame) -> DataFrame:
    """Mean, median and mode per model over all raters; the smallest rank wins
    a tie for the mode. Ranks are counted first, so little is shuffled."""
    counts = ranks.groupBy("model", "rank").agg(F.count("*").alias("n"))
    return counts.groupBy("model").agg(
        (F.sum(F.col("rank") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("rank", F.lit(0.5), F.col("n")).alias("median"),
        F.max_by("rank", F.struct(F.col("n"), -F.col("rank"))).alias("mode"),
    )


def cohen_kappa(ranks: DataFrame, raters: tuple, example: str = "example") -> DataFrame:
    """Chance-corrected agreement of two raters per model."""

    def by(who) -> Column:
        return F.max(F.when(F.col("rater") == F.lit(who), F.col("rank")))

    both = ranks.groupBy(example, "model").agg(by(raters[0]).alias("r1"), by(raters[1]).alias("r2"))
    cells = (
        both.where(F.col("r1").isNotNull() & F.col("r2").isNotNull())
        .groupBy("model", "r1", "r2")
        .agg(F.count("*").alias("n"))
    )
    # A handful of cells per model from here on: one per pair of ranks.
    sides = cells.select(
        "model",
        F.inline(
            F.array(
                F.struct(F.col("r1").alias("rank"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")),
                F.struct(F.col("r2").alias("rank"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")),
            )
        ),
    )
    chance = (
        sides.groupBy("model", "rank")
        .agg((F.sum("a") * F.sum("b")).alias("ab"))
        .groupBy("model")
        .agg(F.sum("ab").alias("ab"))
    )
    seen = cells.groupBy("model").agg(
        F.sum(F.when(F.col("r1") == F.col("r2"), F.col("n")).otherwise(0)).alias("agreed"),
        F.sum("n").alias("total"),
    )
    po = F.col("agreed") / F.col("total")
    pe = F.col("ab") / (F.col("total") * F.col("total"))
    return seen.join(chance, "model").select("model", F.try_divide(po - pe, 1 - pe).alias("kappa"))


def blind_sample(
    df: DataFrame, key: str, candidates: dict[str, str], n: int = 100, seed: int = 22
) -> tuple[DataFrame, DataFrame]:
    """A seeded sample of ``n`` rows whose candidates stand under letters in a
    hidden order of their own: the raters' sheet, and apart from it the table
    ``(key, answer_key)`` that tells which is which.

    ``candidates`` maps model names to text columns.
    """
    letters = [chr(ord("a") + k) for k in range(len(candidates))]
    sample = df.orderBy(md5_of(F.col(key), str(seed)), key).limit(n)
    shuffled = F.sort_array(
        F.array(
            *[
                F.struct(
                    md5_of(F.col(key), str(seed), model).alias("h"),
                    F.lit(model).alias("model"),
                    F.col(column).alias("summary"),
                )
                for model, column in candidates.items()
            ]
        )
    )
    hidden = sample.withColumn("_order", shuffled)
    sheet = [F.get("_order", F.lit(k))["summary"].alias(c) for k, c in enumerate(letters)]
    answers = let(
        F.col("_order"),
        lambda o: F.concat_ws(
            ",", *[F.concat(F.lit(f"{c}="), F.get(o, F.lit(k))["model"]) for k, c in enumerate(letters)]
        ),
    )
    return hidden.select(key, "text", *sheet), hidden.select(key, answers.alias("answer_key"))
