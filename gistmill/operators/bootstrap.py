"""Bootstrap intervals whose draws can be repeated in any engine.

Means are resampled without a row per draw (``operators.resampling``); only a
statistic that is no mean has its draws made and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.operators.order import dense_index, hash_to_long, md5_of
from gistmill.operators.resampling import drawn_means, poisson_means
from gistmill.session import written

RESAMPLES = 1000
LEVEL = 0.95
# Cumulative Poisson(1) probabilities for 0, 1, 2, ... draws.
POISSON_1 = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.9999988747974020, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892,
    0.9999999999363892, 0.9999999999954802,
)


def quantiles(level: float = LEVEL) -> list[float]:
    tail = (1 - level) / 2
    return [tail, 0.5, 1 - tail]


def _intervals(values: DataFrame, plain: DataFrame, names: list[str], level: float) -> DataFrame:
    """A row per name: quantiles of a column of ``values``, and its ``plain``."""
    probs = F.array(*[F.lit(p) for p in quantiles(level)])
    q = values.agg(*[F.percentile(c, probs).alias(f"_q{i}") for i, c in enumerate(names)])
    one = q.crossJoin(plain)  # one row each
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            *[F.get(f"_q{i}", F.lit(k)).alias(b) for k, b in enumerate(("low", "mid", "high"))],
            F.col(f"_mean{i}").alias("mean"),
        )
        for i, c in enumerate(names)
    ]
    return one.select(F.inline(F.array(*rows)))


def _drawn(scores: DataFrame, key: str, n: int, draws: DataFrame) -> DataFrame:
    """Join ``(b, k)`` draws to the rows their hash points at. How the join is
    made is left to adaptive execution, which knows the sizes."""
    indexed = dense_index(scores, key).drop(key)
    at = F.pmod(hash_to_long(md5_of(F.col("b"), F.col("k"))), F.lit(max(n, 1)))
    # Never null, and said so: else the join adds a null test that hashes twice.
    at = F.coalesce(at, F.lit(0))
    return draws.withColumn("idx", at).join(indexed, "idx")


def bootstrap_stats(
    rows: DataFrame,
    stats: dict[str, Column],
    key: str,
    resamples: int = RESAMPLES,
    level: float = LEVEL,
) -> DataFrame:
    """``(metric, low, mid, high, mean)`` for each statistic, an aggregate over
    the columns of ``rows``; ``mean`` is its value over the rows as they are.

    For statistics that are no means, such as a median or a correlation: each
    resample's rows must be there at once, so n times ``resamples`` draws are
    joined to them. ``bootstrap_means`` needs none of that. Each resample takes
    exactly n rows with replacement, the same ones for every statistic. No rows
    give NULLs. ``key`` is unique and of any type.
    """
    rows = written(rows, "scores")
    n = rows.count()
    draws = rows.sparkSession.range(resamples * n).select(
        F.expr(f"id div {max(n, 1)}").alias("b"), (F.col("id") % max(n, 1)).alias("k")
    )
    named = [(f"_s{i}", c) for i, c in enumerate(stats.values())]
    values = _drawn(rows, key, n, draws).groupBy("b").agg(*[c.alias(s) for s, c in named])
    plain = rows.agg(*[c.alias(f"_mean{i}") for i, (_, c) in enumerate(named)])
    found = _intervals(values, plain, [s for s, _ in named], level)
    name = F.element_at(F.create_map(*[F.lit(x) for s, m in zip(named, stats) for x in (s[0], m)]), F.col("metric"))
    return found.withColumn("metric", name)


METHODS = ("draws", "poisson")


def bootstrap_mean(
    scores: DataFrame,
    score: str,
    key: str,
    resamples: int = RESAMPLES,
    level: float = LEVEL,
    method: str = "draws",
) -> DataFrame:
    """``low, mid, high`` of the resampled means and the plain ``mean``.

    ``draws`` takes exactly n rows with replacement per resample. ``poisson``
    gives each row an independent Poisson(1) weight instead, which needs one
    scan and no row index. The caller chooses; the number of rows never does.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    found = _mean_intervals(scores.select(key, score), [score], key, resamples, level, method, filled=True)
    return found.drop("metric")


def bootstrap_means(
    scores: DataFrame,
    columns: list[str],
    key: str,
    resamples: int = RESAMPLES,
    level: float = LEVEL,
    method: str = "draws",
) -> DataFrame:
    """Intervals of several columns' means from one set of draws, in one pass; a
    mean passes over its column's nulls."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    return _mean_intervals(scores.select(key, *columns), columns, key, resamples, level, method)


def _mean_intervals(
    scores: DataFrame, columns: list[str], key: str, resamples: int, level: float, method: str,
    filled: bool = False,
) -> DataFrame:
    scores = written(scores, "scores")
    if filled:
        # Asked of what is stored: of a score in the making it makes it twice.
        scores = scores.where(F.col(columns[0]).isNotNull())
    if method == "draws":
        means = drawn_means(scores, columns, key, resamples)
    else:
        means = poisson_means(scores, columns, key, resamples, POISSON_1)
    named = [f"m{i}" for i in range(len(columns))]
    plain = scores.agg(*[F.avg(c).alias(f"_mean{i}") for i, c in enumerate(columns)])
    metric = F.element_at(F.create_map(*[F.lit(x) for m in zip(named, columns) for x in m]), F.col("metric"))
    return _intervals(means, plain, named, level).withColumn("metric", metric)


def sample_percentiles(
    scores: DataFrame, score: str, key: str, size: int = RESAMPLES, level: float = LEVEL
) -> DataFrame:
    """Percentiles of one sample of raw scores: not an interval of the mean."""
    scores = written(scores.select(key, score), "scores").where(F.col(score).isNotNull())
    n = scores.count()
    draws = scores.sparkSession.range(size).select(F.lit(0).cast("long").alias("b"), F.col("id").alias("k"))
    plain = scores.agg(F.avg(score).alias("_mean0"))
    return _intervals(_drawn(scores, key, n, draws), plain, [score], level).drop("metric")


def paired_bootstrap(
    pairs: DataFrame,
    left: str,
    right: str,
    key: str,
    resamples: int = RESAMPLES,
    level: float = LEVEL,
    stat: Column | None = None,
) -> DataFrame:
    """Percentile interval of a statistic of two columns resampled together.

    ``stat`` is an aggregate over both; by default the share of rows on which
    they agree, rows with a null left out.
    """
    both = pairs.select(key, left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull())
    if stat is not None:
        return bootstrap_stats(both, {"stat": stat}, key, resamples, level).drop("metric")
    agree = both.select(F.col(key).alias("key"), (F.col(left) == F.col(right)).cast("double").alias("agree"))
    return bootstrap_means(agree, ["agree"], "key", resamples, level).drop("metric")


def metric_report(intervals: dict[str, DataFrame]) -> DataFrame:
    """One ``(metric, low, mid, high, mean)`` row per named interval."""
    tables = [
        t.select(F.lit(name).alias("metric"), "low", "mid", "high", "mean")
        for name, t in intervals.items()
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def wide_report(report: DataFrame, metrics: list[str]) -> DataFrame:
    """The report as one row of ``metric_bound`` columns."""
    bounds = ("low", "mid", "high", "mean")
    return report.agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(b))).alias(f"{m}_{b}")
            for m in metrics
            for b in bounds
        ]
    )
