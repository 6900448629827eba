"""Descriptive tables behind the plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_stats(df: DataFrame, columns: Sequence[str], by: str = "type") -> DataFrame:
    """Minimum, mean to two decimals, and maximum of each column per group."""
    aggregates = []
    for c in columns:
        aggregates += [
            F.min(c).alias(f"min_{c}"),
            F.round(F.avg(c), 2).alias(f"mean_{c}"),
            F.max(c).alias(f"max_{c}"),
        ]
    return df.groupBy(by).agg(*aggregates)


def histogram(df: DataFrame, column: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """``(by, bin, lo, hi, n)``: equal-width counts over the column's range in
    the whole table, the top edge falling into the last bin. Bins
    without rows are there with 0."""
    values = df.where(F.col(column).isNotNull())
    edges = values.agg(
        F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).alias("e")
    )
    placed = values.select(*by, F.col(column).cast("double").alias("_x"), edges.scalar().alias("_e"))
    lo, hi = F.col("_e")["lo"], F.col("_e")["hi"]
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    at = F.least(F.floor((F.col("_x") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    # every bin of every group, also where nothing falls; a row per bin is small
    every = counts.select(*by).distinct() if by else edges.select()
    frame = every.crossJoin(edges).select(*by, "e", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    frame = frame.where(F.col("e.lo").isNotNull())
    width = F.when(F.col("e.hi") > F.col("e.lo"), (F.col("e.hi") - F.col("e.lo")) / bins).otherwise(F.lit(1.0))
    keys = [*by, "bin"]
    return frame.join(counts, keys, "left").select(
        *keys,
        (F.col("e.lo") + F.col("bin") * width).alias("lo"),
        (F.col("e.lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
