"""From raw pairs to cleaned, flagged, split pairs in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions import tokens as tk
from gistmill.functions.quality import QualityParams, article_profile, summary_profile
from gistmill.functions.repair import repaired
from gistmill.operators.prep import both_passed, exact_split, quantile_cutoff
from gistmill.operators.quality import describe_filter
from gistmill.session import written


def with_lengths(df: DataFrame, text: str = "text", summary: str = "summary") -> DataFrame:
    return df.withColumns(
        {
            "tok_text_len": tk.token_len(F.col(text)),
            "tok_sum_len": tk.token_len(F.col(summary)),
        }
    )


def with_flags(
    df: DataFrame, article: QualityParams | None = None, summary: QualityParams | None = None
) -> DataFrame:
    """Add both verdicts and the pass flags drawn from them."""
    judged = describe_filter(df, article or article_profile(), "text", "filter")
    judged = describe_filter(judged, summary or summary_profile(), "summary", "filter_sum")
    flagged = judged.withColumns(
        {
            "passed_quality": F.col("filter").isNull(),
            "passed_quality_sum": F.col("filter_sum").isNull(),
        }
    )
    return flagged.withColumn("passed", both_passed())


def clean_pairs(
    df: DataFrame,
    article: QualityParams | None = None,
    summary: QualityParams | None = None,
    repair: bool = True,
) -> DataFrame:
    """Repair, measure, cut off by length, flag.

    Repaired and measured pairs are stored in between: the quantiles then read
    two integer columns, and no text is repaired twice.
    """
    if repair:
        df = repaired(df, ["text", "summary"])
    measured = written(with_lengths(df), "measured")
    kept = quantile_cutoff(measured, ["tok_text_len", "tok_sum_len"])
    return with_flags(kept, article, summary)


def split_pairs(df: DataFrame, key: str, seed: int = 22) -> DataFrame:
    """Cleaned pairs with their split; quality flags stay columns."""
    return exact_split(df, key, "density_bin", seed)
