"""Run the filter chain over a table: one map-only pass, no shuffle.

The chain goes in stages. Cheap filters are generated code; what they have
failed is NULL to the n-gram stage, and what that has failed to the language
stage, so the dear work is done for survivors only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import repetition as rp
from gistmill.functions import tokens as tk
from gistmill.functions.language import LanguageProfile
from gistmill.functions.quality import (
    NGRAM_FILTERS,
    PASSED,
    TOO_LONG,
    QualityParams,
    language_passes,
    ngram_predicate,
    ngram_sizes,
    predicate,
)

UserFilters = Mapping[str, Callable[[Column], Column]]


def first_failure(arms: list[tuple[str, Column]]) -> Column:
    """Name of the first arm whose condition is not true, else NULL.

    ``CASE`` stops at the first arm that holds, so later and dearer conditions
    are not evaluated for rows that failed already.
    """
    if not arms:
        return F.lit(None).cast("string")
    verdict = F
    for name, passes in arms:
        verdict = verdict.when(~F.coalesce(passes, F.lit(False)), F.lit(name))
    return verdict


def describe_filter(
    df: DataFrame,
    params: QualityParams | None = None,
    text: str = "text",
    out: str = "filter",
    profile: LanguageProfile | None = None,
    extra: UserFilters | None = None,
) -> DataFrame:
    """Add ``out``: the first filter a row fails, or NULL when it passes all.

    ``extra`` appends user filters, each a function from the text column to a
    boolean column.
    """
    p = params or QualityParams()
    names = p.active()
    if "detect_language" in names and profile is None:
        raise ValueError("detect_language needs a language profile; pass one or ignore the filter")
    c, verdict = F.col(text), F.col("_q_early")
    helpers = ["_q_words", "_q_lines", "_q_word_chars", "_q_early"]
    words, lines, word_chars = (F.col(h) for h in helpers[:3])
    staged = df.withColumns({"_q_words": tk.n_words(c), "_q_lines": tk.line_array(c), "_q_word_chars": tk.word_chars(c)})
    short_enough = (TOO_LONG, F.coalesce(F.length(c), F.lit(0)) <= p.max_length)
    staged = staged.withColumn("_q_early", first_failure([short_enough]))
    for kind, some in groupby(names, _kind_of):
        group = list(some)
        # Only texts that are still in the running reach the dear stages.
        running = F.when(verdict.isNull(), c)
        if kind == "ngrams":
            staged = staged.withColumn("_q_found", rp.suffix_measures(running, *ngram_sizes(p, group)))
            arms = [(f, ngram_predicate(f, p, F.col("_q_found"), F.length(c))) for f in group]
        elif kind == "language":
            joined = F.array_join(tk.non_blank_lines(running), " ")
            staged = staged.withColumn("_q_raw", profile.raw_scores(joined))
            arms = [(f, language_passes(profile.ranked(F.col("_q_raw")), p)) for f in group]
        else:
            arms = [(f, predicate(f, p, c, words, lines, word_chars)) for f in group]
        staged = staged.withColumn("_q_early", F.coalesce(verdict, first_failure(arms)))
    own = [(name, make(c)) for name, make in (extra or {}).items()]
    judged = staged.withColumn(out, F.coalesce(verdict, first_failure(own)) if own else verdict)
    return judged.drop(*helpers, "_q_found", "_q_raw")


def _kind_of(name: str) -> str:
    if name in NGRAM_FILTERS:
        return "ngrams"
    return "language" if name == "detect_language" else "plain"


def quality_filter(df: DataFrame, params: QualityParams | None = None, **options) -> DataFrame:
    """Rows that pass every filter, all their columns kept."""
    verdict = "_q_verdict"
    judged = describe_filter(df, params, out=verdict, **options)
    return judged.where(F.col(verdict).isNull()).drop(verdict)


def filter_counts(
    df: DataFrame, params: QualityParams | None = None, by: list[str] | None = None, **options
) -> DataFrame:
    """Rows per verdict; those that passed are counted under their own label."""
    judged = describe_filter(df, params, out="filter", **options)
    label = F.coalesce(F.col("filter"), F.lit(PASSED)).alias("filter")
    return judged.groupBy(*(by or []), label).agg(F.count("*").alias("n"))
