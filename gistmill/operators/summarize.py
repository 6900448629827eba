"""Extractive baselines over a table of documents: map-only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions import summaries as sm
from gistmill.functions import tokens as tk
from gistmill.functions.rows import inlined


def lead(df: DataFrame, n: int = 3, text: str = "text", out: str = "pred") -> DataFrame:
    return df.withColumn(out, sm.lead_n(F.col(text), n))


def _with_top(
    df: DataFrame, stop_words: Sequence[str], k: int, rounds: int, text: str
) -> DataFrame:
    c = F.col(text)
    split = df.withColumn("_sents", tk.sentences_of(c))
    spoken = split.withColumn("_runs", sm.sentence_phrases(sm.tokens_of(F.col("_sents")), stop_words))
    ranked = spoken.withColumn("_ranked", sm.phrase_ranks(F.col("_runs"), rounds))
    return ranked.withColumn("_top", sm.top_phrases(F.col("_ranked"), k)).drop("_ranked")


def textrank_phrases(
    df: DataFrame, key: str, stop_words: Sequence[str], k: int = 4,
    rounds: int = sm.ROUNDS, text: str = "text",
) -> DataFrame:
    """``(key, place, phrase, rank)``: the ``k`` top phrases of each document."""
    top = _with_top(df.select(key, text), stop_words, k, rounds, text)
    placed = F.transform(
        "_top",
        lambda p, i: F.struct(
            (i + 1).alias("place"), p["phrase"].alias("phrase"), p["rank"].alias("rank")
        ),
    )
    return inlined(top, [key], placed, "place")


def rank_sentences(
    df: DataFrame, key: str, stop_words: Sequence[str], k: int = 4,
    rounds: int = sm.ROUNDS, text: str = "text",
) -> DataFrame:
    """``(key, sentence, distance)``, smaller is better."""
    top = _with_top(df.select(key, text), stop_words, k, rounds, text)
    distances = sm.sentence_distances(F.col("_runs"), F.col("_top"))
    placed = F.transform(
        distances, lambda d, i: F.struct(i.alias("sentence"), d.alias("distance"))
    )
    return inlined(top, [key], placed, "sentence")


def textrank(
    df: DataFrame, stop_words: Sequence[str], n: int = 3, k: int = 4,
    rounds: int = sm.ROUNDS, text: str = "text", out: str = "pred",
) -> DataFrame:
    top = _with_top(df, stop_words, k, rounds, text)
    distances = sm.sentence_distances(F.col("_runs"), F.col("_top"))
    chosen = sm.closest_sentences(F.col("_sents"), distances, n)
    return top.withColumn(out, chosen).drop("_sents", "_runs", "_top")
