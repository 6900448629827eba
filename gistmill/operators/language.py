"""Learn a language profile from labelled text and score documents with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions.language import FLOOR, SCALE, LanguageProfile, letters_only, trigram_counts
from gistmill.functions.rows import inlined
from gistmill.operators.order import hash_to_long, md5_of


def language_profile(
    df: DataFrame, text: str = "text", lang: str = "lang", size: int = 1000
) -> DataFrame:
    """``(lang, gram, weight)``: each language's ``size`` most frequent trigrams.

    Counting combines map-side, so a language that dominates the corpus costs
    no more than its number of distinct trigrams.
    """
    labelled = df.where(F.col(lang).isNotNull())
    letters = labelled.select(F.col(lang).alias("lang"), letters_only(F.col(text)).alias("letters"))
    seen = letters.mapInArrow(trigram_counts, "lang string, gram string, cnt long")
    counts = seen.groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt"))
    totals = counts.groupBy("lang").agg(F.sum("cnt").alias("total"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("cnt"), "gram")
    top = counts.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= size)
    log = lambda p: F.round(F.log(p) * SCALE).cast("long")
    return top.join(totals, "lang").select(
        "lang", "gram", (log(F.col("cnt") / F.col("total")) - log(F.lit(FLOOR))).alias("weight")
    )


def learns(key: str) -> Column:
    """Half of all rows, by a hash of their key: those a profile is learned from
    where the others are to show how well it does."""
    return F.coalesce(hash_to_long(md5_of(F.col(key))) % 2 == 0, F.lit(False))


def load_profile(profile: DataFrame) -> LanguageProfile:
    """Fetch a profile table. Its size per language and the number of languages
    bound it, whatever the corpus."""
    rows = profile.select("lang", "gram", "weight").collect()
    langs = tuple(sorted({r.lang for r in rows}))
    table: dict[str, list[int]] = {}
    for r in rows:
        table.setdefault(r.gram, [0] * len(langs))[langs.index(r.lang)] = r.weight
    return LanguageProfile(langs, tuple(table), tuple(tuple(w) for w in table.values()))


def language_scores(
    df: DataFrame, profile: LanguageProfile, key: str, text: str = "text"
) -> DataFrame:
    """``(key, lang, prob)`` for every language of the profile and for none."""
    scored = df.select(key, profile.raw_scores(F.col(text)).alias("_raw"))
    return inlined(scored, [key], profile.ranked(F.col("_raw")), "lang")
