"""Repetition tables: one row per document and n-gram size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.functions import repetition as rp
from gistmill.functions import suffixes
from gistmill.functions import tokens as tk
from gistmill.functions.rows import inlined, let


def ngram_counts(df: DataFrame, key: str, lo: int, hi: int, text: str = "text") -> DataFrame:
    """``(key, n, ngram, cnt)`` within each document, counted inside its row."""
    return inlined(ngram_tables(df, key, lo, hi, text), [key, "n"], F.col("grams"), "ngram")


def ngram_tables(df: DataFrame, key: str, lo: int, hi: int, text: str = "text") -> DataFrame:
    """``(key, n, grams)``: the same counts as a row per document and size, ``grams``
    an ``array<struct<ngram, cnt>>``. What is asked of a document's n-grams as a
    whole is answered from its array; as rows they are some fifty times the text."""
    rows = df.select(F.col(key).alias("key"), suffixes.marked(F.col(text)).alias("tokens"))
    kind = df.select(key).schema[0].dataType.simpleString()
    made = f"key {kind}, n int, grams array<struct<ngram:string,cnt:bigint>>"
    return rows.mapInArrow(suffixes.tables(range(lo, hi + 1)), made).withColumnRenamed("key", key)


def top_ngrams(df: DataFrame, key: str, n: int, text: str = "text") -> DataFrame:
    """``(key, ngram, cnt, chr_fraction)`` of the most frequent n-gram; the first
    seen wins a tie. Texts too short for one have no row."""
    return top_ngrams_of(df, key, [n], text).drop("n")


def top_ngrams_of(df: DataFrame, key: str, sizes: Sequence[int], text: str = "text") -> DataFrame:
    """``(key, ngram, cnt, chr_fraction, n)``: the same for several sizes, from one
    suffix array of a document's tokens."""
    kept = df.select(key, F.col(text).alias("_text"), F.length(text).alias("_chars"))
    found = kept.withColumn("_found", rp.suffix_measures(F.col("_text"), sizes, []))

    def top(gapped: Column):
        def one(i: int, n: int):
            cnt, first, chars = (F.get(F.col("_found")[c], F.lit(i)) for c in ("counts", "firsts", "chars"))
            spelled = F.slice(gapped, first.cast("int") + 1, n)
            gram = F.ltrim(F.lower(F.array_join(spelled, "")), F.lit(rp.SPACES))
            share = F.try_divide(chars * cnt, F.col("_chars"))
            row = F.struct(gram.alias("ngram"), cnt.alias("cnt"), share.alias("chr_fraction"), F.lit(n).alias("n"))
            return F.when(cnt > 0, row)

        return F.filter(F.array(*[one(i, n) for i, n in enumerate(sizes)]), lambda x: x.isNotNull())

    return inlined(found, [key], let(tk.tokens(F.col("_text"), tk.GAPPED_TOKEN), top), "n")


def duplicate_ngrams(df: DataFrame, key: str, lo: int, hi: int, text: str = "text") -> DataFrame:
    """``(key, n, dup_chars, n_chars)``: characters under repeated n-grams."""
    sizes = list(range(lo, hi + 1))
    found = df.select(
        key, F.length(text).alias("n_chars"), rp.suffix_measures(F.col(text), [], sizes)["duplicates"].alias("_dup")
    )
    each = F.arrays_zip(F.array(*[F.lit(n) for n in sizes]).alias("n"), F.col("_dup").alias("dup_chars"))
    flat = found.where(F.col("_dup").isNotNull()).select(key, "n_chars", F.inline(each))
    return flat.select(key, "n_chars", "n", "dup_chars")


def with_line_fractions(df: DataFrame, text: str = "text") -> DataFrame:
    """Both duplicate measures for lines and for paragraphs."""
    parts = {"lines": F.split(F.col(text), "\n"), "paragraphs": F.split(F.col(text), "\n\n")}
    out = {}
    for name, column in parts.items():
        out[f"{name}_chr_fraction"] = let(
            column, lambda p: rp.duplicate_chr_fraction(p, F.length(text))
        )
        out[f"{name}_fraction"] = rp.duplicate_fraction(column)
    return df.withColumns(out)
