"""Vocabulary counting, comparison and selection."""

from __future__ import annotations

from functools import reduce

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import tokens as tk
from gistmill.functions.rows import exploded
from gistmill.operators.order import dense_index


def token_counts(df: DataFrame, tokens: Column | None = None, text: str = "text") -> DataFrame:
    """``(token, cnt)`` over the corpus; counts combine before the shuffle."""
    units = tk.tokens(F.col(text)) if tokens is None else tokens
    return exploded(df, [], units, "token").groupBy("token").agg(F.count("*").alias("cnt"))


def membership(a: DataFrame, b: DataFrame, key: str = "token") -> DataFrame:
    """``(key, in_a, in_b)``: one shuffle serves common, only-a and only-b."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return sides.groupBy(key).agg(
        (F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b")
    )


def vocab_overlap(
    a: DataFrame, b: DataFrame, vocab_size: int | None = None, key: str = "token"
) -> DataFrame:
    """Sizes of both vocabularies and of what they share. ``vocab_size`` is
    the full vocabulary the union is compared with."""
    m = membership(a, b, key)
    in_a, in_b = F.col("in_a"), F.col("in_b")
    sizes = m.agg(
        F.count_if(in_a).alias("size_a"),
        F.count_if(in_b).alias("size_b"),
        F.count_if(in_a & in_b).alias("common"),
        F.count_if(in_a & ~in_b).alias("only_a"),
        F.count_if(in_b & ~in_a).alias("only_b"),
        F.count("*").alias("total"),
    )
    whole = F.col("total") if vocab_size is None else F.lit(vocab_size)
    return sizes.withColumns(
        {
            "pct_a_in_b": F.try_divide(F.col("common") * 100, F.col("size_a")),
            "pct_of_vocab": F.try_divide(F.col("total") * 100, whole),
        }
    )


def topk_coverage(counts: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``(k, share)``: occurrences covered by the ``k`` most frequent tokens.

    Tokens of equal count are interchangeable here, so they are grouped by
    count first. N occurrences have fewer than sqrt(2 N) different counts, and
    only those levels are put in order.
    """
    levels = counts.groupBy("cnt").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    ordered = levels.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    total = counts.agg(F.sum("cnt"))
    wanted = ordered.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(
        F.col("above") < F.col("k")
    )
    taken = F.least(F.col("n"), F.col("k") - F.col("above")) * F.col("cnt")
    return (
        wanted.groupBy("k")
        .agg(F.sum(taken).alias("covered"))
        .select("k", F.try_divide(F.col("covered"), total.scalar()).alias("share"))
    )


def top_tokens(counts: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` most frequent tokens; ties go to the smaller token."""
    return counts.orderBy(F.desc("cnt"), "token").limit(k)


def token_ids(counts: DataFrame, reserved: int = 0) -> DataFrame:
    """``(token, id)``: a dictionary of all tokens of a ``(token, cnt)`` table.

    Ids are dense from ``reserved`` on, frequent tokens first, equal counts in
    the order of the token. Tokens are dealt out by ranges of that order and
    numbered within them; only the ranges' sizes meet, so the dictionary may be
    as large as its corpus has words.
    """
    order = F.struct((-F.col("cnt")).alias("neg"), F.col("token").alias("token"))
    numbered = dense_index(counts.select(order.alias("_order")), "_order", "id")
    return numbered.select(F.col("_order.token").alias("token"), (F.col("id") + reserved).alias("id"))


def coded_counts(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """A ``(token, cnt)`` table with ids for tokens; those without one drop out."""
    return counts.join(ids, "token").select(F.col("id").alias("token"), "cnt")


def id_union(*tables: DataFrame, token: str = "token") -> DataFrame:
    """Distinct ids of all tables."""
    return reduce(DataFrame.union, [t.select(F.col(token).cast("long").alias(token)) for t in tables]).distinct()


def select_vocab(
    first: DataFrame,
    second: DataFrame,
    vocab_size: int,
    reserved: int = 1000,
    top_first: int = 30_000,
    top_second: int = 115_000,
    cap: int = 119_900,
    tail: int = 100,
) -> DataFrame:
    """Kept token ids: the reserved low ids, the first corpus's top tokens,
    the second's while room is left under ``cap``, and the last ids.

    Inputs are ``(token, cnt)`` with integer tokens. Every table past the two
    top-k sorts is no longer than the sizes asked for.
    """
    spark = first.sparkSession
    low = spark.range(reserved).toDF("token")
    kept = id_union(low, top_tokens(first, top_first))
    room = kept.agg((F.lit(cap) - F.count("*")).alias("room"))
    fresh = (
        top_tokens(second, top_second)
        .withColumn("token", F.col("token").cast("long"))
        .join(kept, "token", "left_anti")
    )
    place = F.row_number().over(Window.orderBy(F.desc("cnt"), "token"))
    added = fresh.withColumn("place", place).where(F.col("place") <= room.scalar()).select("token")
    last = spark.range(vocab_size - tail, vocab_size).toDF("token")
    return id_union(kept, added, last)


def reindex(ids: DataFrame, key: str = "token", out: str = "new_id") -> DataFrame:
    """Dense new ids in the order of the old ones."""
    return dense_index(ids, key, out)


def gather_embeddings(
    vectors: DataFrame, ids: DataFrame, key: str = "vec_id", token: str = "token"
) -> DataFrame:
    """Embedding rows of the kept ids under their new ids."""
    return ids.join(vectors, ids[token] == vectors[key]).select(
        "new_id", F.col(key).alias("old_id"), "embedding"
    )
