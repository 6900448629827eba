"""Shrink a vocabulary to what two corpora use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.operators import vocab as vc
from gistmill.session import written


def pruned_embeddings(
    first_counts: DataFrame, second_counts: DataFrame, vectors: DataFrame, vocab_size: int, **sizes: int
) -> DataFrame:
    """``(new_id, old_id, embedding)`` of the kept ids."""
    kept = vc.select_vocab(first_counts, second_counts, vocab_size, **sizes)
    return vc.gather_embeddings(vectors, vc.reindex(kept))


def kept_ids(first: DataFrame, second: DataFrame, reserved: int = 1000, tail: int = 100, **sizes: int) -> tuple:
    """Dictionary, kept ids under their new ids, and vocabulary size of two
    corpora's ``(token, cnt)`` tables.

    Both corpora share a dictionary; its ids begin after the reserved ones and
    the last ``tail`` ids are kept for themselves.
    """
    both = first.unionByName(second).groupBy("token").agg(F.sum("cnt").alias("cnt"))
    ids = written(vc.token_ids(both, reserved), "dictionary")
    size = reserved + ids.count() + tail
    coded = [vc.coded_counts(counts, ids) for counts in (first, second)]
    kept = vc.select_vocab(*coded, size, reserved=reserved, tail=tail, **sizes)
    return ids, vc.reindex(kept), size
