"""Repetition inside one document, as expressions over its own row.

A document is one row already, so nothing here groups or shuffles: copies of
lines are found by sorting the row's own, copies of n-grams by the suffix array
of a batch of rows (``functions.suffixes``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions import suffixes
from gistmill.functions import tokens as tk
from gistmill.functions.rows import let, run_lengths, total
from gistmill.functions.suffixes import SPACES


def duplicate_chr_fraction(parts: Column, n_chars: Column) -> Column:
    """Characters in second and later copies of a part, over all characters."""
    lengths = lambda xs: total(F.transform(xs, F.length))
    return F.try_divide(lengths(parts) - lengths(F.array_distinct(parts)), n_chars)


def duplicate_fraction(parts: Column) -> Column:
    """Share of non-blank parts that occur more than once, first copy included."""
    filled = F.filter(parts, lambda p: tk.strip(p) != "")

    def share(items: Column) -> Column:
        single = F.size(F.filter(run_lengths(items), lambda r: r["cnt"] == 1))
        return F.try_divide(F.size(items) - single, F.size(items))

    return let(filled, share)


class Shingles(NamedTuple):
    """Per-token arrays of one document, each evaluated once."""

    gapped: Column  # token with the whitespace in front of it, case kept
    low: Column  # the same, lower-cased
    bare: Column  # lower-cased without that whitespace

    def count(self, n: int) -> Column:
        """Number of n-grams; the one ending on the last token never counts."""
        return F.greatest(F.size(self.low) - n, F.lit(0))

    def texts(self, n: int) -> Column:
        """Lower-cased text of every n-gram, inner whitespace kept."""
        return F.transform(
            F.slice(self.bare, F.lit(1), self.count(n)),
            lambda x, i: F.concat(x, *[F.get(self.low, i + k) for k in range(1, n)]),
        )


def with_shingles(text: Column, body: Callable[[Shingles], Column]) -> Column:
    return let(
        tk.tokens(text, tk.GAPPED_TOKEN),
        lambda gapped: let(
            F.transform(gapped, F.lower),
            lambda low: let(
                F.transform(low, lambda x: F.ltrim(x, F.lit(SPACES))),
                lambda bare: body(Shingles(gapped, low, bare)),
            ),
        ),
    )


def suffix_measures(text: Column, top: Sequence[int], duplicate: Sequence[int]) -> Column:
    """What ``suffixes.measures`` finds out about a text; NULL for a NULL one."""
    return suffixes.measures(text, top, duplicate)


def top_fails(
    found: Column, n_chars: Column, limits: Sequence[float], min_count: int
) -> Column:
    """Does the top n-gram of some size occur too often and cover too much?"""
    verdict = F.lit(False)
    for i, limit in enumerate(limits):
        count, chars = (F.get(found[c], F.lit(i)) for c in ("counts", "chars"))
        too_much = F.coalesce(F.try_divide(chars * count, n_chars) > limit, F.lit(False))
        verdict = verdict | ((count > min_count) & too_much)
    return F.coalesce(verdict, F.lit(False))


def duplicate_fails(found: Column, n_chars: Column, limits: Sequence[float]) -> Column:
    """Do repeats of some size cover too much, or is the text empty?"""
    verdict = n_chars == 0
    for i, limit in enumerate(limits):
        verdict = verdict | (F.get(found["duplicates"], F.lit(i)) > n_chars * F.lit(limit))
    return verdict


def top_ngram_fails(
    text: Column, n_chars: Column, sizes: Sequence[int], limits: Sequence[float], min_count: int
) -> Column:
    """True when some size's top n-gram covers too much of the text."""
    sizes, limits = list(sizes)[: len(limits)], list(limits)
    return top_fails(suffix_measures(text, sizes, []), n_chars, limits[: len(sizes)], min_count)


def duplicate_ngram_fails(
    text: Column, n_chars: Column, sizes: Sequence[int], limits: Sequence[float]
) -> Column:
    """True when repeats of some size cover too much, or the text is empty."""
    sizes, limits = list(sizes)[: len(limits)], list(limits)
    return duplicate_fails(suffix_measures(text, [], sizes), n_chars, limits[: len(sizes)])
