"""Array building blocks that stay inside one row, so they never shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda that captured the expression itself would evaluate it again for
    every element it visits.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positioned(items: Column) -> Column:
    """``array<struct<key, pos>>`` sorted by key, then position."""
    return F.sort_array(
        F.transform(items, lambda x, i: F.struct(x.alias("key"), i.alias("pos")))
    )


def starts_run(ordered: Column, i: Column) -> Column:
    return (i == 0) | (F.get(ordered, i)["key"] != F.get(ordered, i - 1)["key"])


def run_lengths(items: Column) -> Column:
    """Distinct items in key order as ``array<struct<key, cnt, first>>``."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda x, i: F.when(starts_run(ordered, i), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda st, q: F.struct(
                    F.get(ordered, st)["key"].alias("key"),
                    (F.coalesce(F.get(s, q + 1), F.size(ordered)) - st).alias("cnt"),
                    F.get(ordered, st)["pos"].alias("first"),
                ),
            ),
        )

    return let(positioned(items), runs)


def repeat_positions(items: Column) -> Column:
    """Positions, ascending, of every item seen earlier in the array."""

    def later_copies(ordered: Column) -> Column:
        later = F.filter(ordered, lambda x, i: ~starts_run(ordered, i))
        return F.sort_array(F.transform(later, lambda x: x["pos"]))

    return let(positioned(items), later_copies)


def multiset_overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two arrays."""

    def tagged(items: Column) -> Column:
        return F.transform(
            run_lengths(items), lambda r: F.struct(r["key"].alias("key"), r["cnt"].alias("cnt"))
        )

    def neighbours(both: Column) -> Column:
        shared = F.transform(
            both,
            lambda r, i: F.when(
                ~starts_run(both, i), F.least(r["cnt"], F.get(both, i - 1)["cnt"])
            ).otherwise(0),
        )
        return total(shared)

    return let(F.sort_array(F.concat(tagged(left), tagged(right))), neighbours)


def total(numbers: Column) -> Column:
    """Sum of an integer array as a long; 0 when empty."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x)


def grams(items: Column, n: int, sep: str = " ") -> Column:
    """Consecutive ``n``-grams of an array of strings, joined by ``sep``."""
    if n == 1:
        return items
    return let(
        items,
        lambda xs: F.transform(
            F.slice(xs, F.lit(1), F.greatest(F.size(xs) - (n - 1), F.lit(0))),
            lambda x, i: F.concat_ws(sep, x, *[F.get(xs, i + k) for k in range(1, n)]),
        ),
    )


# For a plain explode or inline Spark adds a filter on the array's size, which
# evaluates the array a second time. The outer forms are spared that; the rows
# they keep for empty arrays are dropped afterwards.


def exploded(df: DataFrame, keep: list, items: Column, name: str) -> DataFrame:
    """One row per non-null item."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def inlined(df: DataFrame, keep: list, structs: Column, never_null: str) -> DataFrame:
    """One row per struct, its fields as columns."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(never_null).isNotNull())
