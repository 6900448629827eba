"""Cut-offs, filters, splits and reshaping of pair tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from gistmill.operators.order import hash_slices, kth_hash, md5_of
from gistmill.session import written

SEED = 22
BINS = ("abstractive", "mixed", "extractive")


def length_bounds(
    df: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98
) -> DataFrame:
    """One row: a struct ``(lo, hi)`` per column, interpolated quantiles."""

    def bounds(name: str) -> Column:
        q = F.percentile(name, F.array(F.lit(low), F.lit(high)))
        return F.struct(q[0].alias("lo"), q[1].alias("hi")).alias(name)

    return df.agg(*[bounds(c) for c in columns])


def quantile_cutoff(
    df: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98
) -> DataFrame:
    """Rows whose every length lies within the quantiles of all rows."""
    # One subquery for all columns, so the table is read once for the bounds.
    bounds = length_bounds(df, columns, low, high).select(F.struct(*columns)).scalar()

    def within(name: str) -> Column:
        lo, hi = bounds[name]["lo"], bounds[name]["hi"]
        kind = df.schema[name].dataType
        if isinstance(kind, IntegralType):
            # The same rows, compared in the column's own type.
            lo, hi = F.ceil(lo).cast(kind), F.floor(hi).cast(kind)
        return F.col(name).between(lo, hi)

    return df.where(reduce(Column.__and__, [within(c) for c in columns]))


def density_filter(df: DataFrame, limit: float = 1.5, column: str = "density") -> DataFrame:
    return df.where(F.col(column) <= limit)


def passed_filter(df: DataFrame, quality_filter: bool = True) -> DataFrame:
    return df.where(F.col("passed")) if quality_filter else df


def summary_type_filter(df: DataFrame, types: Sequence[str] = ("abstractive",)) -> DataFrame:
    """Drop mixed and extractive pairs unless listed. For the training split."""
    dropped = [t for t in ("mixed", "extractive") if t not in types]
    if not dropped:
        return df
    return df.where(~F.coalesce(F.col("density_bin").isin(*dropped), F.lit(False)))


def not_null(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(*keep)


def both_passed() -> Column:
    flags = F.col("passed_quality") & F.col("passed_quality_sum")
    return F.coalesce(flags, F.lit(False))


def exact_split(
    df: DataFrame, key: str, bin_col: str = "density_bin", seed: int = SEED
) -> DataFrame:
    """Add ``split``: exact sizes, reproducible.

    The test size is a tenth of the abstractive rows for every bin; validation
    rows come from the abstractive bin only. Rows are ordered by a hash of
    their unique key. Only the few hashes at which a split ends are looked up,
    so texts are never shuffled.
    """
    digest = md5_of(F.col(key), str(seed))
    hashed = df.select(F.col(bin_col), digest.alias("_digest"))
    hashed = hashed.where(F.col(bin_col).isin(*BINS))
    # Three bins by 4,096 slices: stored, since every step below reads them.
    slices = written(hash_slices(hashed, bin_col, "_digest"), "slices")
    sizes = slices.groupBy(bin_col).agg(F.sum("n").alias("n"))
    abstractive = F.sum(F.when(F.col(bin_col) == "abstractive", F.col("n")).otherwise(0))
    tenth = sizes.agg(F.bround(abstractive / 10).cast("long")).scalar()
    ends = sizes.select(
        bin_col,
        F.inline(
            F.array(
                F.struct(F.lit("test").alias("name"), tenth.alias("k")),
                F.struct(F.lit("validation").alias("name"), (tenth * 2).alias("k")),
            )
        ),
    )
    cuts = kth_hash(hashed, slices, bin_col, "_digest", ends)
    wide = cuts.groupBy(bin_col).agg(
        F.max(F.when(F.col("name") == "test", F.col("cut"))).alias("_test"),
        F.max(F.when(F.col("name") == "validation", F.col("cut"))).alias("_validation"),
    )
    limits = sizes.select(bin_col, tenth.alias("_tenth")).join(wide, bin_col, "left")
    # "g" sorts after every hex digest: a bin smaller than the size asked for
    # goes to that split whole. A size of 0 selects nothing.
    upto = lambda cut: F.when(F.col("_tenth") == 0, F.lit("")).otherwise(
        F.coalesce(F.col(cut), F.lit("g"))
    )
    split = (
        F.when(~F.coalesce(F.col(bin_col).isin(*BINS), F.lit(False)), F.lit(None))
        .when(F.col("_d") <= upto("_test"), "test")
        .when((F.col(bin_col) == "abstractive") & (F.col("_d") <= upto("_validation")), "validation")
        .otherwise("train")
    )
    return (
        df.withColumn("_d", digest)
        .join(F.broadcast(limits), bin_col, "left")
        .withColumn("split", split)
        .drop("_d", "_tenth", "_test", "_validation")
    )


def concatenate(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, columns matched by name, nothing deduplicated."""
    return reduce(DataFrame.unionByName, tables)


def labelled_union(tables: dict[str, DataFrame], label: str = "type") -> DataFrame:
    return concatenate(*[t.withColumn(label, F.lit(name)) for name, t in tables.items()])


def reshape(
    df: DataFrame,
    add: dict[str, Column] | None = None,
    drop: Sequence[str] = (),
    rename: dict[str, str] | None = None,
    order: Sequence[str] = (),
    names: Sequence[str] = (),
) -> DataFrame:
    """Name by position, add, drop, rename, then bring columns into order, in
    that sequence. ``names`` has one for every column."""
    named = df.toDF(*names) if names else df
    out = named.withColumns(add or {}).drop(*drop).withColumnsRenamed(rename or {})
    return out.select(*order, *[c for c in out.columns if c not in order])


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct columns to any depth become top-level columns with joined names."""

    def leaves(schema: StructType, path: tuple[str, ...]) -> Iterator[Column]:
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*leaves(df.schema, ()))


def batched_map(
    df: DataFrame, fn: Callable, schema: StructType | str, batch_size: int | None = None
) -> DataFrame:
    """Apply ``fn`` (pandas frame to pandas frame) to batches of rows. Batches
    are of at most ``batch_size`` rows, else as large as the session sets."""

    def run(batches):
        for frame in batches:
            step = batch_size or max(len(frame), 1)
            for at in range(0, len(frame), step):
                yield fn(frame.iloc[at : at + step])

    return df.mapInPandas(run, schema)
