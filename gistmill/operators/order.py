"""Ranks and cut-offs over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.session import written

PREFIX = 3  # hex digits at a time: 4,096 slices of the hash range
SLICE_ROWS = 100_000  # most rows that are ranked in one task


def md5_of(*parts: Column | str) -> Column:
    """Hash of the parts joined by ':'; the same in every engine."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def hash_to_long(digest: Column) -> Column:
    """First 15 hex digits as a non-negative long."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def hash_slices(df: DataFrame, group: str, digest: str) -> DataFrame:
    """``(group, prefix, n)``: rows per slice of the hash range, at most 4,096
    per group. Counting combines map-side, however large a group is."""
    prefix = F.substring(digest, 1, PREFIX).alias("prefix")
    return df.groupBy(F.col(group), prefix).agg(F.count("*").alias("n"))


def _holding(slices: DataFrame, group: str) -> DataFrame:
    """``(group, name, k, prefix, n)``: for each cut the slice it falls in, how
    many rows that has, and ``k`` counted from the slice's start."""
    keys = [group, "name"]
    running = Window.partitionBy(*keys).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    upto = slices.withColumn("upto", F.sum("n").over(running)).withColumn("rest", F.col("k") - F.col("upto") + F.col("n"))
    held = upto.where((F.col("k") <= F.col("upto")) & (F.col("rest") > 0))
    return held.select(*keys, F.col("rest").alias("k"), "prefix", "n")


def kth_hash(df: DataFrame, slices: DataFrame, group: str, digest: str, ks: DataFrame) -> DataFrame:
    """``(group, name, cut)``: the ``k``-th smallest digest of each group.

    ``ks`` holds ``(group, name, k)``, a few rows per group. The slice counts
    tell which slice holds each cut; slices of more than ``SLICE_ROWS`` rows are
    counted again by their next hex digits, so that at any size of table only a
    small one is ranked.
    """
    held = written(_holding(slices.join(ks, group), group), "cuts")
    length = PREFIX
    while length < 30 and (held.agg(F.max("n")).first()[0] or 0) > SLICE_ROWS:
        inside = df.select(group, digest, F.substring(digest, 1, length).alias("prefix"))
        inside = inside.join(F.broadcast(held.drop("n")), [group, "prefix"])
        length += PREFIX
        finer = inside.groupBy(group, "name", "k", F.substring(digest, 1, length).alias("prefix"))
        held = written(_holding(finer.agg(F.count("*").alias("n")), group), "cuts")
    place = F.row_number().over(Window.partitionBy(group, "name").orderBy(digest))
    return (
        df.select(group, digest, F.substring(digest, 1, length).alias("prefix"))
        .join(F.broadcast(held), [group, "prefix"])
        .withColumn("place", place)
        .where(F.col("place") == F.col("k"))
        .select(group, "name", F.col(digest).alias("cut"))
    )


def dense_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """0-based position of each row in the order of a unique ``key``, whatever
    its type; a null key comes first.

    Rows are dealt out by ranges of the key; a row's index is the size of the
    ranges before its own plus its place in it. The dealt table is stored, so
    that both are read from the same ranges.
    """
    slice_ = F.spark_partition_id().alias("_slice")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = written(df.repartitionByRange(parts, key).select("*", slice_), "ranges")
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice, so this window and the broadcast stay tiny.
    offsets = counts.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(key))
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumn(out, place + F.col("_before") - 1)
        .drop("_slice", "_before")
    )
