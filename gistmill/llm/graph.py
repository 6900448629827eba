"""Connected components of a table of links, and names for added columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.session import used_up, written

FILE_ROWS = 500_000


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it new to ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` as they are named, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, root)``: the smallest node of each node's component.

    Alternates two steps until nothing changes: each node's larger neighbours,
    then its smaller ones, move to its smallest neighbour. A node's neighbours
    are never gathered: smallest neighbours combine map-side and reach the
    links by a join whose skewed keys adaptive execution splits. Every round is
    written to the shared folder. Nodes without links are not listed.
    """
    pairs = links.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
    now, seen = written(pairs.distinct(), "links"), None
    while True:  # tables of the rounds before are deleted as they are used up
        rows, mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (rows, mark) == seen or rows == 0:
            break
        seen = (rows, mark)
        # rounds shrink to few rows; they are stored in files of about equal size
        files = max(1, math.ceil(2 * rows / FILE_ROWS))
        both = now.select(F.explode(F.array(_pair("a", "b"), _pair("b", "a"))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.coalesce(files), "larger")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        two = F.explode(F.array(_pair("b", "m"), _pair("a", "m"))).alias("e")
        moved = large.join(down, "a").select(two).select("e.*").where("a != b").distinct()
        before, now = now, written(moved.coalesce(files), "links")
        used_up(before, large)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _pair(a: str, b: str):
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
