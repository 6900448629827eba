"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of the mix; a document of the source is expected
``target / source size`` times, the same for all. The whole part is granted;
the fraction is a probability, and rounding it keeps each source's words near
its target: two documents meet, words of expected mass go from one to the other
at random until one of them is in or out, and the other carries on. The draw
keeps every document's probability, and mass only moves, so a source's words
stay as they are until its last document is rounded.

Reduction tree: documents are dealt into blocks by hash, each block folds its
own and keeps one fraction, and the blocks' fractions are dealt into blocks
again until a source has one. Every level is a table in the shared folder. All
of it is column expressions; a fold holds one block of some dozens of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.graph import own_columns, unused_name
from gistmill.session import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 48
LARGE = 2  # times the mean size of the source
_ITEM = "struct<row_key:bigint,copy:bigint,size:bigint,mass:double>"


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``target`` for each row of a table ``(source, source_size, ...)``.

    Sources in the order of their code points, null last, weigh as ``weights``
    says, repeating. Together they get ``share`` times all sizes; none gets more
    than ``most`` times its own, the excess going to the others by weight. That
    ends where every source below its limit has the same words per weight, so
    one sort by limit per weight finds which are at theirs. One row per source
    passes through one task.
    """
    if share > most:
        raise ValueError("the share can't exceed what all sources may give")
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place)
    limit = F.col("source_size") * F.lit(float(most))
    known = sources.withColumn("weight", weight).withColumn("limit", limit)
    known = known.withColumn("order", F.col("limit") / F.col("weight"))
    by_limit = Window.orderBy("order", F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weigh = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # with all sources before this one at their limits, what a weight is worth
    known = known.withColumn("worth", rest / weigh)
    free = F.when(F.col("worth") <= F.col("order"), F.col("worth"))
    first = F.first(free, ignorenulls=True).over(
        by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least("limit", F.coalesce(first * F.col("weight"), F.col("limit")))
    return known.select(*sources.columns, target.alias("target"))


def _draw(*parts) -> Column:
    """A number from 0 up to 1 that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _fold(items: Column, seed: Column) -> Column:
    """Round the items of a block; returns ``(held, done)``: the one item left
    with a fraction (null if none) and ``(row_key, copy, up)`` of the others."""
    none = F.lit(None).cast(_ITEM)
    start = F.struct(
        none.alias("held"),
        F.expr("cast(array() as array<struct<row_key:bigint,copy:bigint,up:int>>)").alias("done"),
    )

    def settled(item: Column, up: Column) -> Column:
        one = F.struct(item["row_key"].alias("row_key"), item["copy"].alias("copy"), up.cast("int").alias("up"))
        return F.array(one)

    def with_mass(item: Column, mass: Column) -> Column:
        return F.struct(
            item["row_key"].alias("row_key"),
            item["copy"].alias("copy"),
            item["size"].alias("size"),
            mass.alias("mass"),
        )

    def step(acc: Column, b: Column) -> Column:
        a = acc["held"]
        give = F.least(a["mass"], b["size"] - b["mass"])  # from a to b
        take = F.least(b["mass"], a["size"] - a["mass"])  # from b to a
        gives = _draw(seed, a["row_key"], a["copy"], b["row_key"], b["copy"]) * (give + take) < take
        total = a["mass"] + b["mass"]
        # after giving, a is out or b is in; after taking, b is out or a is in
        a_out = gives & (a["mass"] <= b["size"] - b["mass"])
        b_out = ~gives & (b["mass"] <= a["size"] - a["mass"])
        b_in = gives & ~a_out
        b_stays = a_out | (~gives & ~b_out)  # a settles, b goes on
        left = F.when(a_out | b_out, total).when(b_in, total - b["size"]).otherwise(total - a["size"])
        pair = F.struct(
            F.when(b_stays, with_mass(b, left)).otherwise(with_mass(a, left)).alias("held"),
            F.concat(
                acc["done"],
                F.when(b_stays, settled(a, F.when(a_out, 0).otherwise(1))).otherwise(
                    settled(b, F.when(b_in, 1).otherwise(0))
                ),
            ).alias("done"),
        )
        alone = F.struct(b.alias("held"), acc["done"].alias("done"))
        whole = F.struct(
            a.alias("held"),
            F.concat(acc["done"], settled(b, F.when(b["mass"] <= 0, 0).otherwise(1))).alias("done"),
        )
        integral = (b["mass"] <= 0) | (b["mass"] >= b["size"])
        return F.when(integral, whole).when(a.isNull(), alone).otherwise(pair)

    return F.aggregate(items, start, step)


def round_masses(items: DataFrame, seed: int = 0) -> DataFrame:
    """``(row_key, copy, up)`` for ``(source, row_key, copy, size, mass)``.

    ``mass`` is size times probability; ``up`` is 1 for what is taken. Sums per
    source keep to the masses' sum but for the last item of the source.
    """
    most = items.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    done, level, blocks = None, 0, 0
    while blocks != 1:
        # as many blocks as the largest source needs at BLOCK rows each
        blocks = max(1, math.ceil(most / BLOCK))
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "row_key", "copy"), F.lit(blocks))
        item = F.struct("row_key", "copy", "size", "mass")
        folded = items.groupBy("source", block.alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
        folded = folded.select("source", _fold(F.col("items"), F.lit(seed * 64 + level)).alias("f"))
        folded = written(folded.select("source", "f.held", "f.done"), "rounded")
        out = folded.select(F.explode("done").alias("d")).select("d.*")
        done = out if done is None else done.unionByName(out)
        items = folded.where("held is not null").select("source", "held.*")
        most, level = blocks, level + 1
    draw = _draw(F.lit(seed), F.lit("last"), "row_key", "copy") * F.col("size") < F.col("mass")
    return done.unionByName(items.select("row_key", "copy", draw.cast("int").alias("up")))


def _large_first(items: DataFrame, seed: int) -> DataFrame:
    """Round the masses of large items, then those of the others.

    The last large item of a source leaves a difference of up to its size; the
    others' chances are shifted alike to make up for it (as far as a chance can
    be shifted), so that what is left over is at most the size of an item that
    is not large.
    """
    big, small = items.where("large").drop("large"), items.where("not large").drop("large")
    first = written(round_masses(big, 2 * seed), "large")
    missing = big.join(first, ["row_key", "copy"]).select(
        "source", (F.col("mass") - F.col("size") * F.col("up")).alias("missing")
    )
    owed = missing.groupBy("source").agg(F.sum(F.round("missing", 6)).alias("missing"))
    room = small.groupBy("source").agg(F.sum("size").alias("room"))
    shift = room.withColumnRenamed("source", "of").join(owed, F.col("of").eqNullSafe(F.col("source"))).select(
        "of", (F.col("missing") / F.col("room")).alias("shift")
    )
    # one row per source
    shifted = small.join(shift, small["source"].eqNullSafe(shift["of"]), "left")
    mass = F.col("mass") + F.col("size") * F.coalesce("shift", F.lit(0.0))
    bounded = F.greatest(F.lit(0.0), F.least(mass, F.col("size").cast("double")))
    rest = shifted.select("source", "row_key", "copy", "size", bounded.alias("mass"))
    return first.unionByName(round_masses(written(rest, "rest"), 2 * seed + 1))


def word_count(text: Column) -> Column:
    """Number of runs of characters outside space, tab, LF, VT, FF and CR."""
    blanks = [" ", *map(chr, range(9, 14))]
    pieces = F.size(F.split(text, r"[\x20\x09-\x0D]+"))  # blank ends give empty pieces
    ends = [F.substring(text, at, 1).isin(blanks).cast("int") for at in (1, -1)]
    count = F.when(text.isNull() | (text == ""), 0).otherwise(pieces - ends[0] - ends[1])
    return count.cast("bigint")


def _row_key(id_col: str, text_col: str, source_col: str) -> Column:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))
    return F.xxhash64(F.col(id_col), source, F.coalesce(F.col(text_col), F.lit("")))


def copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 0, **kw) -> DataFrame:
    """``(doc_id, source, row_key, size, source_size, target, copies)`` per row.

    Size is the number of words of the text (null: 0). No row gets more copies
    than ``most`` rounded up, which for whole numbers is ``most``. Rows without
    words have no mass to move and get the whole part of the expectation. Equal
    rows are told apart by a number, so that their draws differ. A null source
    is a source of its own. A source without words has target 0. Other columns
    are not read. An empty table gives an empty one.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        _row_key(id_col, text_col, source_col).alias("row_key"),
        word_count(F.col(text_col)).alias("size"),
    )
    alike = written(rows.groupBy("doc_id", "source", "row_key", "size").agg(F.count("*").alias("n")), "sizes")
    sources = alike.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")
    )
    renamed = written(targets(sources, **kw), "targets").withColumnRenamed("source", "of")
    known = alike.join(renamed, alike["source"].eqNullSafe(renamed["of"])).drop("of")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = known.withColumn("whole", F.floor(expected)).withColumn("part", expected - F.floor(expected))
    each = known.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    mass = F.col("size") * F.col("part")
    items = each.where("size > 0").select(
        "source",
        "row_key",
        "copy",
        "size",
        mass.alias("mass"),
        (F.col("size") * F.col("rows") > LARGE * F.col("source_size")).alias("large"),
    )
    rounded = _large_first(items, seed)
    joined = each.join(rounded, ["row_key", "copy"], "left")
    total = (F.col("whole") + F.coalesce(F.col("up"), F.lit(0))).cast("bigint")
    return joined.select("doc_id", "source", "row_key", "copy", "size", "source_size", "target", total.alias("copies"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 0, **kw) -> DataFrame:
    """``docs`` as mixed: each row as often as it was drawn. Of equal rows with
    different draws any takes any of the draws; their sum is what was drawn."""
    drawn = copies(docs, id_col, text_col, source_col, seed, **kw)
    key, times = unused_name(docs, "row_key"), unused_name(docs, "times")
    # of equal rows one stands for all; a draw counts for it alone
    total = drawn.groupBy("row_key").agg(F.sum("copies").alias(times))
    total = total.where(F.col(times) > 0).select(F.col("row_key").alias(key), times)
    own = _row_key(id_col, text_col, source_col)
    kept = docs.withColumn(key, own).join(total, key).dropDuplicates([key])
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))
    return kept.withColumn(times, again).select(*own_columns(docs))
