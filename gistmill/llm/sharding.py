"""Longest-processing-time scheduling of groups onto shards.

The largest group goes first, each to the shard with the least load (ties to
the smaller number), from a heap. Groups of one size are alike, so the heap is
run over the table ``(size, number of groups)``. Different positive sizes that
add up to the table's bytes number fewer than the square root of twice those
bytes (15 million for 100 TB), so that table passes through one task as a
stream, largest first, with one load per shard as its only state. Which group
of a size goes where follows from its place among them, and a row's slot from
its place in its shard; both places are counted in hash cells, never over a
whole size or shard in one task. A group's rows are never brought together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm.graph import unused_name
from gistmill.session import written

CELLS = 64  # of a size's groups
SLOT_CELLS = 4096  # of a shard's rows


def take_least(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each shard gets; updates ``loads``.

    Same result as ``count`` steps of the heap: shard ``k`` takes its ``j``-th
    group when its load is ``loads[k] + j * size``, and the heap takes the
    smallest ``(load, shard)``. Beyond a few groups per shard the level below
    which all are taken is found by bisection.
    """
    n = len(loads)
    taken = [0] * n
    if count > 4 * n and size > 0:
        low, high = min(loads), max(loads) + size * count

        def below(level: int) -> int:
            return sum(max(0, -((load - level) // size)) for load in loads)

        while low < high:
            middle = (low + high + 1) // 2
            if below(middle) <= count:
                low = middle
            else:
                high = middle - 1
        taken = [max(0, -((load - low) // size)) for load in loads]
        count -= sum(taken)
        for k in range(n):
            loads[k] += taken[k] * size
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        loads[k] += size
        taken[k] += 1
    return taken


def _schedule(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [0] * shards
        for batch in batches:
            sizes, ends = batch.column("group_size"), []
            for size, count in zip(sizes.to_pylist(), batch.column("groups").to_pylist(), strict=True):
                total, upto = 0, []
                for k in take_least(loads, size, count):
                    total += k
                    upto.append(total)
                ends.append(upto)
            yield pa.RecordBatch.from_arrays(
                [sizes, pa.array(ends, pa.list_(pa.int64()))], names=["group_size", "ends"]
            )

    return run


def place_in(rows: DataFrame, group: str, cell: Column, order: list, out: str) -> DataFrame:
    """0-based place of each row in its group, counted cell by cell, so that no
    task sorts a whole group. Cells are numbered within a group."""
    cells = rows.withColumn("cell", cell)
    counts = cells.groupBy(group, "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(group, "cell").orderBy(*order))
    placed = cells.withColumn("within", within).join(starts, [group, "cell"])
    return placed.withColumn(out, F.col("start") + F.col("within") - 1).drop("cell", "start", "within")


def shard_groups(rows: DataFrame, shards: int) -> DataFrame:
    """``(group, shard)`` for a table ``(group, size)`` of rows."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("group_size"))
    groups = written(groups, "groups")
    sizes = groups.groupBy("group_size").agg(F.count("*").alias("groups"))
    ordered = sizes.repartition(1).sortWithinPartitions(F.desc("group_size"))
    plan = written(ordered.mapInArrow(_schedule(shards), "group_size bigint, ends array<bigint>"), "schedule")
    cell = F.pmod(F.xxhash64("group"), F.lit(CELLS))
    placed = place_in(groups, "group_size", cell, ["group"], "place").join(plan, "group_size")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int")
    return placed.select("group", shard.alias("shard"))


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and eight more for its frame."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("bigint")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row of ``docs``.

    Rows with equal texts stay together (a null text counts as an empty one; so
    do, harmlessly, texts with the same 64-bit hash). Shards' sizes come as near
    as the groups allow. Slots are gapless from 0 in each shard, in an order
    that repeats from run to run except among wholly equal rows. Null ids are
    placed like others; other columns are not read; an empty table gives an
    empty one.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        row_size(F.col(text_col)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    rows = written(rows, "rows")
    dealt = rows.join(shard_groups(rows, shards), "group")
    cell = F.pmod(F.xxhash64("doc_id", "group"), F.lit(SLOT_CELLS))
    placed = place_in(dealt, "shard", cell, ["doc_id", "group"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("bigint"))


def with_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """``docs`` with a column ``shard`` (``_shard`` where that is taken)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(row_size(F.col(text_col)).alias("size"), F.xxhash64(text).alias("group"))
    key, out = unused_name(docs, "group"), unused_name(docs, "shard")
    found = shard_groups(rows, shards).withColumnsRenamed({"group": key, "shard": out})
    return docs.withColumn(key, F.xxhash64(text)).join(found, key).drop(key)
