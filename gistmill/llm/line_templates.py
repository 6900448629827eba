"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its leading
tokens, those with a digit as ``<*>``. Two lines of a leaf agree if enough
positions are equal, variable ones too, and a word is among them.
Lines that are linked by such pairs are one template, whatever the order and
number of the leaf's lines. Lines of templates that recur in many documents are
dropped from all of them.

Equal lines (after masking) are counted before anything is gathered, with
map-side combining. Only leaves that hold several different lines, and enough
documents, need the lines' text. No task holds more than two blocks of bounded
size; links between blocks become templates as connected components.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gistmill.llm.bits import bitmap, in_bitmap
from gistmill.llm.graph import components, own_columns, unused_name
from gistmill.session import written

DEPTH = 3
SIMILAR = 0.7
MIN_DOCS = 10
PART = 2048  # lines of a leaf that are compared at once
WORDS = 1 << 22  # and their tokens
PIVOTS = 64
LEAF_BITS = 24
VARIABLE = "<*>"
_DIGIT = re.compile(r"\d")


def masked(line: str) -> list[str]:
    """Tokens of a line; those with a digit are variable."""
    tokens = line.split()
    if _DIGIT.search(line):
        tokens = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return tokens


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def path_of(tokens: list[str], depth: int) -> int:
    """Hash of a line's way down the tree."""
    return _signed(xxhash.xxh64_intdigest("\0".join([str(len(tokens)), *tokens[:depth]])))


def line_of(tokens: list[str]) -> int:
    return _signed(xxhash.xxh64_intdigest("\0".join(tokens)))


class Leaf:
    """Lines of a leaf, tokens as numbers, 0 for a variable one, and the groups
    that their links make: a line is linked with all that agree with it."""

    def __init__(self, similar: float):
        self.similar, self.numbers, self.rows = similar, {VARIABLE: 0}, None
        self.names, self.group, self.links = [], None, []

    def add(self, tokens: list[str], name: int) -> int:
        """Name of the first line of the group that the line joins, or its own.
        ``links`` gets what ties it to each group it meets."""
        own, n = np.array([self.numbers.setdefault(t, len(self.numbers)) for t in tokens], np.int32), len(self.names)
        if self.rows is None:
            self.rows, self.group = np.zeros((4, len(own)), np.int32), np.zeros(4, np.int64)
        elif n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.group = np.concatenate([self.group, np.zeros_like(self.group)])
        equal, label = self.rows[:n] == own, n
        # variable on both sides is equal, but some word must be shared
        hits = np.flatnonzero((equal.sum(1) >= self.similar * len(own)) & (equal & (own != 0)).any(1))
        if len(hits):
            met, first = np.unique(self.group[hits], return_index=True)
            label = int(met[0])
            self.links += [(name, self.names[i]) for i in hits[first].tolist()]
            if len(met) > 1:
                self.group[:n][np.isin(self.group[:n], met)] = label
        self.rows[n], self.group[n] = own, label
        self.names.append(name)
        return self.names[label]


def _parsed(depth: int):
    @F.arrow_udf("array<struct<leaf:bigint,line:bigint,first:boolean>>")
    def parsed(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            seen, out = set(), []
            for line in (text.as_py() or "").split("\n"):
                tokens = masked(line)
                if not tokens:
                    out.append(None)
                    continue
                h = line_of(tokens)
                out.append({"leaf": path_of(tokens, depth), "line": h, "first": h not in seen})
                seen.add(h)
            rows.append(out)
        return pa.array(rows, pa.list_(pa.struct([("leaf", pa.int64()), ("line", pa.int64()), ("first", pa.bool_())])))

    return parsed


def _lines_in(bits, depth: int):
    """The lines of a text, once each, whose leaves are in a bitmap."""

    @F.arrow_udf("array<struct<leaf:bigint,line:bigint,words:string>>")
    def lines(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            out = {}
            for line in set((text.as_py() or "").split("\n")):
                tokens = masked(line)
                if tokens:
                    out[line_of(tokens)] = (path_of(tokens, depth), " ".join(tokens))
            leaves = np.array([leaf for leaf, _ in out.values()], np.int64).view(np.uint64)
            kept = in_bitmap(bits.value, leaves)
            rows.append(
                [{"leaf": leaf, "line": h, "words": w} for (h, (leaf, w)), k in zip(out.items(), kept, strict=True) if k]
            )
        kind = pa.struct([("leaf", pa.int64()), ("line", pa.int64()), ("words", pa.string())])
        return pa.array(rows, pa.list_(kind))

    return lines


def _bands(depth: int, similar: float):
    """Hashes of runs of a line's tokens past the leading ones, one run more
    than tokens may differ: lines that agree have one of them in common."""

    @F.arrow_udf("array<bigint>")
    def bands(lines: pa.Array) -> pa.Array:
        rows = []
        for line in lines:
            tokens = line.as_py().split(" ")
            n = len(tokens)
            left, many = max(n - depth, 0), n - math.ceil(similar * n) + 1
            # where all that is left may differ, the leaf is the only run
            cuts = [depth + left * i // many for i in range(many + 1)] if many <= left else [n, n]
            runs = zip(cuts[:-1], cuts[1:], strict=True)
            rows.append([line_of([str(i), *tokens[a:b]]) for i, (a, b) in enumerate(runs)])
        return pa.array(rows, pa.list_(pa.int64()))

    return bands


def _linked(lines: DataFrame, similar: float, key: list[str]) -> DataFrame:
    """Links ``(u, v)`` that tie together the lines ``(line, words)`` which agree
    among those with equal columns of ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaf = None, Leaf(similar)

        def close():
            u, v = zip(*leaf.links, strict=True) if leaf.links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            parts = zip(*[batch.column(c).to_pylist() for c in key], strict=True)
            for here, line, text in zip(parts, *[batch.column(c).to_pylist() for c in ("line", "words")], strict=True):
                if here != at:
                    yield close()
                    at, leaf = here, Leaf(similar)
                leaf.add(text.split(" "), line)
        yield close()

    dealt = lines.select(*key, "line", "words").repartition(*key).sortWithinPartitions(*key, "line")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _links(texts: DataFrame, depth: int, similar: float) -> DataFrame:
    """Links that tie together all lines ``(leaf, line, words, kinds)`` of a leaf
    which agree, whatever else the leaf holds.

    A task compares at most twice ``room`` lines and some pivots. A leaf of more is taken apart
    by the bands of its lines, and a band of more is dealt into blocks: each
    with some pivots of the whole band, which ties most groups together, then
    pairs of blocks that hold lines of different groups.
    """
    room = F.greatest(F.lit(1), F.least(F.lit(PART), F.floor(F.lit(WORDS) / F.size(F.split("words", " ")))))
    texts = texts.withColumn("room", room.cast("bigint"))
    links = _linked(texts.where("kinds <= room"), similar, ["leaf"])
    wide = texts.where("kinds > room")
    if wide.isEmpty():
        return written(links, "links")
    keys = written(wide.select("leaf", "room", "line", F.explode(_bands(depth, similar)("words")).alias("band")), "bands")
    sizes = keys.groupBy("leaf", "band").agg(F.count("*").alias("size"), F.max("room").alias("most"))
    sizes = written(sizes.where("size > 1").withColumn("blocks", F.ceil(F.col("size") / F.col("most"))), "sizes")
    met = keys.drop("room").join(sizes, ["leaf", "band"])
    met = met.withColumn("part", F.pmod(F.xxhash64("line"), F.col("blocks")))
    low = F.shiftrightunsigned(F.xxhash64("line", F.lit(1)), 11).cast("double") / float(1 << 53) < PIVOTS / F.col("size")
    every = F.when(low & (F.col("blocks") > 1), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    met = met.withColumn("part", F.explode(F.coalesce(every, F.array("part"))))
    met = met.select("leaf", "band", "part", "line").join(wide.select("line", "words"), "line")
    links = written(links.unionByName(_linked(met, similar, ["leaf", "band", "part"])), "links")

    hot = keys.drop("room").join(sizes.where("blocks > 1"), ["leaf", "band"])
    if hot.isEmpty():
        return links
    roots = components(links).withColumnRenamed("node", "line")
    hot = hot.join(roots, "line", "left").withColumn("root", F.coalesce("root", "line"))
    own = hot.groupBy("leaf", "band", "root").agg(F.count("*").alias("own"))
    hot = hot.join(own, ["leaf", "band", "root"])
    # a group of many lines has blocks of its own, the others share some
    alone = F.col("own") > F.col("most")
    part = F.when(alone, F.pmod(F.xxhash64("line"), F.ceil(F.col("own") / F.col("most"))))
    shared = F.pmod(F.xxhash64("root"), F.ceil(F.col("size") / F.col("most")))
    hot = hot.withColumn("single", F.when(alone, F.col("root")))
    hot = hot.withColumn("block", F.struct("single", F.coalesce(part, shared).alias("part")))
    hot = written(hot.select("leaf", "band", "line", "single", "block"), "blocks")
    blocks = hot.select("leaf", "band", "single", "block").distinct()
    one, two = (blocks.withColumnsRenamed({"single": f"single_{x}", "block": f"block_{x}"}) for x in "ab")
    pairs = one.join(two, ["leaf", "band"]).where("block_a <= block_b and not (single_a <=> single_b and single_a is not null)")
    pairs = pairs.select("leaf", "band", F.struct("block_a", "block_b").alias("pair"), F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    pairs = pairs.withColumn("pair", F.to_json("pair"))
    met = hot.select("leaf", "band", "line", "block").join(pairs, ["leaf", "band", "block"])
    met = met.select("leaf", "band", "pair", "line").join(wide.select("line", "words"), "line")
    return written(links.unionByName(_linked(met, similar, ["leaf", "band", "pair"])), "links")


def line_templates(
    docs: DataFrame, text_col: str = "text", depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS
):
    """``(lines, recurring)``: the lines ``(row_key, pos, leaf, line, first)`` of
    all texts, and ``(leaf, line, template, docs)`` of those whose template is in
    at least ``min_docs`` documents."""
    spark = docs.sparkSession
    every = docs.select("row_key", F.posexplode(_parsed(depth)(F.col(text_col))).alias("pos", "l"))
    lines = written(every.where("l is not null").select("row_key", "pos", "l.*"), "lines")
    once = lines.where("first").select("leaf", "line", "row_key").distinct()
    counts = once.groupBy("leaf", "line").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    leaves = counts.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"))
    leaves = written(leaves.where((F.col("kinds") > 1) & (F.col("total") >= min_docs)), "leaves")

    bits = spark.sparkContext.broadcast(bitmap(leaves.select("leaf"), LEAF_BITS))
    told = docs.select(F.explode(_lines_in(bits, depth)(F.col(text_col))).alias("l")).select("l.*")
    texts = told.groupBy("leaf", "line").agg(F.min("words").alias("words")).join(leaves, "leaf")
    texts = written(texts.select("leaf", "line", "words", "kinds"), "texts")
    named = components(_links(texts, depth, similar)).select(F.col("node").alias("line"), F.col("root").alias("template"))
    named = written(counts.select("leaf", "line").join(named, "line").select("leaf", "line", "template"), "named")

    # linked with no other: the line is the template
    alone = counts.where(F.col("n") >= min_docs).join(named, ["leaf", "line"], "left_anti")
    alone = alone.select("leaf", "line", F.col("line").alias("template"), F.col("n").alias("docs"))
    held = lines.where("first").join(named, ["leaf", "line"]).select("leaf", "template", "row_key").distinct()
    many = held.groupBy("leaf", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    shared = named.join(many, ["leaf", "template"]).select("leaf", "line", "template", "docs")
    return lines, written(alone.unionByName(shared), "recurring")


@F.arrow_udf(StringType())
def _without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts, dropped, strict=True):
        gone = set(gone.as_py() or ())
        t = text.as_py()
        if t is not None and gone:
            t = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)
        out.append(t)
    return pa.array(out, pa.string())


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` (underscored
    where taken).

    A text that is null stays null with no lines; lines without tokens are kept
    and count as lines. A line counts for a document once. Rows equal in id and
    text count as one document and get equal results, null ids as others. Very
    long lines and texts are parsed whole; an empty table stays empty.
    """
    key = unused_name(docs, "row_key")
    tagged = docs.withColumn(key, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    base = tagged.select(F.col(key).alias("row_key"), F.col(text_col).alias("text"))
    lines, recurring = line_templates(base, **kw)
    gone = lines.join(recurring, ["leaf", "line"]).groupBy("row_key").agg(F.collect_set("pos").alias("gone"))
    drop = unused_name(docs, "gone")
    names = [unused_name(docs, n) for n in ("kept_text", "n_lines", "n_dropped")]
    found = tagged.join(gone.withColumnsRenamed({"row_key": key, "gone": drop}), key, "left")
    text = F.col(text_col)
    return found.select(
        *own_columns(docs),
        _without(text, F.col(drop)).alias(names[0]),
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("bigint").alias(names[1]),
        F.coalesce(F.size(drop), F.lit(0)).cast("bigint").alias(names[2]),
    )
