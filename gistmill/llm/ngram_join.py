"""N-gram Jaccard join by signature trees, and the groups it links.

1. *Candidates by pigeonhole.* Two sets with a Jaccard similarity of at least
   ``t`` differ in at most ``(1 - t) / (1 + t)`` of their sizes' sum. The range
   of hashes is cut into more parts than that, so some part of both is equal;
   a key is the hash of a set's share of a part. Sets meet only in equal size
   classes (a set near a class's upper end also counts as a guest of the next).
   No pair within the threshold is lost, and none is emitted. Shingles that a
   sample shows to be common are left out of the parts, else documents that
   share a passage would meet for that alone; this too loses no pair (see
   ``Threshold.keys``). Keys are counted with map-side combining; the repeated
   ones go into a bitmap in proportion to their number, and only rows at
   repeated keys are shuffled again, as stars around the key's smallest set.
2. *Signature trees over signatures.* The sets of all keys with one hub meet as
   bitmaps, half a byte an element, in blocks. A tree over each block holds in
   its nodes the OR of the bitmaps, the range of sizes, and the most elements
   that share a bit with another; dual traversal drops node pairs whose greatest
   possible overlap is below the threshold. Sets that met for a shared passage
   part here, before anything is closed transitively.
3. *Signature trees over sets.* What is left is closed to candidate groups, whose
   texts are shuffled once, to blocks again. There the same traversal, without
   sets linked already, ends in verification on the exact sets.
4. Links become groups (``graph.components``). Equal sets are one class from the
   start, so copies, however many, are never paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gistmill.llm.bits import bitmap, in_bitmap
from gistmill.llm.graph import components, own_columns, unused_name
from gistmill.llm.words import as_long, mix, shingle_sets, white_space_words
from gistmill.session import small_batches, used_up, written

CLASS_GROWTH = 1.5
BLOCK, SIGNATURE_BLOCK = 512, 1024
FAN = 8
# Bits of a filter for each key in it, and the most bits that are broadcast: 2**30
# are 128 MB. Beyond, rows and keys meet in a join.
FILTER_BITS, FILTER_MOST = 16, 30
# Shingles in at least SEEN of about SAMPLE texts are common; COMMON at most, 8 MB.
SAMPLE, SEEN, COMMON = 8_000, 3, 1 << 20


class Threshold:
    """Jaccard similarity of at least ``num / den``."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be over 0 and at most 1")
        self.num, self.den = num, den

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.num * max(len(a), len(b)) > self.den * min(len(a), len(b)):
            return False
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * shared >= self.num * (len(a) + len(b) - shared)

    def apart(self, total: int) -> int:
        """Most elements in which two sets of ``total`` elements can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def size_class(self, n: int) -> int:
        return int(math.floor(math.log(n) / math.log(CLASS_GROWTH) + 1e-9))

    def parts(self, cls: int) -> tuple[int, int]:
        return _parts(self.num, self.den, cls)

    def keys(self, elements: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """Keys of a sorted set.

        ``common`` are elements, sorted, that say little about likeness. Keys
        are of the parts of the other elements, in which two linked sets differ
        no more than as a whole. Empty parts have no key, so a set of which too
        few parts are left for the pigeonhole principle has keys of all its
        elements too; two linked sets share a key of the first kind unless both
        are such sets.
        """
        n = len(elements)
        rare = elements
        if common is not None and len(common) and n:
            at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
            rare = elements[common[at] != elements]
        if not n:
            return np.zeros(0, np.uint64)
        classes, out = [self.size_class(n)], []
        while self.den * n >= self.num * math.floor(CLASS_GROWTH ** (classes[-1] + 1)):
            classes.append(classes[-1] + 1)
        for c in classes:
            m, d = self.parts(c)
            used, key = _part_keys(rare, m, 2 * c)
            out.append(key)
            if len(used) > d:
                continue
            used, key = _part_keys(elements, m, 2 * c + 1)
            out.append(key)
            if len(used) <= d:  # equal empty parts may be all that is equal
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), used)
                out.append(mix(empty * np.uint64(2) + _seed(2 * c + 1)))
        return np.concatenate(out)


def _seed(kind: int) -> np.uint64:
    return np.uint64((kind + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _part_keys(elements: np.ndarray, m: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and keys of the parts that are not empty. Elements are sorted, so
    a part is a run of them."""
    if not len(elements):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    part = ((elements >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(part, prepend=np.uint64(m + 1)))
    used = part[first]
    return used, mix(np.add.reduceat(mix(elements), first) + mix(used * np.uint64(2) + _seed(kind)))


@cache
def _parts(num: int, den: int, cls: int) -> tuple[int, int]:
    """Parts of a class and the differences that two of its sets can have.

    Beyond one more part than differences there are as many as are likely to be
    empty, since equal empty parts say nothing.
    """
    lowest = max(1, math.ceil(0.9 * CLASS_GROWTH**cls * num / den - 1e-6))
    d = Threshold(num, den).apart(2 * math.ceil(CLASS_GROWTH ** (cls + 1)))
    m = d + 1
    for _ in range(4):
        empty = m * math.exp(-lowest / m)
        m = d + 1 + (math.ceil(empty + 3 * math.sqrt(empty)) if empty > 0.01 else 0)
    return m, d


# --- signature trees ----------------------------------------------------------


def signature(elements: np.ndarray, words: int | None = None) -> np.ndarray:
    """Bitmap of the elements' lowest bits, as 64-bit words; by default about
    four bits an element. Halves of a bitmap ORed are the bitmap of half its size."""
    if words is None:
        words = 1 << max(0, math.ceil(math.log2(max(1, 4 * len(elements)) / 64)))
    flags = np.zeros(words * 64, bool)
    flags[(elements & np.uint64(words * 64 - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class SignatureTree:
    """Levels of nodes over one block's sets, leaves first."""

    def __init__(self, sizes: np.ndarray, smallest: np.ndarray, bits: np.ndarray):
        # neighbours in size and in smallest element share much
        self.order = np.lexsort((smallest, sizes))
        bits, size = bits[self.order], sizes[self.order]
        extra = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, extra)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(extra, at),
                )
            )


def candidate_pairs(x: SignatureTree, y: SignatureTree, t: Threshold) -> np.ndarray:
    """Pairs of positions whose overlap the signatures don't rule out."""
    pairs = np.zeros((1, 2), np.int64)
    dx, dy = len(x.levels) - 1, len(y.levels) - 1
    step = max(16, (1 << 20) // x.levels[0][0].shape[1])
    while True:
        kept = []
        bx, lx, hx, ex = x.levels[dx]
        by, ly, hy, ey = y.levels[dy]
        for a in range(0, len(pairs), step):
            i, j = pairs[a : a + step].T
            fits = (t.num * lx[i] <= t.den * hy[j]) & (t.num * ly[j] <= t.den * hx[i])
            i, j = i[fits], j[fits]
            most = np.bitwise_count(bx[i] & by[j]).sum(1).astype(np.int64) + np.minimum(ex[i], ey[j])
            fits = (t.num + t.den) * most >= t.num * (lx[i] + ly[j])
            kept.append(np.stack([i[fits], j[fits]], 1))
        pairs = np.concatenate(kept)
        if not len(pairs) or dx == dy == 0:
            return pairs
        grow_x, grow_y = dx > 0 and dx >= dy, dy > 0 and dy >= dx
        i, j = pairs.T
        if grow_x:
            dx -= 1
            i, j = _children(i, j, len(x.levels[dx][0]))
        if grow_y:
            dy -= 1
            j, i = _children(j, i, len(y.levels[dy][0]))
        pairs = np.stack([i, j], 1)


def _children(nodes: np.ndarray, others: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    down = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    return down[down < n], np.repeat(others, FAN)[down < n]


def _tree_of(sets: list[np.ndarray], words: int) -> SignatureTree:
    sizes, smallest = np.array([len(s) for s in sets]), np.array([s[0] for s in sets])
    return SignatureTree(sizes, smallest, np.stack([signature(s, words) for s in sets]))


def possible_links(sides: list[tuple], t: Threshold) -> list[tuple[int, int]]:
    """Links that connect all sets which the signatures let be alike. A side is
    ``(nodes, sizes, smallest elements, bitmaps)``; one side is paired with itself."""
    if any(not side[0] for side in sides) or sum(len(side[0]) for side in sides) < 2:
        return []
    words = min(len(b) for side in sides for b in side[3])
    trees = [
        SignatureTree(np.array(sizes), np.array(low, np.uint64), np.stack([folded(b, words) for b in bits]))
        for _, sizes, low, bits in sides
    ]
    x, y = trees[0], trees[-1]
    pairs = candidate_pairs(x, y, t)
    u, v = x.order[pairs[:, 0]], y.order[pairs[:, 1]]
    nodes = np.array(sides[0][0])
    if len(sides) > 1:
        v, nodes = v + len(nodes), np.concatenate([nodes, sides[1][0]])
    # smallest place that pairs lead to, until nothing changes
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(root)))
    return list(zip(nodes[moved].tolist(), nodes[root[moved]].tolist(), strict=True))


def tree_links(xs: list[np.ndarray], ys: list[np.ndarray] | None, t: Threshold) -> list[tuple[int, int]]:
    """Links that connect whatever links between ``xs`` and ``ys`` (or within
    ``xs``) connect; positions of ``ys`` follow those of ``xs``."""
    if not xs or (ys is not None and not ys):
        return []
    most = max(len(s) for s in [*xs, *(ys or [])])
    words = min(1 << 11, max(8, 1 << max(0, math.ceil(math.log2(8 * most / 64)))))
    x = _tree_of(xs, words)
    y = _tree_of(ys, words) if ys is not None else x
    shift = len(xs) if ys is not None else 0
    pairs = candidate_pairs(x, y, t)
    if ys is None:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    parent = list(range(len(xs) + (len(ys) if ys is not None else 0)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in pairs.tolist():
        a, b = int(x.order[i]), int(y.order[j]) + shift
        ra, rb = root(a), root(b)
        if ra != rb and t.linked(xs[a], (xs if ys is None else ys)[b - shift]):
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


# --- the join on Spark --------------------------------------------------------


def _common(base: DataFrame, words: int) -> np.ndarray:
    """Shingles in several texts of a bounded sample: those of lines and
    passages that many texts share. They steer which sets are compared, never
    which are linked. At most ``COMMON`` of them reach the driver."""
    n = base.count()
    text_key = F.xxhash64("text")
    place = F.shiftrightunsigned(text_key, 11).cast("double") / float(1 << 53)
    sample = base.where(place < min(1.0, SAMPLE / max(n, 1))).select("text", text_key.alias("k"))
    sets = sample.dropDuplicates(["k"]).select(F.explode(_set_udf(words)("text")).alias("key"))
    seen = sets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    rows = seen.orderBy(F.desc("n"), "key").limit(COMMON).select("key").toPandas()["key"]
    return np.sort(rows.to_numpy(np.int64).view(np.uint64))


def _key_udf(t: Threshold, words: int, common):
    @F.arrow_udf("array<bigint>")
    def keys(texts: pa.Array) -> pa.Array:
        return _lists([t.keys(s, common.value) for s in shingle_sets(texts, white_space_words(), words)])

    return keys


def _lists(rows: list[np.ndarray], kind=np.int64) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(kind) if rows else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _filter(keys: DataFrame):
    """A broadcast bitmap of a one-column table of hashes, in proportion to its
    rows; None where it would be too large."""
    bits = max(1, FILTER_BITS * keys.count()).bit_length()
    if bits > FILTER_MOST:
        return None
    return keys.sparkSession.sparkContext.broadcast(bitmap(keys, max(15, bits)))


def _in_filter(found):
    @F.arrow_udf(BooleanType())
    def inside(hashes: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(found.value, hashes.to_numpy().view(np.uint64)))

    return inside


def _sketch_udf(t: Threshold, words: int, repeated, common):
    """Size and identity of a set, those of its keys that may be repeated, and,
    where there are any, its smallest element and its signature."""

    @F.arrow_udf("n bigint, node bigint, keys array<bigint>, smallest bigint, signature binary")
    def sketch(texts: pa.Array) -> pa.Array:
        sizes, nodes, kept, low, signatures = [], [], [], [], []
        for s in shingle_sets(texts, white_space_words(), words):
            key = t.keys(s, common.value)
            kept.append(key if repeated is None else key[in_bitmap(repeated.value, key)])
            sizes.append(len(s))
            nodes.append(mix(np.add.reduce(mix(s), keepdims=True) + np.uint64(len(s)))[0])
            met = len(kept[-1]) > 0
            low.append(int(s[:1].view(np.int64)[0]) if met else None)
            signatures.append(signature(s).tobytes() if met else None)
        return pa.StructArray.from_arrays(
            [
                pa.array(sizes, pa.int64()),
                pa.array(as_long(nodes), pa.int64()),
                _lists(kept),
                pa.array(low, pa.int64()),
                pa.array(signatures, pa.binary()),
            ],
            names=["n", "node", "keys", "smallest", "signature"],
        )

    return sketch


def _set_udf(words: int):
    @F.arrow_udf("array<bigint>")
    def elements(texts: pa.Array) -> pa.Array:
        return _lists(list(shingle_sets(texts, white_space_words(), words)))

    return elements


def _dealt(members: DataFrame, block: int, columns: list[str]) -> DataFrame:
    """Deal each group into blocks and pair these: a unit is two blocks, or one
    with itself. A member goes to as many units as its group has blocks."""
    blocks = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.join(blocks, "root").withColumn("block", own).select("*", other)
    units = dealt.select(
        "root",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "node",
        *columns,
    )
    return units.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")


def _by_unit(batches: Iterator[pa.RecordBatch], read, links) -> Iterator[pa.RecordBatch]:
    """``links(sides)`` of each unit, where a side is a list of ``read`` rows."""
    unit, held = None, ([], [])

    def close():
        sides = [held[0]] if unit[1] == unit[2] else [*held]
        pairs = links(sides)
        columns = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["u", "v"])

    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("root", "low", "high", "block")]
        rows = read(batch)
        for root, low, high, block, row in zip(*cols, rows, strict=True):
            if (root, low, high) != unit:
                if unit is not None:
                    yield close()
                unit, held = (root, low, high), ([], [])
            held[0 if block == low else 1].append(row)
    if unit is not None:
        yield close()


def _unit_candidates(t: Threshold):
    def read(batch: pa.RecordBatch):
        nodes, sizes, low = (batch.column(c).to_pylist() for c in ("node", "n", "smallest"))
        bits = [np.frombuffer(b.as_buffer(), np.uint64).copy() for b in batch.column("signature")]
        return zip(nodes, sizes, [x & 0xFFFFFFFFFFFFFFFF for x in low], bits, strict=True)

    def links(sides: list[list]) -> list[tuple[int, int]]:
        return possible_links([tuple(map(list, zip(*side, strict=True))) or ([],) * 4 for side in sides], t)

    return lambda batches: _by_unit(batches, read, links)


def _unit_links(t: Threshold, words: int):
    def read(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column("text"), white_space_words(), words)
        return zip(batch.column("node").to_pylist(), sets, strict=True)

    def links(sides: list[list]) -> list[tuple[int, int]]:
        xs, ys = [s for _, s in sides[0]], [s for _, s in sides[1]] if len(sides) > 1 else None
        nodes = [n for side in sides for n, _ in side]
        return [(nodes[a], nodes[b]) for a, b in tree_links(xs, ys, t)]

    return lambda batches: _by_unit(batches, read, links)


def ngram_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    num: int = 90,
    den: int = 100,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, row_key, group)`` for every row.

    Rows whose sets of ``words``-word shingles have a Jaccard similarity of at
    least ``num / den`` are linked; ``component_id`` is the smallest id that
    links reach, the row's own included. A null or empty text, or one without
    words, has an empty set and is linked with nothing. Equal rows are one
    class and each comes out. A null id stays null; its group's id is the
    smallest that is not null, or null. Other columns of ``docs``, whatever
    their names, are not read. An empty table gives an empty one. ``row_key`` is
    a hash of id and text, ``group`` identifies the group (null: no words).
    """
    spark = docs.sparkSession
    t = Threshold(num, den)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base.withColumn("row_key", F.xxhash64("doc_id", "text"))

    with small_batches(spark):
        common = spark.sparkContext.broadcast(_common(base, words))
        keys = base.select(F.explode(_key_udf(t, words, common)("text")).alias("key"))
        repeated = written(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "repeated")
        bits = _filter(repeated)

        sketched = base.withColumn("s", _sketch_udf(t, words, bits, common)("text"))
        sketched = written(sketched.select("doc_id", "row_key", "s.*"), "sketches")

        own = sketched.where(F.size("keys") > 0).dropDuplicates(["node"])
        at_key = own.select("node", F.explode("keys").alias("key"))
        at_key = written(at_key if bits is not None else at_key.join(repeated, "key", "left_semi"), "keys")
        stars = at_key.groupBy("key").agg(F.min("node").alias("root"), F.count("*").alias("c")).where("c > 1")
        met = at_key.join(stars, "key").select("root", "node").distinct()
        met = written(met.join(own.select("node", "n", "smallest", "signature"), "node"), "met")
        used_up(repeated, at_key)
        alike = _dealt(met, SIGNATURE_BLOCK, ["n", "smallest", "signature"]).mapInArrow(_unit_candidates(t), "u bigint, v bigint")
        alike = written(alike, "alike")
        used_up(met)
        groups = components(alike)

        # one row of each candidate set, whose text is read again
        one = sketched.where("n > 0").groupBy("node").agg(F.min("row_key").alias("row_key"))
        chosen = written(groups.join(one, "node"), "chosen")
        again = base.select("row_key", "text")
        if (these := _filter(chosen.select("row_key"))) is not None:
            again = again.where(_in_filter(these)("row_key"))
        # wholly equal rows have one key, by which the join has dealt and sorted them
        members = chosen.join(again, "row_key").dropDuplicates(["row_key"])
        units = _dealt(written(members, "members"), BLOCK, ["text"])
        links = written(units.mapInArrow(_unit_links(t, words), "u bigint, v bigint"), "found")
        used_up(alike, chosen)

    linked = components(links)
    known = sketched.select("doc_id", F.col("n").alias("n_shingles"), "row_key", "node")
    rows = known.where("n_shingles > 0").join(linked, "node", "left")
    rows = rows.withColumn("group", F.coalesce("root", "node"))
    first = rows.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    columns = ["doc_id", "n_shingles", "component_id", "row_key", "group"]
    none = known.where("n_shingles = 0").withColumns(
        {"component_id": F.col("doc_id"), "group": F.lit(None).cast("bigint")}
    )
    return rows.join(first, "group").select(*columns).unionByName(none.select(*columns))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id.

    Null ids come after all others, rows with the same id in the order of their
    texts' hashes. Rows without words are in no group and all stay, but of rows
    with the same id and text, wherever they are, one stays (a null text counts
    as an empty one).
    """
    found = written(ngram_groups(docs, id_col, text_col, **kw), "groups")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key").alias("row_key"))
    best = found.where("n_shingles > 0").groupBy("group").agg(F.min(order)["row_key"].alias("best"))
    # rows that go, and rows that are there more than once; all others just stay
    many = found.groupBy("row_key").agg(F.count("*").alias("c"), F.min("group").alias("group"))
    many = many.join(best, "group", "left").select("row_key", "c", (F.col("best") != F.col("row_key")).alias("goes"))
    unsure = written(many.where("c > 1 OR goes").select("row_key", F.coalesce("goes", F.lit(False)).alias("goes")), "unsure")
    used_up(found)
    key, goes = unused_name(docs, "row_key"), unused_name(docs, "goes")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    names = own_columns(docs)
    marks = unsure.select(F.col("row_key").alias(key), F.col("goes").alias(goes))
    if (these := _filter(unsure.select("row_key"))) is None:
        kept = keyed.join(marks, key, "left").where(~F.coalesce(goes, F.lit(False))).dropDuplicates([key])
        return kept.select(*names)
    inside = _in_filter(these)(F.col(key))
    stay = keyed.where(~inside).select(*names)
    # other rows than these may be in the filter by chance
    tested = keyed.where(inside).join(marks, key, "left").where(~F.coalesce(goes, F.lit(False)))
    return stay.unionByName(tested.dropDuplicates([key]).select(*names))
