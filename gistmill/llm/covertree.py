"""Exact top-k by inner product with cover trees on both sides.

Rows and queries are dealt into blocks around pivots. A task holds a block of
each, builds a cover tree over both (a node's points lie within its radius, its
children's radii are at most half as large), and walks the two together, best
bound first: for a query node around ``q`` with radius ``r`` and a data node
around ``p`` with radius ``s`` no product exceeds ``q.p + |q| s + |p| r + r s``,
and the pair is passed over when that is below the worst of the k-th scores that
the queries of the node have so far. The same bound decides which pairs of
blocks meet at all, after every query block has searched its nearest data block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.session import written

PIVOTS = 16  # a bounded sample; every row is indexed whatever they are
DATA_BLOCK = 4096
QUERY_BLOCK = 2048
LEAF = 48
NONE = np.iinfo(np.int64).min


def whole_numbers(vec: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component; null for a vector that is null
    or empty or has a component that is null or not finite."""
    xs = F.transform(vec, lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    made = F.transform(xs, lambda x: F.floor(x * scale).cast("bigint"))
    return F.when((F.size(vec) > 0) & ~F.exists(xs, bad), made)


class CoverTree:
    """Nodes as arrays: point of the centre, radius, children or points."""

    def __init__(self, points: np.ndarray):
        self.points, self.centres, self.radii, self.children, self.members = points, [], [], [], []
        # distances between copies must be 0, so they are not taken from products
        self._build(np.arange(len(points)), 0)
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.norms = np.sqrt((points[self.centres] ** 2).sum(1))

    def _far(self, at: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[at] - self.points[centre]) ** 2).sum(1))

    def _build(self, at: np.ndarray, centre: int) -> int:
        """Nodes are made from a list of open ones; no recursion, as a chain of
        ever smaller radii may be long."""
        open_ = [(at, centre, -1)]
        while open_:
            at, centre, parent = open_.pop()
            far = self._far(at, centre)
            radius = float(far.max()) * (1 + 1e-9)
            node = len(self.centres)
            self.centres.append(centre)
            self.radii.append(radius)
            self.children.append([])
            self.members.append(None)
            if parent >= 0:
                self.children[parent].append(node)
            if len(at) <= LEAF or radius == 0:
                self.members[node] = at
                continue
            left, near, groups = at, far, []
            while len(left):
                # the centre covers first, then the point farthest from it
                c = centre if not groups else int(left[near.argmax()])
                d = self._far(left, c)
                inside = d <= radius / 2
                groups.append((left[inside], c))
                left, near = left[~inside], near[~inside]
                if len(groups) >= 64 and len(left):
                    # children of their own would be near to single points
                    half = [left[i : i + LEAF] for i in range(0, len(left), LEAF)]
                    groups += [(part, int(part[0])) for part in half]
                    break
            open_ += [(part, c, node) for part, c in groups]
        return 0


def bound(dot, norm_a, radius_a, norm_b, radius_b):
    return dot + norm_a * radius_b + norm_b * radius_a + radius_a * radius_b


class Search:
    """Queries of one block against data of one block, exactly."""

    def __init__(self, query_ids, queries, worst, k: int):
        self.ids, self.queries, self.k = np.asarray(query_ids, np.int64), queries, k
        self.floats = queries.astype(np.float64)
        self.tree = CoverTree(self.floats)
        self.scores = np.full((len(queries), k), NONE, np.int64)
        self.found = np.full((len(queries), k), NONE, np.int64)
        self.worst = np.asarray(worst, np.float64)  # known from other blocks
        tree, n = self.tree, len(self.tree.centres)
        self.under = [None] * n
        for node in range(n - 1, -1, -1):
            own = tree.members[node]
            parts = [self.under[c] for c in tree.children[node]]
            self.under[node] = own if own is not None else np.concatenate(parts)

    def floor_of(self, node: int) -> float:
        at = self.under[node]
        kth = np.where(self.found[at, -1] == NONE, -np.inf, self.scores[at, -1].astype(np.float64))
        return float(np.maximum(kth, self.worst[at]).min())

    def against(self, ids, data: np.ndarray) -> None:
        ids = np.asarray(ids, np.int64)
        floats = data.astype(np.float64)
        tree, mine = CoverTree(floats), self.tree
        limit = float(np.abs(self.floats).sum(1).max(initial=0)) * float(np.abs(floats).max(initial=0))
        exact = limit < 2.0**52  # then products of doubles are whole numbers

        def best(a: int, b: np.ndarray) -> np.ndarray:
            dots = floats[tree.centres[b]] @ self.floats[mine.centres[a]]
            most = bound(dots, mine.norms[a], mine.radii[a], tree.norms[b], tree.radii[b])
            return most + 1e-9 * np.abs(most) + 1e-6

        heap = [(-float(best(0, np.array([0]))[0]), 0, 0)]
        while heap:
            top, a, b = heapq.heappop(heap)
            if -top < self.floor_of(a):
                continue
            wide_a, wide_b = mine.children[a], tree.children[b]
            if not wide_a and not wide_b:
                self._leaf(mine.members[a], tree.members[b], ids, data, floats, exact)
                continue
            split_a = wide_a and (not wide_b or mine.radii[a] >= tree.radii[b])
            lefts = wide_a if split_a else [a]
            rights = np.array([b] if split_a else wide_b)
            for x in lefts:
                low = self.floor_of(x)
                for y, most in zip(rights.tolist(), best(x, rights).tolist(), strict=True):
                    if most >= low:
                        heapq.heappush(heap, (-most, x, y))

    def _leaf(self, qs, ps, ids, data, floats, exact) -> None:
        if exact:
            products = np.rint(self.floats[qs] @ floats[ps].T).astype(np.int64)
        else:
            products = (self.queries[qs].astype(object) @ data[ps].T.astype(object)).astype(np.int64)
        own = self.ids[qs][:, None] == ids[ps][None, :]
        scores = np.concatenate([self.scores[qs], np.where(own, NONE, products)], 1)
        found = np.concatenate([self.found[qs], np.where(own, NONE, np.broadcast_to(ids[ps], own.shape))], 1)
        # missing ones last, then by score, then by id
        order = np.lexsort((found, ~scores, found == NONE))[:, : self.k]
        self.scores[qs] = np.take_along_axis(scores, order, 1)
        self.found[qs] = np.take_along_axis(found, order, 1)


# --- on Spark -----------------------------------------------------------------


def _nearest(pivots: np.ndarray):
    @F.arrow_udf("cell int, far double")
    def nearest(vecs: pa.Array) -> pa.Array:
        cells, far = [], []
        flat, at = vecs.values.to_numpy(), vecs.offsets.to_numpy()
        for a, b in zip(at[:-1], at[1:], strict=True):
            x = np.zeros(pivots.shape[1])
            x[: min(b - a, len(x))] = flat[a:b][: len(x)]
            d = np.sqrt(((pivots - x) ** 2).sum(1))
            # components beyond the pivots' length count too
            beyond = float((flat[a + len(x) : b].astype(np.float64) ** 2).sum()) if b - a > len(x) else 0.0
            cells.append(int(d.argmin()))
            far.append(float(np.sqrt(d.min() ** 2 + beyond)))
        return pa.StructArray.from_arrays(
            [pa.array(cells, pa.int32()), pa.array(far, pa.float64())], names=["cell", "far"]
        )

    return nearest


def _dealt(rows: DataFrame, size: int, cells_apart: bool) -> DataFrame:
    """``rows`` with ``block``. Data blocks keep to a cell; query blocks take
    neighbouring cells together until they are full. A cell of many rows, even
    of equal ones, is dealt over several blocks by hash."""
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))  # a row per pivot
    before = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = F.broadcast(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    u = F.shiftrightunsigned(F.xxhash64("vec_id"), 11).cast("double") / float(1 << 53)
    if cells_apart:
        part = F.floor(u * F.ceil(F.col("n") / size))
        block = F.concat_ws(":", "cell", part)
    else:
        block = F.floor((F.col("before") + u * F.col("n")) / size).cast("string")
    return rows.join(counts, "cell").withColumn("block", block).drop("n", "before")


def _search(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the k best of each query in each pair
    ``(q, p)`` of blocks."""
    kept = queries.join(pairs, queries["block"] == pairs["q"]).select("q", "p", F.lit(0).alias("side"), "vec_id", "vec", "worst")
    rows = data.join(pairs, data["block"] == pairs["p"]).select("q", "p", F.lit(1).alias("side"), "vec_id", "vec", F.lit(None).cast("double").alias("worst"))
    both = kept.unionByName(rows).repartition("q", "p").sortWithinPartitions("q", "p", "side", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [], [], [], [])

        def close():
            q_ids, q_vecs, worst, ids, vecs = held
            if not q_ids or not ids:
                return None
            width = max(len(v) for v in [*q_vecs, *vecs])
            search = Search(q_ids, _matrix(q_vecs, width), worst, k)
            search.against(ids, _matrix(vecs, width))
            at = np.nonzero(search.found != NONE)
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (search.ids[at[0]], search.found[at], search.scores[at])],
                names=["query_id", "vec_id", "score"],
            )

        for batch in batches:
            q, p = batch.column("q").to_pylist(), batch.column("p").to_pylist()
            side, ids = batch.column("side").to_pylist(), batch.column("vec_id").to_pylist()
            worst, vecs = batch.column("worst").to_pylist(), batch.column("vec")
            flat, at = vecs.values.to_numpy(), vecs.offsets.to_numpy()
            for i in range(batch.num_rows):
                if (q[i], p[i]) != unit:
                    if (out := close()) is not None:
                        yield out
                    unit, held = (q[i], p[i]), ([], [], [], [], [])
                vec = flat[at[i] : at[i + 1]].copy()
                if side[i] == 0:
                    held[0].append(ids[i])
                    held[1].append(vec)
                    held[2].append(worst[i])
                else:
                    held[3].append(ids[i])
                    held[4].append(vec)
        if (out := close()) is not None:
            yield out

    return both.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _matrix(vecs: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width), np.int64)
    for row, v in zip(out, vecs, strict=True):
        row[: len(v)] = v
    return out


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    one_an_id: bool = True,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` picks
    the ``k`` other rows with the greatest inner product of whole numbers.

    Ties go to the smaller id. Rows whose id or vector is null, or whose vector
    is empty or has a component that is null or not finite, take no part. Rows
    with one id are one: that with the greatest vector; without ``one_an_id`` all
    of them are candidates and queries, but for each other. A vector that is shorter
    than another has zeros for what it lacks. Scores must fit a long. Other
    columns are not read; an empty table gives an empty one.
    """
    vec = whole_numbers(F.col(vec_col))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), vec.alias("vec"), is_query.alias("asks"))
    rows = rows.where("vec_id is not null and vec is not null")
    if one_an_id:
        rows = rows.groupBy("vec_id").agg(F.max(F.struct("vec", "asks")).alias("r")).select("vec_id", "r.*")
    rows = written(rows, "vectors")
    picked = rows.orderBy(F.xxhash64("vec_id")).limit(PIVOTS).select("vec").collect()
    pivots = _matrix([np.array(r["vec"]) for r in picked], max([len(r["vec"]) for r in picked], default=1))
    pivots = pivots.astype(np.float64) if len(picked) else np.zeros((1, 1))
    placed = rows.select("vec_id", "vec", "asks", _nearest(pivots)("vec").alias("c")).select("vec_id", "vec", "asks", "c.*")
    placed = written(placed, "placed")
    data = _dealt(placed, DATA_BLOCK, True)
    queries = _dealt(placed.where("asks"), QUERY_BLOCK, False)

    # what is known of blocks: a row per block and cell
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(i, p.tolist(), float(np.sqrt(p @ p))) for i, p in enumerate(pivots)], "cell int, pivot array<double>, norm double"
    )
    dot = F.aggregate(F.zip_with("p.pivot", "q.pivot", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    cells = F.broadcast(data.groupBy("cell").agg(F.max("far").alias("radius")).join(table, "cell"))
    q_cells = queries.groupBy("block", "cell").agg(F.max("far").alias("radius")).join(F.broadcast(table), "cell")
    every = F.explode(F.sequence(F.lit(0), F.lit(len(pivots) - 1))).alias("other")
    near = q_cells.select(F.col("block").alias("q"), "pivot", "norm", "radius", every).alias("q")
    near = near.join(cells.alias("p"), F.col("q.other") == F.col("p.cell"))
    most = bound(dot, F.col("q.norm"), F.col("q.radius"), F.col("p.norm"), F.col("p.radius"))
    meets = near.groupBy("q", "p.cell").agg(F.max(most).alias("most"))
    blocks = data.select("cell", F.col("block").alias("p")).distinct()
    meets = meets.join(blocks, "cell").select("q", "p", "most")
    meets = written(meets.withColumn("most", F.col("most") + F.abs("most") * 1e-9 + 1e-6), "pairs")

    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("most"), "p"))
    pairs = meets.withColumn("n", first).where("n = 1").select("q", "p")
    start = written(_search(pairs, queries.withColumn("worst", F.lit(float("-inf"))), data, k), "first")
    kth = start.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    kth = kth.where(F.col("n") >= k).select(F.col("query_id").alias("of"), F.col("kth").cast("double").alias("kth"))
    known = queries.join(kth, queries["vec_id"] == kth["of"], "left").drop("of")
    known = known.withColumn("worst", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
    worst = known.groupBy("block").agg(F.min("worst").alias("least"))
    rest = meets.join(pairs, ["q", "p"], "left_anti").join(worst, F.col("q") == F.col("block"))
    rest = rest.where("most >= least").select("q", "p")
    found = _best(start.unionByName(_search(rest, known, data, k)), k)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
