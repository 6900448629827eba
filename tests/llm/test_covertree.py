import math
import random

import numpy as np
from pyspark.sql import functions as F

from gistmill.llm import covertree
from gistmill.llm.covertree import CoverTree, Search, top_k
from gistmill.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows, every, k):
    known = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * float(np.float32(x))) for x in v]
            known[i] = max(known.get(i, w), w)
    out = []
    for q in known:
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(known[q], known[p])), p) for p in known if p != q]
            out += [(q, r, p, -s) for r, (s, p) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(spark, rows, every, k=10):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as vec", "1 as cell", "2 as block")
    return sorted(map(tuple, top_k(df, F.col("vec_id") % every == 0, k).collect()))


def test_equals_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(covertree, "DATA_BLOCK", 60)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 8)
    r = random.Random(9)
    vec = lambda: [r.gauss(0, 1) for _ in range(6)]
    centres = [vec() for _ in range(4)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, centres[0]) for i in range(120)]  # copies
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6)]
    rows += [(None, vec()), (2010, [1.0, 2.0]), (2020, [0.5] * 9), (2030, [0.0] * 6), (2040, vec()), (2040, vec()), rows[10]]
    assert found(spark, rows, 10) == by_hand(rows, 10, 10)


def test_fewer_rows_than_asked_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0])]
    assert found(spark, rows, 2) == by_hand(rows, 2, 10)
    assert found(spark, rows[:1], 1) == [] and found(spark, [], 1) == []


def test_very_large_components(spark):
    rows = [(i, [float(2**40 + 2**20 * i), -(2.0**41)]) for i in range(5)]
    rows = [(i, [x / 2**25 for x in v]) for i, v in rows]
    assert found(spark, rows, 1) == by_hand(rows, 1, 10)


def test_nodes_cover_their_points():
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(size=(500, 5)), np.ones((300, 5)), r.normal(size=(400, 5)) * 0.01])
    tree = CoverTree(points)

    def under(node):
        if tree.members[node] is not None:
            return tree.members[node]
        return np.concatenate([under(c) for c in tree.children[node]])

    assert sorted(under(0).tolist()) == list(range(len(points)))
    for node in range(len(tree.centres)):
        far = np.sqrt(((points[under(node)] - points[tree.centres[node]]) ** 2).sum(1))
        assert far.max() <= tree.radii[node] * (1 + 1e-6) + 1e-9


def test_pairs_of_nodes_are_passed_over():
    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 8)) * 1000
    data = np.rint(np.repeat(centres, 100, 0) + r.normal(size=(2000, 8)) * 10).astype(np.int64)
    search = Search([0, 1], data[:2], [-np.inf] * 2, 10)
    leaves = []
    old = search._leaf
    search._leaf = lambda *a: (leaves.append(len(a[1])), old(*a))
    search.against(np.arange(2000), data)
    assert sum(leaves) < 1000  # of 2,000 rows
    want = np.sort(data[:1] @ data[1:].T)[0][::-1][:10]
    assert (search.scores[0] == want).all()


def test_every_vector_of_an_id(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(covertree, "DATA_BLOCK", 20)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 4)
    r = random.Random(10)
    rows = [(i % 130, [r.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(100, [9.0] * 4)] * 3 + [(7, [8.0] * 4)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows]
    want = []
    for q in (0, 100):  # as the SQL says: the rows of an id rank their pairs together
        pairs = [(-sum(a * b for a, b in zip(v, w)), p) for i, v in ints if i == q for p, w in ints if p != q]
        want += [(q, n, p, -s) for n, (s, p) in enumerate(sorted(pairs)[:10], 1)]
    got = QUERIES["op6_cover_tree_topk"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == want
