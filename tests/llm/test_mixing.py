import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gistmill.llm.mixing import copies, mix, targets, word_count


def targets_by_hand(sizes, weights, share, most):
    """Share by weight, cap, share the excess again."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in list(free):
            goal[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if goal[s] >= most * sizes[s]:
                left += goal[s] - most * sizes[s]
                goal[s] = most * sizes[s]
                free.discard(s)
    return goal


def test_targets_as_by_hand(spark):
    r = random.Random(5)
    for _ in range(4):
        sizes = {c: r.randrange(0, 10 ** r.randrange(1, 6)) for c in "éazZ09"} | {None: 500}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x["source"]: x["target"] for x in targets(rows).collect()}
        want = targets_by_hand(sizes, (5, 2, 1), 1.5, 2.0)
        assert got == {s: pytest.approx(x, rel=1e-9) for s, x in want.items()}


def test_word_count(spark):
    texts = [None, "", " ", "a", " a b\tc\n", "\x0b\x0c", "a b c", "x\r\ny", "one  two"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()
    assert [x[0] for x in rows] == [0, 0, 0, 1, 3, 0, 2, 2, 2]


def sample(seed):
    r = random.Random(seed)
    rows = []
    for s, n in (("a", 600), ("b", 250), ("c", 150), (None, 90), ("empty", 3)):
        for _ in range(n):
            words = 0 if s == "empty" else r.choice([0, 1, 5, 20, 80, 300])
            rows.append((len(rows), " ".join(["w"] * words), s))
    rows += [(5, "same row", "b")] * 40 + [(None, None, "c"), (None, "no id", None)]
    return rows


def test_copies_meet_targets(spark):
    rows = sample(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mass", F.lit("x"))
    got = copies(docs, seed=3).collect()
    assert len(got) == len(rows)
    sizes, taken, goal = Counter(), Counter(), {}
    for x in got:
        assert 0 <= x["copies"] <= 2
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["size"] * x["copies"]
        goal[x["source"]] = x["target"]
    want = targets_by_hand(dict(sizes), (5, 2, 1), 1.5, 2.0)
    for s in sizes:
        assert goal[s] == pytest.approx(want[s])
        assert abs(taken[s] - goal[s]) <= 300  # at most one document is left over
    again = copies(docs.repartition(7), seed=3).collect()
    key = lambda x: str((x["doc_id"], x["source"], x["row_key"], x["copy"], x["copies"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_probabilities_hold(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 3 else "b") for i in range(60)], "doc_id long, text string, source string")
    total, runs, expected = defaultdict(int), 12, {}
    for seed in range(runs):
        for x in copies(docs, seed=seed).collect():
            total[x["source"]] += x["copies"]
            expected[x["source"]] = x["target"] / x["source_size"]
    for s, n in total.items():
        rows = 40 if s == "a" else 20
        assert n / runs / rows == pytest.approx(expected[s], abs=0.12)


def test_mixed_rows_and_empty_table(spark):
    rows = sample(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row_key", F.lit(1))
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    drawn = copies(docs).agg(F.sum("copies")).first()[0]
    assert mixed.count() == drawn
    none = docs.limit(0)
    assert mix(none).count() == 0 and copies(none).count() == 0
