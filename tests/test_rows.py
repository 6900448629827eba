import random
from collections import Counter

from pyspark.sql import functions as F

from gistmill.functions import rows


def test_run_lengths_and_overlap_match_counters(spark):
    rng = random.Random(1)
    cases = [
        ([rng.choice("abcd") for _ in range(rng.randrange(12))],
         [rng.choice("abce") for _ in range(rng.randrange(12))])
        for _ in range(200)
    ]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    got = df.select(
        "a", "b",
        rows.run_lengths(F.col("a")).alias("runs"),
        rows.repeat_positions(F.col("a")).alias("later"),
        rows.multiset_overlap(F.col("a"), F.col("b")).alias("shared"),
    ).collect()
    for r in got:
        assert {x["key"]: x["cnt"] for x in r.runs} == Counter(r.a)
        assert all(r.a.index(x["key"]) == x["first"] for x in r.runs)
        assert r.later == [i for i, x in enumerate(r.a) if x in r.a[:i]]
        assert r.shared == sum((Counter(r.a) & Counter(r.b)).values())


def test_grams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r.g for r in df.select(rows.grams(F.col("t"), 2).alias("g")).collect()] == [
        ["a b", "b c"], [], [],
    ]


def test_let_binds_once(spark):
    df = spark.range(1).select(rows.let(F.lit(3), lambda x: x * x).alias("v"))
    assert df.first().v == 9
