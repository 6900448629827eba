import random
import time

from pyspark.sql import functions as F

from gistmill.functions import fragments as fr
from gistmill.operators.evaluate import extractiveness, with_fragments


def plain(summary, text):
    """The definition, position by position."""

    def agree(i, j):
        k = 0
        while i + k < len(summary) and j + k < len(text) and summary[i + k] == text[j + k]:
            k += 1
        return k

    found, i = [], 0
    while i < len(summary):
        best, j = (0, 0), 0
        while j < len(text):
            k = agree(i, j)
            if k > best[0]:
                best = (k, j)
            j += max(k, 1)
        if best[0]:
            found.append((i, best[1], best[0]))
        i += max(best[0], 1)
    return found


def test_random_pairs(spark):
    rng = random.Random(7)
    draw = lambda n: " ".join(rng.choice("abcd") for _ in range(rng.randrange(n)))
    rows = [(i, draw(12), draw(30)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, summary string, text string")
    skipped = 0
    for r in with_fragments(df).collect():
        got = [(m["i"], m["j"], m["len"]) for m in r.matches]
        assert got == plain(r.summary.split(), r.text.split())
        skipped += any(a[1] > b[1] for a, b in zip(got, got[1:]))
    assert skipped


def test_a_match_inside_another_is_not_considered(spark):
    df = spark.createDataFrame([("x x y", "x x x y")], "summary string, text string")
    assert [tuple(m) for m in with_fragments(df).first().matches] == [(0, 0, 2), (2, 3, 1)]


def test_scores_and_empties(spark):
    rows = [(0, "the cat sat", "a cat sat here"), (1, "", "a b"), (2, "a b", ""), (3, "q", "a b")]
    df = spark.createDataFrame(rows, "id int, summary string, text string")
    got = {r.id: (r.coverage, r.density, r.compression) for r in extractiveness(df, "id").collect()}
    assert got == {0: (2 / 3, 4 / 3, 4 / 3), 1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 2)}


def test_case_spans_strings_and_novel_words(spark):
    df = spark.createDataFrame([("The Cat ran", "the Cat sat")], "summary string, text string")
    assert with_fragments(df, case=True).first().matches[0]["i"] == 1
    row = (
        with_fragments(df)
        .select(
            fr.fragment_spans(F.col("matches"), 2).alias("spans"),
            fr.fragment_strings(F.col("matches"), F.col("s_written"), 1).alias("strings"),
            fr.fragment_strings(F.col("matches"), F.col("s_written"), 2).alias("none"),
            fr.novel_words(F.col("s_tokens"), F.col("t_tokens")).alias("novel"),
        )
        .first()
    )
    assert [tuple(s) for s in row.spans] == [(0, 2, 0, 2)]
    assert row.strings == ["The Cat"] and row.none == [] and row.novel == ["ran"]


def test_words_between_any_white_space(spark):
    df = spark.createDataFrame([("a\u00a0b\u2003c", "x\u3000a b\u2028c y")], "summary string, text string")
    row = with_fragments(df, tokenize=False).first()
    assert row.s_tokens == ["a", "b", "c"] and row.t_tokens == ["x", "a", "b", "c", "y"]
    assert [tuple(m) for m in row.matches] == [(0, 1, 3)]


def test_long_runs_of_one_token():
    start = time.perf_counter()
    assert fr._greedy(["a"] * 100_000, ["a"] * 100_000) == [(0, 0, 100_000)]
    assert fr._greedy(["a"] * 2_000, ["b", "a"] * 50) == [(i, 1, 1) for i in range(2_000)]
    assert time.perf_counter() - start < 5


def test_density_bins(spark):
    df = spark.createDataFrame([(1.5,), (1.6,), (8.1875,), (9.0,), (None,)], "d double")
    got = [r.b for r in df.select(fr.density_bin(F.col("d")).alias("b")).collect()]
    assert got == ["abstractive", "mixed", "mixed", "extractive", None]


def test_texts_are_compared_without_arrays_of_tokens(spark):
    rows = [(1, "Σ'ΟΔΟΣ, İx\u00a0y!", "a ΟΔΟΣ, İX\u00a0Y\u0301! ΟΔΟΣ,"), (2, None, "a"), (3, "a", None), (4, "", " "), (5, "b\x0ba\x1cc", "B A\x1cC")]
    df = spark.createDataFrame(rows, "id int, summary string, text string")
    found = with_fragments(df).select("id", "matches", F.size("s_tokens").alias("n"), F.size("t_tokens").alias("m"))
    plan = extractiveness(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    ways = [found, df.select("id", fr.lifted(F.col("summary"), F.col("text")).alias("x")).select("id", "x.*")]
    old, new = ([tuple(r) for r in w.orderBy("id").collect()] for w in ways)
    assert old == new
