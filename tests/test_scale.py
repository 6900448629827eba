"""Forms that keep work and rows in proportion to the text."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from gistmill.functions import quality as qf
from gistmill.functions import suffixes
from gistmill.functions import tokens as tk
from gistmill.operators import language as lg
from gistmill.operators import repetition as rep

ODD = ["a b a b a b c", "  A\n\nb\x0b\n b \t", "", " \n ", None, "İi x İi x İi x y", "\n\nq", "é😀é é😀é z", "a"]


def test_ngram_tables_hold_a_row_a_document_and_size(texts):
    df = texts(*ODD)
    found = rep.ngram_tables(df, "id", 1, 3).collect()
    assert len(found) == len({(r.id, r.n) for r in found})
    nested = sorted((r.id, r.n, g.ngram, g.cnt) for r in found for g in r.grams)
    assert nested == sorted(map(tuple, rep.ngram_counts(df, "id", 1, 3).collect()))
    for i, text in enumerate(ODD):
        gapped = [g.lower() for g in re.findall(r"[ \t\n\x0b\f\r]*(?:\w+|[^\s\w])", text or "")]
        for n in (1, 2, 3):
            grams = ["".join(gapped[k : k + n]).lstrip() for k in range(len(gapped) - n)]
            assert {r[2]: r[3] for r in nested if r[:2] == (i, n)} == {g: grams.count(g) for g in grams}


def test_top_ngrams_of_several_sizes_at_once(texts):
    df = texts(*ODD)
    at_once = {tuple(r) for r in rep.top_ngrams_of(df, "id", [1, 2, 3]).collect()}
    assert at_once == {(*r, n) for n in (1, 2, 3) for r in rep.top_ngrams(df, "id", n).collect()}
    plan = rep.top_ngrams_of(df, "id", [1, 2, 3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_tokens_cross_as_one_string_and_are_scored_once(texts):
    made = texts(*ODD).select(suffixes.marked(F.col("text")).alias("m"))
    assert [f.dataType.simpleString() for f in made.schema["m"].dataType] == ["string", "string"]
    low = pa.array([r.m.low for r in made.collect()], pa.string())
    data, at, rows = suffixes._unmarked(low)
    got = [bytes(data[a:b]).decode() for a, b in zip(at[:-1], at[1:])]
    want = [re.findall(r"[ \t\n\x0b\f\r]*(?:[^\W]+|[^\s\w])", t.replace("İ", "i̇").lower() if t else "") for t in ODD]
    assert got[: len(want[0])] == want[0] and rows[-1] == len(got)
    plan = rep.duplicate_ngrams(texts(*ODD), "id", 5, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_strip_takes_the_same_characters_as_its_pattern(texts):
    edge = [f"{c}a{c}b{c}{c}" for c in map(chr, [*range(1, 0x100), *range(0x1600, 0x3100)]) if c != "\x00"]
    c = F.col("text")
    by_pattern = F.regexp_replace(c, tk.EDGE_SPACE, "")
    assert texts(*edge, "", " \n", None).where(~tk.strip(c).eqNullSafe(by_pattern)).count() == 0
    assert "regexp" not in str(tk.strip(c))


def test_stop_words_are_read_up_to_the_last_one_asked_for(texts):
    c, words = F.col("text"), ("a", "a b", "b", "don't", "é")
    df = texts("a b", "a b c b", "A, B", "don't do", "dab bad", "", None, "é a", "a\nb\na")
    pattern = qf.phrase_pattern(words)
    for n in (0, 1, 2, 3):
        counted = F.regexp_count(F.lower(c), F.lit(pattern)) >= n
        assert df.where(~qf.stop_word(c, words, n).eqNullSafe(counted)).count() == 0
    assert "regexp_count" not in str(qf.stop_word(c, words, 2))


def test_profile_counts_trigrams_without_a_row_for_each(spark):
    rows = [("en", "abcabc! ab"), ("en", None), (None, "zzz"), ("da", "åbå"), ("da", ""), ("en", "abc")]
    df = spark.createDataFrame(rows, "lang string, text string")
    profile = lg.language_profile(df, size=3)
    assert "Generate" not in profile._jdf.queryExecution().executedPlan().toString()
    got = {(r.lang, r.gram) for r in profile.collect()}
    assert got == {("en", "abc"), ("en", " ab"), ("en", "bc "), ("da", " åb"), ("da", "åbå"), ("da", "bå ")}
