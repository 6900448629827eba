import pytest
from pyspark.sql import functions as F

from gistmill.functions import quality as qf
from gistmill.functions import tokens as tk
from gistmill.functions.quality import FILTERS, QualityParams, article_profile, summary_profile
from gistmill.operators.language import language_profile, language_scores, learns, load_profile
from gistmill.operators.quality import describe_filter, filter_counts, quality_filter

def col():
    return F.col("text")


def only(name, **changes):
    return QualityParams(ignore=tuple(f for f in FILTERS if f != name), **changes)


def passes(df, name, **changes):
    judged = describe_filter(df, only(name, **changes)).orderBy("id")
    return [r.filter is None for r in judged.collect()]


def words(n, word="ord"):
    return " ".join([word] * n)


def test_length_bounds_are_inclusive(texts):
    df = texts(words(49), words(50), words(51), "")
    assert passes(df, "doc_length") == [False, True, True, False]


def test_no_words_fails_rather_than_raises(texts):
    df = texts("", " \n ", "?!")
    for name in ("mean_word_length", "alpha_ratio", "symbol_2_word_hashtag", "short_long_sentece"):
        expected = [False] * 3
        assert passes(df, name) == expected, name
    # blank lines count as parts: one of three characters is a copy
    assert passes(df, "duplicate_lines_chr_fraction") == [False, False, True]
    assert passes(df, "duplicate_ngram_chr_fraction") == [False, True, True]
    assert passes(df, "top_ngram_chr_fraction") == [True, True, True]


def test_ratios_at_the_threshold(texts):
    # one hash sign to ten words is exactly 0.1 and must fail
    assert passes(texts(words(10) + "#", words(11) + "#"), "symbol_2_word_hashtag") == [False, True]
    assert passes(texts(words(10) + "…", words(5) + "..."), "symbol_2_word_ellipsis") == [False, True]
    # two of ten characters in a second copy is exactly 0.2 and must fail
    assert passes(texts("ab\nab\nabcd", "ab\nab\nabcde"), "duplicate_lines_chr_fraction") == [
        False, True,
    ]
    long, short = "x" * 31, "x" * 30
    df = texts(f"{long}\n{short}", f"{long}\n{short}\n{short}", f"{long}\n\n \n")
    assert passes(df, "short_long_sentece") == [True, False, True]


def test_alpha_ratio_floors_the_need(texts):
    # floor(3 * 0.6) = 1 word with a letter is enough
    assert passes(texts("a 1 2", "1 2 3", "1"), "alpha_ratio") == [True, False, True]


def test_bullets_and_ellipsis(texts):
    df = texts("- a\n* b", "- a\n - b\n* c", "a…\nb...\nc… \nd", "a…\nb…\nc\nd", "")
    assert passes(df, "line_bullets_or_ellipsis") == [True, False, False, True, True]


def test_danish_stop_words(texts):
    df = texts("Det er en prøve", "Og xyz", "OG i")
    assert passes(df, "stop_word") == [True, False, True]


def test_string_filter_lowers_the_text_only(texts):
    df = texts("Lorem Ipsum", "andet")
    assert passes(df, "string_filter", string="lorem") == [False, True]
    assert passes(df, "string_filter", string="Lorem") == [True, True]


def test_first_failure_wins_and_length_guard_comes_first(texts):
    df = texts("#", "#" * 20)
    p = QualityParams(max_length=10, ignore=("detect_language",))
    assert [r.filter for r in describe_filter(df, p).orderBy("id").collect()] == [
        "doc_length", "max_chr_length",
    ]


def test_no_text_is_not_too_long(texts):
    df = describe_filter(texts(None, "ord"), QualityParams(ignore=("detect_language",)))
    assert {r.filter for r in df.collect()} == {"doc_length"}


def test_ignore_names_are_checked():
    with pytest.raises(ValueError, match="no such filter"):
        QualityParams(ignore=("nope",)).active()
    both = [QualityParams(ignore=(x,)).active() for x in ("short_long_sentence", "short_long_sentece")]
    assert both[0] == both[1]


def test_presets():
    assert article_profile().active() == [
        "doc_length", "mean_word_length", "alpha_ratio", "stop_word", "symbol_2_word_hashtag",
        "symbol_2_word_ellipsis", "duplicate_lines_chr_fraction", "duplicate_paragraph_chr_fraction",
    ]
    assert summary_profile().active() == [
        "symbol_2_word_hashtag", "duplicate_paragraph_chr_fraction", "short_long_sentece",
    ]


def test_survivors_keep_columns_and_counts_add_up(texts):
    good = "Det er en god og lang nok tekst om noget som ikke er alt for kort"
    df = texts(good, "kort").withColumn("more", F.lit(1))
    kept = quality_filter(df, article_profile())
    assert kept.columns == ["id", "text", "more"] and [r.id for r in kept.collect()] == [0]
    counts = {r.filter: r.n for r in filter_counts(df, article_profile()).collect()}
    assert counts == {"passed filters": 1, "doc_length": 1}


def test_user_filter_runs_last(texts):
    df = texts("a", "b")
    extra = {"has_a": lambda c: F.contains(c, F.lit("a"))}
    p = QualityParams(ignore=FILTERS)
    got = [r.filter for r in describe_filter(df, p, extra=extra).orderBy("id").collect()]
    assert got == [None, "has_a"]


def test_language(spark, texts):
    rows = [("da", "det er en dejlig dag og solen skinner"), ("en", "this is the first day of the week")]
    profile = load_profile(language_profile(spark.createDataFrame(rows, "lang string, text string")))
    df = texts("solen er dejlig og det er en dag", "the day of the week is this", "")
    p = only("detect_language", languages=("da",))
    got = [r.filter for r in describe_filter(df, p, profile=profile).orderBy("id").collect()]
    assert got == [None, "detect_language", "detect_language"]
    with pytest.raises(ValueError, match="profile"):
        describe_filter(df, p)


def test_duplicate_part_filters(texts):
    df = texts("a\nb\nc\nd\ne", "a\na\nb")
    got = df.orderBy("id").select(qf.duplicate_line_filter(col(), 0.2).alias("x")).collect()
    assert [r.x for r in got] == [True, False]
    assert df.select(tk.n_words(col()).alias("n")).count() == 2


def test_language_of_rows_not_learned_from_and_of_none(spark, texts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profile = load_profile(language_profile(docs.where(learns("doc_id"))))
    best = F.max_by("lang", "prob").alias("best")
    told = language_scores(docs.where(~learns("doc_id")), profile, "doc_id").groupBy("doc_id").agg(best)
    unseen = told.join(docs, "doc_id").select("lang", "best").collect()
    assert len(unseen) > 60 and sum(r.lang == r.best for r in unseen) >= 0.98 * len(unseen)
    other = texts(
        "Всички хора се раждат свободни и равни по достойнство и права",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である",
        "xq zv kk qqwx zzpt vbnm",
        "zzzz",
        "",
        None,
    )
    rows = language_scores(other, profile, "id").groupBy("id").agg(best, F.max("prob").alias("p"), F.sum("prob").alias("all"))
    got = {r.id: r for r in rows.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]  # a null text has no scores
    assert all(got[i].best == "und" and got[i].p > 0.9 for i in range(4))
    assert abs(got[4].p - 1 / (len(profile.langs) + 1)) < 1e-9 and all(abs(r["all"] - 1) < 1e-9 for r in got.values())


def test_language_scores_do_not_depend_on_slices(spark, texts):
    rows = [("da", "det er en dejlig dag og solen skinner"), ("en", "this is the first day of the week")]
    profile = load_profile(language_profile(spark.createDataFrame(rows, "lang string, text string")))
    values = ["det er", "", "a", None, "this day 語 😀 og solen", "dejlig " * 300]
    raw = lambda: [r.raw for r in texts(*values).coalesce(1).select("id", profile.raw_scores(F.col("text")).alias("raw")).orderBy("id").collect()]
    whole = raw()
    assert whole[3] is None and whole[1] == [0, 0, 0]
    alone = [texts(v).select(profile.raw_scores(F.col("text")).alias("raw")).first().raw for v in values if v is not None]
    assert [w for w in whole if w is not None] == alone


def test_contractions_and_phrases(texts):
    df = texts("I don't, you WON'T.", "don'ts wont", "isn't", "can't-do a", "New   York is a", "newyork xis")
    words = ("don't", "won't", "isn't", "can't", "new york", "is", "a", "don")
    hits = F.regexp_count(F.lower(col()), F.lit(qf.phrase_pattern(words)))
    got = [r.n for r in df.orderBy("id").select(hits.alias("n")).collect()]
    assert got == [2, 1, 1, 2, 3, 0]
    assert passes(df, "stop_word", stop_words=words, min_stop_words=2) == [True, False, False, True, True, False]
    assert passes(df, "stop_word", stop_words=(), min_stop_words=1) == [False] * 6
