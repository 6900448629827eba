import random

from pyspark.sql import functions as F

from gistmill.functions import tokens as tk

def col():
    return F.col("text")


def test_counts_on_edge_texts(texts):
    df = texts("", " \n ", "ord", "Hej, verden! 3 æbler_x $ +", "123 45a")
    got = df.orderBy("id").select(
        tk.token_len(col()).alias("t"), tk.n_words(col()).alias("w"), tk.word_chars(col()).alias("c"),
        tk.n_alpha_words(col()).alias("a"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (0, 0, 0, 0),
        (0, 0, 0, 0),
        (1, 1, 3, 1),
        # Hej , verden ! 3 æbler _ x $ + : the underscore is punctuation
        (10, 7, 3 + 6 + 1 + 5 + 1 + 1 + 1, 4),
        (2, 2, 6, 1),
    ]


def test_sentences(texts):
    df = texts("  En. To?! Tre", "", "...", "a.\n\n b.")
    got = [r.s for r in df.orderBy("id").select(tk.sentences_of(col()).alias("s")).collect()]
    assert got == [["En.", "To?!", "Tre"], [], [], ["a.", "b."]]


def test_truncate_and_lines(texts):
    df = texts("a b c\n\na")
    row = df.select(
        tk.truncate_tokens(col(), 2).alias("t"), tk.line_array(col()).alias("l"),
        tk.paragraph_array(col()).alias("p"), tk.non_blank_lines(col()).alias("n"),
    ).first()
    assert row.t == ["a", "b"]
    assert row.l == ["a b c", "", "a"]
    assert row.p == ["a b c", "a"]
    assert row.n == ["a b c", "a"]


def test_blank_lines_of_any_white_space(texts):
    df = texts("a\n\u00a0\n\u3000\u2009\n b\u00a0")
    row = df.select(tk.non_blank_lines(col()).alias("n"), tk.sentences_of(F.lit("\u00a0x. \u2003")).alias("s")).first()
    assert row.n == ["a", "b"] and row.s == ["x."]


def test_first_sentences(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aB .!?\n\t\u00a0\u2003ñ\r", k=rng.randrange(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in [*texts, "...", "\u00a0.a. b", None]], "text string")
    for n in (0, 1, 3):
        both = df.select("text", tk.first_sentences(col(), n).alias("first"), tk.sentences_of(col()).alias("all"))
        for r in both.collect():
            assert r.first == (None if r.text is None else r.all[:n]), r
