import math
import random
from collections import Counter

import pyarrow as pa

from pyspark.sql import functions as F

from gistmill.functions import summaries as sm
from gistmill.functions.stopwords import ENGLISH
from gistmill.functions.vectors import embedding_match_score
from gistmill.operators import summarize as su
from gistmill.operators import vocab as vc


def counts(spark, **cnt):
    return spark.createDataFrame(list(cnt.items()), "token string, cnt long")


def test_overlap_and_coverage(spark):
    a, b = counts(spark, x=5, y=3, z=3), counts(spark, y=1, q=1)
    row = vc.vocab_overlap(a, b, 10).first()
    assert (row.size_a, row.size_b, row.common, row.only_a, row.only_b, row.total) == (3, 2, 1, 2, 1, 4)
    assert abs(row.pct_a_in_b - 100 / 3) < 1e-9 and row.pct_of_vocab == 40
    share = {r.k: r.share for r in vc.topk_coverage(a, [1, 2, 9]).collect()}
    assert share == {1: 5 / 11, 2: 8 / 11, 9: 1.0}
    assert [r.token for r in vc.top_tokens(a, 2).collect()] == ["x", "y"]


def test_vocabulary_selection_stops_at_the_cap(spark):
    first = spark.createDataFrame([(5, 9), (1, 8), (7, 7)], "token int, cnt long")
    second = spark.createDataFrame([(5, 9), (8, 8), (9, 7), (10, 6)], "token int, cnt long")
    kept = vc.select_vocab(first, second, 20, reserved=3, top_first=2, top_second=4, cap=6, tail=2)
    ids = sorted(r.token for r in kept.collect())
    assert ids == [0, 1, 2, 5, 8, 9, 18, 19]
    new = {r.token: r.new_id for r in vc.reindex(kept).collect()}
    assert new == {t: i for i, t in enumerate(ids)}


def test_lead(texts):
    got = su.lead(texts("En. To. Tre. Fire.", "")).orderBy("id").collect()
    assert [r.pred for r in got] == ["En.\nTo.\nTre.", ""]


def test_textrank(texts):
    df = texts(
        "Red fox ran. The red fox saw a blue bird. Nothing here. The blue bird flew.",
        "It is. And the.",
        "",
    )
    top = su.textrank_phrases(df, "id", ENGLISH, k=2).where("id = 0").orderBy("place").collect()
    assert {r.phrase for r in top} <= {"red fox ran", "red fox saw", "blue bird", "blue bird flew", "nothing"}
    got = [r.pred for r in su.textrank(df, ENGLISH, n=2, k=2).orderBy("id").collect()]
    assert got[1] == "It is. And the." and got[2] == ""
    chosen = got[0].split(". ")
    assert len(chosen) == 2 and "Nothing here" not in got[0]
    ranks = su.rank_sentences(df, "id", ENGLISH, k=2).where("id = 1").collect()
    assert [r.distance for r in ranks] == [0, 0]


def test_embedding_score(spark):
    df = spark.createDataFrame(
        [([[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0]]), ([], [[1.0, 1.0]])],
        "p array<array<float>>, r array<array<float>>",
    )
    got = [r.s for r in df.select(embedding_match_score(F.col("p"), F.col("r")).alias("s")).collect()]
    assert math.isclose(got[0]["precision"], 0.5) and math.isclose(got[0]["recall"], 1.0)
    assert math.isclose(got[0]["f1"], 2 / 3) and got[1] is None


def test_zero_vectors_match_nothing(spark):
    rows = [([[0.0, 0.0], [1.0, 0.0]], [[1.0, 0.0]]), ([[0.0, 0.0]], [[0.0, 0.0]]), ([], [[1.0, 0.0]]), (None, [[1.0, 0.0]])]
    df = spark.createDataFrame(rows, "p array<array<float>>, r array<array<float>>")
    got = [r.s for r in df.select(embedding_match_score(F.col("p"), F.col("r")).alias("s")).collect()]
    assert tuple(got[0]) == (0.5, 1.0, 2 * 0.5 / 1.5) and tuple(got[1]) == (0.0, 0.0, 0.0)
    assert got[2] is None and got[3] is None


def test_ranks_of_a_batch_as_document_by_document(monkeypatch):
    rng = random.Random(9)
    docs = ["", "\n\n", None] + [
        "\n".join(
            "\t".join(" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 4)))
            for _ in range(rng.randrange(1, 5))
        )
        for _ in range(60)
    ]

    def alone(text):
        runs = [[p.split(" ") for p in s.split("\t") if p] for s in (text or "").split("\n")]
        lines = [[w for p in s for w in p] for s in runs]
        words = sorted({w for s in lines for w in s})
        meets = Counter()
        for s in lines:
            for i, j in ((i, j) for i in range(len(s)) for j in range(i + 1, min(i + 4, len(s))) if s[i] != s[j]):
                meets[s[i], s[j]] += 1
                meets[s[j], s[i]] += 1
        out = Counter()
        for (a, _), m in meets.items():
            out[a] += m
        rank = dict.fromkeys(words, 1 / max(len(words), 1))
        for _ in range(20):
            rank = {w: 0.15 / len(words) + 0.85 * sum(rank[a] * m / out[a] for (a, b), m in meets.items() if b == w) for w in words}
        phrases = [p for s in runs for p in s]
        seen = {}
        for k, p in enumerate(phrases):
            seen.setdefault(" ".join(p), k)
        score = lambda p: (sum(rank[w] for w in p) / len(p)) ** 0.5 * len(p) / (len(p) + 1)
        return [(name, score(name.split(" ")), k) for name, k in seen.items()]

    got = sm._ranked(pa.array(docs), 20).to_pylist()
    for text, found in zip(docs, got, strict=True):
        want = alone(text)
        assert [(f["phrase"], f["first"]) for f in found] == [(w[0], w[2]) for w in want]
        assert all(abs(f["rank"] - w[1]) < 1e-12 for f, w in zip(found, want, strict=True))
