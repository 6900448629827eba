import random
import tracemalloc
from collections import Counter

from pyspark.sql import functions as F

from gistmill.functions import rouge
from gistmill.operators.evaluate import rouge_scores


def table(ref, can):
    t = [[0] * (len(can) + 1) for _ in range(len(ref) + 1)]
    for i, a in enumerate(ref, 1):
        for j, b in enumerate(can, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a == b else max(t[i - 1][j], t[i][j - 1])
    return t


def picked(ref, can):
    t, i, j, out = table(ref, can), len(ref), len(can), set()
    while i and j:
        if ref[i - 1] == can[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def f1(hits, n_can, n_ref):
    return 2 * hits / (n_can + n_ref) if hits else 0.0


def lsum(ref, can):
    rs, cs = [s.split() for s in ref.split("\n")], [s.split() for s in can.split("\n")]
    r_left = Counter(w for s in rs for w in s)
    c_left = Counter(w for s in cs for w in s)
    n_r, n_c, hits = sum(r_left.values()), sum(c_left.values()), 0
    for s in rs:
        for i in sorted(set().union(*[picked(s, c) for c in cs])):
            if r_left[s[i]] and c_left[s[i]]:
                hits += 1
                r_left[s[i]] -= 1
                c_left[s[i]] -= 1
    return f1(hits, n_c, n_r)


def test_subsequence_scores(spark):
    rng = random.Random(5)

    def draw():
        lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 4))]
        return "\n".join(lines)

    rows = [(draw(), draw()) for _ in range(300)] + [("", "a"), ("a", ""), ("?", "!")]
    df = spark.createDataFrame(rows, "pred string, ref string")
    p, r = F.col("pred"), F.col("ref")
    got = df.select(
        "pred", "ref",
        rouge.rouge_l(p, r)["fmeasure"].alias("l"), rouge.rouge_lsum(p, r)["fmeasure"].alias("s"),
        rouge.rouge_n(p, r, 1)["fmeasure"].alias("one"),
    ).collect()
    for x in got:
        if not set("abcdef") & set(x.pred) or not set("abcdef") & set(x.ref):
            assert (x.l, x.s, x.one) == (0, 0, 0)
            continue
        can, ref = x.pred.split(), x.ref.split()
        assert abs(x.l - f1(table(ref, can)[-1][-1], len(can), len(ref))) < 1e-12
        assert abs(x.s - lsum(x.ref, x.pred)) < 1e-12
        shared = sum((Counter(can) & Counter(ref)).values())
        assert abs(x.one - f1(shared, len(can), len(ref))) < 1e-12


def test_tokens_are_plain_latin_letters_and_digits(spark):
    df = spark.createDataFrame([("Blåbær 12!",)], "t string")
    assert df.select(rouge.rouge_tokens(F.col("t")).alias("x")).first().x == ["bl", "b", "r", "12"]


def test_scores_per_row(spark):
    df = spark.createDataFrame([(1, "The cat. It sat!", "the cat it sat")], "id int, pred string, summary string")
    row = rouge_scores(df, "id").first()
    assert (row.rouge1, row.rouge2, row.rougeL) == (1, 1, 1)
    assert 0 < row.rougeLsum <= 1


def test_way_back_from_kept_vectors(monkeypatch):
    rng = random.Random(12)
    for _ in range(120):
        ref, can = (rng.choices("abcdefg", k=rng.randrange(0, 40)) for _ in range(2))
        whole = picked(ref, can)
        assert rouge._lcs_places(ref, can) == set(whole) and rouge._lcs_length(ref, can) == len(whole)
        monkeypatch.setattr(rouge._Places, "MASK_BYTES", 0)
        assert rouge._lcs_places(ref, can) == set(whole)
        monkeypatch.undo()


def test_long_texts_in_bounded_memory():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(20_000)]
    ref, can = (rng.choices(words, k=30_000) for _ in range(2))
    can[5_000:15_000] = ref[4_000:14_000]
    tracemalloc.start()
    found = rouge._lcs_places(ref, can)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == rouge._lcs_length(ref, can) > 10_000
    assert most < 80e6


def test_vectors_of_a_sentence_are_made_once(monkeypatch):
    made = []
    make = rouge._Places.__init__
    monkeypatch.setattr(rouge._Places, "__init__", lambda self, ref: (made.append(ref), make(self, ref))[1])
    pred = ["a b c d".split(), "c x a".split(), "y z".split()]
    assert rouge._union_hits(["a b c d".split()], pred) == 4 and not made
    ref = "a c b y d".split()
    expected = len(set().union(*[picked(ref, p) for p in pred]))
    assert rouge._union_hits([ref], pred) == expected and made == [ref]
    assert rouge._union_hits(["p q".split()], pred) == 0 and len(made) == 1


def test_scores_of_nulls_and_of_few_tokens(spark):
    rows = [(None, "a b"), ("a", None), ("", ""), ("a", "a"), ("a b\nc", "b c\na b c"), ("İ K", "i k")]
    df = spark.createDataFrame(rows, "pred string, ref string")
    p, r = F.col("pred"), F.col("ref")
    scores = [rouge.rouge_n(p, r, 1), rouge.rouge_n(p, r, 2), rouge.rouge_l(p, r), rouge.rouge_lsum(p, r)]
    got = [tuple(round(v, 9) for v in x) for x in df.select(*[s["fmeasure"] for s in scores]).collect()]
    assert got[:4] == [(0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 1, 1)]
    assert got[4] == (0.75, round(2 / 3, 9), 0.75, 0.75) and got[5] == (1, 1, 1, 1)
