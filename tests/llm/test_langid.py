import math

import numpy as np
from pyspark.sql import functions as F

from gistmill.llm import langid
from gistmill.llm.langid import Settings, fit, fit_temperature, fit_weights, identify, slots
from gistmill.llm.queries import op5_language_id

SF = "/root/testdata/sf0.01"


def test_slots_do_not_depend_on_chunks(monkeypatch):
    text = "Été où, 12 garçons -- ÀÉ x. " * 50
    whole = slots(text)
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert (slots(text) == whole).all()
    assert not slots("").any() and (slots("A b") == slots("a  -b")).all()


def test_sparse_weights_separate_and_temperature_calibrates():
    r = np.random.default_rng(0)
    rows = [(np.array([y, 10 + int(r.integers(50))]), np.array([1.0, 0.2]), y) for y in r.integers(0, 3, 300).tolist()]
    w, b = fit_weights(rows, 3, Settings(l1=0.5))
    assert all((x @ w[at] + b).argmax() == y for at, x, y in rows)
    assert (w != 0).mean() < 0.001
    heavy, _ = fit_weights(rows, 3, Settings(l1=1e6))
    assert not heavy.any()
    labels = r.integers(0, 2, 4000)
    odds = np.where(r.random(4000) < 0.8, labels, 1 - labels)
    logits = np.eye(2)[odds] * 10  # right in 4 of 5, but nearly certain
    t = fit_temperature(logits, labels)
    assert abs(np.exp(10 / t) / (1 + np.exp(10 / t)) - 0.8) < 0.03


def test_held_out_accuracy(spark):
    got = op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    held = got.where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(held) > 150
    right = np.array([r["lang"] == r["lang_pred"] for r in held])
    assert right.mean() > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


def test_edge_cases(spark):
    texts = [("der die das und ist nicht " * 5, "de"), ("the and of that is not " * 5, "en")]
    rows = [(i, f"{texts[i % 2][0]} {i}", texts[i % 2][1]) for i in range(80)]
    rows += [(90, None, "en"), (91, "", "de"), (92, "12 !? 3", "en"), (93, "the of", None), (94, rows[0][1], "de")]
    docs = spark.createDataFrame(rows, "key long, text string, lang string")
    model = fit(docs)
    assert model.labels == ["de", "en"]
    asked = docs.selectExpr("*", "'x' as lang_pred", "1 as score", "2 as found")
    asked = asked.union(spark.createDataFrame([(95, "und nicht der " * 100_000, None, "x", 1, 2)], asked.schema))
    got = {r["key"]: r for r in identify(asked, model).collect()}
    assert len(got) == 86 and asked.columns == identify(asked, model).columns[:-2]
    assert all(got[i]["_lang_pred"] == "und" and got[i]["_score"] == 0 for i in (90, 91, 92))
    assert got[93]["_lang_pred"] == "en" and got[95]["_lang_pred"] == got[0]["_lang_pred"] == "de"
    assert got[94]["_score"] == got[0]["_score"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert [tuple(r) for r in identify(docs, model).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert langid.accepted(docs.limit(0)).columns == docs.columns


def test_sample_is_bounded_and_deterministic(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = langid.learn(docs, Settings(sample=200))
    b = langid.learn(docs.repartition(5), Settings(sample=200))
    assert np.allclose(a.weights, b.weights) and abs(a.temperature - b.temperature) < 1e-6
    held = docs.select(langid.is_held_out(F.col("doc_id")).alias("h")).agg(F.mean(F.col("h").cast("int"))).first()[0]
    assert 0.2 < held < 0.3


def test_weights_as_coordinate_by_coordinate():
    """The optimiser written out with one number at a time, over ten rows."""
    r = np.random.default_rng(3)
    rows = [(np.sort(r.choice(30, 4, replace=False)), r.random(4), int(r.integers(3))) for _ in range(10)]
    s = Settings(alpha=0.4, beta=0.7, l1=0.05, l2=0.2, passes=2, seed=5)
    got, bias = fit_weights(rows, 3, s)
    size = len(got)
    z, n = {}, {}

    def weight(i, k):
        a = z.get((i, k), 0.0)
        if abs(a) <= s.l1:
            return 0.0
        return -(a - math.copysign(s.l1, a)) / ((s.beta + math.sqrt(n.get((i, k), 0.0))) / s.alpha + s.l2)

    order = np.random.default_rng(s.seed)
    for _ in range(s.passes):
        for row in order.permutation(10):
            at, x, label = rows[row]
            entries = [*zip(at.tolist(), x.tolist(), strict=True), (size, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in entries for k in range(3)}
            odds = [math.exp(sum(w[i, k] * v for i, v in entries)) for k in range(3)]
            for i, v in entries:
                for k in range(3):
                    g = v * (odds[k] / sum(odds) - (k == label))
                    old = n.get((i, k), 0.0)
                    n[i, k] = old + g * g
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * w[i, k]
    want = np.array([[weight(i, k) for k in range(3)] for i in range(size)])
    assert np.allclose(got, want, atol=1e-12) and np.allclose(bias, [weight(size, k) for k in range(3)])
    assert (want != 0).any() and (want == 0).any()


def test_features_by_hand():
    idf = np.random.default_rng(0).random(1 << langid.SLOT_BITS) + 1
    counts = slots("ab ab")
    at, x = langid.features("ab ab", idf)
    raw = {i: counts[i] * idf[i] for i in np.flatnonzero(counts).tolist()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert at.tolist() == sorted(raw) and np.allclose(x, [raw[i] / norm for i in sorted(raw)])
    rare, n = langid.rarity(counts, idf)
    assert n == counts.sum() and abs(rare - sum(counts[i] * idf[i] for i in raw) / n) < 1e-12


def test_temperature_does_not_collapse():
    logits, labels = np.eye(3)[np.arange(60) % 3] * 4, np.arange(60) % 3  # told apart without error
    assert fit_temperature(logits, labels) > 0.2


def test_scores_of_short_and_of_unknown_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    short = docs.where(langid.is_held_out(F.col("doc_id"))).withColumn("text", F.substring("text", 100, 50))
    told = identify(short.where(F.length("text") > 20), model).select("lang", "lang_pred", "score").collect()
    score = np.array([r["score"] for r in told])
    right = np.array([r["lang"] == r["lang_pred"] for r in told])
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(right[bins == b].sum() - score[bins == b].sum()) for b in range(10)) / len(told)
    assert len(told) > 150 and error < 0.05
    other = spark.createDataFrame(
        [
            (1, "Всички хора се раждат свободни и равни по достойнство и права"),
            (2, "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である"),
            (3, "xq zv kk qqwx zzpt vbnm"),
            (4, "xq zv kk qqwx zzpt vbnm " * 40),
        ],
        "doc_id long, text string",
    )
    assert all(r["score"] < 0.3 for r in identify(other, model).collect())
    asked = docs.withColumn("a.b", F.lit(1)).unionByName(other, allowMissingColumns=True)
    kept = langid.accepted(asked)
    assert kept.columns == asked.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
