from pyspark.sql import functions as F

from gistmill.operators import bootstrap as bs
from gistmill.operators import ranking as rk
from gistmill.plans import ratings

MODELS = ("a", "b", "c", "d")


def sheets(spark, *rows):
    names = ", ".join(f"{p} string" for p in ratings.PLACES)
    return spark.createDataFrame([(e, r, *s) for e, r, s in rows], f"example int, rater int, {names}")


def test_places_become_ranks_without_the_dropped_one(spark):
    raw = sheets(spark, (0, 1, "ceabd"), (1, 1, "abcde"))
    got = [tuple(r[m] for m in MODELS) for r in ratings.cleaned_ratings(raw).orderBy("example").collect()]
    assert got == [(2, 3, 1, 4), (1, 2, 3, 4)]


def test_preferences_ties_and_agreement(spark):
    cleaned = spark.createDataFrame(
        [(0, 1, 1, 1, 2, 3), (0, 2, 1, 2, 3, 4), (1, 1, 1, 2, 3, 4)],
        "example int, rater int, a int, b int, c int, d int",
    )
    prefs = rk.pairwise_preferences(cleaned, ["example", "rater"], MODELS)
    assert prefs.where("example = 0 AND rater = 1 AND relation = 'a>b'").first().preferred == 0
    paired = ratings.preferences(cleaned, (1, 2))
    assert paired.count() == 6  # the second example has one rater only
    row = rk.interrater_agreement(paired).first()
    assert (row.agreed, row.total) == (5, 6)


def test_summary_and_kappa(spark):
    ranks = spark.createDataFrame(
        [(e, r, "m", v) for e, vs in enumerate(((1, 1), (2, 2), (1, 2), (2, 1), (1, 1))) for r, v in zip((1, 2), vs)],
        "example int, rater int, model string, rank int",
    )
    s = rk.rank_summary(ranks).first()
    assert (s.mean, s.median, s.mode) == (1.4, 1.0, 1)
    # observed 3/5, by chance (3 * 3 + 2 * 2) / 25
    kappa = rk.cohen_kappa(ranks, (1, 2)).first().kappa
    assert abs(kappa - (0.6 - 13 / 25) / (1 - 13 / 25)) < 1e-12


def test_blind_sample(spark):
    df = spark.createDataFrame([(i, f"t{i}", f"x{i}", f"y{i}") for i in range(30)], "id int, text string, x string, y string")
    sheet, answers = rk.blind_sample(df, "id", {"one": "x", "two": "y"}, n=20)
    sample, keys = sheet.collect(), {r.id: r.answer_key for r in answers.collect()}
    assert sheet.columns == ["id", "text", "a", "b"]
    assert len(sample) == 20 and len(set(keys.values())) == 2
    for r in sample:
        told = dict(p.split("=") for p in keys[r.id].split(","))
        assert {told["a"]: r.a, told["b"]: r.b} == {"one": f"x{r.id}", "two": f"y{r.id}"}


def test_bootstrap_of_a_constant_and_of_agreement(spark):
    same = spark.range(40).selectExpr("id", "2.5D AS score")
    for method in ("draws", "poisson"):
        row = bs.bootstrap_mean(same, "score", "id", 50, method=method).first()
        assert [round(x, 9) for x in row] == [2.5] * 4
    assert [round(x, 9) for x in bs.sample_percentiles(same, "score", "id", 50).first()] == [2.5] * 4
    half = spark.range(100).selectExpr("id", "id % 2 AS l", "0L AS r")
    row = bs.paired_bootstrap(half, "l", "r", "id", 200).first()
    assert row.mean == 0.5 and 0.3 < row.low < row.mid < row.high < 0.7


def test_both_bootstraps_agree_with_theory(spark):
    scores = spark.range(400).selectExpr("id", "CAST(id AS DOUBLE) AS score")
    error = (400**2 / 12) ** 0.5 / 20
    for method in ("draws", "poisson"):
        row = bs.bootstrap_mean(scores, "score", "id", 400, method=method).first()
        assert row.mean == 199.5 and abs(row.mid - 199.5) < error
        assert 3 * error < row.high - row.low < 5 * error


def test_reports(spark):
    one = spark.createDataFrame([(1.0, 2.0, 3.0, 2.0)], "low double, mid double, high double, mean double")
    report = bs.metric_report({"x": one, "y": one})
    assert [r.metric for r in report.orderBy("metric").collect()] == ["x", "y"]
    assert bs.wide_report(report, ["x"]).first().x_high == 3.0


def test_a_score_is_made_once(spark, monkeypatch):
    stored, store = [], bs.written
    monkeypatch.setattr(bs, "written", lambda df, label: (stored.append(df), store(df, label))[1])
    rows = spark.createDataFrame([(i, "a " * i if i % 3 else None) for i in range(12)], "id int, text string")
    scores = rows.select("id", F.regexp_count("text", F.lit("a")).cast("double").alias("score"))
    for made in (bs.bootstrap_mean, bs.sample_percentiles):
        row = made(scores, "score", "id").first()
        assert row["mean"] == sum(i for i in range(12) if i % 3) / 8
    for df in stored:
        # a count is the size of all matches
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
