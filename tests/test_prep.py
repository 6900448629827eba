import os

import pytest
from pyspark.sql import functions as F

from gistmill import session
from gistmill.operators import bootstrap as bs
from gistmill.operators import order, prep, stats
from gistmill.operators.order import dense_index
from gistmill.plans.clean import clean_pairs, split_pairs
from gistmill.session import new_folder
from gistmill.sources import tables as src


def binned(spark, sizes):
    rows = [(f"{b}{i}", b) for b, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, density_bin string")


def split_sizes(df):
    return {(r.density_bin, r.split): r["count"] for r in df.groupBy("density_bin", "split").count().collect()}


def test_exact_split_sizes_and_half_even_rounding(spark):
    # 25 / 10 rounds half to even: 2
    got = prep.exact_split(binned(spark, {"abstractive": 25, "mixed": 40, "extractive": 9}), "id")
    assert split_sizes(got) == {
        ("abstractive", "test"): 2, ("abstractive", "validation"): 2, ("abstractive", "train"): 21,
        ("mixed", "test"): 2, ("mixed", "train"): 38,
        ("extractive", "test"): 2, ("extractive", "train"): 7,
    }


def test_exact_split_is_repeatable_and_seeded(spark):
    df = binned(spark, {"abstractive": 300, "mixed": 50})
    first, again, other = (
        {r.id: r.split for r in prep.exact_split(df.repartition(n), "id", seed=s).collect()}
        for n, s in ((1, 22), (7, 22), (3, 23))
    )
    assert first == again != other
    assert sum(v == "test" for v in first.values()) == 60


def test_exact_split_odd_bins(spark):
    few = prep.exact_split(binned(spark, {"abstractive": 40, "mixed": 3, "other": 2}), "id")
    assert split_sizes(few)[("mixed", "test")] == 3
    assert split_sizes(few)[("other", None)] == 2
    none = prep.exact_split(binned(spark, {"abstractive": 4, "mixed": 3}), "id")
    assert {k[1] for k in split_sizes(none)} == {"train"}


def test_cuts_in_refined_slices(spark, monkeypatch):
    monkeypatch.setattr(order, "PREFIX", 1)
    df = spark.range(900).select(F.lit("b").alias("g"), F.md5(F.col("id").cast("string")).alias("d"))
    ks = spark.createDataFrame([("b", "x", 100), ("b", "y", 451), ("b", "z", 900), ("b", "none", 901)], "g string, name string, k long")
    want = sorted(r.d for r in df.collect())
    for rows in (1, 7, 1000):
        monkeypatch.setattr(order, "SLICE_ROWS", rows)
        got = {r.name: r.cut for r in order.kth_hash(df, order.hash_slices(df, "g", "d"), "g", "d", ks).collect()}
        assert got == {"x": want[99], "y": want[450], "z": want[899]}


def test_dense_index_with_a_crowded_range(spark):
    keys = [0, 10**12] + list(range(500, 900)) + [-5]
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(5)
    got = {r.key: r.idx for r in dense_index(df, "key").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("parts", ["1", "4"])
def test_dense_index_of_any_key_and_no_rows(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        keys = ["http://b", "http://a", "é", "", None]
        df = spark.createDataFrame([(k,) for k in keys], "key string")
        got = {r.key: r.idx for r in dense_index(df, "key").collect()}
        assert got == {None: 0, "": 1, "http://a": 2, "http://b": 3, "é": 4}
        assert dense_index(df.limit(0), "key").count() == 0
        none = spark.createDataFrame([], "key string, x double")
        for method in ("draws", "poisson"):
            row = bs.bootstrap_mean(none, "x", "key", 10, method=method).first()
            assert tuple(row) == (None,) * 4
        assert tuple(bs.sample_percentiles(none, "x", "key", 10).first()) == (None,) * 4
        named = spark.createDataFrame([(f"k{i}", float(i % 2), 3.0) for i in range(40)], "key string, x double, y double")
        both = {r.metric: r for r in bs.bootstrap_means(named, ["x", "y"], "key", 200).collect()}
        assert both["y"].low == both["y"].high == 3.0 and 0.2 < both["x"].low < 0.5 < both["x"].high < 0.8
        pair = bs.paired_bootstrap(named, "x", "y", "key", 50, stat=F.max("x") - F.min("y")).first()
        assert pair["mean"] == -2.0
        with pytest.raises(ValueError):
            bs.bootstrap_mean(named, "x", "key", method="posson")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_cutoff_uses_bounds_of_all_rows(spark):
    df = spark.createDataFrame([(i, 100 - i) for i in range(101)], "a int, b int")
    got = sorted(r.a for r in prep.quantile_cutoff(df, ["a", "b"], 0.02, 0.95).collect())
    assert got == list(range(5, 96))


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, "abstractive", True), (2, "mixed", False), (3, "extractive", None), (4, None, True)],
        "id int, density_bin string, passed boolean",
    )
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(prep.passed_filter(df)) == [1, 4]
    assert ids(prep.passed_filter(df, False)) == [1, 2, 3, 4]
    assert ids(prep.summary_type_filter(df)) == [1, 4]
    assert ids(prep.summary_type_filter(df, ("abstractive", "mixed", "extractive"))) == [1, 2, 3, 4]
    assert prep.not_null(df, "density_bin", ["id"]).columns == ["id"]


def test_flatten_reshape_and_batches(spark):
    df = spark.range(10).select("id", F.struct(F.lit(1).alias("x"), F.struct(F.lit("q").alias("z")).alias("y")).alias("s"))
    assert prep.flatten_struct(df).columns == ["id", "s.x", "s.y.z"]
    sized = prep.batched_map(df.select("id").coalesce(1), lambda f: f.assign(n=len(f)), "id long, n long", 4)
    assert sorted(r.n for r in sized.collect()) == [2, 2] + [4] * 8
    out = prep.reshape(df, add={"w": F.lit(2)}, drop=["s"], rename={"id": "key"}, order=["w"])
    assert out.columns == ["w", "key"]


def test_csv_round_trip_of_awkward_text(spark):
    rows = [(' lead "q" ; , ', "a\nb\r\n\"c\""), ("", None), (None, "æ\\n"), ("tab\t", " ")]
    df = spark.createDataFrame(rows, "text string, summary string")
    schema = df.schema
    for sep in (",", ";"):
        path = new_folder(spark, "t")
        src.write_csv(df, path, sep)
        got = {tuple(r) for r in src.read_pairs(spark, path, schema, sep).collect()}
        assert got == set(rows)
        assert set(src.read_pairs(spark, {"train": path}, schema, sep)) == {"train"}


def test_stage_is_reused_until_redone(spark):
    folder = new_folder(spark, "s")
    src.stage(spark.range(3), "x", folder=folder)
    kept = src.stage(spark.range(3), "x", folder=folder)
    assert kept.count() == 3 and "/stages/x/" in kept.inputFiles()[0]
    for other in (spark.range(7), spark.range(3).toDF("k")):
        with pytest.raises(ValueError, match="another input"):
            src.stage(other, "x", folder=folder)
    assert src.stage(spark.range(9), "x", redo=True, folder=folder).count() == 9
    half = f"{folder}/stages/y/data"
    spark.range(2).write.parquet(half)
    os.remove(f"{half}/_SUCCESS")
    assert src.stage(spark.range(4), "y", folder=folder).count() == 4


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)], "x double")
    got = {r.bin: (r.lo, r.hi, r.n) for r in stats.histogram(df, "x", 5).collect()}
    assert got == {0: (0, 2, 2), 1: (2, 4, 1), 2: (4, 6, 0), 3: (6, 8, 0), 4: (8, 10, 1)}
    flat = stats.histogram(spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double"), "x", 5)
    assert sorted((r.bin, r.n) for r in flat.collect()) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert stats.histogram(df.limit(0), "x", 5).count() == 0


def test_length_stats(spark):
    df = prep.labelled_union({"a": spark.range(3), "b": spark.range(1)})
    got = {r.type: (r.min_id, r.mean_id, r.max_id) for r in stats.length_stats(df, ["id"]).collect()}
    assert got == {"a": (0, 1.0, 2), "b": (0, 0.0, 0)}


def test_pipeline(spark):
    text = "Det er en god og lang tekst om noget som ikke er alt for kort &amp; s{}"
    rows = [(i, text.format(" ord" * i), "en ganske fin opsummering på mere end tredive tegn", "mixed") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, summary string, density_bin string")
    cleaned = clean_pairs(df)
    assert cleaned.count() == 56
    row = cleaned.first()
    assert "&amp;" not in row.text and row.passed and row.filter is None
    assert {r.split for r in split_pairs(cleaned, "id").collect()} == {"train"}


def test_stored_folders_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    path = session.written(spark.range(3)).inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    session.drop_folders(spark)
    assert not os.path.exists(path) and not session._made
