import corpus_pipeline
from gistmill.llm import chat, decontam, ngram_join
from gistmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_each_by_its_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "decontamination", "mix_sources", "shard_groups"]
    told = stages["language_id"](spark, docs, SF)
    assert told.columns == docs.columns and told.count() == docs.count()  # all in one of the languages
    single = stages["ngram_jaccard_join"](spark, docs, SF)
    groups = ngram_join.ngram_groups(docs, words=5, num=80).select("component_id").distinct()
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(r[0] for r in groups.collect())
    clean = stages["decontamination"](spark, docs, SF)
    gone = decontam.hits(docs, benchmark).select("doc_id").distinct().count()
    assert clean.count() == docs.count() - gone and gone > 0
    mixed = stages["mix_sources"](spark, docs, SF)
    words = lambda df: df.selectExpr("sum(size(split(trim(text), '\\\\s+')))").first()[0]
    assert mixed.columns == docs.columns and abs(words(mixed) / words(docs) - 1.5) < 0.05
    placed = stages["shard_groups"](spark, docs, SF)
    assert placed.columns == [*docs.columns, "shard"]
    assert {r[0] for r in placed.select("shard").distinct().collect()} == set(range(corpus_pipeline.SHARDS))


def test_run_and_rejected_documents(spark, tmp_path):
    rows = [(i, f"the and of that was in on {i} " * 4, "en", f"s{i % 2}", 1) for i in range(30)]
    rows += [(40, None, "en", "s0", 0), (41, "123 456", "en", "s0", 7), (42, "item of the benchmark with many words in it", "en", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "item of the benchmark with many words in it")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} & {40, 41, 42} == set()
    assert len(got) > 30  # the mix takes more than all once
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and chat.CHATML.states
