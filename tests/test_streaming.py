from pyspark.sql import functions as F

from gistmill.functions.quality import QualityParams, article_profile
from gistmill.functions.stopwords import ENGLISH
from gistmill.operators.language import language_profile, load_profile
from gistmill.operators.quality import describe_filter, filter_counts
from gistmill.session import new_folder
from gistmill.streaming.clean import clean_stream, count_stream, documents_stream, stream_counts


def test_stream_equals_batch(spark, texts):
    folder = new_folder(spark, "stream")
    good = "Det er en god og lang nok tekst om noget som ikke er alt for kort"
    docs = texts(*[good if i % 3 else "kort" for i in range(30)]).repartition(3)
    docs.write.parquet(f"{folder}/in")

    def run():
        stream = documents_stream(spark, f"{folder}/in", docs.schema, files_per_trigger=1)
        clean_stream(stream, f"{folder}/out", f"{folder}/log", article_profile()).awaitTermination()

    def verdicts(df):
        return sorted((r.id, r.filter) for r in df.collect())

    run()
    expected = verdicts(describe_filter(docs, article_profile()))
    assert verdicts(spark.read.parquet(f"{folder}/out")) == expected
    run()  # nothing new has arrived
    assert verdicts(spark.read.parquet(f"{folder}/out")) == expected


def test_whole_chain_and_counts_over_a_restart(spark):
    """N-grams and language in the stream; stopped and resumed in between."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    profile = load_profile(language_profile(docs))
    params = QualityParams(stop_words=ENGLISH, languages=("en",))
    folder = new_folder(spark, "chain")

    def run():
        stream = documents_stream(spark, f"{folder}/in", docs.schema, files_per_trigger=1)
        rows = clean_stream(stream, f"{folder}/out", f"{folder}/log", params, profile)
        counts = count_stream(stream, f"{folder}/counts", f"{folder}/counts-log", params, ["lang"], profile)
        rows.awaitTermination()
        counts.awaitTermination()

    def verdicts(df):
        return sorted((r["doc_id"], str(r["filter"])) for r in df.collect())

    def counted(df):
        return sorted(map(str, df.select("lang", "filter", "n").collect()))

    halves = [docs.where(F.col("doc_id") % 2 == k) for k in (0, 1)]
    halves[0].repartition(2).write.parquet(f"{folder}/in")
    run()
    assert counted(stream_counts(spark, f"{folder}/counts")) == counted(filter_counts(halves[0], params, ["lang"], profile=profile))
    halves[1].repartition(2).write.mode("append").parquet(f"{folder}/in")
    run()
    run()  # nothing new has arrived
    assert verdicts(spark.read.parquet(f"{folder}/out")) == verdicts(describe_filter(docs, params, profile=profile))
    assert counted(stream_counts(spark, f"{folder}/counts")) == counted(filter_counts(docs, params, ["lang"], profile=profile))
