"""Columns whose names hold dots, or equal the operators' own."""

from pyspark.sql import functions as F

from gistmill.llm import decontam, langid, line_templates, mixing, ngram_join

SF = "/root/testdata/sf0.001"


def test_names_with_dots(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.withColumns({"a.b": F.lit(1), "found": F.lit("x"), "score": F.lit(2.0), "b`c": F.lit(3)})
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert langid.accepted(docs).columns == docs.columns
    assert ngram_join.one_of_each(docs, words=5, num=80).columns == docs.columns
    kept = decontam.decontaminated(docs, items, inside=True)
    assert kept.columns == docs.columns and set(kept.agg(F.collect_set("`a.b`")).first()[0]) == {1}
    assert mixing.mix(docs).columns == docs.columns
    assert line_templates.without_recurring_lines(docs).columns[: len(docs.columns)] == docs.columns
