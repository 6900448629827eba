"""Clean documents as they arrive, and count what became of them.

The chain is made of row expressions only, so a stream runs the very same code
as a batch, the dear filters included: no state, no watermark, exactly-once
through the file sink. Counts per verdict are state, a few rows however long the
stream; each batch's counts are a folder of their own, so that a batch that is
run again after a stop writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gistmill.functions.language import LanguageProfile
from gistmill.functions.quality import QualityParams
from gistmill.operators.quality import describe_filter, filter_counts


def documents_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def clean_stream(
    documents: DataFrame,
    out_path: str,
    checkpoint: str,
    params: QualityParams | None = None,
    profile: LanguageProfile | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write documents with their verdict; ``available_now`` stops at the end
    of what is there, else the query keeps running."""
    judged = describe_filter(documents, params, profile=profile)
    writer = (
        judged.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def count_stream(
    documents: DataFrame,
    out_path: str,
    checkpoint: str,
    params: QualityParams | None = None,
    by: list[str] | None = None,
    profile: LanguageProfile | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep ``(by, filter, n)`` over all that has arrived; ``stream_counts``
    reads the counts as of the last batch."""
    counts = filter_counts(documents, params, by, profile=profile)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(store)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def stream_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """The counts that ``count_stream`` has stored last."""
    every = spark.read.parquet(out_path)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")
