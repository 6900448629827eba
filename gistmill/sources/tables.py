"""Parquet and CSV tables, and stages kept between runs."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gistmill.session import shared_folder

PAIRS_SCHEMA = StructType(
    [
        StructField("text", StringType()),
        StructField("summary", StringType()),
        StructField("density", DoubleType()),
        StructField("density_bin", StringType()),
    ]
)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan. How finely it is split is the session's to say, with
    ``spark.sql.files.maxPartitionBytes`` and ``minPartitionNum``."""
    return spark.read.parquet(path)


def _csv_options(sep: str) -> dict[str, object]:
    # Quotes are doubled and line breaks may stand inside them.
    return {"header": True, "sep": sep, "quote": '"', "escape": '"', "lineSep": "\n"}


def read_pairs(
    spark: SparkSession,
    path: str | dict[str, str],
    schema: StructType = PAIRS_SCHEMA,
    sep: str = ",",
) -> DataFrame | dict[str, DataFrame]:
    """Header CSV with a declared schema; a mapping of split names to files
    gives a mapping of tables.

    Quoted line breaks keep Spark from splitting a file, so a large CSV should
    come as many files and be turned to Parquet before further work.
    """
    if isinstance(path, dict):
        return {name: read_pairs(spark, p, schema, sep) for name, p in path.items()}
    # A missing value is a blank field, an empty string a quoted one. Naming a
    # null marker that no text holds is what keeps the two apart.
    reader = spark.read.schema(schema).options(**_csv_options(sep))
    return reader.options(multiLine=True, nullValue="\x00", mode="FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).options(**_csv_options(sep), nullValue="", emptyValue='""')
    writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """One folder per split value."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def stage(df: DataFrame, name: str, redo: bool = False, folder: str | None = None) -> DataFrame:
    """Result kept under ``name``: read it back if an earlier run finished it,
    else (or with ``redo``) compute and write it.

    Beside the result stands what it was made from: the plan and its input
    files. A stage made from something else is not reused but refused; one that
    was not written to its end is written again.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/stages/{name}"
    mark = source_mark(df)
    if not redo and _exists(spark, f"{path}/data/_SUCCESS") and _exists(spark, f"{path}/made_from/_SUCCESS"):
        if spark.read.text(f"{path}/made_from").first()[0] != mark:
            raise ValueError(f"stage {name!r} was made from another input: redo it or rename it")
        return spark.read.parquet(f"{path}/data")
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").text(f"{path}/made_from")
    return spark.read.parquet(f"{path}/data")


def source_mark(df: DataFrame) -> str:
    """Hash of a table's plan, without the numbers Spark gives its columns, and
    of the files it reads."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    plan = re.sub(r"#\d+L?|\[plan_id=\d+\]", "", plan)
    return hashlib.sha256("\n".join([plan, df.schema.simpleString(), *sorted(df.inputFiles())]).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def first_pairs(df: DataFrame, key: str, columns: list[str], n: int = 100) -> DataFrame:
    """The ``n`` rows with the smallest keys, to write out as a sample."""
    return df.select(key, *columns).orderBy(key).limit(n)
