"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks import all_checks  # noqa: E402
from gistmill.session import drop_folders  # noqa: E402

HEADLINES = (
    "article_profile",
    "describe_filter",
    "duplicate_ngram_chr_fraction",
    "top_ngram_chr_fraction",
    "language_scores",
    "clean_pairs",
    "exact_split",
    "density",
    "rouge_n",
    "rouge_l",
    "rouge_lsum",
    "lead_n",
    "textrank_n",
    "embedding_match_score",
    "bootstrap_mean",
    "interrater_agreement",
    "token_counts",
    "vocab_overlap",
    "topk_coverage",
    "histogram",
)


FILES = 16


def dealt(spark: SparkSession, sf_dir: str, to: str) -> str:
    """The tables as a cluster would hold them, in several files each. The given
    ones are a single row group, which one core reads whatever the settings."""
    for table in sorted(Path(sf_dir).glob("*.parquet")):
        spark.read.parquet(str(table)).repartition(FILES).write.parquet(f"{to}/{table.name}")
    return to


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="gistmill-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        # one task a file of the dealt tables
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_checks()
    names = [n for n in HEADLINES if n in (sys.argv[1:] or HEADLINES)]
    sf_dir = dealt(spark, sf_dir, f"{folder}/{Path(sf_dir).name}")
    # One untimed run starts the JVM, its compiler and the Python workers.
    queries["lead_n"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        drop_folders(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
