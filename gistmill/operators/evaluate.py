"""Score candidate summaries against references and source texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.functions import fragments as fr
from gistmill.functions import rouge
from gistmill.functions import tokens as tk
from gistmill.functions.vectors import embedding_match_score
from gistmill.operators.bootstrap import bootstrap_means

ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def rouge_scores(df: DataFrame, key: str, pred: str = "pred", ref: str = "summary") -> DataFrame:
    """F-measures per row, each side split to one sentence per line first."""
    p, r = F.col("_pred"), F.col("_ref")
    lined = df.select(
        key,
        tk.newline_sentences(F.col(pred)).alias("_pred"),
        tk.newline_sentences(F.col(ref)).alias("_ref"),
    )
    return lined.select(
        key,
        rouge.rouge_n(p, r, 1)["fmeasure"].alias("rouge1"),
        rouge.rouge_n(p, r, 2)["fmeasure"].alias("rouge2"),
        rouge.rouge_l(p, r)["fmeasure"].alias("rougeL"),
        rouge.rouge_lsum(p, r)["fmeasure"].alias("rougeLsum"),
    )


def with_fragments(
    df: DataFrame, summary: str = "summary", text: str = "text", case: bool = False,
    tokenize: bool = True,
) -> DataFrame:
    """Add the tokens as written (``s_written``, ``t_written``) and as compared
    (``s_tokens``, ``t_tokens``), and their ``matches``."""
    written_ = df.withColumns(
        {
            "s_written": fr.side_tokens(F.col(summary), tokenize, True),
            "t_written": fr.side_tokens(F.col(text), tokenize, True),
        }
    )
    lower = lambda c: F.col(c) if case else F.transform(c, F.lower)
    sides = written_.withColumns({"s_tokens": lower("s_written"), "t_tokens": lower("t_written")})
    return sides.withColumn("matches", fr.fragments(F.col("s_tokens"), F.col("t_tokens")))


def extractiveness(df: DataFrame, key: str, summary: str = "summary", text: str = "text") -> DataFrame:
    """``(key, coverage, density, compression)``."""
    found = df.select(key, fr.lifted(F.col(summary), F.col(text)).alias("_found"))
    scores = fr.scored(*[F.col("_found")[x] for x in ("matches", "n_summary", "n_text")])
    return found.select(key, F.inline(F.array(scores)))


def embedding_scores(vectors: DataFrame, pair: str = "pair") -> DataFrame:
    """``(pair, precision, recall, f1)`` from ``(pair, side, pos, vec)`` rows,
    side 'pred' or 'ref'. A pair's rows are the tokens of two summaries, a
    number the truncation lengths bound."""

    def gathered(side: str):
        rows = F.collect_list(F.when(F.col("side") == side, F.struct("pos", "vec")))
        return F.transform(F.sort_array(rows), lambda x: x["vec"])

    both = vectors.groupBy(pair).agg(gathered("pred").alias("p"), gathered("ref").alias("r"))
    return both.select(pair, F.inline(F.array(embedding_match_score(F.col("p"), F.col("r")))))


def evaluate(
    df: DataFrame, key: str, resamples: int = 1000, similarity: DataFrame | None = None
) -> DataFrame:
    """Report over ``(key, text, summary, pred)`` rows: overlap F-measures, the
    density of the predictions and, if given as ``(key, f1)``, similarity."""
    density = extractiveness(df, key, "pred", "text").select(key, "density")
    scores, metrics = rouge_scores(df, key).join(density, key), [*ROUGE, "density"]
    if similarity is not None:
        scores = scores.join(similarity.select(key, F.col("f1").alias("bertscore")), key, "left")
        metrics.append("bertscore")
    return bootstrap_means(scores, metrics, key, resamples)
