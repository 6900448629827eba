"""Sources, projections, cut-offs, splits, rankings, vocabulary, statistics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from checks.evaluation import draws_sql, INTERVAL, rounded
from checks.registry import check
from checks.views import (
    PAIRS,
    RATINGS,
    TOKEN,
    density_sql,
    documents,
    pair_bins,
    pairs,
    r6,
    ratings_raw,
    sql_all,
    sql_sentences,
    table,
)
from checks.quality import SUMMARY, ARTICLE, chain_sql, simple_sql
from gistmill.functions import tokens as tk
from gistmill.functions import repair as repair_
from gistmill.functions.repair import compose
from gistmill.operators import prep, ranking as rk, stats, vocab as vc
from gistmill.operators.order import dense_index
from gistmill.plans import clean, ratings, vocabulary
from gistmill.session import new_folder, written
from gistmill.sources import tables as src

# --- sources and sinks ------------------------------------------------------

TEXT_SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("text", StringType())]
)
TEXTS = "SELECT doc_id, lang, text FROM documents"


def csv_round_trip(spark, sf_dir, sep):
    path = new_folder(spark, "csv")
    src.write_csv(documents(spark, sf_dir).select("doc_id", "lang", "text"), path, sep)
    return src.read_pairs(spark, path, TEXT_SCHEMA, sep)


@check("read_pairs", TEXTS)
def read_pairs(spark, sf_dir):
    return csv_round_trip(spark, sf_dir, ",")


@check("csv_separator", TEXTS)
def csv_separator(spark, sf_dir):
    return csv_round_trip(spark, sf_dir, ";")


@check("pruned_scan", "SELECT text FROM documents")
def pruned_scan(spark, sf_dir):
    return documents(spark, sf_dir).select("text")


@check(
    "split_sink",
    "SELECT lang AS split, doc_id, n_chars FROM documents",
)
def split_sink(spark, sf_dir):
    path = new_folder(spark, "splits")
    rows = documents(spark, sf_dir).select("doc_id", "n_chars", F.col("lang").alias("split"))
    src.write_splits(rows, path)
    return spark.read.parquet(path)


@check("stage_cache", f"SELECT doc_id, len({sql_all('text', TOKEN)})::INTEGER AS n FROM documents")
def stage_cache(spark, sf_dir):
    folder = new_folder(spark, "kept")
    counted = documents(spark, sf_dir).select("doc_id", tk.token_len(F.col("text")).alias("n"))
    first = src.stage(counted, "lengths", folder=folder)
    again = src.stage(counted, "lengths", folder=folder)
    if sorted(first.inputFiles()) != sorted(again.inputFiles()):
        raise RuntimeError("the stage was computed again")
    return again


@check("first_pairs", f"WITH {PAIRS} SELECT id, summary, pred FROM pairs ORDER BY id LIMIT 100")
def first_pairs(spark, sf_dir):
    return src.first_pairs(pairs(spark, sf_dir), "id", ["summary", "pred"])


# --- projections ------------------------------------------------------------


@check(
    "reshape",
    "SELECT lang AS language, doc_id AS id, length(text)::INTEGER AS chars, n_chars FROM documents",
)
def reshape(spark, sf_dir):
    return prep.reshape(
        documents(spark, sf_dir),
        add={"chars": F.length("text")},
        drop=["text", "source"],
        names=["doc_id", "text", "tongue", "source", "n_chars"],
        rename={"doc_id": "id", "tongue": "language"},
        order=["language", "id"],
    )


def replaced(expr: str, pairs_: list[tuple[str, str]]) -> str:
    for old, new in pairs_:
        expr = f"replace({expr}, {old}, {new})"
    return expr


# Every entity the pages hold, the ampersand last so that none is read twice.
ENTITIES = [
    ("'&middot;'", "'·'"), ("'&copy;'", "'©'"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"),
]


@check(
    "repair_text",
    f"SELECT page_id, nfc_normalize(replace({replaced('html', ENTITIES)}, chr(13) || chr(10), chr(10))) "
    "AS text FROM pages",
)
def repair(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return repair_.repaired(pages.select("page_id", F.col("html").alias("text")), ["text"], unescape=True)


@check("repair_damaged", "SELECT doc_id, text FROM documents")
def repair_damaged(spark, sf_dir):
    """Every other accented letter is written as its UTF-8 bytes read as
    Windows-1252, the others as base letter and mark; repair undoes both."""
    damaged = F.col("text")
    for i, x in enumerate("éèêàçöüäßñáíóúÉÈÊÀÄÖÜÑÇ"):
        wrong = x.encode().decode("latin-1").translate(dict(zip(map(ord, repair_.C1), repair_.CP1252)))
        apart = unicodedata.normalize("NFD", x)
        damaged = F.replace(damaged, F.lit(x), F.lit(wrong if i % 2 == 0 else apart))
    return repair_.repaired(documents(spark, sf_dir).select("doc_id", damaged.alias("text")), ["text"])


@check("compose_text", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def compose_text(spark, sf_dir):
    """Texts are taken apart into base letters and marks, then composed."""
    letters = "éèêëàâäçïîôöùûüñáíóúÉÈÊÀÄÖÜÑÁÍÓÚÇ"
    apart = F.col("text")
    for x in letters:
        apart = F.replace(apart, F.lit(x), F.lit(unicodedata.normalize("NFD", x)))
    return documents(spark, sf_dir).select("doc_id", compose(apart).alias("text"))


@check(
    "token_len",
    f"SELECT doc_id, len({sql_all('text', TOKEN)})::INTEGER AS tok_text_len FROM documents",
)
def token_len(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tk.token_len(F.col("text")).alias("tok_text_len"))


@check(
    "truncate_tokens",
    f"SELECT doc_id, list_slice({sql_all('text', TOKEN)}, 1, 128) AS tokens FROM documents",
)
def truncate_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", tk.truncate_tokens(F.col("text"), 128).alias("tokens")
    )


@check(
    "newline_sentences",
    f"SELECT doc_id, array_to_string({sql_sentences('text')}, chr(10)) AS sentences FROM documents",
)
def newline_sentences(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", tk.newline_sentences(F.col("text")).alias("sentences")
    )


@check(
    "line_and_paragraph_arrays",
    "SELECT doc_id, string_split(text, chr(10)) AS lines, "
    "string_split(text, chr(10) || chr(10)) AS paragraphs FROM documents",
)
def line_arrays(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        tk.line_array(F.col("text")).alias("lines"),
        tk.paragraph_array(F.col("text")).alias("paragraphs"),
    )


def labelled_sql() -> str:
    """Labels stand in for the two pass flags; a document may have none."""
    return """flags AS (SELECT d.doc_id, d.text, l.quality = 1 AS passed_quality,
       l.toxic = 0 AS passed_quality_sum FROM documents d LEFT JOIN labels l USING (doc_id))"""


def labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return (
        documents(spark, sf_dir)
        .select("doc_id", "text")
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            "text",
            (F.col("quality") == 1).alias("passed_quality"),
            (F.col("toxic") == 0).alias("passed_quality_sum"),
        )
    )


@check(
    "both_passed",
    f"WITH {labelled_sql()} SELECT doc_id, coalesce(passed_quality AND passed_quality_sum, false) "
    "AS passed FROM flags",
)
def both_passed(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", prep.both_passed().alias("passed"))


@check(
    "flatten_struct",
    'SELECT doc_id AS id, lang AS "meta.lang", source AS "meta.from.source", '
    'n_chars AS "meta.from.n_chars" FROM documents',
)
def flatten_struct(spark, sf_dir):
    nested = documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.struct("lang", F.struct("source", "n_chars").alias("from")).alias("meta"),
    )
    return prep.flatten_struct(nested)


@check("batched_map", "SELECT doc_id, length(text) AS n, upper(lang) AS lang FROM documents")
def batched_map(spark, sf_dir):
    def measure(frame):
        return frame.assign(n=frame.text.str.len(), lang=frame.lang.str.upper())[["doc_id", "n", "lang"]]

    rows = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return prep.batched_map(rows, measure, "doc_id long, n long, lang string", 32)


# --- cut-offs and filters ---------------------------------------------------

LENGTHS = f"""{PAIRS},
lens AS MATERIALIZED (SELECT id, len({sql_all("text", TOKEN)})::INTEGER AS tok_text_len,
         len({sql_all("summary", TOKEN)})::INTEGER AS tok_sum_len FROM pairs),
cut AS (SELECT quantile_cont(tok_text_len, 0.02) AS a, quantile_cont(tok_text_len, 0.98) AS b,
               quantile_cont(tok_sum_len, 0.02) AS c, quantile_cont(tok_sum_len, 0.98) AS d FROM lens),
kept AS MATERIALIZED (SELECT lens.* FROM lens, cut
         WHERE tok_text_len BETWEEN a AND b AND tok_sum_len BETWEEN c AND d)"""


def lengths(spark, sf_dir):
    """Stored, since the bounds and the rows within them are read one after the other."""
    rows = clean.with_lengths(pairs(spark, sf_dir)).select("id", "tok_text_len", "tok_sum_len")
    return written(rows, "lengths")


@check("quantile_cutoff", f"WITH {LENGTHS} SELECT * FROM kept")
def quantile_cutoff(spark, sf_dir):
    rows = lengths(spark, sf_dir)
    return prep.quantile_cutoff(rows, ["tok_text_len", "tok_sum_len"])


@check(
    "density_filter",
    f"WITH {density_sql()} SELECT id, round(density, 6) AS density FROM bins WHERE density <= 1.5::DOUBLE",
)
def density_filter(spark, sf_dir):
    kept = prep.density_filter(pair_bins(spark, sf_dir))
    return kept.select("id", r6(F.col("density")).alias("density"))


@check(
    "passed_filter",
    f"WITH {labelled_sql()} SELECT doc_id FROM flags WHERE passed_quality AND passed_quality_sum",
)
def passed_filter(spark, sf_dir):
    flagged = labelled(spark, sf_dir).withColumn("passed", prep.both_passed())
    return prep.passed_filter(flagged).select("doc_id")


@check(
    "summary_type_filter",
    f"WITH {density_sql()} SELECT id, density_bin FROM bins WHERE density_bin <> 'extractive'",
)
def summary_type_filter(spark, sf_dir):
    kept = prep.summary_type_filter(pair_bins(spark, sf_dir), ("abstractive", "mixed"))
    return kept.select("id", "density_bin")


@check("not_null", f"WITH {labelled_sql()} SELECT text FROM flags WHERE passed_quality IS NOT NULL")
def not_null(spark, sf_dir):
    return prep.not_null(labelled(spark, sf_dir), "passed_quality", ["text"])


# --- splits and set operations ----------------------------------------------

SPLIT = f"""{density_sql()},
n AS (SELECT round_even(count(*) / 10.0, 0)::BIGINT AS k FROM bins WHERE density_bin = 'abstractive'),
placed AS (SELECT id, density_bin, row_number() OVER (PARTITION BY density_bin
           ORDER BY md5(id || ':22')) AS p FROM bins),
split AS MATERIALIZED (SELECT id, density_bin, CASE WHEN p <= k THEN 'test'
           WHEN density_bin = 'abstractive' AND p <= 2 * k THEN 'validation' ELSE 'train' END AS split
         FROM placed, n)"""


@check("exact_split", f"WITH {SPLIT} SELECT id, density_bin, split FROM split")
def exact_split(spark, sf_dir):
    binned = written(pair_bins(spark, sf_dir).select("id", "density_bin"))
    return prep.exact_split(binned, "id")


@check(
    "concatenate",
    "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents UNION ALL SELECT lang FROM documents) "
    "GROUP BY lang",
)
def concatenate(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang")
    both = prep.concatenate(docs, docs.select("lang", "doc_id"))
    return both.groupBy("lang").agg(F.count("*").alias("n"))


LABELLED = f"""{LENGTHS},
combo AS (SELECT 'clean' AS type, * FROM kept UNION ALL SELECT 'raw' AS type, * FROM lens)"""


def combo(spark, sf_dir):
    rows = lengths(spark, sf_dir)
    kept = prep.quantile_cutoff(rows, ["tok_text_len", "tok_sum_len"])
    return prep.labelled_union({"clean": kept, "raw": rows})


@check("labelled_union", f"WITH {LABELLED} SELECT * FROM combo")
def labelled_union(spark, sf_dir):
    return combo(spark, sf_dir)


COUNTS = f"""
ta AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({sql_all("text", TOKEN)}) AS token
       FROM documents) GROUP BY token),
tb AS (SELECT token, count(*) AS cnt FROM (SELECT unnest({sql_all("text", TOKEN)}) AS token
       FROM benchmark) GROUP BY token)"""


def corpus_counts(spark, sf_dir, name="documents"):
    return vc.token_counts(table(spark, sf_dir, name))


@check(
    "membership",
    f"WITH {COUNTS} SELECT coalesce(ta.token, tb.token) AS token, ta.token IS NOT NULL AS in_a, "
    "tb.token IS NOT NULL AS in_b FROM ta FULL JOIN tb ON ta.token = tb.token",
)
def membership(spark, sf_dir):
    return vc.membership(corpus_counts(spark, sf_dir), corpus_counts(spark, sf_dir, "benchmark"))


# --- vocabulary -------------------------------------------------------------


@check("token_counts", f"WITH {COUNTS} SELECT token, cnt FROM ta")
def token_counts(spark, sf_dir):
    return corpus_counts(spark, sf_dir)


@check(
    "vocab_overlap",
    f"""WITH {COUNTS}, m AS (SELECT ta.token AS a, tb.token AS b FROM ta FULL JOIN tb
  ON ta.token = tb.token),
s AS (SELECT count(a) AS size_a, count(b) AS size_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL)
  AS common, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b,
  count(*) AS total FROM m)
SELECT *, round(common * 100.0::DOUBLE / size_a, 6) AS pct_a_in_b,
  round(total * 100.0::DOUBLE / 250000, 6) AS pct_of_vocab FROM s""",
)
def vocab_overlap(spark, sf_dir):
    found = vc.vocab_overlap(
        corpus_counts(spark, sf_dir), corpus_counts(spark, sf_dir, "benchmark"), 250_000
    )
    return found.withColumns({c: r6(F.col(c)) for c in ("pct_a_in_b", "pct_of_vocab")})


KS = (10, 100, 1_000, 10_000, 100_000)


@check(
    "topk_coverage",
    f"""WITH {COUNTS}, o AS (SELECT cnt, row_number() OVER (ORDER BY cnt DESC, token) AS p FROM ta)
SELECT k::INTEGER AS k, round(sum(cnt)::DOUBLE / (SELECT sum(cnt) FROM ta), 6) AS share
FROM o, (VALUES {", ".join(f"({k})" for k in KS)}) x(k) WHERE p <= k GROUP BY k""",
)
def topk_coverage(spark, sf_dir):
    share = vc.topk_coverage(corpus_counts(spark, sf_dir), KS)
    return share.withColumn("share", r6(F.col("share")))


@check("top_tokens", f"WITH {COUNTS} SELECT token, cnt FROM ta ORDER BY cnt DESC, token LIMIT 30")
def top_tokens(spark, sf_dir):
    return vc.top_tokens(corpus_counts(spark, sf_dir))


# Token ids for the vocabulary checks: what customers order, and what they buy.
SIZES = {"reserved": 100, "top_first": 400, "top_second": 900, "cap": 1_000, "tail": 50}
VOCAB = 2_000
IDS = """
ia AS (SELECT l_partkey AS token, count(*) AS cnt FROM lineitem GROUP BY l_partkey),
ib AS (SELECT o_custkey AS token, count(*) AS cnt FROM orders GROUP BY o_custkey),
low AS (SELECT * FROM range(100) t(token) UNION
        SELECT token FROM (SELECT token FROM ia ORDER BY cnt DESC, token LIMIT 400)),
fresh AS (SELECT token, cnt FROM (SELECT token, cnt FROM ib ORDER BY cnt DESC, token LIMIT 900)
          WHERE token NOT IN (SELECT token FROM low)),
added AS (SELECT token FROM fresh
          QUALIFY row_number() OVER (ORDER BY cnt DESC, token) <= 1000 - (SELECT count(*) FROM low)),
kept AS MATERIALIZED (SELECT token FROM low UNION SELECT token FROM added
        UNION SELECT * FROM range(1950, 2000) t(token))"""


def id_counts(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("token"))
    customers = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("token"))
    return parts.agg(F.count("*").alias("cnt")), customers.agg(F.count("*").alias("cnt"))


@check("select_vocab", f"WITH {IDS} SELECT token FROM kept")
def select_vocab(spark, sf_dir):
    return vc.select_vocab(*id_counts(spark, sf_dir), VOCAB, **SIZES)


@check(
    "id_union",
    f"WITH {IDS} SELECT token FROM low",
)
def id_union(spark, sf_dir):
    first, _ = id_counts(spark, sf_dir)
    return vc.id_union(spark.range(100).toDF("token"), vc.top_tokens(first, 400))


@check("reindex", f"WITH {IDS} SELECT token, row_number() OVER (ORDER BY token) - 1 AS new_id FROM kept")
def reindex(spark, sf_dir):
    return vc.reindex(vc.select_vocab(*id_counts(spark, sf_dir), VOCAB, **SIZES))


@check(
    "gather_embeddings",
    f"WITH {IDS}, n AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS new_id FROM kept) "
    "SELECT new_id, vec_id AS old_id, embedding FROM n JOIN embeddings ON token = vec_id",
)
def gather_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vocabulary.pruned_embeddings(*id_counts(spark, sf_dir), vectors, VOCAB, **SIZES)


# Token ids of the two corpora at the sizes of the original selection.
TOKEN_IDS = f"""{COUNTS},
joint AS (SELECT token, sum(cnt) AS cnt FROM (SELECT * FROM ta UNION ALL SELECT * FROM tb) GROUP BY token),
ids AS MATERIALIZED (SELECT token, 999 + row_number() OVER (ORDER BY cnt DESC, token) AS id FROM joint),
vsize AS (SELECT 1000 + count(*) + 100 AS v FROM ids),
coded_b AS (SELECT id AS token, cnt FROM tb JOIN ids USING (token)),
coded_a AS (SELECT id AS token, cnt FROM ta JOIN ids USING (token)),
low AS (SELECT * FROM range(1000) t(token) UNION
        SELECT token FROM (SELECT token FROM coded_b ORDER BY cnt DESC, token LIMIT 30000)),
fresh AS (SELECT token, cnt FROM (SELECT token, cnt FROM coded_a ORDER BY cnt DESC, token LIMIT 115000)
          WHERE token NOT IN (SELECT token FROM low)),
added AS (SELECT token FROM fresh
          QUALIFY row_number() OVER (ORDER BY cnt DESC, token) <= 119900 - (SELECT count(*) FROM low)),
kept AS MATERIALIZED (SELECT token FROM low UNION SELECT token FROM added
        UNION SELECT unnest(range(v - 100, v)) FROM vsize),
fresh_ids AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS new_id FROM kept)"""


def corpus_vocabulary(spark, sf_dir):
    benchmark, documents_ = corpus_counts(spark, sf_dir, "benchmark"), corpus_counts(spark, sf_dir)
    return vocabulary.kept_ids(benchmark, documents_)


@check("token_dictionary", f"WITH {TOKEN_IDS} SELECT token, id FROM ids")
def token_dictionary(spark, sf_dir):
    return corpus_vocabulary(spark, sf_dir)[0]


@check("select_corpus_vocab", f"WITH {TOKEN_IDS} SELECT token, new_id FROM fresh_ids")
def select_corpus_vocab(spark, sf_dir):
    return corpus_vocabulary(spark, sf_dir)[1]


@check(
    "gather_corpus_embeddings",
    f"WITH {TOKEN_IDS}, e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, embedding FROM embeddings), "
    "n AS (SELECT count(*) AS n FROM e) "
    "SELECT new_id, token AS old_id, embedding[1] AS lead, embedding[-1] AS last FROM fresh_ids, n "
    "JOIN e ON k = token % n.n",
)
def gather_corpus_embeddings(spark, sf_dir):
    """Every id of the vocabulary has one of the given vectors, in turn."""
    _, kept, size = corpus_vocabulary(spark, sf_dir)
    given = dense_index(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "k")
    n = given.count()
    ids = spark.range(size).select(F.col("id").alias("vec_id"), (F.col("id") % n).alias("k"))
    found = vc.gather_embeddings(ids.join(given.drop("vec_id"), "k"), kept)
    return found.select(
        "new_id", "old_id", F.get("embedding", F.lit(0)).alias("lead"), F.element_at("embedding", -1).alias("last")
    )


# --- rankings ---------------------------------------------------------------


def cleaned(spark, sf_dir):
    return ratings.cleaned_ratings(ratings_raw(spark, sf_dir))


def paired(spark, sf_dir):
    return ratings.preferences(cleaned(spark, sf_dir), (1, 2))


@check(
    "places_to_ranks",
    f"WITH {RATINGS} SELECT example, rater, "
    + ", ".join(f"max(place) FILTER (letter = '{x}')::INTEGER AS {x}" for x in "abcde")
    + " FROM placed GROUP BY example, rater",
)
def places_to_ranks(spark, sf_dir):
    return rk.places_to_ranks(ratings_raw(spark, sf_dir), ratings.PLACES, ratings.CANDIDATES)


@check(
    "drop_and_rerank",
    f"WITH {RATINGS} SELECT example, rater, "
    + ", ".join(f"max(rank) FILTER (model = '{x}')::INTEGER AS {x}" for x in "abcd")
    + " FROM reranked GROUP BY example, rater",
)
def drop_and_rerank(spark, sf_dir):
    return cleaned(spark, sf_dir)


@check("pairwise_preferences", f"WITH {RATINGS} SELECT example, rater, relation, preferred FROM prefs")
def pairwise_preferences(spark, sf_dir):
    return rk.pairwise_preferences(cleaned(spark, sf_dir), ["example", "rater"], ratings.MODELS)


@check(
    "interrater_agreement",
    f"WITH {RATINGS} SELECT count(*) FILTER (rater1 = rater2) AS agreed, count(*) AS total, "
    "round(avg((rater1 = rater2)::INTEGER), 6) AS agreement FROM paired",
)
def interrater_agreement(spark, sf_dir):
    found = rk.interrater_agreement(paired(spark, sf_dir))
    return found.withColumn("agreement", r6(F.col("agreement")))


@check(
    "rank_summary",
    f"""WITH {RATINGS}, c AS (SELECT model, rank, count(*) AS n FROM reranked GROUP BY model, rank),
m AS (SELECT model, rank AS mode FROM c
      QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, rank) = 1)
SELECT model, round(avg(rank), 6) AS mean, median(rank)::DOUBLE AS median, any_value(mode) AS mode
FROM reranked JOIN m USING (model) GROUP BY model""",
)
def rank_summary(spark, sf_dir):
    ranks = rk.long_ranks(cleaned(spark, sf_dir), ["example", "rater"], ratings.MODELS)
    return rk.rank_summary(ranks).withColumn("mean", r6(F.col("mean")))


@check(
    "cohen_kappa",
    f"""WITH {RATINGS}, p AS (SELECT x.model, x.rank AS r1, y.rank AS r2 FROM reranked x
  JOIN reranked y ON x.example = y.example AND x.model = y.model AND x.rater = 1 AND y.rater = 2),
o AS (SELECT model, avg((r1 = r2)::INTEGER) AS po, count(*) AS n FROM p GROUP BY model),
a AS (SELECT model, r1 AS r, count(*) AS c FROM p GROUP BY ALL),
b AS (SELECT model, r2 AS r, count(*) AS c FROM p GROUP BY ALL),
e AS (SELECT a.model, sum(a.c * b.c) AS s FROM a JOIN b ON a.model = b.model AND a.r = b.r
      GROUP BY a.model)
SELECT model, round((po - s::DOUBLE / n / n) / (1 - s::DOUBLE / n / n), 6) AS kappa
FROM o JOIN e USING (model)""",
)
def cohen_kappa(spark, sf_dir):
    ranks = rk.long_ranks(cleaned(spark, sf_dir), ["example", "rater"], ratings.MODELS)
    return rk.cohen_kappa(ranks, (1, 2)).withColumn("kappa", r6(F.col("kappa")))


@check(
    "blind_sample",
    f"""WITH {PAIRS}, s AS (SELECT * FROM pairs ORDER BY md5(id || ':22'), id LIMIT 100),
o AS (SELECT id, text, x.model, CASE WHEN x.model = 'reference' THEN summary ELSE pred END AS t,
        row_number() OVER (PARTITION BY id ORDER BY md5(id || ':22:' || x.model)) AS p
      FROM s, (VALUES ('reference'), ('lead')) x(model))
SELECT id, any_value(text) AS text, max(t) FILTER (p = 1) AS a, max(t) FILTER (p = 2) AS b
FROM o GROUP BY id""",
)
def blind_sample(spark, sf_dir):
    return rk.blind_sample(pairs(spark, sf_dir), "id", {"reference": "summary", "lead": "pred"})[0]


@check(
    "blind_answers",
    f"""WITH {PAIRS}, s AS (SELECT * FROM pairs ORDER BY md5(id || ':22'), id LIMIT 100),
o AS (SELECT id, x.model, row_number() OVER (PARTITION BY id ORDER BY md5(id || ':22:' || x.model)) AS p
      FROM s, (VALUES ('reference'), ('lead')) x(model))
SELECT id, 'a=' || max(model) FILTER (p = 1) || ',b=' || max(model) FILTER (p = 2) AS answer_key
FROM o GROUP BY id""",
)
def blind_answers(spark, sf_dir):
    return rk.blind_sample(pairs(spark, sf_dir), "id", {"reference": "summary", "lead": "pred"})[1]


@check(
    "paired_bootstrap",
    f"""WITH RECURSIVE {RATINGS}, {draws_sql('''SELECT example * 6 + list_position(
  ['a>b', 'a>c', 'a>d', 'b>c', 'b>d', 'c>d'], relation) - 1 AS key,
  (rater1 = rater2)::INTEGER::DOUBLE AS score FROM paired''', 1000)} """
    + INTERVAL.format(lead="", c="m", of="sc", t="means"),
)
def paired_bootstrap(spark, sf_dir):
    return rounded(ratings.agreement_interval(paired(spark, sf_dir)))


# --- statistics -------------------------------------------------------------


@check(
    "length_stats",
    f"WITH {LABELLED} SELECT type, "
    + ", ".join(
        f"min({c}) AS min_{c}, round(avg({c}), 2) AS mean_{c}, max({c}) AS max_{c}"
        for c in ("tok_text_len", "tok_sum_len")
    )
    + " FROM combo GROUP BY type",
)
def length_stats(spark, sf_dir):
    return stats.length_stats(combo(spark, sf_dir), ["tok_text_len", "tok_sum_len"])


def histogram_sql(rows: str, column: str, bins: int, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""v AS (SELECT * FROM {rows} WHERE {column} IS NOT NULL),
e AS (SELECT min({column})::DOUBLE AS lo, (max({column}) - min({column}))::DOUBLE / {bins} AS w FROM v),
b AS (SELECT {lead}least(floor(({column}::DOUBLE - lo) / w), {bins - 1})::INTEGER AS bin FROM v, e),
c AS (SELECT {lead}bin, count(*) AS n FROM b GROUP BY ALL),
f AS (SELECT {lead}r.bin::INTEGER AS bin, lo, w FROM e, range({bins}) r(bin){f", (SELECT DISTINCT {by} FROM v)" if by else ""})
SELECT {lead}bin, coalesce(n, 0)::BIGINT AS n, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi
FROM f LEFT JOIN c USING ({lead}bin)"""


def edges_rounded(h):
    return h.withColumns({c: r6(F.col(c)) for c in ("lo", "hi")})


@check("histogram", "WITH " + histogram_sql("events", "value", 50))
def histogram(spark, sf_dir):
    return edges_rounded(stats.histogram(table(spark, sf_dir, "events"), "value"))


@check(
    "histogram_by_type",
    f"WITH {LABELLED}, " + histogram_sql("combo", "tok_text_len", 30, "type"),
)
def histogram_by_type(spark, sf_dir):
    return edges_rounded(stats.histogram(combo(spark, sf_dir), "tok_text_len", 30, ["type"]))


# --- the whole preparation --------------------------------------------------


@check(
    "clean_pairs",
    f"""WITH {LENGTHS},
a AS (SELECT id, {chain_sql(ARTICLE, simple_sql(ARTICLE))} FROM pairs),
s AS (SELECT id, {chain_sql(SUMMARY, simple_sql(SUMMARY), "filter_sum")}
      FROM (SELECT id, summary AS text FROM pairs))
SELECT kept.*, filter, filter_sum, filter IS NULL AS passed_quality,
  filter_sum IS NULL AS passed_quality_sum, filter IS NULL AND filter_sum IS NULL AS passed
FROM kept JOIN a USING (id) JOIN s USING (id)""",
)
def clean_pairs(spark, sf_dir):
    rows = pairs(spark, sf_dir).drop("pred")
    return clean.clean_pairs(rows, ARTICLE, SUMMARY).drop("text", "summary")
