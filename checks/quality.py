"""Quality filters, repetition measures, language scores."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import check
from checks.views import GAPPED, TOKEN, WORD, documents, r6, sql_all, sql_list, sql_strip
from gistmill.functions import quality as qf
from gistmill.functions import repetition as rp
from gistmill.functions import tokens as tk
from gistmill.functions.language import EVIDENCE, FLOOR, SCALE, UNKNOWN, background_weight
from gistmill.functions.quality import FILTERS, QualityParams, article_profile, summary_profile
from gistmill.functions.rows import total
from gistmill.functions.stopwords import ENGLISH
from gistmill.operators import language as lg
from gistmill.operators import quality as q
from gistmill.operators import repetition as rep
from gistmill.sources.tables import read_table
from gistmill.streaming import clean as stream
from gistmill.session import new_folder

EN = QualityParams(stop_words=ENGLISH, languages=("en",))
NEEDLE = "thnt"

# --- SQL of the single filters, over documents ------------------------------

N_WORDS = f"len({sql_all('text', WORD)})"
LINES, PARAGRAPHS = "string_split(text, chr(10))", "string_split(text, chr(10) || chr(10))"
N_TOP, N_DUP = (2, 3, 4), (5, 6, 7, 8, 9, 10)


def sum_len(xs: str) -> str:
    return f"list_sum(list_transform({xs}, lambda x: length(x)))"


def symbol_sql(symbol: str) -> str:
    return (
        f"(length(text) - length(replace(text, '{symbol}', '')))::DOUBLE / nullif({N_WORDS}, 0)"
        " < 0.1::DOUBLE"
    )


def chr_fraction_sql(parts: str) -> str:
    return f"({sum_len(parts)} - {sum_len(f'list_distinct({parts})')})::DOUBLE / nullif(length(text), 0)"


def share_sql(pattern: str, share: str, least: int) -> str:
    n = f"len(list_filter({LINES}, lambda x: regexp_matches(x, '{pattern}')))"
    return f"({n}::DOUBLE / len({LINES}) > {share}::DOUBLE AND {n} > {least})"


FILLED = f"list_filter(list_transform({LINES}, lambda x: {sql_strip('x')}), lambda x: x <> '')"


def stop_tokens(words) -> str:
    """Stop words as runs of tokens in angle brackets, longest first."""
    runs = ["".join(f"<{t}>" for t in re.findall(r"[^\W_]+|[^\w\s]|_", w)) for w in words]
    return "|".join(sorted(runs, key=lambda r: (-len(r), r))).replace("'", "''")


def simple_sql(p: QualityParams = EN) -> dict[str, str]:
    words = sql_all("text", WORD)
    return {
        "doc_length": f"{N_WORDS} BETWEEN {p.doc_length[0]} AND {p.doc_length[1]}",
        "mean_word_length": f"{sum_len(words)}::DOUBLE / nullif({N_WORDS}, 0) "
        f"BETWEEN {p.mean_word_length[0]} AND {p.mean_word_length[1]}",
        "alpha_ratio": f"{N_WORDS} >= 1 AND len(list_filter({words}, "
        rf"lambda w: regexp_matches(w, '\p{{L}}'))) >= floor({N_WORDS} * {p.alpha_ratio}::DOUBLE)",
        "stop_word": f"len(regexp_extract_all(array_to_string(list_transform({sql_all('lower(text)', TOKEN)}, "
        f"lambda w: '<' || w || '>'), ''), '{stop_tokens(p.stop_words)}')) >= {p.min_stop_words}",
        "symbol_2_word_hashtag": symbol_sql("#"),
        "symbol_2_word_ellipsis": symbol_sql("…"),
        "line_bullets_or_ellipsis": "NOT ("
        + share_sql("^ *[-*]", "0.9", 2)
        + " OR "
        + share_sql(r"(…|\.\.\.) *\z", "0.3", 2)
        + ")",
        "duplicate_lines_chr_fraction": f"{chr_fraction_sql(LINES)} "
        f"< {p.duplicate_lines_chr_fraction}::DOUBLE",
        "duplicate_paragraph_chr_fraction": f"{chr_fraction_sql(PARAGRAPHS)} "
        f"< {p.duplicate_paragraph_chr_fraction}::DOUBLE",
        "short_long_sentece": f"len(list_filter({FILLED}, lambda x: length(x) > 30))::DOUBLE "
        f"/ nullif(len({FILLED}), 0) >= 0.5::DOUBLE",
        "string_filter": f"NOT contains(lower(text), '{NEEDLE}')",
    }


SIMPLE = simple_sql()

# --- SQL of the n-gram measures ---------------------------------------------

POSITIONS = rf"""
split AS (SELECT doc_id, unnest(g) AS gw, generate_subscripts(g, 1) AS k
          FROM (SELECT doc_id, {sql_all("text", GAPPED)} AS g FROM documents)),
pos AS MATERIALIZED (SELECT doc_id, k, lower(gw) AS low,
               lower(regexp_replace(gw, '^\s+', '')) AS bare,
               sum(length(gw)) OVER (PARTITION BY doc_id ORDER BY k) AS e,
               sum(length(gw)) OVER (PARTITION BY doc_id ORDER BY k)
                 - length(regexp_replace(gw, '^\s+', '')) AS st
        FROM split)"""


def gram_cte(n: int) -> str:
    key = " || ".join(["bare"] + [f"lead(low, {i}) OVER w" for i in range(1, n)])
    return f"""
gram_{n} AS (SELECT doc_id, k, st, lead(e, {n - 1}) OVER w AS en, {key} AS ngram FROM pos
          WINDOW w AS (PARTITION BY doc_id ORDER BY k)
          QUALIFY lead(e, {n}) OVER w IS NOT NULL)"""


def top_cte(n: int) -> str:
    return f"""
top_{n} AS (SELECT doc_id, ngram, cnt FROM (
            SELECT doc_id, ngram, count(*) AS cnt, min(k) AS f FROM gram_{n} GROUP BY doc_id, ngram)
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, f) = 1)"""


def dup_cte(n: int) -> str:
    return f"""
rep_{n} AS (SELECT doc_id, st, en FROM gram_{n}
          QUALIFY row_number() OVER (PARTITION BY doc_id, ngram ORDER BY k) > 1),
mark_{n} AS (SELECT *, CASE WHEN st > lag(en) OVER (PARTITION BY doc_id ORDER BY st) THEN 1 ELSE 0
          END AS b FROM rep_{n}),
isle_{n} AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY st) AS i FROM mark_{n}),
dup_{n} AS (SELECT doc_id, sum(c) AS c FROM (
            SELECT doc_id, i, max(en) - min(st) AS c FROM isle_{n} GROUP BY doc_id, i)
          GROUP BY doc_id)"""


def ngram_verdicts(p: QualityParams = EN) -> str:
    """CTEs up to ``grams_ok(doc_id, top_ok, dup_ok)``."""
    ctes = [POSITIONS, *[gram_cte(n) for n in (*N_TOP, *N_DUP)]]
    ctes += [top_cte(n) for n in N_TOP] + [dup_cte(n) for n in N_DUP]
    top = " OR ".join(
        f"coalesce(top_{n}.cnt > {p.top_ngram_min_count} AND length(top_{n}.ngram) * top_{n}.cnt"
        f"::DOUBLE / length(d.text) > {t}::DOUBLE, false)"
        for n, t in zip(N_TOP, p.top_ngram_thresholds)
    )
    dup = " OR ".join(
        f"coalesce(dup_{n}.c, 0) > length(d.text) * {t}::DOUBLE"
        for n, t in zip(N_DUP, p.duplicate_ngram_thresholds)
    )
    joins = " ".join(
        f"LEFT JOIN {t} ON {t}.doc_id = d.doc_id"
        for t in [f"top_{n}" for n in N_TOP] + [f"dup_{n}" for n in N_DUP]
    )
    ctes.append(
        f"grams_ok AS (SELECT d.doc_id, NOT ({top}) AS top_ok, "
        f"length(d.text) > 0 AND NOT ({dup}) AS dup_ok FROM documents d {joins})"
    )
    return ",\n".join(ctes)


# --- single filters ---------------------------------------------------------


def one_filter(name: str, p: QualityParams = EN):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = documents(spark, sf_dir).select("doc_id", "text")
        ready = docs.withColumns({"w": tk.n_words(F.col("text")), "l": tk.line_array(F.col("text"))})
        ok = qf.predicate(name, p, F.col("text"), F.col("w"), F.col("l"))
        return ready.select("doc_id", F.coalesce(ok, F.lit(False)).alias("passed"))

    return run


for _name, _sql in SIMPLE.items():
    check(
        f"filter_{_name}", f"SELECT doc_id, coalesce({_sql}, false) AS passed FROM documents"
    )(one_filter(_name, EN.but(string=NEEDLE)))

check(
    "filter_top_ngram_chr_fraction",
    f"WITH {ngram_verdicts()} SELECT doc_id, top_ok AS passed FROM grams_ok",
)(one_filter("top_ngram_chr_fraction"))
check(
    "filter_duplicate_ngram_chr_fraction",
    f"WITH {ngram_verdicts()} SELECT doc_id, dup_ok AS passed FROM grams_ok",
)(one_filter("duplicate_ngram_chr_fraction"))


def fraction_sql(parts: str) -> str:
    """Share of non-blank parts whose count is above one."""
    return f"""(SELECT (sum(c) - count(*) FILTER (c = 1))::DOUBLE / sum(c)
        FROM (SELECT count(*) AS c FROM (SELECT unnest({parts}) AS x) t
              WHERE {sql_strip("x")} <> '' GROUP BY x))"""


def part_counts(name: str, parts: str) -> str:
    return f"""
{name} AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest({parts}) AS x FROM documents)
         GROUP BY doc_id, x),
{name}_m AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN length(x) * (c - 1) ELSE 0 END) AS dup_chars,
           sum(c) FILTER ({sql_strip("x")} <> '') AS filled,
           count(*) FILTER ({sql_strip("x")} <> '' AND c = 1) AS single
         FROM {name} GROUP BY doc_id)"""


FRACTIONS = f"""WITH {part_counts("li", LINES)}, {part_counts("pa", PARAGRAPHS)},
fr AS (SELECT d.doc_id,
  li_m.dup_chars::DOUBLE / nullif(length(text), 0) AS lines_chr,
  pa_m.dup_chars::DOUBLE / nullif(length(text), 0) AS paragraphs_chr,
  (li_m.filled - li_m.single)::DOUBLE / nullif(li_m.filled, 0) AS lines_all,
  (pa_m.filled - pa_m.single)::DOUBLE / nullif(pa_m.filled, 0) AS paragraphs_all
  FROM documents d JOIN li_m USING (doc_id) JOIN pa_m USING (doc_id))"""


@check(
    "filter_duplicate_lines_and_paragraphs",
    f"{FRACTIONS} SELECT doc_id, coalesce(lines_all < 0.2::DOUBLE, false) AS lines_ok, "
    "coalesce(paragraphs_all < 0.2::DOUBLE, false) AS paragraphs_ok FROM fr",
)
def duplicate_parts(spark, sf_dir):
    c = F.col("text")
    no = F.lit(False)
    return documents(spark, sf_dir).select(
        "doc_id",
        F.coalesce(qf.duplicate_line_filter(c, 0.2), no).alias("lines_ok"),
        F.coalesce(qf.duplicate_paragraph_filter(c, 0.2), no).alias("paragraphs_ok"),
    )


@check(
    "duplicate_chr_fraction",
    f"{FRACTIONS} SELECT doc_id, round(lines_chr, 6) AS lines_chr_fraction, "
    "round(paragraphs_chr, 6) AS paragraphs_chr_fraction FROM fr",
)
def duplicate_chr(spark, sf_dir):
    found = rep.with_line_fractions(documents(spark, sf_dir))
    names = ("lines_chr_fraction", "paragraphs_chr_fraction")
    return found.select("doc_id", *[r6(F.col(c)).alias(c) for c in names])


@check(
    "duplicate_fraction",
    f"{FRACTIONS} SELECT doc_id, round(lines_all, 6) AS lines_fraction, "
    "round(paragraphs_all, 6) AS paragraphs_fraction FROM fr",
)
def duplicate_share(spark, sf_dir):
    found = rep.with_line_fractions(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[r6(F.col(c)).alias(c) for c in ("lines_fraction", "paragraphs_fraction")]
    )


@check(
    "ngram_counts",
    f"WITH {POSITIONS}, {', '.join(gram_cte(n) for n in N_TOP)}, counted AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {n}::INTEGER AS n, ngram, count(*) AS cnt FROM gram_{n} "
        "GROUP BY doc_id, ngram"
        for n in N_TOP
    )
    + ") SELECT doc_id, n, count(*) AS n_different, sum(cnt)::BIGINT AS n_all, max(cnt) AS most, "
    "sum(cnt * length(ngram))::BIGINT AS chars, min(ngram) AS first, max(ngram) AS last, "
    "sum(('0x' || substr(md5(ngram || ':' || cnt), 1, 12))::BIGINT)::BIGINT AS digest "
    "FROM counted GROUP BY doc_id, n",
)
def ngram_counts(spark, sf_dir):
    counted = rep.ngram_tables(documents(spark, sf_dir), "doc_id", 2, 4)
    grams = F.col("grams")
    # every n-gram and its count, in any order
    digit = lambda g: F.conv(F.substring(F.md5(F.concat_ws(":", g["ngram"], g["cnt"])), 1, 12), 16, 10)
    each = counted.select(
        "doc_id",
        "n",
        F.size(grams).alias("n_different"),
        total(grams["cnt"]).alias("n_all"),
        F.array_max(grams["cnt"]).alias("most"),
        total(F.transform(grams, lambda g: g["cnt"] * F.length(g["ngram"]))).alias("chars"),
        F.array_min(grams["ngram"]).alias("first"),
        F.array_max(grams["ngram"]).alias("last"),
        total(F.transform(grams, lambda g: digit(g).cast("long"))).alias("digest"),
    )
    # ids may repeat
    kinds = {F.sum: ("n_different", "n_all", "chars", "digest"), F.max: ("most", "last"), F.min: ("first",)}
    merged = each.groupBy("doc_id", "n").agg(*[f(c).alias(c) for f, cs in kinds.items() for c in cs])
    return merged.select("doc_id", "n", "n_different", "n_all", "most", "chars", "first", "last", "digest")


@check(
    "top_ngram_chr_fraction",
    f"WITH {POSITIONS}, {', '.join(gram_cte(n) + ',' + top_cte(n) for n in N_TOP)} "
    + " UNION ALL ".join(
        f"SELECT doc_id, {n}::INTEGER AS n, ngram, cnt, "
        "round(length(ngram) * cnt::DOUBLE / length(text), 6) AS chr_fraction "
        f"FROM top_{n} JOIN documents USING (doc_id)"
        for n in N_TOP
    ),
)
def top_ngrams(spark, sf_dir):
    found = rep.top_ngrams_of(documents(spark, sf_dir), "doc_id", N_TOP)
    return found.withColumn("chr_fraction", r6(F.col("chr_fraction")))


@check(
    "duplicate_ngram_chr_fraction",
    f"WITH {POSITIONS}, {', '.join(gram_cte(n) + ',' + dup_cte(n) for n in N_DUP)} "
    + " UNION ALL ".join(
        f"SELECT d.doc_id, {n}::INTEGER AS n, coalesce(c, 0)::BIGINT AS dup_chars, "
        f"length(text)::INTEGER AS n_chars FROM documents d LEFT JOIN dup_{n} USING (doc_id)"
        for n in N_DUP
    ),
)
def duplicate_ngrams(spark, sf_dir):
    return rep.duplicate_ngrams(documents(spark, sf_dir), "doc_id", 5, 10)


SMALL_SIZES, SMALL_LIMITS = (1, 2, 3), (0.6, 0.15, 0.05)


@check(
    "duplicate_ngrams_from_one",
    f"WITH {POSITIONS}, {', '.join(gram_cte(n) + ',' + dup_cte(n) for n in SMALL_SIZES)} "
    "SELECT d.doc_id, length(text) = 0 OR "
    + " OR ".join(
        f"coalesce(dup_{n}.c, 0) > {limit}::DOUBLE * length(text)"
        for n, limit in zip(SMALL_SIZES, SMALL_LIMITS)
    )
    + " AS fails FROM documents d "
    + " ".join(f"LEFT JOIN dup_{n} ON dup_{n}.doc_id = d.doc_id" for n in SMALL_SIZES),
)
def duplicate_ngrams_from_one(spark, sf_dir):
    c = F.col("text")
    fails = rp.duplicate_ngram_fails(c, F.length(c), SMALL_SIZES, SMALL_LIMITS)
    return documents(spark, sf_dir).select("doc_id", fails.alias("fails"))


# --- language ---------------------------------------------------------------

PROFILE_SIZE = 1000
CLEAN = r"(' ' || trim(regexp_replace(lower({t}), '[^\p{{L}}]+', ' ', 'g')) || ' ')"


def grams_of(t: str) -> str:
    return (
        f"list_transform(range(1, greatest(length({t}) - 2, 0) + 1), "
        f"lambda i: substring({t}, i, 3))"
    )


def language_sql(text: str) -> str:
    """CTEs up to ``probs(doc_id, lang, prob)``; ``text`` is what is scored."""
    return f"""
learn AS (SELECT lang, {CLEAN.format(t="text")} AS t FROM documents
          WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % 2 = 0),
seen AS (SELECT lang, g, count(*) AS c FROM (SELECT lang, unnest({grams_of("t")}) AS g FROM learn)
         GROUP BY lang, g),
tot AS (SELECT lang, sum(c) AS n FROM seen GROUP BY lang),
prof AS (SELECT lang, g, (round(ln(c::DOUBLE / n) * {SCALE})
           - round(ln({FLOOR!r}::DOUBLE) * {SCALE}))::BIGINT AS w
         FROM seen JOIN tot USING (lang)
         QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, g) <= {PROFILE_SIZE}),
body AS (SELECT doc_id, {CLEAN.format(t=text)} AS t FROM documents),
used AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest({grams_of("t")}) AS g FROM body)
         GROUP BY doc_id, g),
known AS (SELECT doc_id, lang, coalesce(sum(c * w), 0)::BIGINT AS s
        FROM (SELECT doc_id, lang FROM documents d0, tot) x(doc_id, lang)
        LEFT JOIN (SELECT doc_id, c, w, prof.lang AS pl FROM used JOIN prof USING (g)) y
          ON x.doc_id = y.doc_id AND x.lang = y.pl GROUP BY ALL),
flat AS (SELECT doc_id, greatest(length(t) - 2, 0) * {background_weight()} AS s FROM body),
raw AS (SELECT doc_id, lang, s, f FROM (SELECT doc_id, lang, s FROM known UNION ALL SELECT doc_id, '{UNKNOWN}', s FROM flat)
        JOIN (SELECT doc_id, least(1, coalesce({EVIDENCE * background_weight()}::DOUBLE / nullif(s, 0), 1)) AS f FROM flat)
        USING (doc_id)),
probs AS (SELECT doc_id, lang, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM (
          SELECT doc_id, lang, exp((s - max(s) OVER (PARTITION BY doc_id)) * f / {SCALE}::DOUBLE) AS e
          FROM raw))"""


def scoring_profile(spark: SparkSession, sf_dir: str):
    """Learned from half of the documents; all are scored."""
    labelled = documents(spark, sf_dir).where(lg.learns("doc_id"))
    return lg.load_profile(lg.language_profile(labelled, size=PROFILE_SIZE))


LANG_SQL = language_sql("text").replace(
    "FROM (SELECT doc_id, lang FROM documents d0, tot) x(doc_id, lang)",
    "FROM (SELECT d0.doc_id, tot.lang FROM documents d0, tot) x(doc_id, lang)",
).replace("SELECT doc_id, lang, coalesce(sum", "SELECT x.doc_id, x.lang, coalesce(sum")


@check(
    "language_scores",
    f"WITH {LANG_SQL} SELECT doc_id, lang, round(prob, 6) AS prob FROM probs",
)
def language_scores(spark, sf_dir):
    scored = lg.language_scores(documents(spark, sf_dir), scoring_profile(spark, sf_dir), "doc_id")
    return scored.withColumn("prob", r6(F.col("prob")))


BEST = """best AS (SELECT doc_id, lang AS top, prob AS p FROM probs
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, lang) = 1)"""


@check(
    "filter_detect_language",
    f"WITH {LANG_SQL}, {BEST} SELECT doc_id, top = 'en' AND p >= 0.9::DOUBLE AS top_passes, "
    "(SELECT bool_or(lang IN ('en', 'de') AND prob >= 0.4::DOUBLE) FROM probs b "
    "WHERE b.doc_id = best.doc_id) AS any_passes FROM best",
)
def detect_language(spark, sf_dir):
    profile = scoring_profile(spark, sf_dir)
    loose = EN.but(language_mode="any", languages=("en", "de"), language_threshold=0.4)
    scored = documents(spark, sf_dir).select(
        "doc_id", profile.raw_scores(F.col("text")).alias("raw")
    )
    ranked = scored.select("doc_id", profile.ranked(F.col("raw")).alias("r"))
    return ranked.select(
        "doc_id",
        qf.language_passes(F.col("r"), EN).alias("top_passes"),
        qf.language_passes(F.col("r"), loose).alias("any_passes"),
    )


# --- the chain --------------------------------------------------------------


def chain_sql(p: QualityParams, oks: dict[str, str], out: str = "filter") -> str:
    arms = [f"WHEN NOT coalesce(length(text) <= {p.max_length}, false) THEN 'max_chr_length'"]
    arms += [f"WHEN NOT coalesce({oks[f]}, false) THEN '{f}'" for f in p.active()]
    return f"CASE {' '.join(arms)} END AS {out}"


FULL = EN.but(string=NEEDLE)
# Line breaks are no letters, so scoring the joined lines and the text agree.
FULL_SQL = f"""WITH {ngram_verdicts()}, {LANG_SQL}, {BEST},
verdict AS (SELECT d.*, {chain_sql(FULL, {
    **SIMPLE, "top_ngram_chr_fraction": "top_ok", "duplicate_ngram_chr_fraction": "dup_ok",
    "detect_language": "(top = 'en' AND p >= 0.9::DOUBLE)"})}
  FROM documents d JOIN grams_ok USING (doc_id) JOIN best USING (doc_id))"""


@check("describe_filter", f"{FULL_SQL} SELECT doc_id, filter FROM verdict")
def describe(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    profile = scoring_profile(spark, sf_dir)
    return q.describe_filter(docs, FULL, profile=profile).select("doc_id", "filter")


@check(
    "quality_filter",
    f"{FULL_SQL} SELECT doc_id, text, lang, source, n_chars FROM verdict WHERE filter IS NULL",
)
def survivors(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return q.quality_filter(docs, FULL, profile=scoring_profile(spark, sf_dir))


def counts_sql(p: QualityParams, by: str = "", oks: dict[str, str] | None = None) -> str:
    lead = f"{by}, " if by else ""
    return (
        f"SELECT {lead}coalesce(filter, 'passed filters') AS filter, count(*) AS n FROM "
        f"(SELECT *, {chain_sql(p, oks or simple_sql(p))} FROM documents) GROUP BY ALL"
    )


NO_GRAMS = ("top_ngram_chr_fraction", "duplicate_ngram_chr_fraction", "detect_language")
COUNTED = EN.but(ignore=NO_GRAMS)


@check("filter_counts", counts_sql(COUNTED))
def filter_counts(spark, sf_dir):
    return q.filter_counts(documents(spark, sf_dir), COUNTED)


SHORT = COUNTED.but(max_length=1200)


@check("max_length_guard", counts_sql(SHORT))
def max_length(spark, sf_dir):
    return q.filter_counts(documents(spark, sf_dir), SHORT)


ARTICLE = article_profile(stop_words=ENGLISH)


@check("article_profile", counts_sql(ARTICLE, "lang"))
def article(spark, sf_dir):
    return q.filter_counts(documents(spark, sf_dir), ARTICLE, by=["lang"])


SUMMARY = summary_profile()


@check("summary_profile", counts_sql(SUMMARY, "lang"))
def summary(spark, sf_dir):
    return q.filter_counts(documents(spark, sf_dir), SUMMARY, by=["lang"])


@check(
    "user_filter",
    "SELECT doc_id, CASE WHEN filter IS NOT NULL THEN filter WHEN NOT contains(text, ',') "
    f"THEN 'has_comma' END AS filter FROM (SELECT *, {chain_sql(ARTICLE, simple_sql(ARTICLE))} "
    "FROM documents)",
)
def user_filter(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    extra = {"has_comma": lambda c: F.contains(c, F.lit(","))}
    return q.describe_filter(docs, ARTICLE, extra=extra).select("doc_id", "filter")


@check(
    "stream_clean",
    f"SELECT doc_id, {chain_sql(ARTICLE, simple_sql(ARTICLE))} FROM documents",
)
def stream_clean(spark, sf_dir):
    """The article chain over a file stream, read back from its sink."""
    out = new_folder(spark, "stream")
    source = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(source).schema
    docs = stream.documents_stream(spark, f"{sf_dir}/documents*.parquet", schema)
    stream.clean_stream(docs, f"{out}/data", f"{out}/log", ARTICLE).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("doc_id", "filter")
