"""Tables the checks run on, derived alike in Spark and in SQL.

``pairs`` gives every document a summary made from its own sentences: lifted
whole, lifted in part, or word by word in reverse, by ``doc_id % 3``. No
document is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions import tokens as tk
from gistmill.functions.summaries import lead_of
from gistmill.operators.evaluate import extractiveness
from gistmill.operators.order import md5_of
from gistmill.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def r6(x: Column) -> Column:
    return F.round(x, 6)


# --- SQL pieces -------------------------------------------------------------

TOKEN, WORD, GAPPED, SENTENCE = (
    p.replace("'", "''") for p in (tk.TOKEN, tk.WORD, tk.GAPPED_TOKEN, tk.SENTENCE)
)


def sql_all(expr: str, pattern: str) -> str:
    return f"regexp_extract_all({expr}, '{pattern}')"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{tk.EDGE_SPACE}', '', 'g')"


def sql_sentences(expr: str) -> str:
    return (
        f"list_filter(list_transform({sql_all(sql_strip(expr), SENTENCE)}, "
        f"lambda s: {sql_strip('s')}), lambda s: s <> '')"
    )


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- pairs ------------------------------------------------------------------


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = F.col("_s")
    one = F.coalesce(F.get(sents, F.lit(1)), F.get(sents, F.lit(0)), F.lit(""))
    two = F.coalesce(F.get(sents, F.lit(2)), F.get(sents, F.lit(0)), F.lit(""))
    backward = lambda s: F.array_join(F.reverse(F.split(s, " ")), " ")
    kind = F.col("id") % 3
    summary = (
        F.when(kind == 0, F.concat(one, F.lit(" "), two))
        .when(kind == 1, F.concat(one, F.lit(" "), backward(two)))
        .otherwise(backward(one))
    )
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    split = docs.withColumn("_s", tk.first_sentences(F.col("text"), 3))
    return split.select("id", "text", summary.alias("summary"), lead_of(sents).alias("pred"))


PAIRS = f"""
sents AS MATERIALIZED (SELECT doc_id AS id, text, {sql_sentences("text")} AS s FROM documents),
parts AS (SELECT id, text, s, coalesce(s[2], s[1], '') AS one, coalesce(s[3], s[1], '') AS two
          FROM sents),
pairs AS MATERIALIZED (
  SELECT id, text,
    CASE id % 3
      WHEN 0 THEN one || ' ' || two
      WHEN 1 THEN one || ' ' || array_to_string(list_reverse(string_split(two, ' ')), ' ')
      ELSE array_to_string(list_reverse(string_split(one, ' ')), ' ')
    END AS summary,
    array_to_string(list_slice(s, 1, 3), chr(10)) AS pred
  FROM parts)"""


def fragments_sql(side: str = "summary", text: str = "text", tokens: str = TOKEN) -> str:
    """CTEs up to ``matched(id, ns, nt, st, tt, m)``, ``m`` the greedy matches.

    Run lengths come from islands on the diagonals of equal tokens; two folds
    then apply the skip inside a position and the step over the summary.
    """
    return f"""
tok AS MATERIALIZED (SELECT id, {sql_all(f"lower({side})", tokens)} AS st,
               {sql_all(f"lower({text})", tokens)} AS tt FROM pairs),
sx AS (SELECT id, unnest(st) AS t, generate_subscripts(st, 1) - 1 AS i FROM tok),
tx AS (SELECT id, unnest(tt) AS t, generate_subscripts(tt, 1) - 1 AS j FROM tok),
hit AS (SELECT sx.id, i, j FROM sx JOIN tx ON sx.id = tx.id AND sx.t = tx.t),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY id, j - i ORDER BY i) AS g FROM hit),
run AS (SELECT id, i, j,
               row_number() OVER (PARTITION BY id, j - i, g ORDER BY i DESC) AS len FROM isl),
cand AS (SELECT id, i, list({{'f': 0::BIGINT, 'j': j::BIGINT, 'len': len::BIGINT}} ORDER BY j) AS c
         FROM run GROUP BY id, i),
best AS (SELECT id, i, list_reduce(c,
           lambda a, x: CASE WHEN x.j < a.f THEN a
                             WHEN x.len > a.len THEN {{'f': x.j + x.len, 'j': x.j, 'len': x.len}}
                             ELSE {{'f': x.j + x.len, 'j': a.j, 'len': a.len}} END,
           {{'f': 0::BIGINT, 'j': -1::BIGINT, 'len': 0::BIGINT}}) AS b FROM cand),
steps AS (SELECT id, list({{'n': i::BIGINT, 'o': [{{'i': i::BIGINT, 'j': b.j, 'len': b.len}}]}}
                          ORDER BY i) AS l FROM best GROUP BY id),
folded AS (SELECT id, list_reduce(l,
             lambda a, x: CASE WHEN x.n < a.n THEN a
                               ELSE {{'n': x.n + x.o[1].len, 'o': list_concat(a.o, x.o)}} END,
             {{'n': 0::BIGINT, 'o': []::STRUCT(i BIGINT, j BIGINT, len BIGINT)[]}}).o AS m FROM steps),
matched AS MATERIALIZED (SELECT tok.id, len(st) AS ns, len(tt) AS nt, st, tt,
              coalesce(m, []::STRUCT(i BIGINT, j BIGINT, len BIGINT)[]) AS m
            FROM tok LEFT JOIN folded USING (id))"""


def density_sql() -> str:
    """CTEs up to ``bins(id, density, density_bin)`` over ``pairs``."""
    return f"""{PAIRS}, {fragments_sql()},
dens AS (SELECT id, CASE WHEN ns = 0 THEN 0.0::DOUBLE ELSE
           coalesce(list_sum(list_transform(m, lambda x: x.len * x.len)), 0)::DOUBLE / ns END
           AS density FROM matched),
bins AS MATERIALIZED (SELECT id, density, CASE WHEN density <= 1.5::DOUBLE THEN 'abstractive'
           WHEN density <= 8.1875::DOUBLE THEN 'mixed' ELSE 'extractive' END AS density_bin
         FROM dens)"""


def pair_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, density, density_bin)``."""
    from gistmill.functions.fragments import density_bin

    scored = extractiveness(pairs(spark, sf_dir), "id")
    return scored.select("id", "density", density_bin(F.col("density")).alias("density_bin"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, summary, pred)``: a user turn and its answer."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("summary"))
    replies = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred")
    )
    return asked.join(replies, ["conv_id", "turn"])


TURNS = """
t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS reply,
        lead(turn) OVER w AS next_turn FROM conversations
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, conv_id || ':' || turn AS id, text AS summary, reply AS pred FROM t
          WHERE role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1)"""


# --- ratings ----------------------------------------------------------------

LETTERS = ("a", "b", "c", "d", "e")


def ratings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters place five letters for every conversation, by hash order."""
    convs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("example")).distinct()
    sheets = convs.withColumn("rater", F.explode(F.array(F.lit(1), F.lit(2))))
    order = F.sort_array(
        F.array(
            *[
                F.struct(md5_of(F.col("example"), F.col("rater"), x).alias("h"), F.lit(x).alias("x"))
                for x in LETTERS
            ]
        )
    )
    placed = sheets.withColumn("_o", order)
    return placed.select(
        "example", "rater", *[F.get("_o", F.lit(k))["x"].alias(f"p{k + 1}") for k in range(5)]
    )


RATINGS = """
sheets AS (SELECT DISTINCT conv_id AS example, r.rater
           FROM conversations, (VALUES (1), (2)) r(rater)),
placed AS (SELECT example, rater, x.letter,
             row_number() OVER (PARTITION BY example, rater
                                ORDER BY md5(example || ':' || rater || ':' || x.letter)) AS place
           FROM sheets, (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) x(letter)),
reranked AS (SELECT example, rater, letter AS model,
               dense_rank() OVER (PARTITION BY example, rater ORDER BY place)::INTEGER AS rank
             FROM placed WHERE letter <> 'e'),
prefs AS (SELECT x.example, x.rater, x.model || '>' || y.model AS relation,
            CASE WHEN x.rank < y.rank THEN 1 ELSE 0 END AS preferred
          FROM reranked x JOIN reranked y
            ON x.example = y.example AND x.rater = y.rater AND x.model < y.model),
paired AS (SELECT p.example, p.relation, p.preferred AS rater1, q.preferred AS rater2
           FROM prefs p JOIN prefs q USING (example, relation) WHERE p.rater = 1 AND q.rater = 2)"""


# --- token vectors ----------------------------------------------------------


def token_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten embeddings to a pair: the first five predict, the last five refer."""
    place = F.col("vec_id") % 10
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("pair"),
        F.when(place < 5, "pred").otherwise("ref").alias("side"),
        (place % 5).alias("pos"),
        F.col("embedding").alias("vec"),
    )
