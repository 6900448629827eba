"""Extractiveness, summarisers, overlap scores, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import (
    PAIRS,
    TOKEN,
    TURNS,
    documents,
    fragments_sql,
    pair_bins,
    pairs,
    r6,
    sql_all,
    sql_list,
    sql_sentences,
    token_vecs,
    turn_pairs,
)
from gistmill.functions import fragments as fr
from gistmill.functions import rouge
from gistmill.functions import tokens as tk
from gistmill.functions.rows import exploded, inlined
from gistmill.functions.stopwords import ENGLISH
from gistmill.functions.summaries import DAMPING, LOOKBACK
from gistmill.operators import bootstrap as bs
from gistmill.operators import resampling as rs
from gistmill.operators import evaluate as ev
from gistmill.operators import summarize as su

FRAGMENTS = f"WITH {PAIRS}, {fragments_sql()}"


def per_token(amount: str, base: str) -> str:
    return f"round(coalesce(({amount})::DOUBLE / nullif({base}, 0), 0), 6)"


LENGTHS = "coalesce(list_sum(list_transform(m, lambda x: x.len)), 0)"
SQUARES = "coalesce(list_sum(list_transform(m, lambda x: x.len * x.len)), 0)"


def found(spark, sf_dir):
    return ev.with_fragments(pairs(spark, sf_dir))


@check(
    "fragments",
    f"{FRAGMENTS}, rows AS (SELECT id, unnest(m) AS x FROM matched) SELECT id, x.i::INTEGER AS i, "
    "x.j::INTEGER AS j, x.len::INTEGER AS len FROM rows",
)
def fragments(spark, sf_dir):
    return inlined(found(spark, sf_dir), ["id"], F.col("matches"), "i")


@check(
    "fragments_whitespace",
    f"WITH {PAIRS}, {fragments_sql(tokens='[^' + chr(92) + 's]+').replace('lower(', '(')}, "
    "rows AS (SELECT id, unnest(m) AS x FROM matched) SELECT id, x.i::INTEGER AS i, "
    "x.j::INTEGER AS j, x.len::INTEGER AS len FROM rows",
)
def fragments_whitespace(spark, sf_dir):
    whole = ev.with_fragments(pairs(spark, sf_dir), tokenize=False, case=True)
    return inlined(whole, ["id"], F.col("matches"), "i")


@check(
    "coverage",
    f"{FRAGMENTS} SELECT id, {per_token(LENGTHS, 'ns')} AS coverage, "
    f"{per_token(LENGTHS, 'nt')} AS text_coverage FROM matched",
)
def coverage(spark, sf_dir):
    m = F.col("matches")
    return found(spark, sf_dir).select(
        "id",
        r6(fr.coverage(m, F.size("s_tokens"))).alias("coverage"),
        r6(fr.coverage(m, F.size("t_tokens"))).alias("text_coverage"),
    )


@check(
    "density",
    f"{FRAGMENTS} SELECT id, {per_token(SQUARES, 'ns')} AS density, "
    f"{per_token(SQUARES, 'nt')} AS text_density FROM matched",
)
def density(spark, sf_dir):
    m = F.col("matches")
    return found(spark, sf_dir).select(
        "id",
        r6(fr.density(m, F.size("s_tokens"))).alias("density"),
        r6(fr.density(m, F.size("t_tokens"))).alias("text_density"),
    )


@check(
    "compression",
    f"WITH {PAIRS}, n AS (SELECT id, len({sql_all('text', TOKEN)}) AS nt, "
    f"len({sql_all('summary', TOKEN)}) AS ns FROM pairs) "
    f"SELECT id, {per_token('nt', 'ns')} AS compression, {per_token('ns', 'nt')} AS inverse FROM n",
)
def compression(spark, sf_dir):
    sizes = pairs(spark, sf_dir).select(
        "id", tk.token_len(F.col("text")).alias("nt"), tk.token_len(F.col("summary")).alias("ns")
    )
    nt, ns = F.col("nt"), F.col("ns")
    return sizes.select(
        "id",
        r6(fr.compression(nt, ns)).alias("compression"),
        r6(fr.compression(nt, ns, text_to_summary=False)).alias("inverse"),
    )


@check(
    "fragment_strings",
    f"{FRAGMENTS}, wt AS (SELECT id, {sql_all('summary', TOKEN)} AS sw, {sql_all('text', TOKEN)} AS tw "
    "FROM pairs), rows AS (SELECT id, sw, tw, unnest(list_filter(m, lambda x: x.len > 2)) AS x "
    "FROM matched JOIN wt USING (id)) "
    "SELECT id, array_to_string(list_slice(sw, x.i + 1, x.i + x.len), ' ') AS lifted, "
    "array_to_string(list_slice(tw, x.j + 1, x.j + x.len), ' ') AS source FROM rows",
)
def fragment_strings(spark, sf_dir):
    m = F.col("matches")
    both = F.arrays_zip(
        fr.fragment_strings(m, F.col("s_written"), 2, "i").alias("lifted"),
        fr.fragment_strings(m, F.col("t_written"), 2, "j").alias("source"),
    )
    return inlined(found(spark, sf_dir), ["id"], both, "lifted")


@check(
    "novel_words",
    f"WITH {TURNS}, w AS (SELECT conv_id, turn, unnest(list_distinct({sql_all('lower(pred)', TOKEN)})) "
    f"AS word, {sql_all('lower(summary)', TOKEN)} AS tt FROM pairs) "
    "SELECT conv_id, turn, word FROM w WHERE NOT list_contains(tt, word)",
)
def novel_words(spark, sf_dir):
    words = fr.novel_words(fr.side_tokens(F.col("pred")), fr.side_tokens(F.col("summary")))
    return exploded(turn_pairs(spark, sf_dir), ["conv_id", "turn"], words, "word")


@check(
    "fragment_spans",
    f"{FRAGMENTS}, rows AS (SELECT id, unnest(list_filter(m, lambda x: x.len >= 3)) AS x "
    "FROM matched) SELECT id, x.i::INTEGER AS summary_start, (x.i + x.len)::INTEGER AS summary_end, "
    "x.j::INTEGER AS text_start, (x.j + x.len)::INTEGER AS text_end FROM rows",
)
def fragment_spans(spark, sf_dir):
    return inlined(found(spark, sf_dir), ["id"], fr.fragment_spans(F.col("matches"), 3), "text_start")


@check(
    "density_bin",
    f"{FRAGMENTS}, d AS (SELECT id, coalesce({SQUARES}::DOUBLE / nullif(ns, 0), 0) AS d FROM matched) "
    "SELECT id, CASE WHEN d <= 1.5::DOUBLE THEN 'abstractive' WHEN d <= 8.1875::DOUBLE THEN 'mixed' "
    "ELSE 'extractive' END AS density_bin FROM d",
)
def density_bin(spark, sf_dir):
    return pair_bins(spark, sf_dir).select("id", "density_bin")


# --- summarisers ------------------------------------------------------------


@check(
    "lead_n",
    f"SELECT doc_id, array_to_string(list_slice({sql_sentences('text')}, 1, 3), chr(10)) AS pred "
    "FROM documents",
)
def lead_n(spark, sf_dir):
    return su.lead(documents(spark, sf_dir)).select("doc_id", "pred")


ROUNDS = 20


def textrank_sql() -> str:
    """CTEs of the phrase ranking with its rounds written out."""
    rounds = [
        "r0 AS MATERIALIZED (SELECT doc_id, w, 1.0::DOUBLE / n AS r FROM nodes JOIN size USING (doc_id))"
    ]
    for k in range(1, ROUNDS + 1):
        rounds.append(
            f"r{k} AS MATERIALIZED (SELECT nodes.doc_id, nodes.w, {1 - DAMPING!r}::DOUBLE / n + "
            f"{DAMPING}::DOUBLE * coalesce(s, 0) AS r FROM nodes JOIN size USING (doc_id) LEFT JOIN ("
            f"SELECT e.doc_id, e.b, sum(p.r * e.share) AS s FROM edges e JOIN r{k - 1} p "
            "ON p.doc_id = e.doc_id AND p.w = e.a GROUP BY e.doc_id, e.b) x "
            "ON x.doc_id = nodes.doc_id AND x.b = nodes.w)"
        )
    return f"""
body AS MATERIALIZED (SELECT doc_id, {sql_sentences("text")} AS s FROM documents),
sent AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS sn, unnest(s) AS st FROM body),
toks AS (SELECT doc_id, sn, {sql_all("lower(st)", TOKEN)} AS t FROM sent),
tk AS (SELECT doc_id, sn, generate_subscripts(t, 1) AS k, unnest(t) AS w FROM toks),
flag AS (SELECT *, w NOT IN ({sql_list(ENGLISH)}) AND regexp_matches(w, '\\p{{L}}') AS c FROM tk),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, sn ORDER BY k) AS run,
                row_number() OVER (PARTITION BY doc_id, sn ORDER BY k) AS q
         FROM flag WHERE c),
phr AS MATERIALIZED (SELECT doc_id, sn, min(k) AS k, list(w ORDER BY k) AS ws,
          array_to_string(list(w ORDER BY k), ' ') AS phrase FROM runs GROUP BY doc_id, sn, run),
nodes AS MATERIALIZED (SELECT DISTINCT doc_id, w FROM runs),
size AS (SELECT doc_id, count(*) AS n FROM nodes GROUP BY doc_id),
near AS (SELECT x.doc_id, x.w AS a, y.w AS b FROM runs x JOIN runs y
         ON x.doc_id = y.doc_id AND x.sn = y.sn AND y.q BETWEEN x.q + 1 AND x.q + {LOOKBACK}
         WHERE x.w <> y.w),
both_ways AS (SELECT doc_id, a, b FROM near UNION ALL SELECT doc_id, b, a FROM near),
wt AS (SELECT doc_id, a, b, count(*) AS c FROM both_ways GROUP BY doc_id, a, b),
edges AS MATERIALIZED (SELECT doc_id, a, b, c::DOUBLE / sum(c) OVER (PARTITION BY doc_id, a) AS share
          FROM wt),
{", ".join(rounds)},
uniq AS (SELECT doc_id, phrase, first(ws) AS ws, min((sn, k)) AS f FROM phr GROUP BY doc_id, phrase),
words AS (SELECT doc_id, phrase, f, len(ws) AS n, unnest(ws) AS w FROM uniq),
ranked AS (SELECT words.doc_id, phrase, f, round(sqrt(sum(r) / n) * n / (n + 1), 9) AS rank
           FROM words JOIN r{ROUNDS} p ON p.doc_id = words.doc_id AND p.w = words.w
           GROUP BY words.doc_id, phrase, f, n),
top AS MATERIALIZED (SELECT doc_id, phrase, rank, row_number() OVER (PARTITION BY doc_id
          ORDER BY rank DESC, f)::INTEGER AS place FROM ranked QUALIFY place <= 4),
wsum AS (SELECT doc_id, sum(rank) AS z FROM top GROUP BY doc_id),
held AS (SELECT DISTINCT phr.doc_id, sn, place FROM phr
         JOIN top ON top.doc_id = phr.doc_id AND top.phrase = phr.phrase),
cross_all AS (SELECT sent.doc_id, sent.sn, top.place, top.rank FROM sent
              LEFT JOIN top ON top.doc_id = sent.doc_id),
dist AS (SELECT c.doc_id, c.sn, coalesce(sqrt(sum(CASE WHEN h.place IS NULL
                  THEN (c.rank / z) * (c.rank / z) ELSE 0 END)), 0) AS distance
         FROM cross_all c LEFT JOIN wsum ON wsum.doc_id = c.doc_id
         LEFT JOIN held h ON h.doc_id = c.doc_id AND h.sn = c.sn AND h.place = c.place
         GROUP BY c.doc_id, c.sn)"""


TEXTRANK = f"WITH {textrank_sql()}"


@check(
    "textrank_phrases",
    f"{TEXTRANK} SELECT doc_id, place, phrase, round(rank, 6) AS rank FROM top",
)
def textrank_phrases(spark, sf_dir):
    top = su.textrank_phrases(documents(spark, sf_dir), "doc_id", ENGLISH, rounds=ROUNDS)
    return top.withColumn("rank", r6(F.col("rank")))


@check(
    "rank_sentences",
    f"{TEXTRANK} SELECT doc_id, sn::INTEGER AS sentence, round(distance, 6) AS distance FROM dist",
)
def rank_sentences(spark, sf_dir):
    ranked = su.rank_sentences(documents(spark, sf_dir), "doc_id", ENGLISH, rounds=ROUNDS)
    return ranked.withColumn("distance", r6(F.col("distance")))


@check(
    "textrank_n",
    f"{TEXTRANK}, pick AS (SELECT dist.doc_id, dist.sn, st FROM dist JOIN sent "
    "ON sent.doc_id = dist.doc_id AND sent.sn = dist.sn QUALIFY row_number() OVER "
    "(PARTITION BY dist.doc_id ORDER BY round(distance, 9), dist.sn) <= 3), "
    "joined AS (SELECT doc_id, array_to_string(list(st ORDER BY sn), ' ') AS pred FROM pick "
    "GROUP BY doc_id) SELECT doc_id, coalesce(pred, '') AS pred FROM documents "
    "LEFT JOIN joined USING (doc_id)",
)
def textrank_n(spark, sf_dir):
    return su.textrank(documents(spark, sf_dir), ENGLISH, rounds=ROUNDS).select("doc_id", "pred")


# --- overlap ----------------------------------------------------------------

RT = rouge.ROUGE_TOKEN


def gram_list(side: str, n: int) -> str:
    """List of n-grams from a token list column."""
    if n == 1:
        return side
    parts = " || ' ' || ".join([f"{side}[i + {k}]" for k in range(n)])
    return f"list_transform(range(1, greatest(len({side}) - {n - 2}, 1)), lambda i: {parts})"


def f_measure(hits: str, np: str, nr: str) -> str:
    return f"CASE WHEN {hits} > 0 THEN 2.0::DOUBLE * {hits} / ({np} + {nr}) ELSE 0 END"


ROUGE_TOKENS = f"""
rt AS MATERIALIZED (SELECT id, {sql_all("lower(pred)", RT)} AS p, {sql_all("lower(summary)", RT)} AS r
       FROM pairs)"""


def rouge_n_sql(n: int) -> str:
    return f"""
p{n} AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest({gram_list("p", n)}) AS g FROM rt)
       GROUP BY id, g),
q{n} AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest({gram_list("r", n)}) AS g FROM rt)
       GROUP BY id, g),
h{n} AS (SELECT p.id, sum(least(p.c, q.c)) AS h FROM p{n} p JOIN q{n} q ON p.id = q.id AND p.g = q.g
       GROUP BY p.id),
f{n} AS (SELECT rt.id, {f_measure("coalesce(h, 0)", f"greatest(len(p) - {n - 1}, 0)", f"greatest(len(r) - {n - 1}, 0)")}
       AS f FROM rt LEFT JOIN h{n} ON h{n}.id = rt.id)"""


@check(
    "rouge_n",
    f"WITH {PAIRS}, {ROUGE_TOKENS}, {rouge_n_sql(1)}, {rouge_n_sql(2)} "
    "SELECT id, round(f1.f, 6) AS rouge1, round(f2.f, 6) AS rouge2 FROM f1 JOIN f2 USING (id)",
)
def rouge_n(spark, sf_dir):
    p, s = F.col("pred"), F.col("summary")
    return pairs(spark, sf_dir).select(
        "id",
        r6(rouge.rouge_n(p, s, 1)["fmeasure"]).alias("rouge1"),
        r6(rouge.rouge_n(p, s, 2)["fmeasure"]).alias("rouge2"),
    )


# A bit string holds one bit per reference token, the first at its right end; a
# cleared bit says that the longest common subsequence grows there. A candidate
# token adds the bits at its own places; carries run by doubled steps.
ALL_ONES = "repeat('1', len(r))::BIT"


def places_of(token: str) -> str:
    marks = f"list_transform(list_reverse(r), lambda x: CASE WHEN x = {token} THEN '1' ELSE '0' END)"
    return f"array_to_string({marks}, '')::BIT"


def grown(v: str, m: str) -> str:
    kept, added = f"xor({v}, {v} & {m})", f"({v} & {m})"
    carried = (
        "list_reduce(list_transform(range(0, ceil(log2(len(r)))::BIGINT), lambda k: [(1::INTEGER << k::INTEGER)::BIT]), "
        "lambda s, d: [s[1] | (s[2] & (s[1] << d[1]::INTEGER)), s[2] & (s[2] << d[1]::INTEGER)], "
        f"[{added}, {kept}])[1]"
    )
    return f"(xor({kept}, {carried} << 1) | {kept})"


LCS = f"""
lc AS (SELECT id, len(r) - bit_count(list_reduce(
         list_transform(list_filter(p, lambda t: list_contains(r, t)), lambda t: {places_of("t")}),
         lambda v, m: {grown("v", "m")}, {ALL_ONES})) AS h
       FROM rt WHERE len(r) > 0 AND list_has_any(r, p)),
fl AS (SELECT rt.id, {f_measure("coalesce(h, 0)", "len(p)", "len(r)")} AS f FROM rt LEFT JOIN lc USING (id))"""


@check("rouge_l", f"WITH {PAIRS}, {ROUGE_TOKENS}, {LCS} SELECT id, round(f, 6) AS rouge_l FROM fl")
def rouge_l(spark, sf_dir):
    scored = rouge.rouge_l(F.col("pred"), F.col("summary"))
    return pairs(spark, sf_dir).select("id", r6(scored["fmeasure"]).alias("rouge_l"))


def sentence_tokens(side: str) -> str:
    lines = f"string_split(array_to_string({sql_sentences(side)}, chr(10)), chr(10))"
    return f"list_filter(list_transform({lines}, lambda s: {sql_all('lower(s)', RT)}), lambda t: len(t) > 0)"


# The bit strings of all prefixes are kept; the way back from the last one
# shortens the reference where both ways are equal.
LSUM = f"""
sides AS MATERIALIZED (SELECT id, {sentence_tokens("pred")} AS ps, {sentence_tokens("summary")} AS rs FROM pairs),
rsent AS (SELECT id, unnest(rs) AS r, generate_subscripts(rs, 1) AS a FROM sides),
psent AS (SELECT id, unnest(ps) AS p FROM sides),
grid AS MATERIALIZED (SELECT rsent.id, a, r, p, list_reduce(
    list_transform(p, lambda t: [{places_of("t")}]),
    lambda t, y: list_append(t, {grown("t[-1]", "y[1]")}), [{ALL_ONES}]) AS t
  FROM rsent JOIN psent ON rsent.id = psent.id AND list_has_any(r, p)),
way AS (SELECT id, a, r, list_reduce(
    list_transform(range(0, len(r) + len(p)), lambda k: [k]),
    lambda s, x: CASE WHEN s[1] = 0 OR s[2] = 0 THEN s
      WHEN r[s[1]] = p[s[2]] THEN list_concat([s[1] - 1, s[2] - 1], list_append(s[3:], s[1]))
      WHEN get_bit(t[s[2] + 1], (len(r) - s[1])::INTEGER) = 0 THEN list_concat([s[1], s[2] - 1], s[3:])
      ELSE list_concat([s[1] - 1, s[2]], s[3:]) END,
    [len(r)::BIGINT, len(p)::BIGINT])[3:] AS found FROM grid),
spot AS (SELECT DISTINCT id, a, r, unnest(found) AS i FROM way),
tok_hits AS (SELECT id, r[i] AS w, count(*) AS c FROM spot GROUP BY ALL),
rcount AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(flatten(rs)) AS w FROM sides) GROUP BY ALL),
pcount AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(flatten(ps)) AS w FROM sides) GROUP BY ALL),
ls AS (SELECT id, sum(least(h.c, rcount.c, pcount.c)) AS h FROM tok_hits h JOIN rcount USING (id, w)
       JOIN pcount USING (id, w) GROUP BY id),
fs AS (SELECT rt.id, {f_measure("coalesce(h, 0)", "len(p)", "len(r)")} AS f FROM rt LEFT JOIN ls USING (id))"""


@check("rouge_lsum", f"WITH {PAIRS}, {ROUGE_TOKENS}, {LSUM} SELECT id, round(f, 6) AS rouge_lsum FROM fs")
def rouge_lsum(spark, sf_dir):
    """Of several longest common subsequences the one counts that the way back
    through the table of lengths finds, the reference being shortened first."""
    lined = pairs(spark, sf_dir).withColumns(
        {c: tk.newline_sentences(F.col(c)) for c in ("pred", "summary")}
    )
    scored = rouge.rouge_lsum(F.col("pred"), F.col("summary"))
    return lined.select("id", r6(scored["fmeasure"]).alias("rouge_lsum"))


VECS = """
v AS (SELECT vec_id // 10 AS pair, vec_id % 10 AS k, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT p.pair, p.k AS pk, r.k AS rk, list_cosine_similarity(p.e, r.e) AS s
      FROM v p JOIN v r ON p.pair = r.pair AND p.k < 5 AND r.k >= 5),
pr AS (SELECT pair, avg(s) AS p FROM (SELECT pair, pk, max(s) AS s FROM c GROUP BY pair, pk) GROUP BY pair),
rc AS (SELECT pair, avg(s) AS r FROM (SELECT pair, rk, max(s) AS s FROM c GROUP BY pair, rk) GROUP BY pair),
sim AS (SELECT pair, p AS precision, r AS recall, 2 * p * r / (p + r) AS f1
        FROM pr JOIN rc USING (pair))"""


@check(
    "embedding_match_score",
    f"WITH {VECS} SELECT pair, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1, 6) AS f1 FROM sim",
)
def embedding_match_score(spark, sf_dir):
    scored = ev.embedding_scores(token_vecs(spark, sf_dir))
    return scored.select("pair", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


# --- bootstrap --------------------------------------------------------------


TWO_64 = "18446744073709551616::UHUGEINT"


def mixed(words: str) -> str:
    """A list of 64-bit words, each with its bits mixed."""
    for shift, times in zip((30, 27), rs.MULTIPLY):
        words = f"list_transform({words}, lambda x: xor(x, x >> {shift}))"
        words = f"list_transform({words}, lambda x: ((x::UHUGEINT * {times}::UHUGEINT) % {TWO_64})::UBIGINT)"
    return f"list_transform({words}, lambda x: xor(x, x >> 31))"


def word(value: str) -> str:
    return f"(({value}) % {TWO_64})::UBIGINT"


def numbered(key: str, many: str) -> str:
    """The random words 1 to ``many`` of a key."""
    step = word(f"{key}::UHUGEINT + k::UHUGEINT * {rs.STEP}::UHUGEINT")
    return mixed(f"list_transform(range(1, {many} + 1), lambda k: {step})")


# Draws fall down a tree of places: in a node, as many go left as bits are set
# in as many random bits; what ends beyond the last row starts again.
NODE_KEY = mixed(
    "[" + word(
        f"stream::UHUGEINT + lo::UHUGEINT * {rs.LO_STEP}::UHUGEINT + size::UHUGEINT * {rs.SIZE_STEP}::UHUGEINT"
    ) + "]"
)
TO_THE_LEFT = (
    f"list_sum(list_transform({numbered('key', '(m + 63) // 64')}, "
    "lambda x, i: bit_count(x >> greatest(64 * i - m, 0)::UBIGINT)))::BIGINT"
)


def places_sql(resamples: int) -> str:
    """``dr(b, idx)``: the draws, from ``sc(idx, ..)``."""
    leaf = 1 << rs.LEAF_BITS
    done = f"(lo + size <= n AND size <= {leaf})"
    return f"""
nn AS MATERIALIZED (SELECT count(*) AS n, CASE WHEN count(*) > 1 THEN 1::BIGINT << length(bin(count(*) - 1)) ELSE 1 END
       AS top FROM sc),
node AS (
  SELECT b, {mixed("[" + word(f"(b + 1)::UHUGEINT * {rs.STEP}::UHUGEINT") + "]")}[1] AS stream,
         0::BIGINT AS lo, top::BIGINT AS size, n::BIGINT AS m FROM nn, range({resamples}) x(b) WHERE n > 0
  UNION ALL
  SELECT b, k.stream, k.lo, k.size, k.m FROM (
    SELECT b, unnest(CASE WHEN lo >= n THEN [{{stream: key, lo: 0::BIGINT, size: top::BIGINT, m: m}}]
        ELSE [{{stream: stream, lo: lo, size: size // 2, m: went}},
              {{stream: stream, lo: lo + size // 2, size: size // 2, m: m - went}}] END) AS k
    FROM (SELECT *, {TO_THE_LEFT} AS went FROM (
      SELECT node.*, n, top, {NODE_KEY}[1] AS key FROM node, nn WHERE NOT {done}))) WHERE k.m > 0),
dr AS MATERIALIZED (SELECT b, lo + (w & (size - 1)::UBIGINT)::BIGINT AS idx FROM (
    SELECT b, lo, size, unnest({numbered("key", "m")}) AS w FROM (
      SELECT node.*, {NODE_KEY}[1] AS key FROM node, nn WHERE {done})))"""


def draws_sql(rows: str, resamples: int) -> str:
    """CTEs up to ``means(b, m)`` from a ``(key, score)`` query."""
    return f"""
sc AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key) - 1 AS idx, score FROM ({rows})),
{places_sql(resamples)},
means AS (SELECT b, avg(score) AS m FROM dr JOIN sc USING (idx) GROUP BY b)"""


INTERVAL = (
    "SELECT {lead} round(quantile_cont({c}, 0.025), 6) AS low, round(quantile_cont({c}, 0.5), 6) AS mid, "
    "round(quantile_cont({c}, 0.975), 6) AS high, round((SELECT avg(score) FROM {of}), 6) AS mean "
    "FROM {t}"
)


def rounded(interval):
    return interval.select(
        *[c for c in interval.columns if c == "metric"],
        *[r6(F.col(c)).alias(c) for c in ("low", "mid", "high", "mean")],
    )


CHARS = "SELECT doc_id AS key, n_chars::DOUBLE AS score FROM documents"
RESAMPLES = bs.RESAMPLES


def char_scores(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.col("n_chars").cast("double").alias("score"))


@check(
    "bootstrap_mean",
    f"WITH RECURSIVE {draws_sql(CHARS, RESAMPLES)} " + INTERVAL.format(lead="", c="m", of="sc", t="means"),
)
def bootstrap_mean(spark, sf_dir):
    scores = char_scores(spark, sf_dir)
    return rounded(bs.bootstrap_mean(scores, "score", "doc_id"))


POISSON = " + ".join(f"(u >= {p!r}::DOUBLE)::INTEGER" for p in bs.POISSON_1)


@check(
    "bootstrap_poisson",
    f"""WITH sc AS (SELECT ('0x' || substr(md5(key::VARCHAR), 1, 15))::BIGINT AS h, score FROM ({CHARS})),
dr AS (SELECT score, unnest(range({RESAMPLES})) AS b, unnest({numbered("h", str(RESAMPLES))}) AS x FROM sc),
uu AS (SELECT b, score, (x >> 11)::DOUBLE / 9007199254740992 AS u FROM dr),
w AS (SELECT b, score, {POISSON} AS w FROM uu),
means AS (SELECT b, sum(w * score) / sum(w) AS m FROM w GROUP BY b) """
    + INTERVAL.format(lead="", c="m", of="sc", t="means"),
)
def bootstrap_poisson(spark, sf_dir):
    scores = char_scores(spark, sf_dir)
    return rounded(bs.bootstrap_mean(scores, "score", "doc_id", method="poisson"))


@check(
    "sample_percentiles",
    f"""WITH sc AS (SELECT row_number() OVER (ORDER BY key) - 1 AS idx, score FROM ({CHARS})),
dr AS (SELECT ('0x' || substr(md5('0:' || k), 1, 15))::BIGINT % (SELECT count(*) FROM sc) AS idx
       FROM range(1000) y(k)),
got AS (SELECT score FROM dr JOIN sc USING (idx)) """
    + INTERVAL.format(lead="", c="score", of="sc", t="got"),
)
def sample_percentiles(spark, sf_dir):
    return rounded(bs.sample_percentiles(char_scores(spark, sf_dir), "score", "doc_id"))


def report_part(name: str, rows: str) -> str:
    inner = f"WITH RECURSIVE {draws_sql(rows, RESAMPLES)} " + INTERVAL.format(
        lead=f"'{name}' AS metric,", c="m", of="sc", t="means"
    )
    return f"(SELECT * FROM ({inner}))"


@check(
    "metric_report",
    f"WITH {PAIRS}, {ROUGE_TOKENS}, {rouge_n_sql(1)}, {fragments_sql('pred')} "
    + report_part("rouge1", "SELECT id AS key, f AS score FROM f1")
    + " UNION ALL "
    + report_part(
        "density",
        f"SELECT id AS key, coalesce({SQUARES}::DOUBLE / nullif(ns, 0), 0) AS score FROM matched",
    ),
)
def metric_report(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    overlap = rows.select(
        "id", rouge.rouge_n(F.col("pred"), F.col("summary"), 1)["fmeasure"].alias("rouge1")
    )
    density = ev.extractiveness(rows, "id", "pred", "text")
    report = bs.metric_report(
        {
            "rouge1": bs.bootstrap_mean(overlap, "rouge1", "id"),
            "density": bs.bootstrap_mean(density, "density", "id"),
        }
    )
    return rounded(report)


METRICS = (*ev.ROUGE, "density")


@check(
    "evaluation_report",
    f"""WITH RECURSIVE {PAIRS}, {ROUGE_TOKENS}, {rouge_n_sql(1)}, {rouge_n_sql(2)}, {LCS}, {LSUM}, {fragments_sql('pred')},
dn AS (SELECT id, coalesce({SQUARES}::DOUBLE / nullif(ns, 0), 0) AS density FROM matched),
sc AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY id) - 1 AS idx, f1.f AS rouge1, f2.f AS rouge2, fl.f AS "rougeL",
    fs.f AS "rougeLsum", density
  FROM f1 JOIN f2 USING (id) JOIN fl USING (id) JOIN fs USING (id) JOIN dn USING (id)),
{places_sql(RESAMPLES)},
means AS MATERIALIZED (SELECT b, {", ".join(f'avg("{m}") AS "{m}"' for m in METRICS)}
       FROM dr JOIN sc USING (idx) GROUP BY b) """
    + " UNION ALL ".join(
        INTERVAL.format(lead=f"'{m}' AS metric,", c=f'"{m}"', of="sc", t="means").replace(
            "avg(score)", f'avg("{m}")'
        )
        for m in METRICS
    ),
)
def evaluation_report(spark, sf_dir):
    """The whole evaluation of lead-3 predictions, one set of draws for all."""
    return rounded(ev.evaluate(pairs(spark, sf_dir), "id"))


@check(
    "turn_overlap",
    f"WITH {TURNS}, {ROUGE_TOKENS}, {rouge_n_sql(1)} "
    "SELECT conv_id, turn, round(f1.f, 6) AS rouge1 FROM pairs JOIN f1 USING (id)",
)
def turn_overlap(spark, sf_dir):
    """Overlap of each user turn with the assistant turn that answers it."""
    score = rouge.rouge_n(F.col("pred"), F.col("summary"), 1)["fmeasure"]
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", r6(score).alias("rouge1"))


@check(
    "turn_overlap_whole",
    f"WITH {TURNS}, {ROUGE_TOKENS}, {rouge_n_sql(1)}, {rouge_n_sql(2)}, {LCS} "
    "SELECT conv_id, turn, round(f1.f, 6) AS rouge1, round(f2.f, 6) AS rouge2, round(fl.f, 6) AS rouge_l "
    "FROM pairs JOIN f1 USING (id) JOIN f2 USING (id) JOIN fl USING (id)",
)
def turn_overlap_whole(spark, sf_dir):
    """All scores of whole texts: each user turn with the turn that answers it."""
    p, s = F.col("pred"), F.col("summary")
    scores = {"rouge1": rouge.rouge_n(p, s, 1), "rouge2": rouge.rouge_n(p, s, 2), "rouge_l": rouge.rouge_l(p, s)}
    return turn_pairs(spark, sf_dir).select(
        "conv_id", "turn", *[r6(x["fmeasure"]).alias(name) for name, x in scores.items()]
    )
