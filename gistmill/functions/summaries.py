"""Extractive summaries of one document, inside its row."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions import tokens as tk
from gistmill.functions.rows import let

DAMPING = 0.85
LOOKBACK = 3
ROUNDS = 20
SLICE_ROWS = 1024  # documents whose graphs are ranked together
RANK_DIGITS = 9  # ranks equal up to here count as tied


def lead_n(text: Column, n: int = 3) -> Column:
    """First ``n`` sentences, one per line."""
    return lead_of(tk.first_sentences(text, n), n)


def lead_of(sentences: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(sentences, 1, n), "\n")


def sentence_tokens(text: Column) -> Column:
    """Lower-cased tokens of each sentence; punctuation ends a phrase."""
    return tokens_of(tk.sentences_of(text))


def tokens_of(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: tk.tokens(F.lower(s)))


def _is_content(word: Column, stop_words: Sequence[str]) -> Column:
    return ~word.isin(*stop_words) & word.rlike(r"\p{L}")


def sentence_phrases(words: Column, stop_words: Sequence[str]) -> Column:
    """Maximal runs of content words of each sentence, in order."""
    breaks = lambda ws: F.transform(
        ws, lambda w: F.when(_is_content(w, stop_words), w).otherwise(F.lit("\n"))
    )
    runs = lambda ws: F.split(F.array_join(breaks(ws), " "), "\n")
    return F.transform(
        words, lambda ws: F.filter(F.transform(runs(ws), lambda p: F.trim(p)), lambda p: p != "")
    )


class Phrases(NamedTuple):
    """Phrases and their words, of the documents of a batch one after another."""

    names: pa.Array
    doc: np.ndarray  # of each phrase
    line: np.ndarray  # sentence of each phrase, counted over the batch
    words: pa.Array
    ends: np.ndarray  # of each phrase in the words


def _split(texts: pa.Array, by: str) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts and which text each is of."""
    lists = pc.split_pattern(texts, by)
    return lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _phrases(texts: pa.Array) -> Phrases:
    lines, doc = _split(texts.fill_null(""), "\n")
    names, line = _split(lines, "\t")
    filled = pc.greater(pc.binary_length(names), 0)
    names, line = names.filter(filled), line[filled.to_numpy(zero_copy_only=False)]
    words, of = _split(names, " ")
    return Phrases(names, doc[line], line, words, np.cumsum(np.bincount(of, minlength=len(names))))


def _word_ranks(p: Phrases, rounds: int) -> np.ndarray:
    """Rank of each word of the batch in its document, by fixed rounds over the
    graphs of words that stand at most ``LOOKBACK`` apart in a sentence, weighted
    by how often they do. The graphs are one block-diagonal matrix."""
    phrase = np.repeat(np.arange(len(p.ends)), np.diff(p.ends, prepend=0))
    doc, line = p.doc[phrase], p.line[phrase]
    code = p.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    nodes, at = np.unique(doc * (int(code.max(initial=0)) + 1) + code, return_inverse=True)
    n = len(nodes)
    size = np.zeros(int(doc.max(initial=-1)) + 1)
    home = np.zeros(n, np.int64)
    home[at] = doc
    np.add.at(size, home, 1)
    ends = []
    for gap in range(1, LOOKBACK + 1):
        near = (line[gap:] == line[:-gap]) & (at[gap:] != at[:-gap])
        ends.append((at[:-gap][near], at[gap:][near]))
    # Every meeting counts once in each direction.
    src = np.concatenate([x for a, b in ends for x in (a, b)])
    dst = np.concatenate([x for a, b in ends for x in (b, a)])
    share = 1.0 / np.bincount(src, minlength=n)[src]
    rank = 1.0 / size[home]
    stay = (1 - DAMPING) / size[home]
    for _ in range(rounds):
        rank = stay + DAMPING * np.bincount(dst, rank[src] * share, n)
    return rank[at]


PHRASES = "array<struct<phrase:string,rank:double,first:int>>"


def _ranked(texts: pa.Array, rounds: int) -> pa.ListArray:
    p = _phrases(texts)
    if not len(p.names):
        empty = pa.array([], pa.struct([("phrase", pa.string()), ("rank", pa.float64()), ("first", pa.int32())]))
        return pa.ListArray.from_arrays(pa.array([0] * (len(texts) + 1), pa.int32()), empty)
    starts, length = np.append(0, p.ends[:-1]), np.diff(p.ends, prepend=0)
    mean = np.add.reduceat(_word_ranks(p, rounds), starts) / length
    scores = np.sqrt(mean) * length / (length + 1)
    code = p.names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first = np.unique(p.doc * (int(code.max()) + 1) + code, return_index=True)
    first = np.sort(first)
    before = np.searchsorted(p.doc, p.doc[first])  # phrases in front of the document's own
    structs = pa.StructArray.from_arrays(
        [p.names.take(pa.array(first)), pa.array(scores[first]), pa.array((first - before).astype(np.int32))],
        names=["phrase", "rank", "first"],
    )
    ends = np.append(0, np.cumsum(np.bincount(p.doc[first], minlength=len(texts))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def phrase_ranks(phrases: Column, rounds: int = ROUNDS) -> Column:
    """Distinct phrases of one document with their rank and first place.

    A phrase of k words with rank sum s scores sqrt(s / k) * k / (k + 1). All
    documents of a batch are ranked at once.
    """

    @F.arrow_udf(PHRASES)
    def ranked(texts: pa.Array) -> pa.Array:
        parts = [_ranked(texts.slice(a, SLICE_ROWS), rounds) for a in range(0, len(texts), SLICE_ROWS)]
        return pa.concat_arrays(parts) if parts else _ranked(texts, rounds)

    return ranked(F.array_join(F.transform(phrases, lambda ps: F.array_join(ps, "\t")), "\n"))


def top_phrases(ranked: Column, k: int = 4) -> Column:
    """The ``k`` best phrases; ties go to the one seen first."""
    keyed = F.transform(
        ranked,
        lambda p: F.struct(
            F.round(-p["rank"], RANK_DIGITS).alias("neg"), p["first"].alias("first"), p["phrase"].alias("phrase")
        ),
    )
    return F.transform(
        F.slice(F.sort_array(keyed), 1, k),
        lambda p: F.struct(p["phrase"].alias("phrase"), (-p["neg"]).alias("rank")),
    )


def sentence_distances(phrases: Column, top: Column) -> Column:
    """Per sentence: length of the weight vector of the top phrases it lacks."""

    def distance(held: Column, top: Column, z: Column) -> Column:
        absent = F.filter(top, lambda p: ~F.array_contains(held, p["phrase"]))
        squares = F.aggregate(
            absent, F.lit(0.0), lambda a, p: a + F.pow(F.try_divide(p["rank"], z), F.lit(2))
        )
        return F.sqrt(squares)

    return let(
        top,
        lambda t: let(
            F.aggregate(t, F.lit(0.0), lambda a, p: a + p["rank"]),
            lambda z: F.transform(phrases, lambda held: distance(held, t, z)),
        ),
    )


def closest_sentences(sentences: Column, distances: Column, n: int = 3) -> Column:
    """The ``n`` nearest sentences in document order, joined by a blank."""
    keyed = F.transform(
        distances, lambda d, i: F.struct(F.round(d, RANK_DIGITS).alias("d"), i.alias("i"))
    )
    places = F.sort_array(F.transform(F.slice(F.sort_array(keyed), 1, n), lambda x: x["i"]))
    return let(
        sentences, lambda ss: F.array_join(F.transform(places, lambda i: F.get(ss, i)), " ")
    )
