"""How much of a summary is lifted from its text: fragments and their scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions import tokens as tk
from gistmill.functions.rows import let, total

MATCHES = "array<struct<i:int,j:int,len:int>>"
WHITESPACE_WORD = f"[^{tk.SPACE}]+"


def side_tokens(text: Column, tokenize: bool = True, case: bool = False) -> Column:
    """Tokens to compare: pattern tokens or whitespace words, lower-cased."""
    source = text if case else F.lower(text)
    return tk.tokens(source, tk.TOKEN if tokenize else WHITESPACE_WORD)


def _greedy(summary: list[str], text: list[str]) -> list[tuple[int, int, int]]:
    """Longest shared runs, left to right over the summary.

    Only the positions where the walk stops are looked at. There the text's
    places of the token are taken in order, each run is followed as far as it
    goes, and places inside it are passed over, so a stop costs no more than one
    pass over the text. The first of equal length wins.
    """
    known, places = set(summary), {}
    for j, t in enumerate(text):
        if t in known:
            places.setdefault(t, []).append(j)
    out, i = [], 0
    while i < len(summary):
        length, at, free = 0, 0, 0
        for j in places.get(summary[i], ()):
            if j < free:
                continue
            k, most = 1, min(len(summary) - i, len(text) - j)
            while k < most and summary[i + k] == text[j + k]:
                k += 1
            free = j + k
            if k > length:
                length, at = k, j
        if length:
            out.append((i, at, length))
        i += length or 1
    return out


def fragments(summary_tokens: Column, text_tokens: Column) -> Column:
    """``array<struct<i, j, len>>``: start in summary, start in text, length.

    Both sides are columns of one row, so nothing is shuffled; the pairwise
    run lengths need state that array expressions cannot hold.
    """

    @F.arrow_udf(MATCHES)
    def matched(summaries: pa.Array, texts: pa.Array) -> pa.Array:
        ends, flat = [0], []
        for s, t in zip(summaries.to_pylist(), texts.to_pylist()):
            if s and t:
                flat.extend(_greedy(s.split(" "), t.split(" ")))
            ends.append(len(flat))
        columns = [pa.array([m[k] for m in flat], pa.int32()) for k in range(3)]
        structs = pa.StructArray.from_arrays(columns, names=["i", "j", "len"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)

    # Tokens hold no blanks, so one string per side crosses to Python.
    return matched(F.array_join(summary_tokens, " "), F.array_join(text_tokens, " "))


def _spaced(text: Column) -> Column:
    """Lower-cased pattern tokens with white space between them, as one string."""
    return F.lower(F.regexp_replace(text, tk.SYMBOL, " $0 "))


LIFTED = f"struct<matches:{MATCHES},n_summary:int,n_text:int>"


def lifted(summary: Column, text: Column) -> Column:
    """``struct<matches, n_summary, n_text>`` of two texts: fragments over their
    lower-cased tokens, and how many tokens there are. No array of tokens is made
    in Spark; those are split apart where they are compared."""

    @F.arrow_udf(LIFTED)
    def matched(summaries: pa.Array, texts: pa.Array) -> pa.Array:
        ends, flat, sizes = [0], [], []
        # Bytes are split at the white space of the pattern, ASCII only.
        for pair in zip(*(side.cast(pa.binary()).to_pylist() for side in (summaries, texts))):
            s, t = (None if x is None else x.split() for x in pair)
            if s and t:
                flat.extend(_greedy(s, t))
            ends.append(len(flat))
            sizes.append([None if x is None else len(x) for x in (s, t)])
        columns = [pa.array([m[k] for m in flat], pa.int32()) for k in range(3)]
        structs = pa.StructArray.from_arrays(columns, names=["i", "j", "len"])
        matches = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
        counts = [pa.array([x[k] for x in sizes], pa.int32()) for k in range(2)]
        return pa.StructArray.from_arrays([matches, *counts], names=["matches", "n_summary", "n_text"])

    return matched(_spaced(summary), _spaced(text))


def _per_token(amount: Column, base: Column) -> Column:
    return F.coalesce(F.try_divide(amount, base), F.lit(0.0))


def coverage(matches: Column, base: Column) -> Column:
    """Matched tokens over ``base`` tokens (summary or text); 0 when empty."""
    return _per_token(total(F.transform(matches, lambda m: m["len"])), base)


def density(matches: Column, base: Column) -> Column:
    """Squared match lengths over ``base`` tokens; 0 when empty."""
    squared = F.transform(matches, lambda m: m["len"].cast("long") * m["len"])
    return _per_token(total(squared), base)


def compression(n_text: Column, n_summary: Column, text_to_summary: bool = True) -> Column:
    """Length ratio; 0 when the divisor is 0."""
    return _per_token(n_text, n_summary) if text_to_summary else _per_token(n_summary, n_text)


def fragment_strings(
    matches: Column, side: Column, min_length: int = 0, start: str = "i"
) -> Column:
    """Matched slices longer than ``min_length``; ``start`` 'i' cuts summary
    tokens, 'j' cuts text tokens."""
    kept = F.filter(matches, lambda m: m["len"] > min_length)
    return let(
        side,
        lambda ts: F.transform(
            kept, lambda m: F.array_join(F.slice(ts, m[start] + 1, m["len"]), " ")
        ),
    )


def fragment_spans(matches: Column, min_length: int = 0) -> Column:
    """Spans to highlight, those shorter than ``min_length`` left out."""
    kept = F.filter(matches, lambda m: m["len"] >= min_length)
    return F.transform(
        kept,
        lambda m: F.struct(
            m["i"].alias("summary_start"),
            (m["i"] + m["len"]).alias("summary_end"),
            m["j"].alias("text_start"),
            (m["j"] + m["len"]).alias("text_end"),
        ),
    )


def novel_words(summary_tokens: Column, text_tokens: Column) -> Column:
    """Distinct summary tokens the text does not hold, sorted."""
    return F.sort_array(F.array_except(summary_tokens, text_tokens))


def density_bin(density: Column, lower: float = 1.5, upper: float = 8.1875) -> Column:
    return (
        F.when(density <= lower, "abstractive")
        .when(density <= upper, "mixed")
        .when(density.isNotNull(), "extractive")
    )


def scored(matches: Column, n_summary: Column, n_text: Column) -> Column:
    """Coverage, density and compression as one struct."""
    return let(
        matches,
        lambda m: F.struct(
            coverage(m, n_summary).alias("coverage"),
            density(m, n_summary).alias("density"),
            compression(n_text, n_summary).alias("compression"),
        ),
    )
