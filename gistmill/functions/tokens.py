"""Tokens, words, sentences, lines: the units every other operator counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns are written without look-around or possessive forms, so that any
# linear-time regex engine reads them the same way.
SYMBOL = r"[^\s\p{L}\p{N}]"
TOKEN = r"[\p{L}\p{N}]+|" + SYMBOL
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}\p{P}]"
GAPPED_TOKEN = r"\s*(?:" + TOKEN + ")"
ALPHA_TAIL = r"\p{L}[\p{L}\p{N}]*"
NOT_IN_WORD = r"[\s\p{P}]+"
SENTENCE = r"[^.!?]+[.!?]*\s*"
# What counts as white space at the edges of lines and sentences
# and between plain words, written out since engines differ in their classes.
SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
EDGE_SPACE = rf"^[{SPACE}]+|[{SPACE}]+\z"
#: The same characters one by one.
SPACE_CHARS = "".join(
    map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_len(text: Column, pattern: str = TOKEN) -> Column:
    """Number of tokens, counted without building the array."""
    return F.regexp_count(text, F.lit(pattern))


def truncate_tokens(text: Column, n: int, pattern: str = TOKEN) -> Column:
    return F.slice(tokens(text, pattern), 1, n)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def word_chars(text: Column) -> Column:
    """Characters inside words: whatever is neither space nor punctuation."""
    return F.length(F.regexp_replace(text, NOT_IN_WORD, ""))


def n_alpha_words(text: Column) -> Column:
    """Words holding a letter; each is matched once, from its first letter."""
    return F.regexp_count(text, F.lit(ALPHA_TAIL))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def sentences_of(text: Column) -> Column:
    """Stripped sentences; runs that strip to nothing are left out."""
    found = F.regexp_extract_all(strip(text), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def first_sentences(text: Column, n: int) -> Column:
    """The first ``n`` of ``sentences_of``; a text is read no further than these."""
    # What stands between two sentences is stops that no sentence begins with.
    head = rf"\A[{SPACE}]*+((?:[.!?]*+[^.!?]++[.!?]*+\s*+){{0,{max(n, 0)}}}+)"
    return sentences_of(F.regexp_extract(text, head, 1))


def newline_sentences(text: Column) -> Column:
    return F.array_join(sentences_of(text), "\n")


def line_array(text: Column) -> Column:
    return F.split(text, "\n")


def paragraph_array(text: Column) -> Column:
    return F.split(text, "\n\n")


def non_blank_lines(text: Column) -> Column:
    return F.filter(F.transform(line_array(text), strip), lambda s: s != "")
