"""Document-quality predicates. Each says, as a boolean column, who passes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions import repetition as rp
from gistmill.functions import tokens as tk
from gistmill.functions.stopwords import DANISH

# Names a verdict can carry, in the order the filters run.
FILTERS = (
    "doc_length",
    "mean_word_length",
    "alpha_ratio",
    "stop_word",
    "symbol_2_word_hashtag",
    "symbol_2_word_ellipsis",
    "line_bullets_or_ellipsis",
    "duplicate_lines_chr_fraction",
    "duplicate_paragraph_chr_fraction",
    "top_ngram_chr_fraction",
    "duplicate_ngram_chr_fraction",
    "detect_language",
    "short_long_sentece",
    "string_filter",
)
TOO_LONG = "max_chr_length"
PASSED = "passed filters"
SPELLINGS = {"short_long_sentence": "short_long_sentece"}


@dataclass(frozen=True)
class QualityParams:
    """Thresholds of the filter chain."""

    # Defaults of the chain.
    doc_length: tuple[int, int] = (50, 100_000)
    mean_word_length: tuple[float, float] = (3, 10)
    alpha_ratio: float = 0.6
    min_stop_words: int = 2
    symbol_2_word_hashtag: float = 0.1
    symbol_2_word_ellipsis: float = 0.1
    max_p_begin_bullets: float = 0.9
    max_p_end_ellipsis: float = 0.3
    min_bullets: int = 2
    min_ellipsis: int = 2
    duplicate_lines_chr_fraction: float = 0.2
    duplicate_paragraph_chr_fraction: float = 0.2
    top_ngram_range: tuple[int, int] = (2, 4)
    top_ngram_thresholds: tuple[float, ...] = (0.20, 0.18, 0.16)
    top_ngram_min_count: int = 3
    duplicate_ngram_range: tuple[int, int] = (5, 10)
    duplicate_ngram_thresholds: tuple[float, ...] = (0.25, 0.24, 0.23, 0.22, 0.21, 0.20)
    language_mode: str = "top"
    languages: tuple[str, ...] = ("da",)
    language_threshold: float = 0.9
    long_sentence_chars: int = 30
    long_sentence_ratio: float = 0.5
    string: str | None = None
    max_length: int = 5_000_000
    stop_words: tuple[str, ...] = field(default=DANISH, repr=False)
    ignore: tuple[str, ...] = ()

    def active(self) -> list[str]:
        """Filters left after ``ignore``, in order."""
        dropped = {SPELLINGS.get(name, name) for name in self.ignore}
        unknown = dropped - set(FILTERS)
        if unknown:
            raise ValueError(f"no such filter: {sorted(unknown)}; known: {list(FILTERS)}")
        if self.string is None:
            dropped = dropped | {"string_filter"}
        return [name for name in FILTERS if name not in dropped]

    def but(self, **changes) -> QualityParams:
        return replace(self, **changes)


def article_profile(**changes) -> QualityParams:
    """Preset for article texts."""
    preset = QualityParams(
        doc_length=(10, 100_000),
        duplicate_lines_chr_fraction=0.4,
        duplicate_paragraph_chr_fraction=0.4,
        ignore=(
            "line_bullets_or_ellipsis",
            "top_ngram_chr_fraction",
            "duplicate_ngram_chr_fraction",
            "detect_language",
            "short_long_sentece",
        ),
    )
    return preset.but(**changes)


def summary_profile(**changes) -> QualityParams:
    """Preset for summaries: hashtags, repeated paragraphs, short lines."""
    keep = {"symbol_2_word_hashtag", "duplicate_paragraph_chr_fraction", "short_long_sentece"}
    preset = QualityParams(
        duplicate_paragraph_chr_fraction=0.6,
        ignore=tuple(f for f in FILTERS if f not in keep and f != "string_filter"),
    )
    return preset.but(**changes)


def doc_length(words: Column, lo: int, hi: int) -> Column:
    return words.between(lo, hi)


def mean_word_length(word_chars: Column, words: Column, lo: float, hi: float) -> Column:
    return F.try_divide(word_chars, words).between(lo, hi)


def alpha_ratio(text: Column, words: Column, ratio: float) -> Column:
    return (words >= 1) & (tk.n_alpha_words(text) >= F.floor(words * F.lit(ratio)))


def _prefix_tree(phrases: Sequence[str]) -> str:
    """Phrases as a pattern that reads each shared beginning once; longer ones first."""
    ends, heads = "" in phrases, {}
    for x in phrases:
        if x:
            heads.setdefault(x[0], []).append(x[1:])
    if not heads:
        return ""
    read = lambda c: r"\s+" if c == " " else re.escape(c)
    body = "|".join(read(c) + _prefix_tree(rest) for c, rest in sorted(heads.items()))
    return f"(?:{body})?" if ends else f"(?:{body})"


def phrase_pattern(phrases: Sequence[str]) -> str:
    """A pattern that finds phrases as whole tokens of a text. A contraction is
    several tokens under the text's own pattern and found as such; of phrases
    that start alike the longest is found. White space in a phrase stands for any."""
    word = r"[\p{L}\p{N}]"
    groups: dict[tuple[bool, bool], list[str]] = {}
    for x in sorted({" ".join(x.split()) for x in phrases} - {""}):
        groups.setdefault((x[0].isalnum(), x[-1].isalnum()), []).append(x)
    return "|".join(
        (f"(?<!{word})" if before else "") + _prefix_tree(some) + (f"(?!{word})" if after else "")
        for (before, after), some in sorted(groups.items(), reverse=True)
    )


def stop_word(text: Column, stop_words: Sequence[str], n: int) -> Column:
    pattern = phrase_pattern(stop_words)
    if not pattern:
        return F.lit(n <= 0)
    # Each atomic group ends behind the next phrase, so a text is read up to its n-th.
    return F.lower(text).rlike(rf"\A(?>[\s\S]*?(?:{pattern})){{{max(n, 0)}}}")


def symbol_to_word(text: Column, words: Column, symbol: str, ratio: float) -> Column:
    n_symbols = F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))
    return F.try_divide(n_symbols, words * len(symbol)) < ratio


def bullets_or_ellipsis(
    lines: Column, max_bullets: float, max_ellipsis: float, min_bullets: int, min_ellipsis: int
) -> Column:
    """Lines are stripped of blanks only; empty lines count as lines."""

    def too_many(pattern: str, share: float, least: int) -> Column:
        n = F.size(F.filter(lines, lambda x: x.rlike(pattern)))
        return (F.try_divide(n, F.size(lines)) > share) & (n > least)

    return ~(
        too_many(r"^ *[-*]", max_bullets, min_bullets)
        | too_many(r"(…|\.\.\.) *\z", max_ellipsis, min_ellipsis)
    )


def long_sentences(text: Column, chars: int, ratio: float) -> Column:
    """Share of non-blank lines longer than ``chars``."""
    filled = tk.non_blank_lines(text)
    return rp.let(
        filled,
        lambda xs: F.try_divide(F.size(F.filter(xs, lambda s: F.length(s) > chars)), F.size(xs))
        >= ratio,
    )


def lacks_string(text: Column, needle: str) -> Column:
    """The text is lower-cased, the needle is not."""
    return ~F.contains(F.lower(text), F.lit(needle))


def language_passes(ranked: Column, p: QualityParams) -> Column:
    """``ranked`` is ``array<struct<lang, prob>>``, best first."""
    hit = lambda r: r["lang"].isin(*p.languages) & (r["prob"] >= p.language_threshold)
    if p.language_mode == "top":
        return rp.let(F.get(ranked, F.lit(0)), hit)
    if p.language_mode == "any":
        return F.exists(ranked, hit)
    raise ValueError(f"language_mode is 'top' or 'any', not {p.language_mode!r}")


def predicate(
    name: str, p: QualityParams, text: Column, words: Column, lines: Column, word_chars: Column | None = None
) -> Column:
    """Pass condition of one filter. A condition that comes out NULL fails."""
    n_chars = F.length(text)
    if name == "doc_length":
        return doc_length(words, *p.doc_length)
    if name == "mean_word_length":
        return mean_word_length(tk.word_chars(text) if word_chars is None else word_chars, words, *p.mean_word_length)
    if name == "alpha_ratio":
        return alpha_ratio(text, words, p.alpha_ratio)
    if name == "stop_word":
        return stop_word(text, p.stop_words, p.min_stop_words)
    if name == "symbol_2_word_hashtag":
        return symbol_to_word(text, words, "#", p.symbol_2_word_hashtag)
    if name == "symbol_2_word_ellipsis":
        return symbol_to_word(text, words, "…", p.symbol_2_word_ellipsis)
    if name == "line_bullets_or_ellipsis":
        return bullets_or_ellipsis(
            lines, p.max_p_begin_bullets, p.max_p_end_ellipsis, p.min_bullets, p.min_ellipsis
        )
    if name == "duplicate_lines_chr_fraction":
        return rp.duplicate_chr_fraction(lines, n_chars) < p.duplicate_lines_chr_fraction
    if name == "duplicate_paragraph_chr_fraction":
        paragraphs = tk.paragraph_array(text)
        return rp.duplicate_chr_fraction(paragraphs, n_chars) < p.duplicate_paragraph_chr_fraction
    if name in NGRAM_FILTERS:
        found = rp.suffix_measures(text, *ngram_sizes(p, [name]))
        return ngram_predicate(name, p, found, n_chars)
    if name == "short_long_sentece":
        return long_sentences(text, p.long_sentence_chars, p.long_sentence_ratio)
    if name == "string_filter":
        return lacks_string(text, p.string)
    raise ValueError(f"no expression for {name!r}")


NGRAM_FILTERS = ("top_ngram_chr_fraction", "duplicate_ngram_chr_fraction")


def ngram_sizes(p: QualityParams, names: Sequence[str]) -> tuple[list[int], list[int]]:
    """Sizes that the n-gram filters among ``names`` look at."""
    ranges = zip(NGRAM_FILTERS, (p.top_ngram_range, p.duplicate_ngram_range))
    limits = (p.top_ngram_thresholds, p.duplicate_ngram_thresholds)
    top, duplicate = (
        list(range(lo, hi + 1))[: len(limit)] if name in names else []
        for (name, (lo, hi)), limit in zip(ranges, limits)
    )
    return top, duplicate


def ngram_predicate(name: str, p: QualityParams, found: Column, n_chars: Column) -> Column:
    """Pass condition of an n-gram filter, from what one suffix array tells
    about all sizes."""
    if name == NGRAM_FILTERS[0]:
        return ~rp.top_fails(found, n_chars, p.top_ngram_thresholds, p.top_ngram_min_count)
    return ~rp.duplicate_fails(found, n_chars, p.duplicate_ngram_thresholds)


def duplicate_line_filter(text: Column, fraction: float) -> Column:
    """Available on its own; not part of the chain."""
    return rp.duplicate_fraction(tk.line_array(text)) < fraction


def duplicate_paragraph_filter(text: Column, fraction: float) -> Column:
    """Available on its own; not part of the chain."""
    return rp.duplicate_fraction(tk.paragraph_array(text)) < fraction
