"""N-gram and subsequence overlap between a candidate and a reference."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions import tokens as tk
from gistmill.functions.rows import let

# Fixed value: the metric's own token pattern, applied to lower-cased text.
ROUGE_TOKEN = r"[a-z0-9]+"
ROUGE_GAP = r"[^a-z0-9\n]"


def rouge_tokens(text: Column) -> Column:
    return tk.tokens(F.lower(text), ROUGE_TOKEN)


def prf(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """Precision, recall and F-measure; 0 where nothing can match."""

    def scores(h: Column) -> Column:
        p = F.coalesce(F.try_divide(h, n_pred), F.lit(0.0))
        r = F.coalesce(F.try_divide(h, n_ref), F.lit(0.0))
        f = F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0))
        return F.struct(p.alias("precision"), r.alias("recall"), f.alias("fmeasure"))

    return let(hits, scores)


def _spaced(text: Column) -> Column:
    """A text's tokens, lower-cased and parted by blanks; line breaks are kept."""
    return F.regexp_replace(F.lower(text), f"{ROUGE_GAP}+", " ")


def _measured(hits: Callable[[str, str], tuple[int, int, int]], pred: Column, ref: Column) -> Column:
    """``prf`` of two texts from a function of their tokens: hits and both sizes."""

    @F.arrow_udf("struct<hits:int,n_pred:int,n_ref:int>")
    def counted(preds: pa.Array, refs: pa.Array) -> pa.Array:
        pairs = zip(preds.to_pylist(), refs.to_pylist())
        found = [(None,) * 3 if p is None or r is None else hits(p, r) for p, r in pairs]
        columns = [pa.array([x[k] for x in found], pa.int32()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, names=["hits", "n_pred", "n_ref"])

    return let(
        counted(_spaced(pred), _spaced(ref)), lambda x: prf(x["hits"], x["n_pred"], x["n_ref"])
    )


def _grams(tokens: list[str], n: int) -> list:
    return tokens if n == 1 else list(zip(*(tokens[k:] for k in range(n))))


def rouge_n(pred: Column, ref: Column, n: int) -> Column:
    """Clipped n-gram overlap of two texts."""

    def hits(p: str, r: str) -> tuple[int, int, int]:
        ps, rs = _grams(p.split(), n), _grams(r.split(), n)
        return (Counter(ps) & Counter(rs)).total(), len(ps), len(rs)

    return _measured(hits, pred, ref)


class _Places:
    """Where each token of a reference stands, as bits of whole numbers. Those of
    frequent tokens are kept, as many as fit ``MASK_BYTES``; others are made when
    asked for, so that many different tokens don't cost the square of a text."""

    MASK_BYTES = 1 << 25

    def __init__(self, ref: list[str]):
        self.size = len(ref)
        self.at: dict[str, list[int]] = {}
        for i, t in enumerate(ref):
            self.at.setdefault(t, []).append(i)
        often = sorted(self.at, key=lambda t: -len(self.at[t]))
        self.kept = {t: self._bits(t) for t in often[: max(16, self.MASK_BYTES // (self.size // 8 + 32))]}
        self.full = (1 << self.size) - 1

    def _bits(self, token: str) -> int:
        bits = bytearray(self.size // 8 + 1)
        for i in self.at.get(token, ()):
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    def step(self, v: int, token: str) -> int:
        """From the vector of a candidate's prefix to that of one token more. A
        cleared bit i says the longest common subsequence grows by one at ref[i]."""
        m = self.kept.get(token)
        if m is None:
            if token not in self.at:
                return v
            m = self._bits(token)
        u = v & m
        return ((v + u) | (v - u)) & self.full if u else v


def _lcs_length(ref: list[str], pred: list[str]) -> int:
    """The last prefix's vector alone says how long the subsequence is."""
    places = _Places(ref)
    v = places.full
    for t in pred:
        v = places.step(v, t)
    return len(ref) - v.bit_count()


def _lcs_places(ref: list[str], pred: list[str], places: _Places | None = None) -> set[int]:
    """Positions in ``ref`` of one longest common subsequence, read back from
    the end; without a match the reference is shortened first.

    The way back needs all prefixes' vectors. Only one in about ``sqrt(len(pred))``
    is kept; those between two of them are made again when the way reaches them.
    """
    places = places or _Places(ref)
    every = math.isqrt(len(pred)) + 1
    kept = [places.full]
    v = places.full
    for j, t in enumerate(pred, 1):
        v = places.step(v, t)
        if j % every == 0:
            kept.append(v)
    i, j, found = len(ref), len(pred), set()
    while i and j:
        block = (j - 1) // every  # holds the vectors of prefixes block * every to j
        rows = [kept[block]]
        for t in pred[block * every : j]:
            rows.append(places.step(rows[-1], t))
        while i and j > block * every:
            if ref[i - 1] == pred[j - 1]:
                i, j = i - 1, j - 1
                found.add(i)
            elif rows[j - block * every] >> (i - 1) & 1:
                i -= 1
            else:
                j -= 1
    return found


def _union_hits(ref: list[list[str]], pred: list[list[str]]) -> int:
    """Reference tokens on a longest common subsequence with any candidate
    sentence, no token counted more often than either side holds it."""
    left = Counter(t for s in ref for t in s) & Counter(t for s in pred for t in s)
    hits = 0
    for sentence in ref if left else ():
        if sentence in pred:
            found = set(range(len(sentence)))
        else:
            places = _Places(sentence)
            near = [p for p in pred if not places.at.keys().isdisjoint(p)]
            found = set().union(*(_lcs_places(sentence, p, places) for p in near))
        for i in sorted(found):
            if left[sentence[i]] > 0:
                left[sentence[i]] -= 1
                hits += 1
    return hits


def rouge_l(pred: Column, ref: Column) -> Column:
    """Longest common subsequence of the two token lists."""

    def hits(p: str, r: str) -> tuple[int, int, int]:
        ps, rs = p.split(), r.split()
        return _lcs_length(rs, ps), len(ps), len(rs)

    return _measured(hits, pred, ref)


def rouge_lsum(pred: Column, ref: Column) -> Column:
    """Summary-level variant over newline-separated sentences."""

    def hits(p: str, r: str) -> tuple[int, int, int]:
        ps, rs = ([s.split() for s in text.split("\n") if s.strip()] for text in (p, r))
        return _union_hits(rs, ps), sum(map(len, ps)), sum(map(len, rs))

    return _measured(hits, pred, ref)
