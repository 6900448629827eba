"""Repeated n-grams of documents by a suffix array with common-prefix lengths.

A slice of an Arrow batch holds the tokens of many documents one after another
as whole numbers. One sort of all their suffixes answers every n-gram size: two
n-grams are equal where the common prefix of their suffixes is that long, so the
copies of an n-gram are a run of the array. Ranks of doubled lengths give both
the order and the prefix lengths; there is no step per document or n-gram.

An n-gram is its first token without the white space before it, then the others
with theirs. So a suffix starts with the number of its document and bare token,
and goes on with numbers of spaced tokens. Each document's last token, on which
no n-gram may end, is a number of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions import tokens as tk

SPACES = " \t\n\x0b\f\r"
SLICE_BYTES = 1 << 20
#: text of which n-grams are spelled out at a time: they are some ten times as long
SPELLED_BYTES = 1 << 18
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))


class Tokens(NamedTuple):
    """Of the tokens of some documents, one after another."""

    spaced: np.ndarray  # number of the token with the white space before it
    bare: np.ndarray  # number of the token without it
    gap: np.ndarray  # characters of that white space
    low_chars: np.ndarray  # of the lower-cased token
    chars: np.ndarray  # of the token as written
    rows: np.ndarray  # where each document starts, and the end
    data: np.ndarray  # bytes of the lower-cased tokens with their white space
    at: np.ndarray  # where each token starts in these, and the end


def marked(text: Column) -> Column:
    """Struct of a text's tokens as one string, which is dealt with faster than
    an array: lower-cased, with the white space before each and a line break
    after each; and, where lower-casing made it longer, the same as written."""
    ended = F.regexp_replace(text, tk.GAPPED_TOKEN, "$0\n")
    low = F.lower(ended)
    return F.struct(low.alias("low"), F.when(F.length(low) != F.length(ended), ended).alias("written"))


def _slices(texts: pa.Array, most: int) -> Iterator[slice]:
    """Rows of about ``most`` bytes, one at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _unmarked(low: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens, where each token and where each row starts, and the
    ends. A line break ends a token if it stands behind no white space: a token
    has white space in front only."""
    low = low.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    held = low.buffers()[2]
    data = np.frombuffer(held if held is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = _IS_SPACE[data]
    end = np.flatnonzero((data[1:] == ord("\n")) & ~space[:-1]) + 1
    rows = np.searchsorted(end, offsets)
    # what follows a row's last token, or its start, belongs to none
    rest = offsets[:-1].copy()
    filled = rows[1:] > rows[:-1]
    rest[filled] = end[rows[1:][filled] - 1] + 1
    loose = np.zeros(len(data) + 1, np.int64)
    np.add.at(loose, rest, 1)
    np.add.at(loose, offsets[1:], -1)
    keep = np.cumsum(loose[:-1]) == 0
    keep[end] = False
    before = np.cumsum(keep)
    return data[keep], np.append(0, before[end - 1]), rows


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))


def _token_chars(texts: pa.Array) -> np.ndarray:
    data, at, _ = _unmarked(texts)
    return pc.utf8_length(_strings(data, at)).to_numpy(zero_copy_only=False).astype(np.int64)


def numbered(low: pa.Array, written: pa.Array) -> Tokens:
    data, at, rows = _unmarked(low)
    coded = _strings(data, at).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    bare = pc.utf8_ltrim(words, characters=SPACES)
    bare_code = bare.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    low_chars = pc.utf8_length(bare).to_numpy(zero_copy_only=False).astype(np.int64)
    gap = (chars - low_chars)[code]
    own = low_chars[code]
    for i in np.flatnonzero(written.is_valid().to_numpy(zero_copy_only=False)):
        a, b = rows[i], rows[i + 1]
        own[a:b] = _token_chars(written.slice(i, 1)) - gap[a:b]
    return Tokens(code, bare_code[code], gap, low_chars[code], own, rows, data, at)


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs; equal pairs have one rank."""
    key = first * (int(second.max(initial=0)) + 1) + second
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """What stands ``by`` places on; 0, which is no rank of theirs, beyond the end."""
    out = np.zeros(len(x), np.int64)
    if by < len(x):
        out[: len(x) - by] = x[by:] + 1
    return out


class Suffixes:
    """Suffixes of the tokens in order, and how much neighbours have in common,
    as far as n-grams of up to ``most`` tokens tell."""

    def __init__(self, t: Tokens, most: int):
        self.tokens = t
        n = len(t.spaced)
        sizes = np.diff(t.rows)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        last = t.rows[1:][sizes > 0] - 1
        rest = t.spaced.copy()
        rest[last] = int(t.spaced.max(initial=0)) + 1 + np.arange(len(last))
        start = _ranks(self.row, t.bare)
        start[last] = int(start.max(initial=0)) + 1 + np.arange(len(last))
        levels, width = [(1, rest)], 1
        while width < most - 1:
            levels.append((2 * width, _ranks(levels[-1][1], _ahead(levels[-1][1], width))))
            width *= 2
        follows = _ahead(levels[-1][1], 1)
        self.order = np.argsort(start * (int(follows.max(initial=0)) + 1) + follows, kind="stable")
        a, b = self.order[:-1], self.order[1:]
        common = np.zeros(max(n - 1, 0), np.int64)
        same = start[a] == start[b]
        common[same] = 1
        # binary digits of the common length of what follows the first token
        open_ = same.copy()
        for width, rank in reversed(levels):
            i, j = a + common, b + common
            fits = open_ & (np.maximum(i, j) < n)
            at = np.flatnonzero(fits)
            equal = at[rank[i[at]] == rank[j[at]]]
            common[equal] += width
        self.common = np.concatenate([[0], common]) if n else common

    def runs(self, n: int) -> np.ndarray:
        """Where in the order the runs of equal n-grams start."""
        return np.flatnonzero(self.common < n)

    def starts(self, n: int) -> np.ndarray:
        """Which tokens start an n-gram that counts: none on the last token."""
        ends = self.tokens.rows[1:][self.row]
        return np.arange(len(self.row)) + n < ends


def _by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return run[rows[1:]] - run[rows[:-1]]


def duplicate_chars(s: Suffixes, n: int) -> np.ndarray:
    """Characters of each document under second and later copies of n-grams."""
    t = s.tokens
    m = len(s.order)
    if not m:
        return np.zeros(len(t.rows) - 1, np.int64)
    runs = s.runs(n)
    first = np.minimum.reduceat(s.order, runs)
    again = s.order[s.order != np.repeat(first, np.diff(np.append(runs, m)))]
    again = again[s.starts(n)[again]]
    steps = np.zeros(m + n + 1, np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + n, -1)
    under = np.cumsum(steps)[:m] > 0
    np.add.at(steps, again, -1)
    np.add.at(steps, again + 1, 1)
    joined = np.cumsum(steps)[:m] > 0
    return _by_row(t.chars * under + t.gap * joined, t.rows)


def top_ngrams(s: Suffixes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document's most frequent n-gram, the first among equals: copies,
    the token it starts at, and characters. No n-gram: 0, -1, 0."""
    t = s.tokens
    docs, m = len(t.rows) - 1, len(s.order)
    count, at, chars = np.zeros(docs, np.int64), np.full(docs, -1), np.zeros(docs, np.int64)
    if not m:
        return count, at, chars
    runs = s.runs(n)
    first = np.minimum.reduceat(s.order, runs)
    copies = np.diff(np.append(runs, m))
    good = s.starts(n)[first]
    first, copies = first[good], copies[good]
    best = np.lexsort((first, -copies, s.row[first]))
    best = best[np.append(True, np.diff(s.row[first[best]]) != 0)] if len(best) else best
    doc = s.row[first[best]]
    spelled = np.concatenate([[0], np.cumsum(t.low_chars + t.gap)])
    count[doc], at[doc] = copies[best], first[best] - t.rows[doc]
    chars[doc] = spelled[first[best] + n] - spelled[first[best]] - t.gap[first[best]]
    return count, at, chars


def spelled(s: Suffixes, n: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Distinct n-grams of each document: its row, in order, the n-gram and its copies."""
    t, runs = s.tokens, s.runs(n)
    first = np.minimum.reduceat(s.order, runs) if len(runs) else runs
    copies = np.diff(np.append(runs, len(s.order)))
    good = s.starts(n)[first]
    first, copies = first[good], copies[good]
    start = t.at[first] + t.gap[first]
    size = t.at[first + n] - start
    ends = np.append(0, np.cumsum(size))
    chars = t.data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    grams = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(chars))
    return s.row[first], grams, copies


def tables(sizes: Sequence[int]):
    """From ``(key, tokens)`` batches, tokens as ``marked``, to ``(key, n, grams)``
    ones: a row per text and size that has n-grams, ``grams`` their texts and
    counts. A few documents at a time, since n-grams are longer than their text."""
    sizes = list(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tokens = batch.columns
            low, written = tokens.field("low"), tokens.field("written")
            for part in _slices(low, SPELLED_BYTES):
                width = part.stop - part.start
                s = Suffixes(numbered(low.slice(part.start, width), written.slice(part.start, width)), max(sizes))
                for n in sizes:
                    row, grams, copies = spelled(s, n)
                    some, at = np.unique(row, return_index=True)
                    ends = pa.array(np.append(at, len(row)), pa.int32())
                    pairs = pa.StructArray.from_arrays([grams, pa.array(copies, pa.int64())], names=["ngram", "cnt"])
                    columns = [
                        keys.slice(part.start, width).take(pa.array(some, pa.int64())),
                        pa.array(np.full(len(some), n), pa.int32()),
                        pa.ListArray.from_arrays(ends, pairs),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "grams"])

    return run


_KIND = "counts array<bigint>, firsts array<bigint>, chars array<bigint>, duplicates array<bigint>"


def measures(text: Column, top: Sequence[int], duplicate: Sequence[int]) -> Column:
    """Struct of arrays: ``counts, firsts, chars`` of the top n-gram of each size
    in ``top``, and ``duplicates``, characters under repeats, of each in
    ``duplicate``. NULL for a NULL text."""
    top, duplicate = list(top), list(duplicate)
    most = max([*top, *duplicate])

    @F.arrow_udf(_KIND)
    def measured(tokens: pa.Array) -> pa.Array:
        columns = [[] for _ in range(4)]
        low, written = tokens.field("low"), tokens.field("written")
        for part in _slices(low, SLICE_BYTES):
            a, b = part.start, part.stop
            s = Suffixes(numbered(low.slice(a, b - a), written.slice(a, b - a)), most)
            found = [top_ngrams(s, n) for n in top]
            for k in range(3):
                columns[k].append(np.array([f[k] for f in found], np.int64).reshape(len(top), b - a).T)
            covered = [duplicate_chars(s, n) for n in duplicate]
            columns[3].append(np.array(covered, np.int64).reshape(len(duplicate), b - a).T)
        arrays = []
        for parts, width in zip(columns, [len(top)] * 3 + [len(duplicate)], strict=True):
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(tokens) + 1) * width, pa.int32())
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())))
        names = [f.split()[0] for f in _KIND.split(", ")]
        return pa.StructArray.from_arrays(arrays, names=names, mask=low.is_null())

    # Else a filter on what is found would have it done a second time.
    return measured.asNondeterministic()(marked(text))
