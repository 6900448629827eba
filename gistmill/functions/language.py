"""Language scores from character trigrams, a batch of rows at a time.

Beside the languages of a profile stands a class for none of them: a text whose
trigrams are, on the whole, less likely in every language than under a flat
background. What the trigrams say is scaled to that of ``EVIDENCE`` trigrams,
whatever the length, so long texts are not certain by length alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions.rows import let

SCALE = 1_000_000  # log-probabilities are kept as integers of this many parts
FLOOR = 1e-6  # probability of a trigram outside a language's profile
BACKGROUND = 3e-5  # probability of a trigram in a text of no known language
EVIDENCE = 10  # trigrams whose mean evidence a text is judged by
UNKNOWN = "und"
SLICE_CHARS = 1 << 20
TRIGRAM = r"(?=(...))"


def letters_only(text: Column) -> Column:
    """Lower-cased letters, any other run turned into one blank, blank-padded."""
    return F.concat(
        F.lit(" "),
        F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")),
        F.lit(" "),
    )


def trigrams(text: Column) -> Column:
    return F.regexp_extract_all(letters_only(text), F.lit(TRIGRAM), F.lit(1))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Rows of about ``SLICE_CHARS`` bytes, one at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_CHARS, "right")))
        yield slice(a, b)
        a = b


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each trigram's number and row."""
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = _codes(_points("".join(texts.to_pylist())))
    ends = np.cumsum(chars)
    row = np.repeat(np.arange(len(chars)), chars)[: len(codes)]
    inside = np.arange(len(codes)) + 3 <= ends[row]
    return codes[inside], row[inside]


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``(lang, letters)`` batches to ``(lang, gram, cnt)``, a row per language
    and trigram of a slice, so that no row per trigram is made."""
    for batch in batches:
        letters = batch.column("letters").fill_null("")
        coded = batch.column("lang").dictionary_encode()
        names, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for part in _slices(letters):
            codes, row = _coded(letters.slice(part.start, part.stop - part.start))
            lang = of[part][row]
            order = np.lexsort((codes, lang))
            codes, lang = codes[order], lang[order]
            new = np.append(True, (codes[1:] != codes[:-1]) | (lang[1:] != lang[:-1]))[: len(codes)]
            at = np.flatnonzero(new)
            points = codes[at][:, None] >> np.array([42, 21, 0]) & ((1 << 21) - 1)
            text = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            grams = [text[i : i + 3] for i in range(0, len(text), 3)]
            counts = np.diff(np.append(at, len(codes)))
            columns = [names.take(pa.array(lang[at])), pa.array(grams, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "cnt"])


def background_weight() -> int:
    return round(math.log(BACKGROUND) * SCALE) - round(math.log(FLOOR) * SCALE)


def _codes(points: np.ndarray) -> np.ndarray:
    """A number for each three characters in a row."""
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


@dataclass(frozen=True)
class LanguageProfile:
    """Trigram weights per language: a small table by construction."""

    langs: tuple[str, ...]
    grams: tuple[str, ...]
    weights: tuple[tuple[int, ...], ...]  # one row per gram, one value per language

    def raw_scores(self, text: Column) -> Column:
        """Summed integer weights, in the order of ``langs``, and last that of the
        background; NULL stays NULL."""
        keys = np.array([_codes(_points(g))[0] for g in self.grams], dtype=np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        weights = np.array(self.weights, dtype=np.int64).reshape(len(keys), len(self.langs))[order]
        flat = background_weight()

        def scored(texts: pa.Array) -> np.ndarray:
            codes, row = _coded(texts)
            out = np.zeros((len(texts), len(self.langs) + 1), np.int64)
            out[:, -1] = np.bincount(row, minlength=len(texts)) * flat
            if len(keys) and len(codes):
                at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                known = keys[at] == codes
                at, row = at[known], row[known]
                for k in range(len(self.langs)):
                    # sums of whole numbers, exact as doubles
                    out[:, k] = np.bincount(row, weights[at, k], len(texts))
            return out

        @F.arrow_udf("array<bigint>")
        def summed(texts: pa.Array) -> pa.Array:
            filled = texts.fill_null("")
            parts = [scored(filled.slice(p.start, p.stop - p.start)) for p in _slices(filled)]
            flat_rows = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(texts) + 1) * (len(self.langs) + 1), pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(flat_rows), mask=texts.is_null())

        # Marked so that Catalyst scores each row once, where it is asked to,
        # instead of moving the call into filters.
        return summed.asNondeterministic()(letters_only(text))

    def ranked(self, raw: Column) -> Column:
        """``array<struct<lang, prob>>`` from raw scores, best first; ``UNKNOWN``
        is none of the languages."""
        names = F.array(*[F.lit(name) for name in (*self.langs, UNKNOWN)])
        enough = F.lit(float(EVIDENCE * background_weight()))

        def softmax(scores: Column, top: Column) -> Column:
            share = F.least(F.lit(1.0), F.coalesce(F.try_divide(enough, F.element_at(scores, -1)), F.lit(1.0)))
            rel = F.transform(scores, lambda s: F.exp((s - top) * share / F.lit(float(SCALE))))
            return let(
                rel,
                lambda es: let(
                    F.aggregate(es, F.lit(0.0), lambda a, e: a + e),
                    lambda z: F.transform(
                        F.sort_array(
                            F.transform(
                                es, lambda e, i: F.struct((-e / z).alias("neg"), F.get(names, i).alias("lang"))
                            )
                        ),
                        lambda r: F.struct(r["lang"].alias("lang"), (-r["neg"]).alias("prob")),
                    ),
                ),
            )

        return let(raw, lambda scores: softmax(scores, F.array_max(scores)))
