"""Language-model scores from a log-frequency Bloom filter.

*Counting.* A task hashes its words in numpy, counts the n-grams it has seen
and sends each segment of the hash range its share, as sorted keys and counts.
A segment's task adds these up. Single words keep exact counts. Counts of longer
n-grams are quantised to levels that grow by ``base``; an n-gram of level ``q``
puts the events ``(n-gram, 1) .. (n-gram, q)`` into the segment's Bloom filter,
whose bits are in proportion to its events. So the model grows with the corpus
and its error does not.

*Scoring.* An n-gram's level is found by probing for its events in turn until
one is missing; the level's least count stands for the count, so what is
over-estimated is only what the filter takes for a member. With a Dirichlet prior
the probabilities are ``(c(h w) + mu * p(w | shorter h)) / (c(h) + mu)``; at the
end of the recursion are words with half a count more than seen.

*Reaching the workers.* Up to ``Settings.broadcast`` bytes, the segments are
broadcast. A larger model stays where it is: documents are written in chunks,
each chunk's distinct n-grams go to groups of segments, and the answers come back
to the chunk. Both ways give the same scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gistmill.llm.words import _utf8, mix, white_space_words, word_hashes
from gistmill.session import collect_garbage, small_batches, used_up, written

#: hash of the token that ends each text
END = np.uint64(0x5851F42D4C957F2D)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EVENT = np.uint64(0xD6E8FEB86659FD93)
#: text bytes whose n-grams a task counts before it sends them, and of a counted
#: slice; scored ones are smaller, for the worker holds the model beside them
HELD_BYTES, SLICE_BYTES, SCORED_BYTES, CHUNK_BYTES = 1 << 23, 1 << 20, 1 << 18, 1 << 22
#: text bytes a segment: small ones as long as there are few, for even work
SMALL, LARGE, MANY = 1 << 22, 1 << 26, 1 << 12
#: bytes of a model whose segments answer together, of an Arrow batch on the way
#: to them and back, and keys looked up at once
GROUP_BYTES, PASSED_BYTES, ASKED = 1 << 21, 1 << 21, 1 << 18
_BLOOM, _MODEL = 0, -1  # n of a filter's row, chunk of a model's row
_TEXTS = 0  # n of a row that holds a chunk's texts


@dataclass(frozen=True)
class Settings:
    """``order``: longest n-gram. ``base``: growth of levels. ``bits`` an event
    and ``hashes``: of the filter. ``mu``: weight of the prior, from held-out rows
    of a small table, where 128 to 512 did about alike. ``broadcast``:
    most bytes of a model that every worker gets a copy of."""

    order: int = 2
    base: float = 1.25
    bits: int = 10
    hashes: int = 7
    mu: float = 256.0
    broadcast: int = 3 << 26


def is_held_out(id_: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 1, F.lit(False))


# --- tokens and n-grams of a batch ----------------------------------------------


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and each row's first; a row's last token is its end."""
    words, rows = word_hashes(texts, white_space_words())
    first = rows + np.arange(len(rows))
    tokens = np.empty(first[-1], np.uint64)
    last = np.zeros(len(tokens), bool)
    last[first[1:] - 1] = True
    tokens[last], tokens[~last] = END, words
    return tokens, first[:-1]


def ngram_keys(tokens: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams within rows, and the place of each one's last token."""
    if n == 1:
        return tokens, np.arange(len(tokens))
    size = np.diff(np.append(first, len(tokens)))
    within = np.arange(len(tokens)) - np.repeat(first, size)
    at = np.flatnonzero(within >= n - 1)
    key = np.full(len(at), n, np.uint64)
    for j in range(n - 1, -1, -1):
        key = mix(key * _BASE + tokens[at - j])
    return key, at


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _planes(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all first bytes, then all second ones: small
    numbers leave runs of zeros, which shuffles compress."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, np.uint64), dtype=np.uint64)


def _shares(keys: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment's share of sorted keys begins, and the last one's end."""
    if segments == 1:
        return np.array([0, len(keys)])
    edges = np.arange(1, segments, dtype=np.uint64) * np.uint64((1 << 64) // segments)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    if segments == 1:
        return np.zeros(len(keys), np.int64)
    return np.minimum(keys // np.uint64((1 << 64) // segments), np.uint64(segments - 1)).astype(np.int64)


def _slices(texts: pa.Array, most: int) -> Iterator[slice]:
    _, offsets = _utf8(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield slice(a, b)
        a = b


# --- the filter --------------------------------------------------------------------


def level_starts(base: float) -> np.ndarray:
    """Least count of each level; whole numbers, so low counts are exact."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, int(out[-1] * base)))
    return np.array(out)


class Bloom:
    """Levels of n-grams, as bit arrays one after another, one a segment."""

    def __init__(self, bits: np.ndarray, begin: np.ndarray, size: np.ndarray, hashes: int):
        self.bits, self.begin, self.size, self.hashes = bits, begin, size, hashes

    @staticmethod
    def events(keys: np.ndarray, j: int) -> np.ndarray:
        return mix(keys + np.uint64(j * int(_EVENT) & 0xFFFFFFFFFFFFFFFF))

    @staticmethod
    def places(events: np.ndarray, i: int, size) -> np.ndarray:
        """Bit of each event's ``i``-th hash."""
        h = (events + np.uint64(i) * ((events >> np.uint64(32)) | np.uint64(1))) & np.uint64(0xFFFFFFFF)
        return ((h * np.asarray(size, np.uint64)) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, levels: np.ndarray, s: Settings) -> Bloom:
        size = int(min(max(64, levels.sum() * s.bits), (1 << 32) - 1))
        flags = np.zeros(-(-size // 8) * 8, bool)
        j = 0
        while len(keys):
            j += 1
            events = cls.events(keys, j)
            for i in range(s.hashes):
                flags[cls.places(events, i, size)] = True
            more = levels > j
            keys, levels = keys[more], levels[more]
        return cls(np.packbits(flags, bitorder="little"), np.zeros(1, np.int64), np.array([size]), s.hashes)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by probing event after event until one is missing."""
        out = np.zeros(len(keys), np.uint8)
        seg = _segment_of(keys, len(self.size))
        begin, size, at, j = self.begin[seg], self.size[seg], np.arange(len(keys)), 0
        while len(at) and j < 255:
            j += 1
            events, left = self.events(keys, j), np.arange(len(keys))
            for i in range(self.hashes):
                p = self.places(events[left], i, size[left])
                left = left[(self.bits[begin[left] + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1]
            keys, begin, size, at = keys[left], begin[left], size[left], at[left]
            out[at] = j
        return out


# --- learning ------------------------------------------------------------------------

_ROWS = "segment int, chunk long, n int, keys binary, extra binary"
_NAMES = ["segment", "chunk", "n", "keys", "extra"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _count(segments: int, order: int):
    """Sorted keys and counts of what a task has read, for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {n: [] for n in range(1, order + 1)}, 0

        def sent():
            for n, parts in held.items():
                if not parts:
                    continue
                keys, counts = _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                at = _shares(keys, segments)
                for lo in range(0, segments, 256):
                    rows = []
                    for s in range(lo, min(lo + 256, segments)):
                        a, b = at[s], at[s + 1]
                        if b > a:
                            rows.append((s, 0, n, _packed(keys[a:b]), _planes(counts[a:b].astype(np.int64))))
                    yield _rows(rows)
                parts.clear()

        for batch in batches:
            texts = batch.column("text").fill_null("")
            for part in _slices(texts, SLICE_BYTES):
                tokens, first = token_stream(texts.slice(part.start, part.stop - part.start))
                for n, parts in held.items():
                    parts.append(_counted(ngram_keys(tokens, first, n)[0]))
                size += 8 * len(tokens)
                if size >= HELD_BYTES:
                    yield from sent()
                    size = 0
        yield from sent()

    return run


def _walked(batches: Iterator[pa.RecordBatch], key: Callable, open_: Callable, each: Callable, close: Callable):
    """Walk rows that are sorted by ``key(segment, chunk)``."""
    now, state = None, None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in _NAMES]
        for row in zip(*columns, strict=True):
            if (own := key(*row[:2])) != now:
                if now is not None:
                    yield from close(now, state)
                now, state = own, open_()
            yield from each(state, *row)
    if now is not None:
        yield from close(now, state)


def _build(s: Settings):
    """Each segment's exact word counts and filter, as model rows."""
    starts = level_starts(s.base)

    def each(held, _segment, _chunk, n, keys, extra):
        held.setdefault(n, []).append((_unpacked(keys), _from_planes(extra, np.int64)))
        return ()

    def close(segment, held):
        total = {n: _counted(*map(np.concatenate, zip(*parts, strict=True))) for n, parts in held.items()}
        if 1 in total:
            keys, counts = total.pop(1)
            yield _rows([(segment, _MODEL, 1, keys.tobytes(), counts.tobytes())])
        if total:
            keys = np.concatenate([k for k, _ in total.values()])
            levels = np.concatenate([np.searchsorted(starts, c, "right") for _, c in total.values()])
            bloom = Bloom.build(keys, levels, s)
            yield _rows([(segment, _MODEL, _BLOOM, bloom.bits.tobytes(), bloom.size.tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walked(batches, lambda segment, _: segment, dict, each, close)

    return run


@dataclass(frozen=True)
class Model:
    """A stored model. ``tokens`` and ``types``: of what was learned from."""

    rows: DataFrame
    segments: int
    tokens: int
    types: int
    bytes: int
    settings: Settings


def learn(docs: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> Model:
    """Count all texts of ``docs``. Null texts count as empty ones: an end, no word."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    segments = max(1, size // LARGE, min(size // SMALL, MANY))
    sent = texts.mapInArrow(_count(segments, settings.order), _ROWS)
    dealt = sent.repartition("segment").sortWithinPartitions("segment")
    # a worker keeps what it took here when it comes to hold the model
    with small_batches(docs.sparkSession):
        rows = written(dealt.mapInArrow(_build(settings), _ROWS), "language-model")
    whole = rows.where("n = 1").mapInArrow(_totals, "tokens long, types long").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))
    )
    tokens, types = whole.first()
    held = rows.agg(F.coalesce(F.sum(F.octet_length("keys") + F.octet_length("extra")), F.lit(0))).first()[0]
    return Model(rows, segments, int(tokens), int(types), int(held), settings)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.frombuffer(raw.as_buffer(), np.int64) for raw in batch.column("extra")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([len(c) for c in counts], pa.int64())],
            names=["tokens", "types"],
        )


# --- scoring -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Lookup:
    """Exact counts of words and levels of n-grams, in one process."""

    words: np.ndarray
    counts: np.ndarray
    bloom: Bloom | None

    def __call__(self, n: int, keys: np.ndarray) -> np.ndarray:
        if n > 1:
            return self.bloom.levels(keys) if self.bloom is not None else np.zeros(len(keys), np.uint8)
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, self.counts[at], 0).astype(np.int64)


def _lookup(sizes: list[tuple[int, int, int]], rows: Iterable[tuple], segments: int, hashes: int) -> Lookup:
    """From a model's ``(segment, n, keys, extra)`` rows in any order, each held
    only until it is copied; ``sizes`` are their ``(segment, n, bytes of keys)``."""
    begin, size, at = np.zeros(segments, np.int64), np.full(segments, 64, np.int64), {}
    end, many = 8, 0  # segments without n-grams share an empty filter
    for segment, n, length in sorted(sizes):
        at[segment, n] = end if n == _BLOOM else many
        end, many = (end + length, many) if n == _BLOOM else (end, many + length // 8)
    bits, words, counts = np.zeros(end, np.uint8), np.zeros(many, np.uint64), np.zeros(many, np.int64)
    for segment, n, keys, extra in rows:
        a = at[segment, n]
        if n == _BLOOM:
            begin[segment], size[segment] = a, np.frombuffer(extra, np.int64)[0]
            bits[a : a + len(keys)] = np.frombuffer(keys, np.uint8)
        else:
            words[a : a + len(keys) // 8] = np.frombuffer(keys, np.uint64)
            counts[a : a + len(keys) // 8] = np.frombuffer(extra, np.int64)
    if not len(counts) or counts.max() < 1 << 31:
        counts = counts.astype(np.int32)
    return Lookup(words, counts, Bloom(bits, begin, size, hashes))


def _scores(texts: pa.Array, look: Callable[[int, np.ndarray], np.ndarray], tokens: int, types: int, s: Settings):
    """``(tokens, known tokens, base score, score)`` of each row."""
    stream, first = token_stream(texts)
    if not len(first):
        none = np.zeros(0)
        return none.astype(np.int64), none.astype(np.int64), none, none
    distinct, at = np.unique(stream, return_inverse=True)
    seen = look(1, distinct)[at]
    p = (seen + 0.5) / (tokens + 0.5 * (types + 1))
    base = np.add.reduceat(np.log10(p), first)
    starts, count = np.append(0, level_starts(s.base)), seen
    for n in range(2, s.order + 1):
        keys, last = ngram_keys(stream, first, n)
        history = count[last - 1]
        # an n-gram whose shorter forms were never seen was not seen either
        may = (history > 0) & (count[last] > 0)
        # sorted and once each: probes of one segment follow each other
        distinct, at = np.unique(keys[may], return_inverse=True)
        found = np.zeros(len(keys), np.int64)
        found[may] = starts[look(n, distinct)[at]]
        found = np.minimum(found, np.minimum(history, count[last]))
        known = history > 0
        p[last[known]] = (found[known] + s.mu * p[last[known]]) / (history[known] + s.mu)
        count = np.zeros(len(stream), np.int64)
        count[last] = found
    sizes = np.diff(np.append(first, len(stream)))
    return sizes, np.add.reduceat((seen > 0).astype(np.int64), first), base, np.add.reduceat(np.log10(p), first)


def _scored_slices(texts: pa.Array, look: Callable, tokens: int, types: int, s: Settings) -> list[tuple]:
    return [
        _scores(texts.slice(p.start, p.stop - p.start), look, tokens, types, s) for p in _slices(texts, SCORED_BYTES)
    ]


_SCORE = "n_tokens long, n_known long, base_score double, score double"


def _score_udf(model: Model, shared):
    """Scores of texts, every worker holding the whole model."""
    names = [f.split()[0] for f in _SCORE.split(", ")]

    @F.arrow_udf(StructType.fromDDL(_SCORE))
    def score(texts: pa.Array) -> pa.Array:
        done = _scored_slices(texts, shared.value, model_tokens, model_types, settings)
        columns = [np.concatenate(c) for c in zip(*done, strict=True)] if done else [np.zeros(0)] * 4
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    model_tokens, model_types, settings = model.tokens, model.types, model.settings
    return score


# --- models that are too large for every worker ----------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task, some megabytes of text to a row, packed. The number is
    unique as the table is written once."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        texts = batch.column("text")
        for part in _slices(texts, SLICE_BYTES):
            held.append(batch.slice(part.start, part.stop - part.start))
            size += len(_utf8(held[-1].column("text"))[0])
            if size >= CHUNK_BYTES:
                yield _rows([(0, number, _TEXTS, _sealed(held), None)])
                number, held, size = number + 1, [], 0
    if held:
        yield _rows([(0, number, _TEXTS, _sealed(held), None)])


def _sealed(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        for part in parts:
            stream.write_batch(part)
    return sink.getvalue().to_pybytes()


def _opened(raw: bytes) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(raw))


def _distinct(parts: list[pa.RecordBatch], n: int) -> np.ndarray:
    """Sorted distinct n-grams of a chunk, whose parts are hashed one at a time."""
    keys = np.concatenate([ngram_keys(*token_stream(part.column("text")), n)[0] for part in parts])
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _ask(segments: int, per: int, order: int):
    """The distinct words and n-grams of each chunk, for each group of ``per``
    segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                parts = _opened(batch.column("keys")[i].as_buffer())
                for n in range(1, order + 1):
                    keys = _distinct(parts, n)
                    at = _shares(keys, segments)
                    at = np.append(at[:-1:per], at[-1])
                    groups = np.flatnonzero(np.diff(at)).tolist()
                    for lo in range(0, len(groups), 32):
                        yield _rows(
                            [(g * per, chunk, n, _packed(keys[at[g] : at[g + 1]]), None) for g in groups[lo : lo + 32]]
                        )

    return run


def _answer(segments: int, per: int, hashes: int):
    """Counts and levels of what chunks ask for, looked up for many chunks at
    once. A group's model rows come first; one group is in memory at a time."""

    def told(held):
        if "look" not in held:
            rows = held.pop("rows")
            held["look"] = _lookup([(r[0], r[1], len(r[2])) for r in rows], rows, segments, hashes)
        for n in sorted({n for _, _, n, _ in held["asked"]}):
            asked = [a for a in held["asked"] if a[2] == n]
            distinct, at = np.unique(np.concatenate([a[3] for a in asked]), return_inverse=True)
            found = np.split(held["look"](n, distinct)[at], np.cumsum([len(a[3]) for a in asked])[:-1])
            pack = _planes if n == 1 else np.ndarray.tobytes
            yield _rows([(*a[:3], None, pack(f)) for a, f in zip(asked, found, strict=True)])
        held["asked"], held["size"] = [], 0

    def each(held, segment, chunk, n, keys, extra):
        if chunk == _MODEL:
            held["rows"].append((segment, n, keys, extra))
            return
        held["asked"].append((segment, chunk, n, _unpacked(keys)))
        held["size"] += len(held["asked"][-1][3])
        if held["size"] >= ASKED:
            yield from told(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = lambda: {"rows": [], "asked": [], "size": 0}
        yield from _walked(batches, lambda segment, _: segment // per, open_, each, lambda _, held: told(held))

    return run


def _score_chunks(order: int, tokens: int, types: int, s: Settings):
    """Scores of chunks, from rows sorted by chunk: its texts, then the answers
    in the order of what was asked."""

    def each(held, _segment, _chunk, n, keys, extra):
        held.setdefault(n, []).append(keys if n == _TEXTS else extra)
        return ()

    def close(_chunk, held):
        parts = _opened(held.pop(_TEXTS)[0])
        known = {}
        for n in range(1, order + 1):
            raws = held.pop(n, [])
            values = [_from_planes(r, np.int64) if n == 1 else np.frombuffer(r, np.uint8) for r in raws]
            known[n] = (_distinct(parts, n), np.concatenate(values) if values else np.zeros(0, np.int64))

        def look(n: int, keys: np.ndarray) -> np.ndarray:
            own, values = known[n]
            return values[np.searchsorted(own, keys)] if len(own) else values[:0]

        for part in parts:
            columns = map(np.concatenate, zip(*_scored_slices(part.column("text"), look, tokens, types, s), strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *map(pa.array, columns)], names=["id", "n_tokens", "n_known", "base_score", "score"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _walked(batches, lambda _, chunk: chunk, dict, each, close)

    return run


def _scored_by_segments(rows: DataFrame, model: Model) -> DataFrame:
    """The scores are stored here, for only jobs that are run here have their
    batches bounded."""
    s, spark = model.settings, rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    per = max(1, model.segments * GROUP_BYTES // max(1, model.bytes))
    group = F.expr(f"segment div {per}")
    collect_garbage(spark)  # what was counted is as large on disk as what is asked
    with small_batches(spark, PASSED_BYTES):
        # packed already; a codec would keep buffers as large as a file
        chunks = written(rows.mapInArrow(_chunks, _ROWS), "chunks", compression="uncompressed")
        asked = chunks.mapInArrow(_ask(model.segments, per, s.order), _ROWS)
        met = model.rows.unionByName(asked).repartition(group).sortWithinPartitions(group, "chunk", "n")
        answers = met.mapInArrow(_answer(model.segments, per, s.hashes), _ROWS)
        both = chunks.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk", "n", "segment")
        told = both.mapInArrow(_score_chunks(s.order, model.tokens, model.types, s), f"id {kind}, {_SCORE}")
        stored = written(told, "scores")
    used_up(chunks)
    return stored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``base_score`` is the sum over tokens of the logarithm of smoothed exact
    word counts, ``score`` the model's log10 probability of the text. A null or
    empty text, or one of white space, has one token, its end. Equal rows each
    come out; null ids stay; other columns, whatever their names, are not read.
    A model of no texts gives every token the same chance. Texts are scored
    whole; a text and the hashes of its tokens are in memory at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if model.bytes <= model.settings.broadcast:
        sizes = model.rows.select("segment", "n", F.octet_length("keys")).collect()
        parts = model.rows.select("segment", "n", "keys", "extra").toLocalIterator()
        shared = docs.sparkSession.sparkContext.broadcast(
            _lookup([tuple(r) for r in sizes], parts, model.segments, model.settings.hashes)
        )
        told = rows.withColumn("s", _score_udf(model, shared)("text")).select("id", "s.*")
    else:
        told = _scored_by_segments(rows, model)
    return told.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
