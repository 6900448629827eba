"""Resampled sums without a row per draw.

*Draws with replacement.* The ``n`` draws of each resample fall down a binary
tree over the rows' places: half a node's draws go left, as many as random bits
are set among as many bits as it has draws, so a split costs a word for 64
draws. Draws that end beyond the last row fall again from the top. The tree ends
at leaves of a power of two of places; ``(leaf, resample, draws)`` rows are all
that is shuffled beside the scores. A leaf's rows then meet its counts, and each
task keeps one array of sums for all resamples.

*Poisson weights.* Each row has its own weight in each resample; one scan, and
again one array of sums a task.

All random words are ``mix64`` of a key and a number, so any engine can repeat
them; how rows lie on tasks does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.operators.order import dense_index, hash_to_long, md5_of

# Multipliers of the finaliser of a well-known 64-bit generator, and its step.
MULTIPLY = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15
LO_STEP, SIZE_STEP = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
LEAF_BITS = 16
WORDS = 1 << 20  # random words in memory at a time
_M = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLY[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLY[1])
    return x ^ (x >> np.uint64(31))


def node_keys(stream: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix64(stream + lo.astype(np.uint64) * np.uint64(LO_STEP) + size.astype(np.uint64) * np.uint64(SIZE_STEP))


def _words(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(key's place, number from 0, word)`` of ``counts`` words of each key, in
    blocks of bounded size."""
    ends = np.cumsum(counts)
    for a in range(0, int(ends[-1]) if len(ends) else 0, WORDS):
        number = np.arange(a, min(a + WORDS, int(ends[-1])))
        at = np.searchsorted(ends, number, "right")
        number = number - (ends - counts)[at]
        yield at, number, mix64(keys[at] + (number + 1).astype(np.uint64) * np.uint64(STEP))


def _left(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How many of a node's draws go left: fair coins, 64 to a word."""
    out = np.zeros(len(keys), np.int64)
    for at, number, word in _words(keys, -(-draws // 64)):
        spare = np.clip(64 * (number + 1) - draws[at], 0, 63).astype(np.uint64)
        np.add.at(out, at, np.bitwise_count(word >> spare).astype(np.int64))
    return out


def leaf_counts(resamples: np.ndarray, n: int, leaf: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(resample, first place, size, key, draws)`` of every leaf with draws."""
    top = 1 << max(n - 1, 0).bit_length()
    b = np.asarray(resamples, np.int64)
    stream = mix64((b + 1).astype(np.uint64) * np.uint64(STEP))
    lo, size = np.zeros(len(b), np.int64), np.full(len(b), top, np.int64)
    draws = np.full(len(b), n, np.int64)
    while len(b):
        beyond, done = lo >= n, (lo + size <= n) & (size <= leaf)
        keys = node_keys(stream, lo, size)
        yield b[done], lo[done], size[done], keys[done], draws[done]
        again = (b[beyond], keys[beyond], 0 * lo[beyond], np.full(beyond.sum(), top), draws[beyond])
        split = ~beyond & ~done
        half, left = size[split] // 2, _left(keys[split], draws[split])
        first = (b[split], stream[split], lo[split], half, left)
        second = (b[split], stream[split], lo[split] + half, half, draws[split] - left)
        b, stream, lo, size, draws = (np.concatenate(x) for x in zip(again, first, second, strict=True))
        some = draws > 0
        b, stream, lo, size, draws = b[some], stream[some], lo[some], size[some], draws[some]


_SHARES = "leaf long, kind int, at long, b long, size long, key long, draws long"
_SUMS = "b array<long>, sums array<array<double>>, counts array<array<double>>"


def _falling(n: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, lo, size, keys, draws in leaf_counts(batch.column("b").to_numpy(), n, leaf):
                columns = [lo // leaf, np.zeros(len(b), np.int32), lo, b, size, keys.view(np.int64), draws]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _SHARES.split(", ")])

    return run


class _Sums:
    """Sums and counts of each metric's values in each resample."""

    def __init__(self, resamples: int, metrics: int):
        self.sums, self.counts = np.zeros((metrics, resamples)), np.zeros((metrics, resamples))
        self.used = False

    def row(self) -> Iterator[pa.RecordBatch]:
        if self.used:
            lists = [pa.array([x.tolist()]) for x in (np.arange(self.sums.shape[1]), self.sums, self.counts)]
            yield pa.RecordBatch.from_arrays(lists, names=["b", "sums", "counts"])


def _values(batch: pa.RecordBatch, metrics: int) -> np.ndarray:
    """A column a metric; nulls are kept apart by the second array."""
    columns = [batch.column(f"m{i}") for i in range(metrics)]
    values = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
    return values, np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


def _summing(resamples: int, metrics: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums(resamples, metrics)
        now, shares, rows = None, [], []

        def close():
            if not shares or not rows:
                return
            total.used = True
            values, valid = (np.concatenate(x, 1) for x in zip(*rows, strict=True))
            at, b, size, keys, draws = (np.concatenate(x) for x in zip(*shares, strict=True))
            for where, _, word in _words(keys.view(np.uint64), draws):
                place = (at[where] % leaf) + (word & (size[where] - 1).astype(np.uint64)).astype(np.int64)
                first = np.flatnonzero(np.diff(where, prepend=-1))
                of = b[where[first]]
                for i in range(metrics):
                    np.add.at(total.sums[i], of, np.add.reduceat(values[i][place], first))
                    np.add.at(total.counts[i], of, np.add.reduceat(valid[i][place].astype(np.int64), first))

        for batch in batches:
            leaves, kinds = batch.column("leaf").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.append(True, (np.diff(leaves) != 0) | (np.diff(kinds) != 0))) if len(leaves) else []
            for a, e in zip(edges, np.append(edges[1:], len(leaves)), strict=True):
                if leaves[a] != now:
                    close()
                    now, shares, rows = leaves[a], [], []
                part = batch.slice(a, e - a)
                if kinds[a] == 0:
                    shares.append([part.column(c).to_numpy() for c in ("at", "b", "size", "key", "draws")])
                else:
                    rows.append(_values(part, metrics))
        close()
        yield from total.row()

    return run


def _merged(parts: DataFrame, metrics: int) -> DataFrame:
    """``(b, mean of each metric)`` from the tasks' arrays."""
    flat = parts.select(F.explode(F.arrays_zip("b", *[F.get(f"{x}", F.lit(i)).alias(f"{x}{i}") for i in range(metrics) for x in ("sums", "counts")])).alias("z"))
    flat = flat.select("z.*")
    means = [F.try_divide(F.sum(f"sums{i}"), F.sum(f"counts{i}")).alias(f"m{i}") for i in range(metrics)]
    return flat.groupBy("b").agg(*means)


def _renamed(rows: DataFrame, columns: list[str]) -> list:
    return [F.col(f"`{c}`").cast("double").alias(f"m{i}") for i, c in enumerate(columns)]


def drawn_means(rows: DataFrame, columns: list[str], key: str, resamples: int, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """``(b, m0, m1, ..)``: means of each column over ``n`` rows drawn with
    replacement, the same rows for all columns. Means pass over nulls. ``rows``
    is read more than once: a stored table."""
    spark, n, leaf = rows.sparkSession, rows.count(), 1 << leaf_bits
    metrics = len(columns)
    indexed = dense_index(rows.select(F.col(f"`{key}`").alias("key"), *_renamed(rows, columns)), "key", "at").drop("key")
    scores = indexed.withColumn("leaf", F.expr(f"at div {leaf}")).withColumn("kind", F.lit(1))
    counts = spark.range(resamples if n else 0).withColumnRenamed("id", "b").mapInArrow(_falling(n, leaf), _SHARES)
    met = counts.unionByName(scores, allowMissingColumns=True)
    met = met.repartition("leaf").sortWithinPartitions("leaf", "kind", "at")
    return _merged(met.mapInArrow(_summing(resamples, metrics, leaf), _SUMS), metrics)


def poisson_weights(keys: np.ndarray, resamples: np.ndarray, thresholds: tuple[float, ...]) -> np.ndarray:
    """A row a key, a column a resample."""
    words = mix64(keys.view(np.uint64)[:, None] + ((resamples + 1).astype(np.uint64) * np.uint64(STEP))[None, :])
    chance = (words >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(np.array(thresholds), chance, "right")


def poisson_means(rows: DataFrame, columns: list[str], key: str, resamples: int, thresholds: tuple[float, ...]) -> DataFrame:
    """``(b, m0, ..)``: means under independent Poisson(1) weights. One scan."""
    metrics = len(columns)
    held = max(1, WORDS // max(resamples, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, numbers = _Sums(resamples, metrics), np.arange(resamples)
        for batch in batches:
            for a in range(0, batch.num_rows, held):
                part = batch.slice(a, held)
                total.used = True
                weights = poisson_weights(part.column("key").to_numpy(), numbers, thresholds)
                values, valid = _values(part, metrics)
                total.sums += values @ weights
                total.counts += valid.astype(np.int64) @ weights
        yield from total.row()

    hashed = F.coalesce(hash_to_long(md5_of(F.col(f"`{key}`"))), F.lit(0)).alias("key")
    return _merged(rows.select(hashed, *_renamed(rows, columns)).mapInArrow(run, _SUMS), metrics)
