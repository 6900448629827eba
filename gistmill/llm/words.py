"""Words and shingles of whole Arrow batches as 64-bit hashes.

All work is on byte arrays, some numpy passes per window, never a Python step
per word. A window holds about a megabyte of text; a longer text is cut into
several at bytes outside words, so memory does not grow with a text. A table of
256 flags says which bytes make up words; A-Z is lowered, other bytes are taken
as they are.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(0xD6E8FEB86659FD93)


def white_space_words() -> np.ndarray:
    """Words are runs of bytes other than space, tab, LF, VT, FF and CR."""
    flags = np.ones(256, bool)
    flags[[0x20, *range(0x09, 0x0E)]] = False
    return flags


def letter_words() -> np.ndarray:
    """Words are runs of ASCII letters and digits and of all bytes beyond ASCII."""
    flags = np.zeros(256, bool)
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        flags[ord(low) : ord(high) + 1] = True
    flags[128:] = True
    return flags


@cache
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n``."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = []
        for base in (_BASE, inverse):
            steps = np.full(max(n, WINDOW + 1), base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS[0], _POWERS[1]


def _window_words(buf: np.ndarray, cuts: np.ndarray, flags: np.ndarray):
    """Hash and start of each word of a window; no word runs across a cut."""
    inside = flags[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(buf))]
    first[inner] |= inside[inner]
    last[inner - 1] |= inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(buf))
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_lower()[buf].astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=run[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((run[ends] - run[starts]) * inverse[starts] + length * _STEP), starts


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its rows in them."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def word_hashes(texts: pa.Array, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and the offsets of its rows in
    them. Null texts have no words."""
    if texts.null_count:
        texts = texts.fill_null("")
    buf, offsets = _utf8(texts)
    hashes, places, a = [], [], 0
    while a < len(buf):
        b = min(a + WINDOW, len(buf))
        if b < len(buf):  # back to the last row start or byte outside a word
            row = offsets[np.searchsorted(offsets, b, "right") - 1]
            gap = np.flatnonzero(~flags[buf[a:b]])
            best = max(row, a + gap[-1] if len(gap) else a)
            if best > a:
                b = int(best)
            else:  # one word longer than a window
                while b < len(buf) and flags[buf[b]] and b not in offsets:
                    b += 1
        h, at = _window_words(buf[a:b], offsets - a, flags)
        hashes.append(h)
        places.append(at + a)
        a = b
    all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    all_places = np.concatenate(places) if places else np.zeros(0, np.int64)
    return all_hashes, np.searchsorted(all_places, offsets)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each row, repeats included, and
    the rows' offsets in them. A row of fewer words, but at least one, has one
    shingle: all of its words."""
    n = len(hashes)
    count = np.diff(rows)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(size):
            rolled += hashes[j : j + len(rolled)] * factor
            factor = factor * _BASE
    rolled = mix(rolled + np.uint64(size))
    full = np.maximum(count - size + 1, 0)
    made = np.where((count > 0) & (full == 0), 1, full)
    offsets = np.concatenate([[0], np.cumsum(made)])
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], made)
    at = np.repeat(rows[:-1], made) + within
    out = rolled[np.minimum(at, max(len(rolled) - 1, 0))] if len(rolled) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero((count > 0) & (full == 0)):
        words, total, factor = hashes[rows[i] : rows[i + 1]], np.uint64(0), np.uint64(1)
        with np.errstate(over="ignore"):
            for w in words:
                total += w * factor
                factor = factor * _BASE
            out[offsets[i]] = mix(np.array([total + np.uint64(len(words))], np.uint64))[0]
    return out, offsets


def shingle_sets(texts: pa.Array, flags: np.ndarray, size: int):
    """The sorted set of shingle hashes of each text, one after another."""
    for a in range(0, len(texts), 256):
        hashes, rows = word_hashes(texts.slice(a, 256), flags)
        out, offsets = shingles(hashes, rows, size)
        for i in range(len(offsets) - 1):
            yield np.unique(out[offsets[i] : offsets[i + 1]])


def as_long(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)
