"""Fill-in-middle by displacement scatter.

Ids are hashed in Spark to two cuts and a form. The bytes of a batch then move
at once: scanning the code points gives each cut its byte, a difference array
holds by how much the shift changes at each piece's first byte, its running sum
is every byte's shift, and one numpy scatter puts the bytes in their places.
Restoring finds the three marks, builds the shifts of the inverse in the same
way, and gathers. Shifts exist for a window of bytes at a time, so beyond input
and output memory does not grow with a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gistmill.llm.words import _utf8

WINDOW = 1 << 20
SLICE_BYTES = 1 << 23
MARKS = ("<P>", "<S>", "<M>")
_MARK = 3  # bytes of a mark
_FORMS = {"plain": 0, "psm": 1, "spm": 2}
#: the pieces (0 prefix, 1 middle, 2 suffix) in the order a form writes them
_ORDER = {1: (0, 2, 1), 2: (2, 0, 1)}
_SIGN = {0: b"<P>", 1: b"<M>", 2: b"<S>"}


def _cut_bytes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte at which the code point number ``at`` (counted over the batch) starts."""
    order = np.argsort(at, kind="stable")
    wanted, found = at[order], np.full(len(at), len(buf), np.int64)
    seen, lo = 0, 0
    for w in range(0, len(buf), WINDOW):
        starts = np.flatnonzero((buf[w : w + WINDOW] & 0xC0) != 0x80)
        hi = np.searchsorted(wanted, seen + len(starts), "left")
        found[lo:hi] = w + starts[wanted[lo:hi] - seen]
        seen, lo = seen + len(starts), hi
    out = np.empty(len(at), np.int64)
    out[order] = found
    return out


def _row_chars(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points before each row's first byte, and all of them."""
    before, seen, lo = np.zeros(len(offsets), np.int64), 0, 0
    for w in range(0, len(buf), WINDOW):
        run = np.concatenate([[0], np.cumsum((buf[w : w + WINDOW] & 0xC0) != 0x80)])
        hi = np.searchsorted(offsets, w + len(run) - 1, "left")
        before[lo:hi] = seen + run[offsets[lo:hi] - w]
        seen, lo = seen + int(run[-1]), hi
    before[lo:] = seen
    return before


def _shifts(starts: np.ndarray, shift: np.ndarray, size: int):
    """``(window's first byte, shift of each of its bytes)``: pieces start at
    the rising ``starts``; of several that start at a byte the last is not empty."""
    step = np.diff(shift, prepend=0)
    carry = 0
    for w in range(0, size, WINDOW):
        n = min(WINDOW, size - w)
        lo, hi = np.searchsorted(starts, [w, w + n], "left")
        change = np.zeros(n, np.int64)
        np.add.at(change, starts[lo:hi] - w, step[lo:hi])
        change[0] += carry
        run = np.cumsum(change)
        carry = int(run[-1])
        yield w, run


def _places(sizes: np.ndarray, form: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, dict]:
    """Where each row's three pieces start in the output, and its marks."""
    place = np.stack([base, base + sizes[:, 0], base + sizes[:, 0] + sizes[:, 1]], 1)
    marks = {piece: [] for piece in _SIGN}
    for code, order in _ORDER.items():
        rows = np.flatnonzero(form == code)
        at = base[rows].copy()
        for piece in order:
            marks[piece].append(at.copy())
            at += _MARK
            place[rows, piece] = at
            at += sizes[rows, piece]
    return place, {piece: np.concatenate(at) for piece, at in marks.items()}


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if offsets[-1] < 1 << 31:
        kind, offsets = pa.string(), offsets.astype(np.int32)
    else:
        kind = pa.large_string()
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def scattered(texts: pa.Array, form: np.ndarray, prefix: np.ndarray, middle: np.ndarray) -> pa.Array:
    """The texts with their pieces moved and marked. ``form`` holds codes, the
    others code points; rows of form 0 stay as they are."""
    buf, offsets = _utf8(texts)
    first = _row_chars(buf, offsets)[:-1]
    moved = form > 0
    one = np.where(moved, prefix, 0)
    two = np.where(moved, prefix + middle, 0)
    cuts = _cut_bytes(buf, np.concatenate([first + one, first + two]))
    a, b = cuts[: len(form)], cuts[len(form) :]
    starts = np.stack([offsets[:-1], np.minimum(a, offsets[1:]), np.minimum(b, offsets[1:])], 1)
    sizes = np.diff(np.concatenate([starts, offsets[1:, None]], 1), axis=1)
    ends = np.cumsum(np.diff(offsets) + 3 * _MARK * moved)
    base = np.concatenate([[0], ends])
    place, marks = _places(sizes, form, base[:-1])
    out = np.empty(base[-1], np.uint8)
    for w, shift in _shifts(starts.ravel(), (place - starts).ravel(), len(buf)):
        out[np.arange(w, w + len(shift)) + shift] = buf[w : w + len(shift)]
    for piece, at in marks.items():
        for k, byte in enumerate(_SIGN[piece]):
            out[at + k] = byte
    return _strings(out, base)


def _find_marks(buf: np.ndarray) -> np.ndarray:
    found = []
    for w in range(0, len(buf), WINDOW):
        part = buf[w : w + WINDOW + _MARK - 1]
        letter = part[1:-1]
        known = (letter == ord("P")) | (letter == ord("S")) | (letter == ord("M"))
        found.append(w + np.flatnonzero((part[:-2] == ord("<")) & known & (part[2:] == ord(">"))))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def gathered(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts from which ``scattered`` made ``outputs``."""
    buf, offsets = _utf8(outputs)
    moved = np.flatnonzero(form > 0)
    at = _find_marks(buf)
    row = np.searchsorted(offsets, at, "right") - 1
    at = at[form[row] > 0] if len(at) else at
    if len(at) != 3 * len(moved):
        raise ValueError("an output does not hold each of its three marks once")
    at = at.reshape(-1, 3)
    if (at[:, 0] != offsets[moved]).any() or (at[:, 2] >= offsets[moved + 1]).any():
        raise ValueError("an output does not begin with its mark")
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - 3 * _MARK * (form > 0))])
    begin = np.concatenate([at + _MARK, offsets[moved + 1, None]], 1)
    size = np.diff(begin, axis=1) - _MARK * np.array([1, 1, 0])
    source = np.repeat(offsets[:-1, None], 3, 1)
    target = np.repeat(ends[:-1, None], 3, 1)
    for code, order in _ORDER.items():
        rows = np.flatnonzero(form[moved] == code)
        sizes = {piece: size[rows, k] for k, piece in enumerate(order)}
        start = {piece: begin[rows, k] for k, piece in enumerate(order)}
        t = ends[moved[rows]].copy()
        for piece in range(3):
            source[moved[rows], piece] = start[piece]
            target[moved[rows], piece] = t
            t += sizes[piece]
    out = np.empty(ends[-1], np.uint8)
    for w, shift in _shifts(target.ravel(), (source - target).ravel(), len(out)):
        out[w : w + len(shift)] = buf[np.arange(w, w + len(shift)) + shift]
    return _strings(out, ends)


def _sliced(texts: pa.Array, work) -> pa.Array:
    """``work(texts, slice)`` over runs of rows of bounded size."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets = _utf8(texts)
    done, a = [], 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        done.append(work(texts.slice(a, b - a), slice(a, b)))
        a = b
    if not done:
        return pa.array([], pa.string())
    if any(x.type == pa.large_string() for x in done):
        done = [x.cast(pa.large_string()) for x in done]
    return pa.concat_arrays(done)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(StringType())
def _scatter(texts: pa.Array, form: pa.Array, prefix: pa.Array, middle: pa.Array) -> pa.Array:
    f, p, m = _numbers(form), _numbers(prefix), _numbers(middle)
    return _sliced(texts, lambda part, rows: scattered(part, f[rows], p[rows], m[rows]))


@F.arrow_udf(StringType())
def _gather(outputs: pa.Array, form: pa.Array) -> pa.Array:
    f = _numbers(form)
    return _sliced(outputs, lambda part, rows: gathered(part, f[rows]))


def _code(form: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in _FORMS.items():
        out = F.when(form == name, F.lit(code)).otherwise(out)
    return out


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone."""
    return _gather(output, _code(form))


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salt: str = "1:",
    rate: int = 90,
    spm: int = 20,
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row.

    Four numbers come from the hash of ``salt`` and the id: two cuts among the
    ``n + 1`` places of the text's ``n`` code points, and two percentages.
    ``rate`` percent are taken apart, of these ``spm`` percent with the suffix
    first. An empty text, or one that holds a mark, is ``plain``: its output is
    the text, its piece lengths are null. A null text counts as empty, a null id
    as an empty string. Rows with one id and text come out alike, each by
    itself; other columns, whatever their names, are not read. There is no
    shuffle. A text is one row in memory, however long.
    """
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("_key", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("_key")
    )
    rows = rows.withColumn("n", F.char_length("text").cast("bigint"))
    c1, c2 = (F.pmod(x, F.col("n") + 1) for x in h[:2])
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.col("text").contains(mark)
    form = (
        F.when((F.col("n") == 0) | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    )
    rows = rows.withColumns({"form": form, "a": F.least(c1, c2), "b": F.greatest(c1, c2)})
    whole = F.col("form") == "plain"
    rows = rows.withColumns(
        {"prefix_chars": F.when(~whole, F.col("a")), "middle_chars": F.when(~whole, F.col("b") - F.col("a"))}
    )
    output = _scatter(F.col("text"), _code(F.col("form")), F.col("prefix_chars"), F.col("middle_chars"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))
