"""Benchmark decontamination: MinHash containment search for short test items
in long documents, verified on exact shingles.

A document contains an item when it has at least ``num / den`` of the item's
five-word shingles. Items are partitioned by size; a partition's items have
MinHash sketches of one size: their smallest shingle hashes, one more than any
item of the partition can miss. So a document that contains an item has at
least one hash of its sketch, and in general as many as the sketch has beyond
what may be missing: no document is lost, however long, and a long document
needs no sketch of its own. Documents that reach that number are verified on
the item's shingles as they are written.

Items are read in blocks of bounded size, each broadcast to one pass over the
documents; documents are never shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.graph import own_columns, unused_name
from gistmill.llm.words import letter_words, shingles, word_hashes

BLOCK_CHARS = 16_000_000  # of item texts in a broadcast
FILTER_BITS = 22
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def written_shingles(text: str | None, size: int) -> set[bytes]:
    """Shingles as they are written: words lower-cased (A-Z), one blank between."""
    words = _WORD.findall((text or "").encode().lower())
    if not words:
        return set()
    if len(words) < size:
        return {b"\0" + b" ".join(words)}
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class Items:
    """A block of items: their sketches, sorted, and their shingles."""

    def __init__(self, ids: list, texts: list[str], size: int, num: int, den: int):
        self.ids, self.texts, self.size, self.num, self.den = ids, texts, size, num, den
        flags = letter_words()
        out, at = shingles(*word_hashes(pa.array(texts, pa.string()), flags), size)
        hashes, owners, self.enough = [], [], np.zeros(len(ids), np.int64)
        for i in range(len(ids)):
            own = np.unique(out[at[i] : at[i + 1]])
            n = len(own)
            if not n:
                continue
            top = (1 << n.bit_length()) - 1  # largest size of the partition
            sketch = own[: top * (den - num) // den + 1]
            self.enough[i] = len(sketch) - n * (den - num) // den
            hashes.append(sketch)
            owners.append(np.full(len(sketch), i))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owners = flat[order], owner[order]

    def prepare(self) -> None:
        """What a worker needs beside what was sent."""
        if not hasattr(self, "filter"):
            self.filter = np.zeros(1 << FILTER_BITS, bool)
            self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.written = {}

    def shingles_of(self, i: int) -> set[bytes]:
        if i not in self.written:
            self.written[i] = written_shingles(self.texts[i], self.size)
        return self.written[i]

    def candidates(self, out: np.ndarray) -> np.ndarray:
        """Items of which enough sketch hashes are among a text's shingles."""
        seen = np.unique(out[self.filter[out >> np.uint64(64 - FILTER_BITS)]])
        if not len(seen):
            return seen.astype(np.int64)
        low = np.searchsorted(self.hashes, seen, "left")
        high = np.searchsorted(self.hashes, seen, "right")
        hit = np.concatenate([self.owners[a:b] for a, b in zip(low, high, strict=True)])
        if not len(hit):
            return hit
        item, count = np.unique(hit, return_counts=True)
        return item[count >= self.enough[item]]

    def found(self, text: str, out: np.ndarray) -> list[dict]:
        hits = self.candidates(out)
        if not len(hits):
            return []
        own, rows = written_shingles(text, self.size), []
        for i in hits.tolist():
            wanted = self.shingles_of(i)
            shared = len(wanted & own)
            if self.den * shared >= self.num * len(wanted):
                rows.append({"item_id": self.ids[i], "shared": shared, "of": len(wanted)})
        return rows


def _find(block):
    @F.arrow_udf("array<struct<item_id:bigint,shared:bigint,of:bigint>>")
    def find(texts: pa.Array) -> pa.Array:
        for items in block.value:
            items.prepare()
        flags, rows = letter_words(), []
        for a in range(0, len(texts), 256):
            part = texts.slice(a, 256)
            words, made = word_hashes(part, flags), [[] for _ in range(len(part))]
            for items in block.value:
                out, at = shingles(*words, items.size)
                for i in range(len(part)):
                    own = out[at[i] : at[i + 1]]
                    if len(own):
                        made[i] += items.found(part[i].as_py(), own)
            rows += made
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("of", pa.int64())]))
        return pa.array(rows, kind)

    return find


def by_width(ids: list, texts: list[str], words: int, num: int, den: int, inside: bool) -> list[Items]:
    """Items of a block by the width of their shingles: with ``inside``, an item
    of fewer than ``words`` words is a single shingle of its own width."""
    widths = [min(words, len(_WORD.findall(t.encode())) or words) if inside else words for t in texts]
    made = []
    for w in sorted({words, *widths}):
        at = [i for i, x in enumerate(widths) if x == w]
        made.append(Items([ids[i] for i in at], [texts[i] for i in at], w, num, den))
    return made


def item_blocks(benchmark: DataFrame, words: int, num: int, den: int, inside: bool = False):
    """Broadcasts of items, each of at most ``BLOCK_CHARS`` characters (or one
    item); items come to the driver a block at a time."""
    context, ids, texts, held = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if ids and held + len(row["text"]) > BLOCK_CHARS:
            yield context.broadcast(by_width(ids, texts, words, num, den, inside))
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"])
    yield context.broadcast(by_width(ids, texts, words, num, den, inside))


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    words: int = 5,
    num: int = 80,
    den: int = 100,
    inside: bool = False,
) -> DataFrame:
    """``docs`` with an array ``found`` (``_found`` where that is taken) of
    ``(item_id, shared, of)``: the items a text contains, and how many of the
    item's shingles it has.

    Words are runs of letters and digits (of any bytes beyond ASCII), A-Z
    lower-cased. A text of fewer than five words is one shingle, equal only to
    that of a text of the same words; with ``inside`` an item of fewer words is
    found wherever its words stand in a row. A null or empty text, on either
    side, matches nothing. Repeated items with one id and text count once. An empty
    benchmark finds nothing, an empty table stays empty.
    """
    name, text = unused_name(docs, "found"), F.coalesce(F.col(text_col), F.lit(""))
    found = [_find(b)(text) for b in item_blocks(benchmark, words, num, den, inside)]
    return docs.withColumn(name, F.concat(*found) if len(found) > 1 else found[0])


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``(doc_id, item_id, shared, of)``: a row per row of ``docs`` and item it
    contains."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = contained_items(own, benchmark, **kw)
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that contain an item."""
    name = unused_name(docs, "found")
    found = contained_items(docs, benchmark, text_col, **kw)
    return found.where(F.size(name) == 0).select(*own_columns(docs))
