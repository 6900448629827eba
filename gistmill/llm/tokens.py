"""Edit-aware token counts.

A document's pre-tokens are kept in leaves of some dozens, and a binary tree
over the leaves has the characters and tokens of every subtree. An edit is
found by descending the tree, text is cut and encoded again from a little before
it until a cut falls on an old leaf's start behind it, and the sums above the
leaves that changed are renewed. Where leaves become more or fewer the tree is
set up again from its leaves; no text is encoded for that.

The pattern that cuts pre-tokens reads from left to right and looks only ahead,
at most ``CONTEXT`` characters beyond a cut, so equal text from a cut on is cut
alike.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.graph import unused_name

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 32
CONTEXT = 4
CACHED = 400_000
LONGEST_CACHED = 64

#: Edits of the query: what is personal or secret gives way to a mark.
RULES = (
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    (r"AKIA[0-9A-Z]{16}", "<key>"),
    (r"\+?\d[\d ().-]{5,}\d", "<number>"),
)


class _Counts(dict):
    """Tokens of a pre-token, remembered while there is room."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


@cache
def _coder(ranks: str, pattern: str):
    """Cutting pattern and token counts of a vocabulary, once per worker."""
    import regex
    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
    return regex.compile(pattern), _Counts(encoding)


class SumTree:
    """Binary tree over leaves ``(characters, tokens)`` with subtree sums.

    Node 1 is the root, the children of ``i`` are ``2 i`` and ``2 i + 1``.
    """

    def __init__(self, chars, tokens):
        self.n = len(chars)
        self.wide = 1 << max(0, (self.n - 1).bit_length())
        self.sums = np.zeros((2 * self.wide, 2), np.int64)
        self.sums[self.wide : self.wide + self.n, 0] = chars
        self.sums[self.wide : self.wide + self.n, 1] = tokens
        at = self.wide
        while at > 1:
            half = at // 2
            self.sums[half:at] = self.sums[at : 2 * at].reshape(half, 2, 2).sum(1)
            at = half

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, i: int) -> tuple[int, int]:
        return tuple(int(x) for x in self.sums[self.wide + i])

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts."""
        node, start = 1, 0
        while node < self.wide:
            left = int(self.sums[2 * node, 0])
            if position - start < left:
                node = 2 * node
            else:
                start, node = start + left, 2 * node + 1
        return node - self.wide, start

    def set(self, i: int, chars: int, tokens: int) -> None:
        node = self.wide + i
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def replaced(self, first: int, last: int, leaves: list[tuple[int, int]]) -> "SumTree":
        """The tree with leaves ``first`` up to ``last`` replaced."""
        if last - first == len(leaves):
            for i, leaf in enumerate(leaves, first):
                self.set(i, *leaf)
            return self
        own = self.sums[self.wide : self.wide + self.n]
        parts = [own[:first], np.array(leaves, np.int64).reshape(-1, 2), own[last:]]
        return SumTree(*np.concatenate(parts).T)


def build(text: str, ranks: str = RANKS, pattern: str = PATTERN) -> SumTree:
    cut, counts = _coder(ranks, pattern)
    pieces = cut.findall(text)
    if not pieces:
        return SumTree([0], [0])
    at = np.arange(0, len(pieces), LEAF)
    sizes = [
        np.add.reduceat(np.fromiter(map(f, pieces), np.int64, len(pieces)), at) for f in (len, counts.__getitem__)
    ]
    return SumTree(*sizes)


def edited(text: str, edits) -> str:
    """Text after edits ``(start, end, text)``, sorted, apart, in characters."""
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def checked(text: str, edits) -> list:
    """Edits in order; raises where they overlap or leave the text."""
    ordered, at = sorted((e for e in edits), key=lambda e: (e[0], e[1])), 0
    for start, end, _ in ordered:
        if not at <= start <= end <= len(text):
            raise ValueError("edits overlap or leave the text")
        at = end
    return ordered


def update(tree: SumTree, old: str, edits, ranks: str = RANKS, pattern: str = PATTERN) -> tuple[SumTree, str, int]:
    """Tree and text after the edits, and how many characters were encoded."""
    edits = checked(old, edits)
    if not edits:
        return tree, old, 0
    new = edited(old, edits)
    if not old or not new:
        return build(new, ranks, pattern), new, len(new)
    cut, counts = _coder(ranks, pattern)
    regions, shift, k, encoded = [], 0, 0, 0
    while k < len(edits):
        first, start = tree.find(min(max(0, edits[k][0] - CONTEXT), len(old) - 1))
        leaf, bound = first, start  # old leaf that starts at ``bound``
        pieces, behind, synced = [], -1, False
        begin = at = start + shift
        while True:
            # take in every edit that what is cut so far may depend on
            while k < len(edits) and edits[k][0] - CONTEXT < at - shift + 1 or behind < 0:
                s, e, text = edits[k]
                behind = s + shift + len(text)  # its end in the new text
                shift += len(text) - (e - s)
                k += 1
            if at >= behind and at > begin or at >= len(new):
                while leaf < tree.n and bound < at - shift:
                    bound += tree.leaf(leaf)[0]
                    leaf += 1
                synced = bound == at - shift
            if synced or at >= len(new):
                break
            piece = cut.match(new, at).group()
            pieces.append(piece)
            at += len(piece)
        encoded += at - begin
        sizes = []
        for i in range(0, len(pieces), LEAF):
            part = pieces[i : i + LEAF]
            sizes.append((sum(map(len, part)), sum(map(counts.__getitem__, part))))
        regions.append((first, leaf if at < len(new) else tree.n, sizes))
    for first, last, sizes in reversed(regions):
        tree = tree.replaced(first, last, sizes)
    return tree, new, encoded


# --- on Spark -----------------------------------------------------------------

TREE = "struct<n:int,chars:array<int>,tokens:array<int>>"


def _pack(trees: list[SumTree]) -> pa.Array:
    """The leaves of trees; sums are set up again in one pass over them."""
    leaves = [t.sums[t.wide : t.wide + t.n] for t in trees]
    return pa.StructArray.from_arrays(
        [
            pa.array([t.n for t in trees], pa.int32()),
            pa.array([x[:, 0].astype(np.int32) for x in leaves], pa.list_(pa.int32())),
            pa.array([x[:, 1].astype(np.int32) for x in leaves], pa.list_(pa.int32())),
        ],
        names=["n", "chars", "tokens"],
    )


def _texts(column: pa.Array):
    return (t.as_py() or "" for t in column)


def tree_of(text: Column, ranks: str = RANKS, pattern: str = PATTERN) -> Column:
    """The tree of a text's counts, to be stored beside it."""

    @F.arrow_udf(TREE)
    def made(texts: pa.Array) -> pa.Array:
        return _pack([build(t, ranks, pattern) for t in _texts(texts)])

    return made(text)


def edits_of(text: Column, rules=RULES) -> Column:
    """Edits that replace what the patterns match: leftmost first, and of two
    that begin together the one of the earlier rule."""

    @F.arrow_udf("array<struct<start:int,end:int,text:string>>")
    def found(texts: pa.Array) -> pa.Array:
        patterns = [(re.compile(p), mark) for p, mark in rules]
        rows = []
        for t in _texts(texts):
            spans = [(m.start(), i, m.end(), mark) for i, (p, mark) in enumerate(patterns) for m in p.finditer(t)]
            kept, at = [], 0
            for start, _, end, mark in sorted(spans):
                if start >= at and end > start:
                    kept.append({"start": start, "end": end, "text": mark})
                    at = end
            rows.append(kept)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        return pa.array(rows, kind)

    return found(text)


def updated(tree: Column, text: Column, edits: Column, ranks: str = RANKS, pattern: str = PATTERN) -> Column:
    """``(text, tree, chars, tokens, encoded)`` after the edits."""

    @F.arrow_udf(f"text string, tree {TREE}, chars bigint, tokens bigint, encoded bigint")
    def made(trees: pa.Array, texts: pa.Array, edits_: pa.Array) -> pa.Array:
        after, done, encoded = [], [], []
        for tree, t, e in zip(trees, _texts(texts), edits_, strict=True):
            x = tree.as_py()
            spans = [(d["start"], d["end"], d["text"] or "") for d in e.as_py() or []]
            grown, new, n = update(SumTree(x["chars"], x["tokens"]), t, spans, ranks, pattern)
            after.append(new)
            done.append(grown)
            encoded.append(n)
        return pa.StructArray.from_arrays(
            [
                pa.array(after, pa.string()),
                _pack(done),
                pa.array([t.chars for t in done], pa.int64()),
                pa.array([t.tokens for t in done], pa.int64()),
                pa.array(encoded, pa.int64()),
            ],
            names=["text", "tree", "chars", "tokens", "encoded"],
        )

    return made(tree, text, edits)


def with_trees(docs: DataFrame, text_col: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with a column ``tree`` (``_tree`` where that is taken). A null
    or empty text has a tree of no tokens; copies and very long texts are as any
    other; an empty table stays empty."""
    return docs.withColumn(unused_name(docs, "tree"), tree_of(F.col(text_col), ranks, pattern))


def recounted(docs: DataFrame, text_col: str = "text", tree_col: str = "tree", edits_col: str = "edits", **kw) -> DataFrame:
    """``docs`` with a column ``after`` (``_after`` where taken): text, tree,
    characters, tokens after the edits of the row, and the characters encoded
    for them. Null edits are none. Edits that overlap or leave the text raise."""
    name = unused_name(docs, "after")
    return docs.withColumn(name, updated(F.col(tree_col), F.col(text_col), F.col(edits_col), **kw))
