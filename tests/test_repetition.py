"""In-row n-gram measures against plain loops."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gistmill.functions import repetition as rp
from gistmill.operators import repetition as rep

TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_")
SIZES = (5, 6, 7, 8, 9, 10)
LIMITS = (0.25, 0.24, 0.23, 0.22, 0.21, 0.20)


def spans(text):
    return [m.span() for m in TOKEN.finditer(text)]


def grams_of(text, n):
    """N-grams with their span; the one on the last token is not counted."""
    at = spans(text)
    ends = [(at[i][0], at[i + n - 1][1]) for i in range(max(len(at) - n, 0))]
    return [(text[a:b].lower(), a, b) for a, b in ends]


def covered(text, n):
    seen, marked = set(), set()
    for g, a, b in grams_of(text, n):
        if g in seen:
            marked.update(range(a, b))
        seen.add(g)
    return len(marked)


def random_texts(count, seed):
    rng = random.Random(seed)
    words = ["en", "To", "tre,", "fire.", "x", "lang-ord", "to\n", "…"]
    out = ["", " ", "ord", "a b a b a b a b a b a b a b"]
    for _ in range(count):
        line = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))
        extra = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(3)]
        out.append("  ".join([line] * rng.randrange(1, 5) + extra))
    return out


def test_counts_top_and_duplicates(texts):
    values = random_texts(150, 3)
    df = texts(*values)
    counted = {}
    for r in rep.ngram_counts(df, "id", 2, 3).collect():
        counted.setdefault((r.id, r.n), {})[r.ngram] = r.cnt
    top = {r.id: r for r in rep.top_ngrams(df, "id", 2).collect()}
    dups = {(r.id, r.n): r.dup_chars for r in rep.duplicate_ngrams(df, "id", 3, 6).collect()}
    for i, text in enumerate(values):
        for n in (2, 3):
            assert counted.get((i, n), {}) == Counter(g for g, _, _ in grams_of(text, n))
        pairs = [g for g, _, _ in grams_of(text, 2)]
        if pairs:
            # most_common keeps first-seen order among equals
            best, cnt = Counter(pairs).most_common(1)[0]
            assert (top[i].ngram, top[i].cnt) == (best, cnt)
            assert abs(top[i].chr_fraction - len(best) * cnt / len(text)) < 1e-12
        for n in range(3, 7):
            assert dups[i, n] == covered(text, n), (text, n)


def test_pruned_verdicts_equal_the_plain_rule(texts):
    values = random_texts(300, 4)
    c = F.col("text")
    got = (
        texts(*values)
        .select(
            "id",
            rp.duplicate_ngram_fails(c, F.length(c), SIZES, LIMITS).alias("dup"),
            rp.top_ngram_fails(c, F.length(c), (2, 3, 4), (0.2, 0.18, 0.16), 3).alias("top"),
        )
        .collect()
    )
    for r in got:
        text = values[r.id]
        dup = not text or any(covered(text, n) > t * len(text) for n, t in zip(SIZES, LIMITS))
        top = False
        for n, t in zip((2, 3, 4), (0.2, 0.18, 0.16)):
            found = Counter(g for g, _, _ in grams_of(text, n)).most_common(1)
            top |= any(len(g) * k / len(text) > t and k > 3 for g, k in found)
        assert (r.dup, r.top) == (dup, top), text
    assert {r.dup for r in got} == {True, False} == {r.top for r in got}


def test_ranges_from_one(texts):
    values = [" ".join(f"a b c {'x' * 12}{i}{j}" for j in range(3)) for i in range(6)] + random_texts(150, 5)
    values.append("   ".join(["a b c"] + [f"{'w' * 9}{k} a b c" for k in range(5)]))
    c = F.col("text")
    for sizes, limits in (((1, 2), (0.9, 0.3)), ((1, 2, 3), (0.6, 0.4, 0.2)), ((1,), (0.2,))):
        got = texts(*values).select("id", rp.duplicate_ngram_fails(c, F.length(c), sizes, limits).alias("dup")).collect()
        for r in got:
            text = values[r.id]
            want = not text or any(covered(text, n) > t * len(text) for n, t in zip(sizes, limits))
            assert r.dup == want, (text, sizes)


def test_last_ngram_is_not_counted(texts):
    df = texts("a b", "a b c", "a b a b")
    got = {(r.id, r.ngram): r.cnt for r in rep.ngram_counts(df, "id", 2, 2).collect()}
    assert got == {(1, "a b"): 1, (2, "a b"): 1, (2, "b a"): 1}


def test_part_fractions(texts):
    df = texts("a\n\na\n\nb", "", "x\nx\n\ny")
    got = [r for r in rep.with_line_fractions(df).orderBy("id").collect()]
    assert abs(got[0].paragraphs_chr_fraction - 1 / 7) < 1e-12
    assert abs(got[0].paragraphs_fraction - 2 / 3) < 1e-12
    assert got[1].lines_chr_fraction is None and got[1].lines_fraction is None
    assert abs(got[2].lines_fraction - 2 / 3) < 1e-12
