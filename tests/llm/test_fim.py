import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmill.llm import fim


def by_hand(key, text):
    text = text or ""
    digest = hashlib.sha256(("1:" + ("" if key is None else str(key))).encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def sample():
    r = random.Random(8)
    alphabet = ["a", "<", ">", "P", "S", "M", "é", "語", "😀", "\n", " ", "́"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 5, 40, 300])))) for i in range(400)]
    rows += [(400, None), (None, "no id"), (401, ""), (402, "a<P>b"), (403, "<M>"), (404, "<P"), (404, "<P")]
    rows += [(405, "x" * 9), (405, "y" * 9)]
    return rows


@pytest.mark.parametrize("window, piece", [(1 << 20, 1 << 23), (7, 50)])
def test_as_by_hand(spark, monkeypatch, window, piece):
    rows = sample()
    texts = pa.array([t for _, t in rows])
    want = [by_hand(k, t) for k, t in rows]
    form = np.array([fim._FORMS[w[1]] for w in want])
    prefix, middle = (np.array([w[i] or 0 for w in want]) for i in (2, 3))
    monkeypatch.setattr(fim, "WINDOW", window)
    monkeypatch.setattr(fim, "SLICE_BYTES", piece)
    out = fim._sliced(texts, lambda part, s: fim.scattered(part, form[s], prefix[s], middle[s]))
    assert out.to_pylist() == [w[4] for w in want]
    back = fim._sliced(out, lambda part, s: fim.gathered(part, form[s]))
    assert back.to_pylist() == [t or "" for _, t in rows]


def test_table(spark):
    rows = sample()
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, n int, `a.b` int")
    made = fim.fill_in_middle(docs)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple(str(v) for v in x)
    want = sorted(((k, *by_hand(k, t), t or "") for k, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_long_and_empty(spark):
    long = "wörd 語 " * 400_000
    docs = spark.createDataFrame([(i, long) for i in (1, 2)], "doc_id long, text string")
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    for row in made.collect():
        assert tuple(row)[1:6] == by_hand(row["doc_id"], long) and row["back"] == long
    empty = fim.fill_in_middle(docs.limit(0))
    assert empty.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect() == []


def test_damaged_output():
    with pytest.raises(ValueError):
        fim.gathered(pa.array(["<P>a<S>b"]), np.array([1]))
    with pytest.raises(ValueError):
        fim.gathered(pa.array(["x<P>a<S>b<M>"]), np.array([1]))
