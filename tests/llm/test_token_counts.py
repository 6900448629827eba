import os
import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from gistmill.llm import tokens
from gistmill.llm.queries import op2_token_counts
from gistmill.llm.tokens import SumTree, build, edited, update

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="needs the vocabulary files")


def count(text):
    return len(tokens._coder(tokens.RANKS, tokens.PATTERN)[1].encoding.encode_ordinary(text))


def random_text(r, n):
    parts = ["the", " cat", "'s", "'", "re", "  ", "\n\n", "é", "12", " 7", "!", "?!", " ", "\t", "日本", " ", "'ll", "x"]
    return "".join(r.choice(parts) for _ in range(n))


@pytest.mark.parametrize("leaf", [1, 2, 5, 32])
def test_counts_after_random_edits(monkeypatch, leaf):
    monkeypatch.setattr(tokens, "LEAF", leaf)
    r = random.Random(leaf)
    for _ in range(150):
        text = random_text(r, r.choice([0, 1, 3, 40, 300]))
        tree = build(text)
        assert (tree.tokens, tree.chars) == (count(text), len(text))
        for _ in range(4):  # edits upon edits
            cuts = sorted(r.randrange(len(text) + 1) for _ in range(2 * r.randrange(4)))
            edits = [(a, b, random_text(r, r.randrange(4))) for a, b in zip(cuts[::2], cuts[1::2])]
            tree, new, _ = update(tree, text, edits)
            assert new == edited(text, edits)
            assert (tree.tokens, tree.chars) == (count(new), len(new))
            leaves = tree.sums[tree.wide : tree.wide + tree.n]
            again = SumTree(*leaves.T)
            assert (again.sums[1:] == tree.sums[1:]).all()
            text = new


def test_only_the_surroundings_are_encoded():
    text = "some words that go on and on. " * 5000
    tree = build(text)
    new_tree, new, encoded = update(tree, text, [(70_000, 70_004, "XY"), (120_000, 120_000, " more")])
    assert encoded < 1500 and new_tree.tokens == count(new)


def test_find_and_set():
    tree = SumTree([3, 1, 4, 1, 5], [1, 1, 2, 1, 2])
    starts = np.cumsum([0, 3, 1, 4, 1])
    for p in range(14):
        leaf, start = tree.find(p)
        assert starts[leaf] == start and start <= p < start + tree.leaf(leaf)[0]
    tree.set(2, 6, 3)
    assert (tree.chars, tree.tokens) == (16, 8)


def test_query_counts_equal_those_of_edited_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("edits", tokens.edits_of(F.col("text")))
    want, edits = {}, 0
    for r in docs.collect():
        spans = [(e["start"], e["end"], e["text"]) for e in r["edits"]]
        new = edited(r["text"], spans)
        want[r["doc_id"]] = (count(r["text"]), len(spans), len(new), count(new))
        edits += len(spans)
    got = op2_token_counts(spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_edits"], r["edited_chars"], r["edited_tokens"]) for r in got} == want
    assert edits > 3


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "mail me@here.org now"), (5, "word " * 200_000 + "AKIA" + "A" * 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tree", "'x' as after")
    kept = tokens.with_trees(docs).withColumn("edits", tokens.edits_of(F.col("text")))
    done = tokens.recounted(kept, tree_col="_tree")
    assert done.columns == [*docs.columns, "_tree", "edits", "_after"]
    got = [(r["doc_id"], r["_after"]["text"], r["_after"]["tokens"]) for r in done.collect()]
    assert sorted((str(d), t[:20], n == count(t)) for d, t, n in got) == sorted(
        [("1", "", True), ("2", "", True), ("3", "a", True), ("3", "a", True), ("None", "mail <email> now", True), ("5", "word word word word ", True)]
    )
    none = kept.withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,text:string>>"))
    assert {r["_after"]["encoded"] for r in tokens.recounted(none, tree_col="_tree").collect()} == {0}
    assert tokens.with_trees(docs.limit(0)).count() == 0
    wrong = kept.withColumn("edits", F.expr("array(named_struct('start', 5, 'end', 9, 'text', 'x'))"))
    with pytest.raises(PythonException):
        tokens.recounted(wrong, tree_col="_tree").collect()
