import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from gistmill.llm import decontam
from gistmill.llm.decontam import contained_items, decontaminated, hits

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def shingle_set(text, k=5):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({("", *w)} if w else set())


def by_hand(docs, items):
    out = []
    for d, t in docs:
        own = shingle_set(t)
        for i, s in sorted(set(items), key=str):
            want = shingle_set(s)
            if want and 100 * len(own & want) >= 80 * len(want):
                out.append((d, i, len(own & want), len(want)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' as found", "1 as item_id"), spark.createDataFrame(
        items, ITEMS
    )


def sample():
    r = random.Random(10)
    say = lambda n: [r.choice(["alpha", "Beta", "gamma", "dëlta", "eps", "7"]) + str(r.randrange(60)) for _ in range(n)]
    items = [(i, " ".join(say(r.choice([3, 5, 6, 9, 20, 60])))) for i in range(40)]
    docs = []
    for i in range(60):
        words = say(r.choice([0, 2, 30, 400]))
        for _ in range(r.randrange(3)):
            passage = r.choice(items)[1].upper().split(" ")
            for _ in range(r.choice([0, 0, 1, 3])):
                passage[r.randrange(len(passage))] = "changed"
            at = r.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((i, ", ".join(words)))
    return docs, items


def test_equals_exact_containment(spark, monkeypatch):
    docs, items = sample()
    docs += [(100, None), (101, ""), (102, "!?"), (103, items[0][1]), (103, items[0][1]), (None, items[1][1]), (104, " ".join(t for _, t in items) * 20)]
    items += [(50, None), (51, ""), (52, "--"), (53, "one two"), items[2], (2, "another text of the same id here")]
    docs += [(105, "One, two."), (106, "one two three"), (107, "z" * 2_000_000 + " " + items[5][1])]
    want = by_hand(docs, items)
    assert len(want) > 30
    for chars in (10**6, 300):  # one block of items, and many
        monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
        got = hits(*tables(spark, docs, items)).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_columns_and_rows_kept(spark):
    docs, items = sample()
    d, b = tables(spark, docs, items)
    kept = decontaminated(d, b)
    assert kept.columns == d.columns
    gone = {x[0] for x in by_hand(docs, items)}
    assert {r[0] for r in kept.collect()} == {i for i, _ in docs} - gone
    assert contained_items(d, b).columns == [*d.columns, "_found"]


def test_empty_tables(spark):
    docs, items = sample()
    d, b = tables(spark, docs, items)
    assert decontaminated(d, b.limit(0)).count() == len(docs)
    assert decontaminated(d.limit(0), b).count() == 0 and hits(d, b.where(F.lit(False))).count() == 0


def test_short_items_inside_documents(spark, tmp_path):
    items = [(1, "Who wrote Hamlet?"), (2, "word"), (3, None), (4, "!"), (5, "one two three four five"), (6, "x y")]
    docs = [(1, "so, who WROTE hamlet and when"), (2, "a Word."), (3, "who wrote it, Hamlet"), (4, "x, y"), (5, "y x"), (6, "wrote hamlet")]
    docs += [(7, "then one two three four five six"), (8, None), (9, "!"), (10, "who wrote hamlet"), (11, "words")]
    want = [(1, 1, 1, 1), (2, 2, 1, 1), (4, 6, 1, 1), (7, 5, 1, 1), (10, 1, 1, 1)]
    d, b = tables(spark, docs, items)
    assert sorted(map(tuple, hits(d, b, inside=True).collect())) == want
    b.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.benchmark_free(spark, d, str(tmp_path))
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [3, 5, 6, 8, 9, 11]
