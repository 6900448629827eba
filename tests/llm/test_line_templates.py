import random

import pytest
from pyspark.sql import functions as F

from gistmill.llm import line_templates as lt
from gistmill.llm.line_templates import Leaf, masked, without_recurring_lines


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row_key", "'y' as n_lines")
    got = without_recurring_lines(docs, **kw)
    assert got.columns == [*docs.columns, "kept_text", "_n_lines", "n_dropped"]
    return {(r["doc_id"], r["text"]): r for r in got.collect()}


def by_hand(rows, min_docs, depth=lt.DEPTH, similar=lt.SIMILAR):
    """One leaf after another, lines in the order of their hashes."""
    leaves, docs = {}, {}
    for d, text in set(rows):
        for line in (text or "").split("\n"):
            t = masked(line)
            if t:
                leaves.setdefault((len(t), *t[:depth]), {})[lt.line_of(t)] = t
                docs.setdefault(lt.line_of(t), set()).add((d, text))
    drop = set()
    for lines in leaves.values():
        leaf, groups = Leaf(similar), {}
        for h in sorted(lines):
            groups.setdefault(leaf.add(lines[h], h), []).append(h)
        for hs in groups.values():
            if len(set().union(*[docs[h] for h in hs])) >= min_docs:
                drop.update(hs)
    return {
        (d, text): None if text is None else "\n".join(
            x for x in text.split("\n") if not masked(x) or lt.line_of(masked(x)) not in drop
        )
        for d, text in rows
    }


def sample():
    r = random.Random(11)
    names, rows = ["ann", "bob", "eve", "joe", "kim"], []
    say = lambda n: " ".join(r.choice("abcdefghijklm") * 3 + str(r.randrange(3)) * 0 + r.choice("nopqrstuvw") for _ in range(n))
    for i in range(40):
        lines = [say(r.choice([1, 4, 9])) for _ in range(r.randrange(1, 6))]
        lines.append(f"Posted on 2024-01-{i:02d} by {r.choice(names)} at noon in the evening news today")
        if i % 3 == 0:
            lines.insert(0, "All rights reserved.")
        lines.append("")
        rows.append((i, "\n".join(lines)))
    return rows


def test_equals_parse_by_hand(spark):
    rows = sample() + [(90, None), (91, ""), (92, "\n\n"), (None, "All rights reserved.\nx y"), (93, "tok " * 100_000)]
    want = by_hand(rows, 5)
    got = run(spark, rows, min_docs=5)
    assert {k: r["kept_text"] for k, r in got.items()} == want
    assert got[(0, rows[0][1])]["n_dropped"] >= 2
    for (_, text), r in got.items():
        lines = 0 if text is None else len(text.split("\n"))
        assert r["_n_lines"] == lines
        if text is not None:
            assert lines - r["n_dropped"] == (len(r["kept_text"].split("\n")) if r["n_dropped"] < lines else 0)


def test_variable_fields_and_repeats_within_a_document(spark):
    rows = [(i, f"User {w} logged in from {i}.0.0.1 by {w}") for i, w in enumerate(["ann", "bob", "eve", "kim"])]
    rows = [(i, t.replace("User", "The user named")) for i, t in rows]
    rows += [(10, "spam line here now\n" * 9 + "end of it all")]
    got = run(spark, rows, min_docs=4)
    assert [got[x]["kept_text"] for x in rows[:4]] == [""] * 4
    assert got[rows[4]]["n_dropped"] == 0  # often, but in one document


def test_parts_of_a_leaf_meet_again(spark, monkeypatch):
    monkeypatch.setattr(lt, "PART", 3)
    r = random.Random(12)
    rows = [(i, "head of line " + " ".join(["same"] * 12) + " " + "".join(r.choice("abcdef") for _ in range(8))) for i in range(40)]
    got = run(spark, rows, min_docs=40)
    assert all(x["kept_text"] == "" for x in got.values())


@pytest.mark.parametrize("copies", [9, 10])
def test_threshold_counts_documents(spark, copies):
    rows = [(i, f"the very same line\nown words of {chr(97 + i) * 5} {chr(98 + i) * 4} {chr(99 + i) * 3}") for i in range(copies)]
    got = run(spark, rows)
    assert {x["n_dropped"] for x in got.values()} == {int(copies >= lt.MIN_DOCS)}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one line")] * 12 + [(2, "one line")], "doc_id long, text string")
    assert without_recurring_lines(docs, min_docs=3).agg(F.sum("n_dropped")).first()[0] == 0
    assert without_recurring_lines(docs.limit(0)).count() == 0


def test_lines_of_which_half_is_masked(spark):
    names = ["ann", "bob", "eve", "kim", "joe", "sue"]
    rows = [(i, f"2024-01-0{i + 1} 12:0{i} 10.0.0.{i} GET page {w} took {i}ms") for i, w in enumerate(names)]
    rows += [(20 + i, f"1 2 3 4 5 {w}") for i, w in enumerate(names)]  # share no word
    got = run(spark, rows, min_docs=6)
    assert [got[x]["kept_text"] for x in rows] == [""] * 6 + [t for _, t in rows[6:]]


def groups_by_pairs(texts, similar=lt.SIMILAR, depth=lt.DEPTH):
    """Every pair of lines compared."""
    lines = [masked(t) for t in texts]
    root = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            same = [x for x, y in zip(a, b) if x == y]
            if len(a) == len(b) and a[:depth] == b[:depth] and len(same) >= similar * len(a) and set(same) - {lt.VARIABLE}:
                root = [root[j] if x == root[i] else x for x in root]
    return [{j for j, x in enumerate(root) if x == root[i]} for i in range(len(lines))]


def test_groups_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(13)
    words = [[f"w{chr(97 + i)}{c}" for c in "abcdefghij"] for i in range(8)]
    texts = ["1 2 3 " + " ".join(r.choice(w[:3]) for w in words[: r.choice([2, 5, 8])]) for _ in range(120)]
    texts += ["1 2 3 " + " ".join(r.choice(w) for w in words[:6]) for _ in range(60)] + [f"1 2 3 far {w}" for w in "abcd"]
    texts = sorted(set(texts))
    want = groups_by_pairs(texts)
    sizes = {len(g) for g in want}
    assert min(sizes) == 1 and max(sizes) > 20
    want = [t if len(g) < 4 else "" for t, g in zip(texts, want)]
    rows = list(enumerate(texts))
    for part, pivots in ((2048, 64), (5, 0)):
        monkeypatch.setattr(lt, "PART", part)
        monkeypatch.setattr(lt, "PIVOTS", pivots, raising=False)
        got = run(spark, rows, min_docs=4)
        assert [got[x]["kept_text"] for x in rows] == want
