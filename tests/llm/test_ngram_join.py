import random
import re

import numpy as np
import pytest

from gistmill.llm.ngram_join import Threshold, ngram_groups, one_of_each, tree_links


def shingle_set(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups_by_hand(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = {}
    for g, (d, _) in zip(group, rows, strict=True):
        ids[g] = min([x for x in (ids.get(g), d) if x is not None], default=None)
    return sorted(
        ((d, len(s), ids[g] if s else d) for (d, _), s, g in zip(rows, sets, group, strict=True)), key=str
    )


def texts_with_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 3, 5, 12, 40, 150]))]
        rows.append(base)
        for _ in range(r.choice([0, 1, 4])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_groups_equal_those_by_hand(spark, k, num):
    rows = texts_with_copies(k)
    rows += [(None, rows[0][1]), (700, None), (701, ""), (702, " \t\n"), (703, "ONE two"), (704, "one\ttwo"), (705, "two one")]
    rows += [rows[3], rows[3], (800, "long " * 3), (801, "y" * 70_000 + " z a b c"), (802, "y" * 70_000 + " z a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "'x' as row_key", "1 as node", "'k' as key")
    found = ngram_groups(docs, words=k, num=num).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == groups_by_hand(rows, k, num, 100)


def test_many_copies_and_a_crowded_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(700):  # more sets than a block holds, each with one other word
        w = list(base)
        w[i % 120] = f"x{i}"
        rows.append((1000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_groups(docs).collect()
    assert len(found) == 1000 and {r["component_id"] for r in found} == {0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_groups(docs).count() == 0
    assert one_of_each(docs).columns == ["doc_id", "text"]


def test_one_of_each_keeps_the_smallest(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(5, t, "a"), (2, t, "b"), (None, t, "c"), (7, "", "d"), (8, None, "e"), (2, t, "b"), (9, "other words here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    kept = one_of_each(docs, words=5, num=80)
    assert kept.columns == docs.columns
    assert sorted((r[0], r[2]) for r in kept.collect()) == [(2, "b"), (7, "d"), (8, "e"), (9, "f")]


def test_linked_sets_share_a_key():
    r = np.random.default_rng(1)
    for num in (80, 90):
        t = Threshold(num, 100)
        for n in [1, 2, 3, 5, 9, 20, 60, 300, 2000]:
            for _ in range(30):
                a = np.unique(r.integers(0, 2**63, n, np.uint64))
                gone = r.integers(0, t.apart(2 * n) + 1)
                kept = r.permutation(a)[min(gone, len(a) - 1) // 2 :]
                b = np.unique(np.concatenate([kept, r.integers(0, 2**63, gone - gone // 2, np.uint64)]))
                if t.linked(a, b):
                    assert np.isin(t.keys(a), t.keys(b)).any()
                    share = r.random()  # any elements may be common
                    both = np.union1d(a, b)
                    common = both[r.random(len(both)) < share]
                    assert np.isin(t.keys(a, common), t.keys(b, common)).any()


def test_trees_find_all_links():
    r = np.random.default_rng(2)
    t = Threshold(80, 100)
    base = [np.unique(r.integers(0, 2**63, 60, np.uint64)) for _ in range(6)]
    sets = []
    for b in base:
        for _ in range(20):
            keep = r.permutation(b)[r.integers(0, 9) :]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**63, r.integers(0, 6), np.uint64)])))

    def parts(links):
        g = list(range(len(sets)))
        for a, b in links:
            g = [g[a] if x == g[b] else x for x in g]
        return {frozenset(i for i, x in enumerate(g) if x == y) for y in g}

    everything = [(i, j) for i in range(len(sets)) for j in range(i) if t.linked(sets[i], sets[j])]
    assert parts(tree_links(sets, None, t)) == parts(everything)
    across = [(i, j) for i in range(50) for j in range(50, len(sets)) if t.linked(sets[i], sets[j])]
    assert parts(tree_links(sets[:50], sets[50:], t)) == parts(across)
