import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmill import session
from gistmill.llm import bloom_lm
from gistmill.llm.bloom_lm import Bloom, Settings, level_starts

S = Settings(bits=24, hashes=12)  # next to no false members


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def by_hand(rows, s):
    """Exact counts; levels only round the counts of longer n-grams down."""
    counts = Counter()
    for key, text in rows:
        if not held_out(key):
            w = words(text)
            counts.update(tuple(w[i : i + n]) for n in range(1, s.order + 1) for i in range(len(w) - n + 1))
    starts = level_starts(s.base).tolist()
    total, types = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    floor = lambda c: max([x for x in starts if x <= c], default=0)
    out = []
    for key, text in rows:
        w = words(text)
        base = score = 0.0
        for i in range(len(w)):
            p = (counts[(w[i],)] + 0.5) / (total + 0.5 * (types + 1))
            base += math.log10(p)
            found = [counts[(w[i],)]]
            for n in range(2, min(s.order, i + 1) + 1):
                g = tuple(w[i - n + 1 : i + 1])
                h = counts[g[:-1]] if n == 2 else hist[-1][n - 2]
                if h:
                    c = min(floor(counts[g]), h, found[-1])
                    p = (c + s.mu * p) / (h + s.mu)
                else:
                    c = 0
                found.append(c)
            hist = [*([] if i == 0 else hist), found]
            score += math.log10(p)
        out.append((key, held_out(key), len(w), sum(counts[(x,)] > 0 for x in w), total, base, score))
    return out


def sample():
    r = random.Random(3)
    vocab = ["the", "The", "a", "of", "é", "語", "x1"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(vocab, [60, 10, 40, 30, 5, 5, 5] + [1] * 60, k=r.choice([0, 1, 2, 9, 70])))) for i in range(200)]
    rows += [(3, None), (None, "the end"), (11, "\t\n"), (12, "the of"), (12, "the of")]
    return rows + [(13, "z" * 5000 + " Z " + "the of " * 3000)]


def table(spark, rows):
    return spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, `a.b` string, score int")


def scored(spark, rows, s):
    docs = table(spark, rows).repartition(3)
    held = bloom_lm.is_held_out(F.col("doc_id"))
    model = bloom_lm.learn(docs.where(~held), settings=s)
    found = bloom_lm.score(docs, model).withColumn("held_out", held)
    return model, found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()


@pytest.mark.parametrize("order, broadcast, small", [(2, 1 << 28, 1 << 22), (3, 1 << 28, 500), (2, 0, 1 << 22), (3, 0, 500)])
def test_as_by_hand(spark, monkeypatch, order, broadcast, small):
    monkeypatch.setattr(bloom_lm, "SMALL", small)
    rows = sample()
    s = replace(S, order=order, broadcast=broadcast)
    model, got = scored(spark, rows, s)
    assert (model.segments > 1) == (small == 500) and model.tokens == got[0]["train_tokens"]
    key = lambda x: tuple(str(v) for v in x[:4]) + (round(x[5], 6),)
    got, want = sorted((tuple(r) for r in got), key=key), sorted(by_hand(rows, s), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_levels():
    starts = level_starts(1.25)
    assert starts[:8].tolist() == [1, 2, 3, 4, 5, 6, 7, 8] and starts[-1] >= 1 << 60 and len(starts) < 255
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    levels = rng.integers(1, 12, len(keys))
    bloom = Bloom.build(keys, levels, Settings())
    got = bloom.levels(keys)
    assert (got >= levels).all() and (got > levels).mean() < 0.03  # one-sided
    others = rng.integers(1 << 63, 1 << 64, 50_000, dtype=np.uint64)
    assert (bloom.levels(others) > 0).mean() < 0.02


def test_model_grows_with_the_corpus(spark):
    make = lambda n: spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.md5(F.col("id").cast("string")), F.lit("x")).alias("text"))
    small, large = (bloom_lm.learn(make(n)) for n in (200, 2000))
    assert 8 < large.bytes / small.bytes < 12


@pytest.mark.parametrize("broadcast", [1 << 28, 0])
def test_empty_tables(spark, broadcast):
    s = replace(S, broadcast=broadcast)
    none = table(spark, []).limit(0)
    assert bloom_lm.score(none, bloom_lm.learn(none, settings=s)).collect() == []
    got = bloom_lm.score(table(spark, [(1, "a b"), (2, None)]), bloom_lm.learn(none, settings=s)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got) == [(1, 0, 0, 0), (3, 0, 0, 0)]


def test_learned_order_scores_higher(spark):
    docs = table(spark, [(i, "one two three four") for i in range(50)])
    model = bloom_lm.learn(docs, settings=Settings(mu=4.0))
    found = bloom_lm.score(table(spark, [(1, "one two three four"), (2, "four three two one")]), model).collect()
    right, wrong = sorted(found, key=lambda r: r["doc_id"])
    assert right["score"] > wrong["score"] + 3 and right["base_score"] == pytest.approx(wrong["base_score"])
    assert right["score"] > right["base_score"]


def test_scoring_needs_little_beside_the_model():
    import tracemalloc

    texts = pa.array([" ".join(f"w{i * j % 997}" for i in range(300)) for j in range(4000)])
    look = lambda n, keys: np.ones(len(keys), np.int64)
    # the hash's table of powers is made once a process
    bloom_lm._scored_slices(texts[:1], look, 10, 10, bloom_lm.Settings())
    tracemalloc.start()
    bloom_lm._scored_slices(texts, look, 10, 10, bloom_lm.Settings())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6


def test_large_models_pass_small_batches(spark, monkeypatch):
    most, given = {}, spark.conf.get(session.BATCH_BYTES)

    def noted(df, label, **options):
        most[label] = int(spark.conf.get(session.BATCH_BYTES))
        return session.written(df, label, **options)

    monkeypatch.setattr(bloom_lm, "written", noted)
    docs = table(spark, sample())
    model = bloom_lm.learn(docs, settings=replace(S, broadcast=0))
    bloom_lm.score(docs, model).collect()
    assert len(most) == 3 and max(most.values()) <= 1 << 23
    assert spark.conf.get(session.BATCH_BYTES) == given


@pytest.mark.parametrize("group, asked, chunk, part", [(1, 1, 1, 1), (20_000, 50, 3000, 700), (1 << 22, 1 << 18, 3000, 1 << 20)])
def test_groups_of_segments_answer_as_a_broadcast_model(spark, monkeypatch, group, asked, chunk, part):
    for name, value in [("SMALL", 500), ("GROUP_BYTES", group), ("ASKED", asked), ("CHUNK_BYTES", chunk), ("SLICE_BYTES", part)]:
        monkeypatch.setattr(bloom_lm, name, value)
    rows = sample()[120:]
    model, want = scored(spark, rows, replace(S, order=3))
    split, got = scored(spark, rows, replace(S, order=3, broadcast=0))
    assert split.segments == model.segments > 8
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_a_chunk_needs_little(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(bloom_lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    texts = pa.array([" ".join(f"w{i * j % 9973}" for i in range(300)) for j in range(2000)])
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["id", "text"])
    chunks = list(bloom_lm._chunks(iter([docs])))
    assert [c.num_rows for c in chunks] == [1]
    asked = list(bloom_lm._ask(16, 4, 2)(iter(chunks)))
    assert sum(a.num_rows for a in asked) == 8  # four groups, words and pairs
    asked = sorted((r for a in asked for r in a.to_pylist()), key=lambda r: (r["segment"], r["n"]))
    asked = pa.RecordBatch.from_pylist(asked, schema=chunks[0].schema)
    told = [r for b in bloom_lm._answer(16, 4, 7)(iter([asked])) for r in b.to_pylist()]
    told = pa.RecordBatch.from_pylist(sorted(told, key=lambda r: (r["n"], r["segment"])), schema=chunks[0].schema)
    tracemalloc.start()
    out = list(bloom_lm._score_chunks(2, 10, 10, Settings())(iter([*chunks, told])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for b in out for i in b.column("id").to_pylist()] == list(range(len(texts)))
    assert peak < 30e6
