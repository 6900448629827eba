import heapq
import random
from collections import Counter, defaultdict

from gistmill.llm.sharding import shard, take_least, with_shards


def heap_by_hand(sizes, shards):
    heap, out = [(0, k) for k in range(shards)], []
    for size in sorted(sizes, reverse=True):
        load, k = heapq.heappop(heap)
        out.append((size, k))
        heapq.heappush(heap, (load + size, k))
    return out


def test_equal_groups_in_bulk_as_by_heap():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 9)
        loads, size, count = [r.randrange(50) for _ in range(n)], r.randrange(1, 20), r.randrange(120)
        heap = [(x, k) for k, x in enumerate(loads)]
        heapq.heapify(heap)
        want = Counter()
        for _ in range(count):
            load, k = heapq.heappop(heap)
            want[k] += 1
            heapq.heappush(heap, (load + size, k))
        got = list(loads)
        taken = take_least(got, size, count)
        assert taken == [want[k] for k in range(n)]
        assert got == [x + size * t for x, t in zip(loads, taken, strict=True)]


def test_loads_and_slots(spark):
    r = random.Random(4)
    rows = [(i, "a" * r.randrange(300)) for i in range(400)] + [(900 + i, "same") for i in range(200)]
    rows += [(None, "nül"), (1, None), (2, ""), (2, ""), (3, "b" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as shard", "8 as cell")
    got = shard(docs, shards=5).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), size(t)) for d, t in rows)
    slots, loads, homes = defaultdict(list), Counter(), defaultdict(set)
    for x in got:
        slots[x["shard"]].append(x["slot"])
        loads[x["shard"]] += x["size"]
        homes[(x["text_crc32"], x["size"])].add(x["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += size(t)
    want = Counter()
    for s, k in heap_by_hand(groups.values(), 5):
        want[k] += s
    assert loads == want
    placed = with_shards(docs, shards=5)
    assert placed.columns == [*docs.columns, "_shard"] and placed.count() == len(rows)


def test_empty_table(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
