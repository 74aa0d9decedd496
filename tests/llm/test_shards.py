import random
import zlib
from collections import Counter, defaultdict

import pytest

from cinetrace.llm import shards


def smallest_capacity(sizes, k):
    """Least capacity for at most k contiguous shards, by trying one after the other."""

    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= k

    c = 1
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("seed,k,bits", [(1, 4, 3), (2, 7, 2), (3, 5, 12), (4, 2, 4)])
def test_capacity_is_smallest(spark, seed, k, bits):
    rnd = random.Random(seed)
    groups = {rnd.randrange(2**63): rnd.randrange(1, 60) for _ in range(90)}
    df = spark.createDataFrame(sorted(groups.items()), "key long, size long")
    capacity, single, cuts = shards.plan(df, k, bits)
    rest = sorted((key, size) for key, size in groups.items() if key not in single)
    assert capacity == smallest_capacity([s for _, s in rest], k - len(single))
    loads = Counter()
    for key, size in rest:
        loads[sum(key >= c for c in cuts)] += size
    assert max(loads.values()) == capacity and len(loads) <= k - len(single)


def test_large_groups_stand_alone(spark):
    df = spark.createDataFrame([(i, 10) for i in range(50)] + [(60, 5000), (70, 900)], "key long, size long")
    capacity, single, cuts = shards.plan(df, 6, 4)
    assert sorted(single) == [60, 70] and capacity == 130 and len(cuts) == 3


def rows_of(docs, rows, **kw):
    return [r.asDict() for r in shards.assign(docs(rows, ["size", "key", "shard", "stretch", "law"]), **kw).collect()]


def test_assignment(docs):
    rows = [(i, f"text {i % 150} " * (1 + i % 7)) for i in range(400)]
    rows += [(None, None), (1, ""), (None, "text"), (5, rows[5][1]), (500, "é" * 3000)]
    got = rows_of(docs, rows, shards=8)
    assert len(got) == len(rows)
    want = sorted(((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_few_or_no_rows(docs):
    assert rows_of(docs, []) == []
    assert [r["slot"] for r in rows_of(docs, [(1, "a")])] == [0]
    got = rows_of(docs, [(i, "same") for i in range(30)])
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(30))
