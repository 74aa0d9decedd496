import math
import random

import numpy as np

from cinetrace.llm import partcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = []
    for vec_id, v, label, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, m in members.items():
                books[p][e] = [sum(x) // len(m) for x in zip(*m)]
    out, by_label = [], {}
    for (vec_id, _, label), c in zip(kept, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((vec_id, "".join(f"{e:02x}" for _, e in best), error, label))
    digest = partcodes.digest([np.array(b, object) for b in books])
    return [(i, c, e, by_label[label], digest) for i, c, e, label in out]


def check(spark, rows, **kw):
    rows = [(*r, "mine", 7) for r in rows]
    got = partcodes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute(rows, **kw)))


def vectors(n, dims=64, seed=2, spread=0.15):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(dims)], r.choice([0, 1, None])) for i in range(n)]


def test_codes_equal_brute_force(spark):
    rows = vectors(300)
    bad = [(3000, None, 1), (3001, [None] * 64, 1), (3002, [math.nan] + [0.0] * 63, 1), (3003, [math.inf] + [0.0] * 63, 0)]
    check(spark, rows + bad + [(None, rows[5][1], None), (7, rows[9][1], 1), rows[11], rows[11]])


def test_few_rows_ties_and_equal_vectors(spark):
    check(spark, vectors(5))
    check(spark, [(i, [0.25, -0.0] * 16, 0) for i in range(100)])
    coarse = [(i, [math.floor(x * 8) / 8 for x in v], k) for i, v, k in vectors(200, 32, spread=0.2)]
    check(spark, coarse)
    check(spark, [(None, v, k) for _, v, k in vectors(70, 16)], entries=8, rounds=1)


def test_large_components_are_exact(spark):
    r = random.Random(4)
    check(spark, [(i, [r.uniform(-1e6, 1e6) for _ in range(16)], 0) for i in range(80)])


def test_odd_lengths_go_and_no_rows(spark):
    rows = vectors(80)
    odd = [(2000, [], 0), (2001, [1.0] * 15, 0), (-5, [1.0] * 3, 0), (2002, [1.0] * 32, 0)]
    df = lambda rows: spark.createDataFrame([(*r, "mine", 7) for r in rows], SCHEMA)
    got = partcodes.compress(df(rows + odd))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows))
    for none in ([], odd[:2], [(1, None, 0)]):
        assert partcodes.compress(df(none)).count() == 0


def test_errors_beyond_a_long_are_null(spark):
    rows = [(i, [1e12 * (i % 3), 1.0] * 8, 0) for i in range(200)]
    got = partcodes.compress(spark.createDataFrame([(*r, "mine", 7) for r in rows], SCHEMA), entries=1)
    assert {r["error"] for r in got.collect()} == {None}


def test_trie_walk_in_small_blocks(monkeypatch):
    monkeypatch.setattr(partcodes, "BLOCK", 3)
    r = np.random.default_rng(1)
    parts, _, n = partcodes._distinct(r.integers(-3, 3, (500, 4)).astype(float))
    assert n.sum() == 500
    book = r.integers(-3, 3, (9, 4)).astype(object)
    entry, distance = partcodes.nearest(parts, book)
    every = ((parts[:, None, :] - book[None].astype(float)) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
