import random

import numpy as np
import pytest

from cinetrace.llm import decontaminate, merkle


@pytest.fixture
def archive(spark):
    rows = [(f"f{i % 7}", 900 * (i // 7), i, bytes([i % 251]) * 700) for i in range(600)]
    return spark.createDataFrame(rows, "file string, offset long, record_id long, record binary")


def test_audit_finds_each_damage(spark, archive):
    rows = {(r["file"], r["offset"], r["record_id"]): bytes(r["record"]) for r in archive.collect()}
    other = dict(rows)
    keys = sorted(rows)
    other[keys[3]] = b"x" + other[keys[3]][1:]
    other[keys[200]] = other[keys[200]][:100]
    del other[keys[77]]
    other[("f9", 0, 5000)] = b"new"
    right = spark.createDataFrame([(*k, v) for k, v in other.items()], archive.schema)
    got = merkle.audit(merkle.leaves(archive), merkle.leaves(right)).collect()
    found = {((r["file"], r["offset"], r["record_id"]), r["kind"], r["length"], r["other_length"]) for r in got}
    assert found == {
        (keys[3], "differs", 700, 700),
        (keys[200], "differs", 700, 100),
        (keys[77], "missing", 700, None),
        (("f9", 0, 5000), "extra", None, 3),
    }


def test_sound_replicas_and_no_records(archive):
    leaves = merkle.leaves(archive)
    assert merkle.audit(leaves, merkle.leaves(archive.orderBy("record"))).count() == 0
    assert merkle.audit(leaves.limit(0), leaves.limit(0)).count() == 0
    assert merkle.audit(leaves, leaves.limit(0)).filter("kind = 'missing'").count() == 600


def test_archive_of_odd_pages(spark):
    rows = [(1, "u", "<p>"), (1, "u", "<p>"), (None, None, None), (2, None, "x" * 300_000), (700, "v", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS file", "1 AS offset")
    got = merkle.archive(pages).collect()
    assert len(got) == 5 and {r["file"] for r in got} == {"segment-0000000000", "segment-0000000001", "segment-none"}
    for name in {r["file"] for r in got}:
        own = sorted((r["offset"], len(r["record"])) for r in got if r["file"] == name)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_blocks_find_all_within_the_radius():
    rnd = np.random.default_rng(8)
    prints = rnd.integers(0, 2**64, 40, dtype=np.uint64)
    windows = prints[rnd.integers(0, 40, 500)].copy()
    for i in range(500):
        for bit in rnd.choice(64, rnd.integers(0, 12), replace=False):
            windows[i] ^= np.uint64(1) << np.uint64(bit)
    own = decontaminate._Class(8, prints, np.arange(40), np.zeros(40, int))
    got = {(int(w), int(e)) for w, e, _ in zip(*own.near(windows))}
    d = np.bitwise_count(windows[:, None] ^ prints[None, :])
    assert got == {tuple(x) for x in np.argwhere(d <= decontaminate.RADIUS).tolist()}


def test_fingerprint_is_the_majority_of_bits():
    words = np.random.default_rng(2).integers(0, 2**64, 50, dtype=np.uint64)
    for at, f in enumerate(decontaminate.fingerprints(words, 9)):
        bits = np.unpackbits(words[at : at + 9].view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        assert f == np.packbits(bits.sum(0) * 2 > 9).view(np.uint64)[0]


def test_leaks_against_all_windows(spark, docs):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, say(n)) for i, n in enumerate([8, 12, 19, 33, 40, 57, 57, 90])] + [(50, say(4))]
    rows, truth = [], set()
    for k in range(160):
        body = say(rnd.randrange(0, 150))
        if k % 2:
            i, item = rnd.choice(items[:8])
            own = list(item)
            if k % 6 == 1 and len(own) >= 40:
                own[rnd.randrange(len(own))] = "changed"
            at = rnd.randrange(len(body) + 1)
            body[at:at] = own
        rows.append((k, " ".join(body)))
        own = decontaminate.words_of(rows[-1][1].encode())
        for i, item in items[:8]:
            w, n = decontaminate.words_of(" ".join(item).encode()), len(item)
            if len(own) >= 5 and max(
                decontaminate.similarity(decontaminate.bag(own[p : p + n]), decontaminate.bag(w))
                for p in range(max(1, len(own) - n + 1))
            ) >= 0.75:
                truth.add((k, i))
    edges = [(None, None), (700, ""), (701, "a b"), (1, rows[1][1])]
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items] + [(60, None), (61, "")], "item_id long, text string")
    df = docs(rows + edges, ["item_id", "similarity", "id"])
    got = decontaminate.find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth and len(got) == len(truth) + 1
    clean = decontaminate.without_leaks(df, bench)
    dirty = {k for k, _ in truth}
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {k for k, _ in rows + edges if k not in dirty}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs([]), bench).count() == 0


@pytest.mark.parametrize("size", [8, 12, 18, 27, 28, 40])
def test_no_edit_within_the_similarity_hides_a_leak(size):
    rnd = np.random.default_rng(size)
    say = lambda n: rnd.integers(0, 2**64, n, dtype=np.uint64)
    items = [(k, say(size)) for k in range(2)]
    index = decontaminate.Index(items)
    docs, truth = [], []
    for k, item in items:
        for at in range(size):
            for far in (0, 1, size - 1):
                own = item.copy()
                own[[at, (at + far) % size]] = say(2)
                if far == 1:  # a word left out
                    own = np.delete(own, at)
                docs.append(np.concatenate([say(9), own, say(int(rnd.integers(0, 9)))]))
                whole = docs[-1]
                best = max(
                    decontaminate.similarity(decontaminate.bag(whole[p : p + size]), decontaminate.bag(item))
                    for p in range(len(whole) - 4)
                )
                truth.append({k} if best >= 0.75 else set())
    assert any(truth) or size < 11
    assert [{m[0] for m in own} for own in index.matches(docs)] == truth


def test_short_items_are_found_word_for_word(spark, docs):
    """Items of one to seven words: every place is found, and only exact ones."""
    france = "what is the capital of France ?"
    bench = spark.createDataFrame(
        [(1, france), (2, "yes"), (3, "a b c d"), (4, "one two three four five"), (5, "ONE two three four five")], "item_id long, text string"
    )
    rows = [
        (1, f"Quiz: {france.upper()} Paris ."),
        (2, "what is the capital of Spain ?"),
        (3, "well yes , of course"),
        (4, " YES\n"),
        (5, "x a b c d y a b c d"),
        (6, "zero one two three four five six"),
        (7, "one two three four 5"),
        (8, " ".join(f"w{i}" for i in range(60_000)) + " " + france),  # a very long text
        (9, None),
        (10, "a b c"),
    ]
    found = decontaminate.find_leaks(docs(rows), bench).collect()
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["words"], r["similarity"], r["distance"]) for r in found}
    assert got == {
        (1, 1, 1, 7, 1.0, 0), (3, 2, 1, 1, 1.0, 0), (4, 2, 0, 1, 1.0, 0), (5, 3, 1, 4, 1.0, 0),
        (6, 4, 1, 5, 1.0, 0), (6, 5, 1, 5, 1.0, 0), (8, 1, 60_000, 7, 1.0, 0),
    }
    kept = {r["doc_id"] for r in decontaminate.without_leaks(docs(rows), bench).collect()}
    assert kept == {2, 3, 5, 7, 9, 10}
