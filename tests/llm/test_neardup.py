import itertools
import random
import re

import numpy as np
import pytest

from cinetrace.llm import neardup


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """component of each row, by comparing all pairs of texts."""
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(
        ((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([6, 20, 60, 200]))] for _ in range(6)]
    rows = []
    for k in range(n):
        base = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, len(base) // 12])):
            base[rnd.randrange(len(base))] = rnd.choice(words)
        if rnd.random() < 0.2:
            base = base[: max(1, int(len(base) * rnd.uniform(0.7, 1)))]
        text = rnd.choice([" ", "\n", "\t "]).join(base)
        rows.append((k, text.upper() if rnd.random() < 0.2 else text))
    return rows


EDGES = [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (904, "One  two"), (905, "one two three"), (906, "ÀB")]


@pytest.mark.parametrize("block", [256, 5])
def test_components_equal_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", block)
    rows = corpus(3, 120) + EDGES + [(5, "again here"), (5, "again here"), (None, "again HERE"), (None, "all alone now")]
    df = docs(rows, ["set_key", "id", "kept", "root", "n_shingles"])
    got = neardup.groups(df).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_keep_one(docs):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (2, text + " end"), (2, text + " end"), (None, text), (7, None), (8, ""), (9, "other words"), (None, "lone")]
    df = docs(rows, ["id", "root", "best"])
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert kept == sorted([(2, text + " end"), (7, None), (8, ""), (9, "other words"), (None, "lone")], key=repr)


def test_no_rows(docs):
    assert neardup.groups(docs([])).count() == 0
    assert neardup.keep_one(docs([])).count() == 0


def test_one_very_long_text(docs):
    text = " ".join(f"x{i % 9973} y{i}" for i in range(150_000))
    got = neardup.groups(docs([(1, text), (2, text + " tail"), (3, "short one")])).collect()
    assert sorted((r[0], r[2]) for r in got) == [(1, 1), (2, 1), (3, 3)]


def test_small_sets_at_the_threshold_always_share_a_key():
    """20,000 pairs at or just above 0.75: the least shared shingle is among the first of both."""
    r = np.random.default_rng(3)
    for _ in range(20_000):
        n = int(r.integers(2, neardup.SMALL))
        common = r.integers(0, 2**63, n, dtype=np.uint64)
        more = int(r.integers(0, n // 3 + 1))  # 100 n >= 75 (n + more)
        one = int(r.integers(0, more + 1))
        a = np.unique(np.concatenate([common, r.integers(0, 2**63, one, dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, r.integers(0, 2**63, more - one, dtype=np.uint64)]))
        assert 100 * len(common) >= 75 * len(np.union1d(a, b))
        assert len(np.intersect1d(neardup.first_shingles(a), neardup.first_shingles(b)))


def test_short_texts_with_three_of_four_shingles(docs):
    """Seven and eight words: three of four shingles in common, each pair a group."""
    rows = []
    for i in range(400):
        words = [f"w{i}x{k}" for k in range(8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:7]))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(docs(rows)).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(400))
