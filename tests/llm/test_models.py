"""Toxicity, quality, line labels: parts by brute force, models by held-out accuracy."""

import itertools
import math
import random

import numpy as np
import pytest

from cinetrace.llm import linecrf, quality, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(5)
    words = {"bramble": 2.0, "bramblewood": 3.0, "clod": 1.5, "clodhopper": 2.5, "tarnish": 1.0}
    auto = toxicity.Automaton(words, {})
    for _ in range(4000):
        w = list(rnd.choice(list(words)))
        for _ in range(rnd.randrange(4)):
            i = rnd.randrange(1, len(w) + 1)
            w[i : i + rnd.randrange(2)] = rnd.choice(["", "x", "o", "ll"])
        w = "".join(w)
        want = [(d, -v) for t, v in words.items() if (d := distance(t[1:], w[1:])) <= toxicity.slack(t) and t[0] == w[0]]
        found = auto.match(w)
        assert (found is None) == (not want), w
        if want:
            assert (found[1], -found[0]) == min(want), w


def test_stems_and_marks():
    model = toxicity.Model({"bramble": 2.0}, {"snarl": 1.0})
    assert model.of_word("Snarling!!") == (1.0, 0) and model.of_word('"BRAMBLE,') == (2.0, 0)
    assert model.of_word("brambel") is None and model.of_word("bramblle") == (2.0, 1) and model.of_word("---") is None
    spans = model.spans('they said "you bramble fool" and left . bramble !')
    assert [(s[0], s[3]) for s in spans] == [(3, True), (8, False)]
    assert model.spans("") == []


def test_first_letters_and_words_below_stems_bear_edits():
    words, stems = toxicity.lexicon([("snarling", 5, 2.0), ("snar*", 9, 1.0), ("bramble", 5, 2.0)])
    assert set(words) == {"snarling", "bramble"} and set(stems) == {"snar"}
    auto = toxicity.Automaton(words, stems)
    assert [auto.match(w) for w in ("xramble", "ramble", "xbramble")] == [(2.0, 1)] * 3
    assert auto.match("snrling") == auto.match("znarling") == (2.0, 1) and auto.match("snarls") == (1.0, 0)
    for w in map("".join, itertools.product("bx", "bra", ["ramble", "amble", "mble"])):
        d = min(distance(t, w) for t in ["bramble"])
        assert (auto.match(w) is not None) == (d <= 1), w


def toxic_rows():
    rnd = random.Random(7)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for k in range(400):
        words = [rnd.choice(plain) for _ in range(40)]
        bad = k % 4 == 0
        for _ in range(3 * bad):
            words[rnd.randrange(40)] = rnd.choice(["grobble", "snarkish", "Grobble!", "vilestuff"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad or k % 8 == 0), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(rows), lab)
    extra = [(None, None), (1000, ""), (1001, "grobbel nonsense grobblle"), (4, rows[4][1]), (1002, "x" * 200_000)]
    got = toxicity.score(docs(rows + extra, ["score", "matches", "lang"]), model)
    got = got.withColumn("held", toxicity.held_out(got["doc_id"])).collect()
    toxic = {k: t for k, _, t in labels}
    held = [r for r in got if r["held"] and r["doc_id"] in toxic]
    assert held and all(r["predicted"] == toxic[r["doc_id"]] for r in held)
    other = {r["doc_id"]: r for r in got if r["doc_id"] not in toxic}
    assert other[1001]["predicted"] == 1 and not any(other[k]["predicted"] for k in (None, 1000, 1002))
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows) + len(extra)


def test_models_without_rows(spark, docs):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs([(1, "a b")]), toxicity.train(docs([]), lab)).first()["predicted"] == 0
    assert quality.grade(docs([(1, "a b"), (2, None)]), quality.train(docs([]), lab)).count() == 2
    assert linecrf.judge(docs([(1, "a b"), (2, None)]), linecrf.train(docs([]), lab)).filter("kept").count() == 0


def test_quality_by_held_out_accuracy(spark, docs):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for k in range(300):
        own = [rnd.choice(words) for _ in range(30)]
        if k % 3 == 0:
            own = [f"{w.upper()}!!" for w in own]
        rows.append((k, " ".join(own)))
        labels.append((k, int(k % 3 != 0), 0))
    lab = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    edges = [(None, None), (900, ""), (901, "one"), (3, rows[3][1])]
    got = quality.grade(docs(rows + edges, ["accepted", "p_good"]), quality.train(docs(rows), lab)).collect()
    assert len(got) == len(rows) + len(edges)
    held = [r for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 300]
    assert all(r["accepted"] == (r["doc_id"] % 3 != 0) for r in held)
    assert all(r["p_best"] <= r["p_good"] + 1e-12 and 0 <= r["expected_grade"] <= 2 for r in got)


def test_ordinal_gradient_orders_thresholds():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=400)
    grades = np.digitize(x + rnd.normal(scale=0.3, size=400), [-0.5, 0.7])
    model = quality.fit(np.arange(401), np.zeros(400, np.int64), x, grades)
    assert model.weights[0] > 1 and model.thresholds[0] < model.thresholds[1]
    assert abs(model.thresholds[0] / model.weights[0] + 0.5) < 0.2


def best_path(chain, scores):
    best = None
    for path in itertools.product((1, 0), repeat=len(scores)):
        s = sum(scores[i] * p for i, p in enumerate(path)) + sum(chain.steps[a, b] for a, b in zip(path, path[1:]))
        if best is None or s > best[0] + 1e-12:
            best = (s, path)
    return best[0]


def test_viterbi_equals_all_paths():
    rnd = np.random.default_rng(3)
    chain = linecrf.Chain(rnd.normal(size=linecrf.FEATURES), rnd.normal(size=(2, 2)))
    rows = [rnd.integers(0, 1 << linecrf.FEATURES, n) for n in (1, 7, 4, 9, 1, 2)]
    for bits, labels in zip(rows, linecrf.viterbi(chain, rows)):
        scores = linecrf._emissions(chain, bits)
        own = sum(scores[labels == 1]) + sum(chain.steps[a, b] for a, b in zip(labels, labels[1:]))
        assert own == pytest.approx(best_path(chain, scores))
    assert linecrf.viterbi(chain, []) == []


def base_by_hand(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\f\r"):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_line_labels(spark, docs):
    rnd = random.Random(2)
    good = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(12)).capitalize() + "."
    bad = lambda: " ".join(f"w{rnd.randrange(500)}###" for _ in range(12))
    rows = [(k, "\n".join((bad if k % 3 == 0 else good)() for _ in range(6))) for k in range(240)]
    lab = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(150)], "doc_id long, quality int, toxic int")
    edges = [(None, None), (900, ""), (901, "\n\n"), (902, "a b c\na b c\né €x a b c"), (903, "one two " * 30_000), (3, rows[3][1])]
    got = linecrf.judge(docs(rows + edges, ["kept", "n_words"]), linecrf.train(docs(rows), lab)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got:
        if r["doc_id"] != 903:
            assert tuple(r[n] for n in names) == base_by_hand(r["text"]), r["text"]
    by = {r["doc_id"]: r for r in got}
    assert by[903]["n_words"] == by[903]["n_repeat_words"] == 60_000 and by[903]["base_failed"]
    assert all(by[k]["kept"] == (k % 3 != 0) for k in range(150, 240)) and not by[None]["kept"]


def test_long_labelled_documents_reach_the_fit(docs, monkeypatch):
    """A document of 1,000 lines is trained as spans, and labels without a document take no place in the sample."""
    taken = []
    real = linecrf.fit
    monkeypatch.setattr(linecrf, "fit", lambda bits, marks: taken.append([len(b) for b in bits]) or real(bits, marks))
    rows = [(1, "\n".join(f"line {i} of a long text" for i in range(1000))), (2, "short\ntext"), (3, None)]
    lab = docs([]).sparkSession.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)] + [(k, 1, 0) for k in range(100, 200)], "doc_id long, quality int, toxic int")
    linecrf.train(docs(rows), lab)
    assert sorted(taken[0]) == [2, 200, 400, 400]
    linecrf.train(docs(rows), lab, max_labelled=3)  # the first span of each document before others
    assert sorted(taken[1])[:2] == [2, 400] or sorted(taken[1]) == [2, 200, 400]
    assert len(taken[1]) == 3


def test_ordinal_fit_follows_the_likelihood_of_plain_loops(monkeypatch):
    """A few steps of the fit against the same steps along differences of the penalised likelihood, row by row."""
    size, steps = 12, 4
    monkeypatch.setattr(quality, "BUCKETS", size)
    monkeypatch.setattr(quality, "EPOCHS", steps)
    rnd = np.random.default_rng(5)
    rows = [rnd.choice(size, rnd.integers(1, 6), replace=False) for _ in range(25)]
    values = [rnd.random(len(r)) for r in rows]
    grades = rnd.integers(0, 3, 25)

    def loss(p):
        """Minus the mean log-likelihood of the grades plus the penalty; p: weights, first cut, log of the step."""
        w, cuts = p[:size], [p[size], p[size] + math.exp(p[size + 1])]
        total = 0.0
        for row, x, g in zip(rows, values, grades):
            score = sum(w[j] * v for j, v in zip(row, x))
            reach = [1.0] + [1 / (1 + math.exp(c - score)) for c in cuts] + [0.0]
            total -= math.log(reach[g] - reach[g + 1])
        return total / len(rows) + quality.DECAY / 2 * sum(v * v for v in w)

    p = np.array([0.0] * size + [-0.5, 0.0])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        g = np.array([(loss(p + e) - loss(p - e)) / 2e-5 for e in np.eye(len(p)) * 1e-5])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        p = p - quality.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    got = quality.fit(starts, np.concatenate(rows), np.concatenate(values), grades)
    assert got.weights == pytest.approx(p[:size], abs=1e-4)
    assert got.thresholds == pytest.approx([p[size], p[size] + math.exp(p[size + 1])], abs=1e-4)
