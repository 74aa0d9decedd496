import random
import re

import pytest

from cinetrace.llm import licences

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, phrases=BASE):
    words = words_of(text)
    found = []
    for phrase, label in phrases.items():
        want = phrase.split()
        found += [(label, i) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), sorted(found, key=lambda x: (x[1], x[0]))


def check(docs, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = licences.scan(docs(rows, ["labels", "id", "score", "places"]))
    assert len(rows) == got.count()
    for r in got.collect():
        n, places = brute(texts[r["doc_id"]])
        starts = [at for _, at in places]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for x, _ in places}))
        assert sorted((p["label"], p["word"]) for p in r["places"]) == sorted(places)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_places_equal_brute_force(docs):
    r = random.Random(5)
    bits = "GNU general public License gnu-general Apache license, cc by CC-BY mit MIT\nlicense é licenseé 12 the under licensed".split(" ")
    texts = [" ".join(r.choices(bits, k=r.randint(0, 60))) for _ in range(300)]
    check(docs, texts + [None, "", "cc", "CC BY", "cc by cc by by cc", "gnu gnu general public license", "cc—by", "CC BY"])


def test_stretches_of_a_long_text(docs, monkeypatch):
    monkeypatch.setattr(licences, "SPAN", 7)
    texts = ["x " * n + "GNU General  Public\n\nLicense cc by mit license" for n in range(12)]
    for t in texts:
        report = licences.read(t.encode())
        n, places = brute(t)
        assert (report.n_words, sorted(report.base)) == (n, sorted(places))


def test_very_long_text_and_no_rows(docs):
    check(docs, ["word " * 500_000 + "Apache License", "y" * 3_000_000, "cc by " * 100_000, "SPDX-License-Identifier: " + "MIT OR " * 50_000])
    check(docs, [])


def test_all_phrases_equal_brute_force():
    phrases = {p: k for k, p in enumerate(licences._phrases())}
    r = random.Random(7)
    vocabulary = sorted({w for p in phrases for w in p.split()})
    for _ in range(200):
        text = " ".join(r.choice([r.choice(vocabulary), *r.sample(list(phrases), 1)]) for _ in range(30))
        places = [p for p in licences.AUTOMATON.scan(text.encode()) if not isinstance(p, int)]
        assert len(places) == len(brute(text, phrases)[1])


def plain(tokens):
    """Openness by recursive descent, with its own precedence rules."""

    def either():
        out = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            out = max(out, both())
        return out

    def both():
        out = single()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            out = min(out, single())
        return out

    def single():
        if tokens[0] == "(":
            tokens.pop(0)
            out = either()
            tokens.pop(0)
        else:
            out = licences.OPENNESS.get(licences.identify(tokens.pop(0)), licences.PERMISSIVE)
        while tokens and tokens[0] == "with":
            del tokens[:2]
            out = max(out, (out + licences.PERMISSIVE) / 2)
        return out

    return either()


def expression(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        out = [r.choice(["mit", "gpl-2.0-only", "agpl-3.0", "cc0-1.0", "lgpl-2.1+", "cc-by-nc-4.0"])]
        return out + ["with", "classpath-exception-2.0"] if r.random() < 0.3 else out
    inner = expression(r, depth - 1) + [r.choice(["and", "or"])] + expression(r, depth - 1)
    return ["(", *inner, ")"] if kind < 0.65 else inner


def test_expressions_equal_recursive_descent():
    r = random.Random(11)
    for _ in range(500):
        tokens = expression(r, 4)
        text, value = licences.evaluate(" ".join(tokens).upper().encode())
        assert value.openness == plain(list(tokens))
        assert text == " ".join(tokens).replace("( ", "(").replace(" )", ")")
        labels = {licences.identify(t) for i, t in enumerate(tokens) if t not in ("and", "or", "with", "(", ")") and tokens[i - 1] != "with"}
        assert value.labels == labels


@pytest.mark.parametrize(
    "text, labels, found",
    [
        ("SPDX-License-Identifier: MIT", "mit", ["mit"]),
        ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */ GPL-2.0", "apache,bsd,mit", ["(mit or apache-2.0) and bsd-3-clause"]),
        ("spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl", ["gpl-2.0-only with classpath-exception-2.0"]),
        ("SPDX-License-Identifier: MIT AND", "mit", ["mit"]),
        ("SPDX-License-Identifier: ((MIT OR", "mit", ["mit"]),
        ("SPDX-License-Identifier: mitten", "", []),
        ("Licensed under the Apache License, Version 2.0 or the MIT license, at your option.", "apache,mit", ["apache or mit"]),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", ["cc-by-nc"]),
        ("licensed under (GNU GPL or the GNU Lesser General Public License) and MIT", "gpl,lgpl,mit", ["(gpl or lgpl) and mit"]),
        ("All rights reserved.", "proprietary", []),
        ("Permission is hereby granted, free of charge, to any person", "mit", []),
        ("the cat sat under a tree and a mitten or two", "", []),
    ],
)
def test_tags_leads_and_notices(text, labels, found):
    report = licences.read(text.encode())
    assert ",".join(sorted(report.labels)) == labels
    assert [t for t, _ in report.expressions] == found
    assert (report.score > 0) == bool(labels)


def test_repeated_rows_null_ids_and_bad_bytes(spark, docs):
    got = licences.scan(docs([(None, "mit license"), (None, "mit license"), (1, "mit license")]))
    assert [r["n_base"] for r in got.collect()] == [1, 1, 1]
    assert licences.read(b"mit \xff license mit license").base == [("mit", 3)]
