import re
from collections import Counter

from cinetrace.llm import lines

STRIP = " \t\n\x0b\f\r"


def brute(rows, least=10):
    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(STRIP))

    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for k, t in rows:
        own = (t or "").split("\n")
        stay = [x for x in own if not (key(x) and found[key(x)] >= least)]
        out.append((k, len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def check(docs, rows, **kw):
    df = docs(rows, ["n_lines", "gone", "line", "at"])
    got = lines.drop_frequent_lines(df, **kw)
    assert set(got.columns) == set(df.columns) | {"n_lines", "n_dropped"}
    found = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr)
    assert found == brute(rows)


def test_lines_equal_brute_force(docs):
    rows = [(i, f"Shared Line \nown {i}\n\n\tshared line \nrare {i // 9}\n") for i in range(30)]
    rows += [(30, None), (31, ""), (32, "SHARED LINE"), (None, "shared line\nx"), (None, None), (5, rows[5][1]), (33, "\n\n")]
    check(docs, rows)


def test_threshold_is_exact(docs):
    check(docs, [(i, "nine\nten" if i < 9 else "ten") for i in range(10)])


def test_repeats_in_one_text_count_once(docs):
    check(docs, [(1, "\n".join(["same"] * 50))])


def test_long_text_and_no_rows(docs):
    check(docs, [(1, "\n".join(f"line {i}" for i in range(50_000)))] + [(i, "line 7") for i in range(2, 14)])
    check(docs, [])
