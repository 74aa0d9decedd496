import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cinetrace.llm import divergence
from cinetrace.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "text string, lang string, source string"


def low(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def brute_counts(rows, least):
    docs, uses = Counter(), Counter()
    for text, lang, source in rows:
        terms = [low(t) for t in TERM.findall(text or "")]
        docs.update({(lang or "", t) for t in terms})
        uses.update((lang or "", source or "", t) for t in terms)
    return {k: n for k, n in uses.items() if docs[k[0], k[2]] >= least}


def brute(rows, least, top=10):
    uses = brute_counts(rows, least)
    groups = {(lang or "", source or "") for _, lang, source in rows}
    kept, total, whole = defaultdict(set), Counter(), Counter()
    for (lang, source, t), n in uses.items():
        kept[lang].add(t)
        total[lang, source] += n
        total[lang] += n
        whole[lang, t] += n

    def share(count, n, v):
        return 1 + 10**9 * (count + 2) // (n + 2 * v)

    def gap(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    for lang, source in groups:
        v = len(kept[lang])
        mine = {t: share(uses.get((lang, source, t), 0), total[lang, source], v) for t in kept[lang]}
        pairs = []
        for other in {s for x, s in groups if x == lang} - {source}:
            theirs = {t: share(uses.get((lang, other, t), 0), total[lang, other], v) for t in kept[lang]}
            pairs.append((other, sum(gap(mine[t], theirs[t]) for t in mine)))
        terms = []
        for t, p in mine.items():
            q = share(whole[lang, t], total[lang], v)
            if uses.get((lang, source, t), 0) and p > q:
                terms.append((t, gap(p, q)))
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def check(spark, rows, least=3, parts=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for name in ("chunk", "n", "docs", "term", "p", "total"):  # columns that clash with those of the operator
        df = df.withColumn(name, F.lit("mine"))
    got = divergence.audit(df, min_docs=least, **kw)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least)


def corpus(n=120, seed=3):
    r = random.Random(seed)
    words = ["The", "the,", "THE.", "naïve", "x-ray", "ray", "—", "12", "日本", "don't", "Ünit", "a b", "𝔘x"] + [f"w{i}q" for i in range(30)]
    out = []
    for i in range(n):
        lang, source = r.choice(["en", "de", None, ""]), "src0" if i % 3 == 0 else r.choice(["src1", "s2", None])
        out.append((r.choice([" ", "\n", "\t\x0b", " \r\n"]).join(r.choices(words, k=r.randint(0, 25))), lang, source))
    return out


def test_audit_equals_brute_force(spark):
    rows = corpus() + [(None, "fr", "s"), ("", "fr", "t"), ("x", "fr", "u"), ("lone", "it", "s"), (None, None, None)]
    check(spark, rows)
    check(spark, rows * 2, least=10)


def test_documents_are_told_apart_across_chunks(spark):
    # two documents with three spellings each, and three documents with one each
    rows = [("Word word, (word)", "en", "a")] * 2 + [(w, "en", "b") for w in ("other", "Other.", "'other'")]
    check(spark, rows, least=3)
    scratch = Scratch(spark, "test")
    counts = divergence.count_terms(spark.createDataFrame(rows, SCHEMA), scratch, 3)
    assert {(r["term"], r["n"]) for r in counts.collect()} == {("other", 3)}


def test_pieces_of_a_task_add_up(spark):
    check(spark, corpus(600), parts=2, piece=60)


def test_prints_that_fall_together_do_no_harm(spark):
    check(spark, corpus(60), bits=7)


def test_terms_in_many_blocks(spark):
    rows = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600) if i % (k + 1) == 0), "en", f"s{k}") for k in range(4)] * 3
    check(spark, rows)


def test_counts_beyond_64_bits_are_exact(spark):
    df = spark.range(1).select(divergence._share(F.lit(10**12), F.lit(3 * 10**12), F.lit(7)).alias("p"))
    assert df.first()["p"] == 1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 14)


def test_long_text_and_no_rows(spark):
    check(spark, [("many words " * 100_000 + "y" * 100_000, "en", "a")] * 3 + [("words", "en", "b")])
    check(spark, [])
