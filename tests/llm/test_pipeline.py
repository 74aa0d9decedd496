"""The pipeline stage by stage against plain versions, and all registered queries."""

import random

import pytest
from llm.test_lines import brute as plain_lines
from llm.test_neardup import brute as plain_groups

import __spark_entry__ as entry
import corpus_pipeline
from cinetrace.llm import catalog, decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(700)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    docs, labels = [], []
    for k in range(240):
        text = "\n".join(say(25) + "." for _ in range(3))
        if k % 4 == 0:
            text = " ".join(f"{w}$$$" for w in text.split())
        elif k % 9 == 1:
            text += "\nAll rights reserved here."
        elif k % 11 == 2:
            text += "\n" + items[k % 5][1]
        elif k % 7 == 3 and docs:
            text = docs[-2][1] + " tail"
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(k % 4 != 0), 0))
    docs += [(None, None, None, None, None), (500, "", "en", "s", 0), (1, docs[1][1], "en", "s1", docs[1][4])]
    pages = [(i, f"http://h/{i}", "<p>x</p>" * (i % 5)) for i in range(120)]
    for name, rows, ddl in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", items, "item_id long, text string"),
        ("pages", pages, "page_id long, url string, html string"),
    ):
        spark.createDataFrame(rows, ddl).write.parquet(f"{root}/{name}.parquet")
    return root


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = [sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        assert n == 4 or out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            seen.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
    raw, good, lines, single, clean = seen
    assert [r for r in good if r[0] is not None and r[0] < 240] == [r for r in raw if r[0] is not None and r[0] % 4]
    assert lines == [(k, t) for k, _, _, t in plain_lines(good)]
    least = {(k, c) for k, n, c in plain_groups(lines) if n and k == c} | {(k, k) for k, n, c in plain_groups(lines) if not n}
    assert [k for k, _ in single] == sorted((k for k, _ in least), key=repr)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    index = decontaminate.Index([(i, decontaminate.words_of(t.encode())) for i, t in items])
    assert clean == [r for r in single if not any(t in (r[1] or "") for _, t in items)] and len(clean) < len(single)
    assert len(index.classes) == 1
    last = docs.collect()
    assert sorted((r.doc_id for r in last), key=repr) == sorted((k for k, _ in clean), key=repr)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_run_and_empty_input(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(catalog.QUERIES) | {"pipeline"} <= set(names) and set(catalog.ORACLES) <= set(entry.oracle_sql())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", ["op2_benchmark_leaks", "op5_toxicity", "op6_byte_bpe", "op8_ppm_scores", "op9_line_labels"])
def test_query_columns(spark, tables, name):
    want = {
        "op2_benchmark_leaks": {"doc_id", "item_id", "first_word", "words", "similarity", "distance"},
        "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op6_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op8_ppm_scores": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op9_line_labels": {
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "content_words", "content_share",
        },
    }
    df = catalog.QUERIES[name](spark, tables)
    assert set(df.columns) == want[name]
    assert name == "op2_benchmark_leaks" or df.count() == 243


def test_bpe_digests(spark, tables):
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{tables}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest((r.text or "").encode())))
    got = catalog.QUERIES["op6_byte_bpe"](spark, tables).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
