"""Scores against SQLite's full-text search."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from cinetrace.operators import search as se

WORDS = "dog cat feeder keys black table quokka savanna lion tree café run-down 42".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(7)
    kinds = ["transcript", "caption", "detection", "event"]
    rows = [
        (1, f"d{i:03d}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 12))), rnd.choice(kinds), rnd.randrange(0, 90_000, 1000), i)
        for i in range(60)
    ]
    docs = spark.createDataFrame(rows, "run_id long, doc_id string, content string, source_type string, timestamp_ms long, frame_idx long")
    size = sum((F.size(se.tokens(F.col(f).cast("string"))) for f in se.FIELDS), F.lit(0))
    docs = docs.withColumn("len", size).cache()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE ix USING fts5(content, source_type, timestamp_ms, frame_idx)")
    for r in rows:
        con.execute("INSERT INTO ix VALUES (?,?,?,?)", r[2:])
    return rows, docs, se.postings(docs).cache(), con


CASES = [
    ("dog cat", "dog cat"),
    ("dog OR lion", "dog OR lion"),
    ("qu*", "qu*"),
    ("dog NOT cat", "dog NOT cat"),
    ("content:dog", "content:dog"),
    ("Cafe", "Cafe"),
    ("caption", "caption"),
    ("dog? cat", '"dog?" OR "cat"'),
    ('"dog" AND NOT "cat"', '"dog" OR "AND" OR "NOT" OR "cat"'),
    ("run-down", '"run-down"'),
    ("tree run-down", '"tree" OR "run-down"'),
    ("zzz", "zzz"),
]


def test_scores_match(spark, corpus):
    rows, docs, index, con = corpus
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(CASES)], "query_id long, query string")
    got = {}
    for r in se.search(docs, index, queries, limit=1000).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    for i, (text, fts) in enumerate(CASES):
        want = {rows[rowid - 1][1]: rank for rowid, rank in con.execute("SELECT rowid, rank FROM ix WHERE ix MATCH ?", (fts,))}
        mine = got.get(i, {})
        assert set(mine) == set(want), text
        if "NOT" not in text:
            assert all(mine[d] == pytest.approx(want[d], abs=1e-9) for d in want), text


def test_empty_query_finds_nothing(spark, corpus):
    _, docs, index, _ = corpus
    queries = spark.createDataFrame([(1, ""), (2, "()")], "query_id long, query string")
    assert se.search(docs, index, queries).count() == 0


def test_limit_and_source(spark, corpus):
    _, docs, index, _ = corpus
    queries = spark.createDataFrame([(1, "dog")], "query_id long, query string")
    assert se.search(docs, index, queries, 3).count() == 3
    assert {r.source_type for r in se.search(docs, index, queries, source="caption").collect()} == {"caption"}


@pytest.mark.parametrize(
    "text, want",
    [
        ("c\u1ea1n Cafe\u0301", ["can", "cafe"]),  # one mark, composed and decomposed
        ("ti\u1ebfng", ["ti\u1ebfng"]),  # two marks stay
        ("\u03ac\u03bb\u03c6\u03b1 x", ["\u03ac\u03bb\u03c6\u03b1", "x"]),  # other scripts stay
    ],
)
def test_marks(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(se.tokens(F.col("t")), se.word_count(F.col("t"))).first()
    assert row[0] == want and row[1] == len(want)


def test_blocks_are_left_out_without_losing_a_document(spark, monkeypatch):
    """Scores with small blocks equal those with one block, and fewer entries are read."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(600):
        text = " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 10, 40, 150])))
        rows.append((1 + i % 7 // 6, f"d{i:03d}", text, "event", 0, i))
    docs = spark.createDataFrame(rows, "run_id long, doc_id string, content string, source_type string, timestamp_ms long, frame_idx long")
    docs = docs.withColumn("len", F.size(se.tokens(F.col("content")))).cache()
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w3 OR w4 OR w5"), (3, "w6 NOT w7")], "query_id long, query string")
    found = lambda index: sorted(tuple(r) for r in se.search(docs, index, queries, 5).select("query_id", "run_id", "rank", "doc_id").collect())
    want = found(se.postings(docs, True))
    monkeypatch.setattr(se, "BLOCK_DOCS", 8)
    index = se.postings(docs, True).cache()
    assert index.groupBy("term", "run_id").count().agg(F.max("count")).first()[0] > 2 * se.FIRST_BLOCKS
    read = []
    real = se._scored
    monkeypatch.setattr(se, "_scored", lambda hits, *a: read.append(hits.count()) or real(hits, *a))
    assert found(index) == want
    terms = se.query_terms(queries).select("term", "query_id").distinct()
    assert sum(read) < index.join(terms, "term").agg(F.sum("n")).first()[0]


def test_stored_index_is_built_once_and_read_by_word(spark, corpus, tmp_path):
    _, docs, _, _ = corpus
    path = str(tmp_path / "index")
    first = se.ensure_index(docs, path)
    files = sorted(str(p) for p in (tmp_path / "index").rglob("*.parquet"))
    again = se.ensure_index(docs, path)
    assert files == sorted(str(p) for p in (tmp_path / "index").rglob("*.parquet"))
    assert [p.name for p in tmp_path.iterdir()] == ["index"]
    queries = spark.createDataFrame([(1, "dog"), (2, "qu*")], "query_id long, query string")
    one = lambda i: sorted(tuple(r) for r in se.search(i.docs, i.postings, queries, runs=i.runs).collect())
    assert one(first) == one(again) == sorted(tuple(r) for r in se.search(docs, se.postings(docs), queries).collect())
    terms = se.query_terms(queries.filter("query_id = 1")).withColumn("bucket", se._bucket(F.col("term")))
    asked = se._asked(again.postings, terms, terms.collect())
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,dog)]" in plan


def test_stored_postings_are_never_shuffled(spark, corpus, tmp_path, monkeypatch):
    """Only documents are shuffled: postings are many times larger and made where the documents lie."""
    _, docs, _, _ = corpus
    written = []
    real = se._index_rows
    monkeypatch.setattr(se, "_index_rows", lambda *a: written.append(real(*a)) or written[-1])
    before = spark.conf.get(se._SPLIT)
    index = se.ensure_index(docs, str(tmp_path / "index"))
    assert spark.conf.get(se._SPLIT) == before
    assert "Exchange" not in written[0]._jdf.queryExecution().executedPlan().toString()
    whole = docs.select("run_id", F.explode(F.concat(*[se.tokens(F.col(f).cast("string")) for f in se.FIELDS])).alias("term"))
    want = {r.term: r["count"] for r in whole.groupBy("term").count().collect()}
    assert {r.term: r.w for r in index.postings.groupBy("term").agg(F.sum("words").alias("w")).collect()} == want


def test_any_word_queries_add_up_their_weights(spark, corpus, monkeypatch):
    """Without a clause of several words or a NOT no list of weights per document is needed; scores are the same."""
    _, docs, index, _ = corpus
    queries = spark.createDataFrame([(1, "dog? cat dog"), (2, "dog OR lion OR dog")], "query_id long, query string")
    both = spark.createDataFrame([(1, "dog? cat dog"), (2, "dog OR lion OR dog"), (3, "dog NOT cat")], "query_id long, query string")
    seen = []
    real = se._scored
    monkeypatch.setattr(se, "_scored", lambda *a: seen.append(real(*a)) or seen[-1])
    found = lambda q: {(r.query_id, r.doc_id): r.score for r in se.search(docs, index, q, 1000).filter("query_id < 3").collect()}
    alone = found(queries)
    assert all("collect_list" not in s._jdf.queryExecution().optimizedPlan().toString() for s in seen)
    mixed = found(both)
    assert alone.keys() == mixed.keys() and alone == pytest.approx(mixed, abs=1e-9)


def test_both_forms_of_a_query_are_one_search(spark, monkeypatch):
    """Wide answers hide those of the typed form in their run only; the index is searched once."""
    rows = [(1, "a", "red car", 2), (1, "b", "red", 1), (2, "c", "red dog", 2)]
    docs = spark.createDataFrame(rows, "run_id long, doc_id string, content string, len long").selectExpr(
        "run_id", "doc_id", "content", "'caption' AS source_type", "0L AS timestamp_ms", "CAST(NULL AS BIGINT) AS frame_idx", "len"
    )
    queries = spark.createDataFrame([(7, "red")], "query_id long, query string")
    synonyms = spark.createDataFrame([("red", "car")], "word string, synonym string")
    calls, plain = [], se.search
    monkeypatch.setattr(se, "search", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = se.search_expanded(docs, se.postings(docs, clean=True), queries, synonyms).collect()
    assert len(calls) == 1
    assert sorted((r.query_id, r.run_id, r.doc_id, r["rank"]) for r in got) == [(7, 1, "a", 1), (7, 2, "c", 1)]


def test_a_word_in_several_clauses_counts_once(spark):
    """Clauses that share words, one of them excluded: scores are the sum of the distinct words' weights."""
    rows = [(1, f"d{i}", text, "caption", 0, i) for i, text in enumerate(["a b c", "a c", "b c", "a b", "c d", "e e f", "f g", "h"])]
    docs = spark.createDataFrame(rows, "run_id long, doc_id string, content string, source_type string, timestamp_ms long, frame_idx long")
    docs = docs.withColumn("len", F.size(se.tokens(F.col("content"))))
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a b OR a c"), (4, "c NOT d")], "query_id long, query string")
    got = {}
    for r in se.search(docs, se.postings(docs, True), queries, 100).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert set(got[3]) == {"d0", "d1", "d3"} and set(got[4]) == {"d0", "d1", "d2"}
    assert got[3]["d3"] == pytest.approx(got[1]["d3"] + got[2]["d3"], abs=1e-12)


def test_documents_are_dealt_out_by_bytes_and_read_once(spark):
    """Long texts are few rows: ranges of rows would put them into one task and read all texts to draw the ranges."""
    docs = spark.range(4000).selectExpr(
        "id % 400 AS run_id", "concat('d', id) AS doc_id", "CASE WHEN id % 400 >= 360 THEN repeat('word ', 400) ELSE 'a b' END AS content",
        "'caption' AS source_type", "0L AS timestamp_ms", "id AS frame_idx", "CASE WHEN id % 400 >= 360 THEN 400L ELSE 2L END AS len",
    )
    laid = se._laid_out(docs)
    assert "rangepartitioning" not in laid._jdf.queryExecution().executedPlan().toString()
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        words = [r.w for r in laid.groupBy(F.spark_partition_id()).agg(F.sum("len").alias("w")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sum(words) == 400 * 400 + 3600 * 2 and max(words) < sum(words) / 2


def test_few_documents_of_many_lengths_share_a_block(spark):
    """A short run of differing lengths is one block; a block is of one shape once it is an eighth full."""
    import numpy as np

    run = np.array([1] * 6 + [2] * 40)
    shape = np.array([1, 2, 3, 4, 5, 6] + [1] * 3 + [2] * 2 + [3] * 35)
    first = se._first_docs(run, shape, 32).tolist()
    assert first == [0, 4, 6, 11, 43]
    docs = spark.range(24).selectExpr(
        "1L AS run_id", "concat('d', id) AS doc_id", "repeat('word ', CAST(pow(2, id % 8) AS INT)) AS content", "'caption' AS source_type",
        "0L AS timestamp_ms", "id AS frame_idx", "CAST(pow(2, id % 8) AS BIGINT) AS len",
    ).coalesce(1)
    row = se.postings(docs, True).collect()
    assert [(r.n, r.words, r.most, r.least) for r in row] == [(24, 3 * 255, 128, 1)]


def test_hits_of_a_block_are_scored_where_they_meet(spark, corpus, monkeypatch):
    """Index rows are dealt out once, by block; grouping their documents shuffles nothing more."""
    _, docs, index, _ = corpus
    queries = spark.createDataFrame([(1, "dog cat"), (2, "dog OR lion")], "query_id long, query string")
    seen, real = [], se._scored
    monkeypatch.setattr(se, "_scored", lambda hits, *a: seen.append((hits, real(hits, *a))) or seen[-1][1])
    se.search(docs, index, queries).collect()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert seen
    for hits, scored in seen:
        assert "places" not in hits.columns
        after = plan(scored).split("REPARTITION_BY_COL")[0]
        assert "Exchange hashpartitioning" not in after.split("BroadcastExchange")[0].replace("Exchange hashpartitioning(query_id", "", 1)


def test_many_queries_do_not_multiply_what_is_shuffled(spark, corpus):
    """Whole passages as queries: index rows are dealt out by run, once for all that ask for them, and hits stay there."""
    _, docs, index, _ = corpus
    queries = spark.createDataFrame([(i, " ".join(WORDS[i % 5 : 11]) + " ?") for i in range(40)], "query_id long, query string")
    found = se.search(docs, index, queries).select("query_id", "run_id", "rank", "doc_id", "timestamp_ms", "score")
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("Exchange hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum("REPARTITION_BY" in line and line.startswith("run_id#") for line in dealt) == 1
    keys = [line.split(")")[0] for line in dealt]
    assert not [k for k in keys if "doc_id" in k or "query_id" in k and "run_id" in k]
    with_text = {tuple(r) for r in se.search(docs, index, queries).select("doc_id", "snippet").collect()}
    assert with_text <= {(r.doc_id, r.content) for r in docs.collect()} and len(with_text) > 1


def test_large_and_small_runs_are_searched_alike(spark, monkeypatch):
    """Runs of many blocks are searched block by block, the others whole; both give the same answers."""
    rnd = random.Random(3)
    rows = [
        (1 if i < 120 else 2 + i % 3, f"d{i:03d}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 12))), "event", i * 10, i)
        for i in range(150)
    ]
    docs = spark.createDataFrame(rows, "run_id long, doc_id string, content string, source_type string, timestamp_ms long, frame_idx long")
    docs = docs.withColumn("len", F.size(se.tokens(F.col("content")))).cache()
    queries = spark.createDataFrame([(1, "dog? cat"), (2, "dog OR lion"), (3, "cat NOT dog"), (4, "keys")], "query_id long, query string")
    calls, real = [], se._word_search
    monkeypatch.setattr(se, "_word_search", lambda *a: calls.append(1) or real(*a))
    found = lambda: sorted(tuple(r) for r in se.search(docs, se.postings(docs, True), queries, 7).withColumn("score", F.round("score", 9)).collect())
    whole = found()
    assert not calls
    monkeypatch.setattr(se, "BLOCK_DOCS", 8)
    assert found() == whole and calls


def test_shuffle_files_of_the_documents_go_once_they_are_written(spark, corpus, tmp_path):
    """They hold every text and would lie on disk beside the postings."""
    _, docs, _, _ = corpus
    docs.count()
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: blocks.getAllFiles().mkString(" ").count("shuffle_")
    before, freed = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    se.write_index(docs, str(tmp_path / "index"))
    assert shuffled() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == freed
