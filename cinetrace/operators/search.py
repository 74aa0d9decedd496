"""Full-text search: positional index, BM25, query fallback."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cinetrace.functions.text import clean_query
from cinetrace.functions.times import mmss_to_ms
from cinetrace.operators.ordering import first_n
from cinetrace.sources.readers import Scratch, configured, exists, remove, rename

K1, B = 1.2, 0.75  # Fixed values: BM25 parameters.
FIELDS = ("content", "source_type", "timestamp_ms", "frame_idx")


def _accents() -> tuple[str, str]:
    """Latin letters with one mark and their base letters, by Unicode decomposition; then the marks.

    Marks of their own have no counterpart and vanish; letters with two marks stay as they are.
    """
    parts = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(a, b[0]) for a, b in parts if len(b) == 2 and b[0].isascii()]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in kept) + marks, "".join(b for _, b in kept)


_FROM, _TO = _accents()
_LETTERS = r"[\p{L}\p{N}]+"


class Index(NamedTuple):
    """A stored index: its documents, postings and run statistics."""

    docs: DataFrame
    postings: DataFrame
    runs: DataFrame


def tokens(text: Column) -> Column:
    """Case-folded words without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), _FROM, _TO), F.lit(_LETTERS), F.lit(0))


def word_count(text: Column) -> Column:
    """``size(tokens(text))`` without building the words; no text has none.  Marks do not part words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\u0300-\u036F]*")), F.lit(0))


def documents(
    captions: DataFrame, audio: DataFrame, detections: DataFrame, events: DataFrame, clean: bool = False
) -> DataFrame:
    """One row per searchable text, with its length in words.

    ``captions`` must carry their frame's time.  Detections have no time of their own;
    ``clean`` expects ``detections`` to carry ``timestamp_ms`` and uses it.
    """
    none = F.lit(None).cast("bigint")

    def rows(df: DataFrame, text: str, kind: str, ident: Column, at: Column, frame: Column) -> DataFrame:
        return df.select(
            "run_id",
            F.concat(F.lit(kind + ":"), ident.cast("string")).alias("doc_id"),
            F.trim(F.col(text)).alias("content"),
            F.lit(kind).alias("source_type"),
            at.cast("bigint").alias("timestamp_ms"),
            frame.cast("bigint").alias("frame_idx"),
        )

    idx = F.col("frame_idx")
    at = F.coalesce("timestamp_ms", F.lit(0))
    per_frame = ["run_id", "frame_idx", "class_name"] + (["timestamp_ms"] if clean else [])
    classes = detections.select(*per_frame).distinct()
    parts = [
        rows(audio, "text", "transcript", F.col("segment_id"), F.col("start_ms"), none),
        rows(captions, "caption", "caption", idx, at, idx),
        rows(captions, "change_line", "change", idx, at, idx),
        rows(captions, "verifier_caption", "verifier", idx, at, idx),
        rows(
            classes, "class_name", "detection", F.concat_ws("/", idx, "class_name"),
            F.col("timestamp_ms") if clean else none, idx,
        ),
        rows(events, "description", "event", F.col("ev_idx"), mmss_to_ms(F.col("start_time")), none),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fields = FIELDS[:1] if clean else FIELDS
    words = sum((word_count(F.col(f).cast("string")) for f in fields), F.lit(0))
    return union.filter("content <> ''").withColumn("len", words)


def index_counts(docs: DataFrame) -> DataFrame:
    """Documents per run and source."""
    return docs.groupBy("run_id", "source_type").agg(F.count(F.lit(1)).alias("rows"))


def run_statistics(docs: DataFrame) -> DataFrame:
    """Documents per run and their average length."""
    return docs.groupBy("run_id").agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))


BLOCK_DOCS = 1024  # documents of a run that share an index row, at most
BUCKETS = 32  # folders of the stored index, by word
PART_DOCS, PART_BYTES = 1 << 19, 8 << 20  # stored documents that a task indexes: its postings are sorted in memory
_SPLIT = "spark.sql.files.maxPartitionBytes"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ENTRY = "struct<doc_id:string,len:bigint,source_type:string,places:array<struct<field:int,pos:int>>>"
_ROW = f"term string, run_id bigint, block bigint, n bigint, words bigint, most bigint, least bigint, entries array<{_ENTRY}>"


def _laid_out(docs: DataFrame) -> DataFrame:
    """Documents of a run and of like length next to each other.

    Runs are dealt out by bytes, not by rows: ranges of rows would put all long texts into one task, and to draw
    them the texts had to be read twice.  Spark splits a task that holds too much, such as a very large run.
    """
    return docs.hint("rebalance", "run_id").sortWithinPartitions("run_id", _shape(), "doc_id")


def _shape() -> Column:
    return F.floor(F.log2(F.col("len") + 1) * 2)


def _first_docs(run: np.ndarray, shape: np.ndarray, most: int) -> np.ndarray:
    """Where the blocks of documents in the order of ``_laid_out`` begin.

    A block holds at most ``most`` documents of one run, and of one shape once it holds an eighth of that: few
    documents of many lengths would otherwise take an index row per word and length.
    """
    other_run = np.diff(run, prepend=run[0] - 1) != 0
    starts = np.flatnonzero(other_run | (np.diff(shape, prepend=shape[0]) != 0))
    first, held = [], 0
    for at, size, new in zip(starts.tolist(), np.diff(starts, append=len(run)).tolist(), other_run[starts].tolist(), strict=True):
        room = 0 if new or held >= max(most // 8, 1) else most - held
        first.extend(range(at + room, at + size, most))
        held = held + size if size <= room else (size - room - 1) % most + 1
    return np.array(first)


def _blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Index rows of blocks of at most ``most`` neighbouring documents of a run; ``block`` is named by its first."""
    for batch in batches:
        fields = batch.column("words")
        per_doc = np.diff(fields.offsets.to_numpy())
        lists = fields.flatten()
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            continue
        code = coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.repeat(np.arange(len(batch)), per_doc), sizes)
        field = np.repeat(np.concatenate([np.arange(n) for n in per_doc]), sizes)
        pos = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        run, shape, length = (batch.column(c).to_numpy() for c in ("run_id", "shape", "len"))
        first_doc = _first_docs(run, shape, most)
        block = np.repeat(first_doc, np.diff(first_doc, append=len(batch)))
        order = np.argsort(code * len(batch) + doc, kind="stable")
        code, doc = code[order], doc[order]
        entry = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        tf, e_code, e_doc = np.diff(entry, append=len(code)), code[entry], doc[entry]
        row = np.flatnonzero((np.diff(e_code, prepend=-1) != 0) | (np.diff(block[e_doc], prepend=-1) != 0))
        places = pa.StructArray.from_arrays(
            [pa.array(field[order].astype(np.int32)), pa.array(pos[order].astype(np.int32))], ["field", "pos"]
        )
        places = pa.ListArray.from_arrays(pa.array(np.append(entry, len(code)).astype(np.int32)), places)
        own = [batch.column(c).take(pa.array(e_doc)) for c in ("doc_id", "len", "source_type")]
        entries = pa.StructArray.from_arrays([*own, places], ["doc_id", "len", "source_type", "places"])
        yield pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(e_code[row])),
                pa.array(run[e_doc[row]]),
                batch.column("name").take(pa.array(block[e_doc[row]])),
                pa.array(np.diff(row, append=len(entry))),
                pa.array(np.add.reduceat(tf, row)),
                pa.array(np.maximum.reduceat(tf, row)),
                pa.array(np.minimum.reduceat(length[e_doc], row)),
                pa.ListArray.from_arrays(pa.array(np.append(row, len(entry)).astype(np.int32)), entries),
            ],
            ["term", "run_id", "block", "n", "words", "most", "least", "entries"],
        )


def _index_rows(docs: DataFrame, clean: bool) -> DataFrame:
    """Postings of documents in the order of ``_laid_out``, made block by block where they lie."""
    fields = FIELDS[:1] if clean else FIELDS
    listed = F.array(*[F.coalesce(tokens(F.col(f).cast("string")), F.array().cast("array<string>")) for f in fields])
    name = _shape() * (1 << 32) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    said = docs.filter("run_id IS NOT NULL").select(
        F.col("run_id").cast("bigint"), "doc_id", F.col("len").cast("bigint"), "source_type",
        _shape().cast("bigint").alias("shape"), name.cast("bigint").alias("name"), listed.alias("words"),
    )
    return said.mapInArrow(partial(_blocks_of, most=BLOCK_DOCS), _ROW)


def postings(docs: DataFrame, clean: bool = False) -> DataFrame:
    """Positional inverted index: one row per word, run and block of documents.

    A row has the number of its documents ``n`` and of the word's places ``words``, the most places it
    has in one of them and the least length of one, and an entry per document.  Blocks hold at most
    BLOCK_DOCS documents of like length, as short ones weigh most.  ``clean`` indexes the
    content only; otherwise all four fields are searchable, so a source name or a time is a word too.
    """
    return _index_rows(_laid_out(docs), clean)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str, clean: bool = False) -> None:
    """Store documents, run statistics and postings; these in folders by word, ordered by word in each file.

    The documents are shuffled once, into their order, and never their postings, which are many times
    larger: a task writes those of its documents into all folders.  Their shuffle files go as soon as they are
    written, and do not lie beside the postings.  A search for some words opens their
    folders only, and reads the row groups that may hold them.  The folder appears under its name once
    it is whole; whoever comes second keeps the first one.
    """
    spark = docs.sparkSession
    part = f"{path}-{uuid.uuid4().hex[:12]}"
    small = {"maxRecordsPerFile": PART_DOCS, "parquet.block.size": PART_BYTES}
    with configured(spark, _FREED, "true"):
        _laid_out(docs).write.option("compression", "zstd").options(**small).parquet(f"{part}/documents")
        stored = spark.read.schema(docs.schema).parquet(f"{part}/documents")
        run_statistics(stored).write.parquet(f"{part}/runs")
    order = ["bucket", "term", "run_id", "block"]
    rows = _index_rows(stored, clean).withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions(*order)
    with configured(spark, _SPLIT, str(PART_BYTES // 2)):  # a file or a row group a task
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{part}/postings")
    if not rename(spark, part, path):
        remove(spark, part)


def open_index(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("documents"), read("postings"), read("runs"))


def ensure_index(docs: DataFrame, path: str, clean: bool = False) -> Index:
    """The index at ``path``; built first if it is not there."""
    if not exists(docs.sparkSession, path):
        write_index(docs, path, clean)
    return open_index(docs.sparkSession, path)


_WORD = r"^((content|source_type|timestamp_ms|frame_idx):)?[\p{L}\p{N}_]+\*?$"
_MISPLACED = r"^(AND|OR|NOT)\b|\b(AND|OR|NOT)$|\b(AND|OR|NOT) (AND|OR|NOT)\b"


def query_terms(queries: DataFrame) -> DataFrame:
    """Words of each query (query_id, query) with what has to match.

    Words are all required unless ``OR`` separates them into clauses; words after ``NOT``
    exclude.  A query that is not well-formed matches any of its words, each taken as a phrase.
    Rows: one per token of a phrase.
    """
    cleaned = queries.select("query_id", clean_query(F.col("query")).alias("q")).filter("q <> ''")
    words = F.split("q", " ")
    operator = lambda w: w.isin("AND", "OR", "NOT")
    broken = F.exists(words, lambda w: ~operator(w) & ~w.rlike(_WORD)) | F.col("q").rlike(_MISPLACED)
    split = cleaned.select("query_id", broken.alias("broken"), words.alias("words")).select(
        "query_id", "broken", "words", F.posexplode("words").alias("at", "word")
    )
    before = F.slice("words", F.lit(1), F.col("at"))
    ors = F.size(F.filter(before, lambda w: w == "OR"))
    named = F.regexp_extract("word", r"^(content|source_type|timestamp_ms|frame_idx):", 1)
    phrases = split.filter(F.col("broken") | ~operator(F.col("word"))).select(
        "query_id",
        F.when(F.col("broken"), F.col("at")).otherwise(ors).alias("clause"),
        (~F.col("broken") & F.array_contains(before, "NOT")).alias("excluded"),
        F.when(F.col("broken") | (named == ""), None).otherwise(named).alias("only_field"),
        (~F.col("broken") & F.col("word").endswith("*")).alias("prefix"),
        tokens(
            F.when(F.col("broken"), F.col("word")).otherwise(
                F.regexp_replace("word", r"^(content|source_type|timestamp_ms|frame_idx):", "")
            )
        ).alias("phrase"),
    )
    keyed = phrases.filter(F.size("phrase") > 0).withColumn(
        "phrase_id",
        F.concat_ws("|", F.coalesce("only_field", F.lit("")), F.col("prefix").cast("string"), F.array_join("phrase", " ")),
    )
    return keyed.select("*", F.posexplode("phrase").alias("offset", "term"), F.size("phrase").alias("length")).drop("phrase")


MOST_TERMS = 5000  # words of all queries up to which they are looked at on the driver
MOST_WORDS = 1000  # distinct words up to which the index is filtered by their list
FIRST_BLOCKS = 4  # blocks of a run that are scored before others are left out
TASK_HITS = 1 << 20  # hits that a task scores and ranks in memory


def _asked(index: DataFrame, terms: DataFrame, few: list | None) -> DataFrame:
    """The index rows that the words of the queries may need; all words where one is a prefix.

    ``few`` are the rows of ``terms`` if there are few: then their words and folders are named in the scan.
    """
    if any(r["prefix"] for r in few) if few is not None else not terms.filter("prefix").isEmpty():
        return index
    words = sorted({r["term"] for r in few}) if few is not None else []
    if few is None or len(words) > MOST_WORDS:
        return index.join(terms.select("term").distinct(), "term", "left_semi")
    if "bucket" in index.columns:
        index = index.filter(F.col("bucket").isin(sorted({r["bucket"] for r in few})))
    return index.filter(F.col("term").isin(words))


def _with_prefixes(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Words to look up per phrase; prefixes are first matched against the distinct words by their first letters."""
    asked = terms.select("phrase_id", "only_field", "prefix", "offset", "term", "length").distinct()
    starts = asked.filter("prefix").withColumnRenamed("term", "start")
    letters = F.sequence(F.lit(1), F.length("term"))
    spelled = index.select("term").distinct().select(
        "term", F.explode(F.transform(letters, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("start")
    )
    wide = starts.join(spelled, "start").select("phrase_id", "only_field", "offset", "term", "length")
    return asked.filter("NOT prefix").drop("prefix").unionByName(wide)


def _phrase_hits(index: DataFrame, words: DataFrame) -> DataFrame:
    """Occurrences of each phrase per document: the places where all its words follow each other."""
    named = F.element_at(F.array(*[F.lit(f) for f in FIELDS]), F.col("place.field") + 1)
    found = (
        index.join(words, "term")
        .select("run_id", "phrase_id", "only_field", "length", "offset", F.explode("entries").alias("entry"))
        .select("*", F.explode("entry.places").alias("place"))
        .filter(F.col("only_field").isNull() | (F.col("only_field") == named))
    )
    doc = ["run_id", F.col("entry.doc_id").alias("doc_id"), F.col("entry.len").alias("len"), F.col("entry.source_type").alias("source_type")]
    starts_at = found.groupBy(*doc, "phrase_id", "length", "place.field", (F.col("place.pos") - F.col("offset")).alias("at")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return starts_at.filter("n = length").groupBy("run_id", "doc_id", "len", "source_type", "phrase_id").agg(F.count(F.lit(1)).alias("tf"))


def _idf(found_in: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, phrase_id, idf, avg_len of phrases with their document counts ``df``."""
    idf = _idf_of(F.col("docs"), F.col("df"))
    return found_in.join(runs, "run_id").select("run_id", "phrase_id", "avg_len", idf.alias("idf"))


def _idf_of(docs: Column, df: Column) -> Column:
    raw = F.log((docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, 1e-6).otherwise(raw)


def _weight(tf: Column, length: Column) -> Column:
    """What ``tf`` places in a document of this length weigh, without the idf; grows with ``tf`` and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))


def _scored(hits: DataFrame, wanted: DataFrame, source: str | None, doc: tuple[str, ...] = ("run_id", "doc_id")) -> DataFrame:
    """query_id, the columns ``doc`` and score of the documents that match a query.

    ``hits``: query_id, run_id, doc_id, len, source_type, phrase_id, tf, idf, avg_len, of phrases of the query only.  ``doc``
    are the columns that name a document; hits that are dealt out by some of them and the query are not shuffled.
    """
    weighed = hits.withColumn("weight", F.col("idf") * _weight(F.col("tf"), F.col("len")))
    if source is not None:
        weighed = weighed.filter(F.col("source_type") == source)
    sized = wanted.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("query_id", "clause", "excluded")))
    if sized.filter("excluded OR size > 1").isEmpty():
        # Any phrase matches, as in queries that are not well-formed: their weights only have to be added up.
        added = weighed.groupBy("query_id", *doc).agg((-F.sum("weight")).alias("score"))
        return added.select("query_id", *doc, "score")
    # A word that several clauses share counts once in the score: in the first of them.
    first = F.min(F.when(~F.col("excluded"), F.col("clause"))).over(W.partitionBy("query_id", "phrase_id"))
    counted = sized.withColumn("counted", ~F.col("excluded") & (F.col("clause") == first))
    matched = (
        weighed.join(counted, ["query_id", "phrase_id"])
        .groupBy("query_id", *doc, "clause", "excluded", "size")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("counted"), F.col("weight")).otherwise(0.0)).alias("weight"))
    )
    complete = F.col("n") == F.col("size")
    return (
        matched.groupBy("query_id", *doc)
        .agg(
            F.max(~F.col("excluded") & complete).alias("hit"),
            F.max(F.col("excluded") & complete).alias("barred"),
            (-F.sum("weight")).alias("score"),
        )
        .filter("hit AND NOT barred")
        .select("query_id", *doc, "score")
    )


def _best(scored: DataFrame, limit: int) -> DataFrame:
    return first_n(scored, ["query_id", "run_id"], [F.round("score", 9), F.col("doc_id")], limit)


def _run_search(
    docs: DataFrame, index: DataFrame, terms: DataFrame, wanted: DataFrame, runs: DataFrame, limit: int, source: str | None
) -> DataFrame:
    """Best documents of queries of plain words in runs of few documents, each run searched whole in one task.

    Index rows and documents, without their texts, are dealt out once, by run.  All queries are scored, ranked and told
    the source and time of their documents there: hits are as many as all queries find in all runs, and never shuffled.
    """
    words = terms.select("query_id", "phrase_id", "term").distinct()
    askers = words.groupBy("term").agg(F.count(F.lit(1)).alias("askers"))
    hits = index.join(askers, "term").agg(F.sum(F.col("n") * F.col("askers"))).first()[0] or 0
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), hits // TASK_HITS + 1)
    told = ["len", "source_type", "timestamp_ms", "frame_idx"]
    tf = lambda e: F.struct(e["doc_id"].alias("doc_id"), F.size(e["places"]).alias("tf"))
    lists = index.select("run_id", "term", "n", F.transform("entries", tf).alias("entries"))
    none = F.array(F.struct("doc_id", F.lit(None).cast("int").alias("tf")))
    own = docs.filter("run_id IS NOT NULL").select("run_id", none.alias("entries"), F.struct(*told).alias("told"))
    met = lists.unionByName(own, allowMissingColumns=True).repartition(tasks, "run_id")
    met = met.withColumn("df", F.sum("n").over(W.partitionBy("run_id", "term")))
    met = met.select("run_id", "term", "df", "told", F.inline("entries"))
    met = met.withColumn("told", F.max("told").over(W.partitionBy("run_id", "doc_id"))).filter("term IS NOT NULL AND told IS NOT NULL")
    idf = _idf_of(F.col("docs"), F.col("df"))
    found = words.join(met.join(runs, "run_id"), "term").select(
        "query_id", "run_id", "doc_id", "told.*", "phrase_id", "tf", "avg_len", idf.alias("idf")
    )
    return _best(_scored(found, wanted, source, ("run_id", "doc_id", *told)), limit)


def _word_search(index: DataFrame, terms: DataFrame, wanted: DataFrame, runs: DataFrame, limit: int, source: str | None) -> DataFrame:
    """Best documents of queries of plain words, scored block by block.

    The most places of a block's words and its least lengths bound the score of all its documents.  Per query and
    run the blocks with the highest bounds are scored first; of the others only those are read
    whose bound reaches the last place so far, so no better document is missed.  The index rows of a block meet in
    one task, once for all queries, and its documents are scored there.
    """
    scratch = Scratch(index.sparkSession, "search")
    words = terms.select("phrase_id", "term").distinct()
    blocks = index.select("term", "run_id", "block", "n", "most", "least").join(words, "term").drop("term")
    blocks = scratch.keep(blocks, "blocks")
    idf = scratch.keep(_idf(blocks.groupBy("run_id", "phrase_id").agg(F.sum("n").alias("df")), runs), "idf")
    scoring = wanted.filter("NOT excluded").select("query_id", "phrase_id").distinct()
    bounds = (
        blocks.join(idf, ["run_id", "phrase_id"]).join(scoring, "phrase_id").groupBy("query_id", "run_id", "block")
        .agg(F.sum(F.col("idf") * _weight(F.col("most"), F.col("least"))).alias("bound"))
    )
    by_bound = W.partitionBy("query_id", "run_id").orderBy(F.desc("bound"), "block")
    bounds = scratch.keep(bounds.withColumn("turn", F.row_number().over(by_bound)), "bounds")
    every = terms.select("query_id", "phrase_id", "term").distinct()

    def score(chosen: DataFrame) -> DataFrame:
        asked = chosen.groupBy("run_id", "block").agg(F.collect_set("query_id").alias("asked"))
        tf = lambda e: F.struct(*[e[c].alias(c) for c in ("doc_id", "len", "source_type")], F.size(e["places"]).alias("tf"))
        lists = index.select("term", "run_id", "block", F.transform("entries", tf).alias("entries"))
        lists = lists.repartition("run_id", "block").join(asked, ["run_id", "block"])
        rows = every.join(lists, "term").filter(F.array_contains("asked", F.col("query_id"))).join(idf, ["run_id", "phrase_id"])
        hits = rows.select("query_id", "run_id", "block", "phrase_id", "idf", "avg_len", F.inline("entries"))
        return _scored(hits, wanted, source, ("run_id", "block", "doc_id")).drop("block")

    later = bounds.filter(F.col("turn") > FIRST_BLOCKS)
    if later.isEmpty():
        return _best(score(bounds), limit)
    first = scratch.keep(_best(score(bounds.filter(F.col("turn") <= FIRST_BLOCKS)), limit).drop("rank"), "first")
    last = first.groupBy("query_id", "run_id").agg(F.count(F.lit(1)).alias("have"), F.max("score").alias("last"))
    reach = F.col("last").isNull() | (F.col("have") < limit) | (-F.col("bound") <= F.col("last") + 1e-6)
    later = later.join(last, ["query_id", "run_id"], "left").filter(reach)
    return _best(first.unionByName(score(later)), limit)


def _phrase_search(index: DataFrame, terms: DataFrame, wanted: DataFrame, runs: DataFrame, limit: int, source: str | None) -> DataFrame:
    """Best documents of queries with phrases, fields or prefixes, whose counts are known only once they are found."""
    scratch = Scratch(index.sparkSession, "search")
    hits = scratch.keep(_phrase_hits(index, _with_prefixes(index, terms)), "hits")
    idf = _idf(hits.groupBy("run_id", "phrase_id").agg(F.count(F.lit(1)).alias("df")), runs)
    asked = wanted.select("query_id", "phrase_id").distinct()
    return _best(_scored(hits.join(asked, "phrase_id").join(idf, ["run_id", "phrase_id"]), wanted, source), limit)


def search(
    docs: DataFrame, index: DataFrame, queries: DataFrame, limit: int = 20, source: str | None = None, runs: DataFrame | None = None
) -> DataFrame:
    """Best documents per query and run by BM25; lower scores are better.

    All queries run together: their words meet the index in one join.  ``index`` is that of
    ``postings``, best a stored one; ``runs`` are its run statistics.
    """
    runs = run_statistics(docs) if runs is None else runs
    terms = query_terms(queries)
    simple = ~F.col("prefix") & F.col("only_field").isNull() & (F.col("length") == 1)
    plain = terms.groupBy("query_id").agg(F.min(simple).alias("plain"))
    terms = terms.join(plain, "query_id").withColumn("bucket", _bucket(F.col("term")))
    large = runs.filter(F.col("docs") > FIRST_BLOCKS * BLOCK_DOCS).select("run_id")
    some_large = not large.isEmpty()
    some_small = not some_large or not runs.filter(F.col("docs") <= FIRST_BLOCKS * BLOCK_DOCS).isEmpty()
    told = terms.limit(MOST_TERMS + 1).toArrow()
    few = None
    if told.num_rows <= MOST_TERMS:
        few, terms = told.to_pylist(), terms.sparkSession.createDataFrame(told, terms.schema)
    found = []
    named = ["run_id", "doc_id"]
    for plain in (True, False):
        own = terms.filter(F.col("plain") == plain)
        rows = None if few is None else [r for r in few if r["plain"] == plain]
        if not (rows or rows is None and not own.isEmpty()):
            continue
        wanted = own.select("query_id", "clause", "excluded", "phrase_id").distinct()
        asked = _asked(index, own, rows)
        if not plain:
            found.append(_phrase_search(asked, own, wanted, runs, limit, source).join(docs, named))
            continue
        if some_large:
            best = _word_search(asked.join(large, "run_id", "left_semi"), own, wanted, runs, limit, source)
            found.append(best.join(docs.join(large, "run_id", "left_semi"), named))
        if not some_small:
            continue
        rest = lambda df: df.join(large, "run_id", "left_anti") if some_large else df
        best = _run_search(rest(docs), rest(asked), own, wanted, runs, limit, source)
        # Texts come last, to the best documents only; Spark leaves this join out where they are not selected.
        found.append(best.join(docs.groupBy(*named).agg(F.first("content").alias("content")), named, "left"))
    if not found:
        none = terms.select("query_id", F.lit(0).cast("bigint").alias("run_id"), F.lit("").alias("doc_id"), F.lit(0.0).alias("score"))
        found = [_best(none.filter("false"), limit).join(docs, named)]
    shown = [
        best.select(
            "query_id", "run_id", "rank", "doc_id", "source_type",
            F.coalesce("timestamp_ms", F.lit(0)).alias("timestamp_ms"), "frame_idx",
            F.col("content").alias("snippet"), "score",
        )
        for best in found
    ]
    return reduce(DataFrame.unionByName, shown)


def expanded_queries(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Append the synonyms (word, synonym) of every query word."""
    words = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("word")).distinct()
    extra = (
        words.join(synonyms, "word")
        .groupBy("query_id")
        .agg(F.array_join(F.array_sort(F.collect_set("synonym")), " ").alias("extra"))
    )
    return queries.join(extra, "query_id", "left").select(
        "query_id", F.concat_ws(" ", "query", "extra").alias("query")
    )


def search_expanded(
    docs: DataFrame, index: DataFrame, queries: DataFrame, synonyms: DataFrame, limit: int = 20, runs: DataFrame | None = None
) -> DataFrame:
    """Search with synonyms; a query that then finds nothing in a run is searched as typed.

    Both forms are asked in one search, which reads the index and the documents once.
    """
    form = lambda df, typed: df.select(F.struct("query_id", F.lit(typed).alias("typed")).alias("query_id"), "query")
    asked = form(expanded_queries(queries, synonyms), False).unionByName(form(queries, True))
    found = search(docs, index, asked, limit, runs=runs)
    rest = [c for c in found.columns if c != "query_id"]
    found = found.select("query_id.query_id", "query_id.typed", *rest)
    only_typed = F.min("typed").over(W.partitionBy("query_id", "run_id"))
    return found.withColumn("only", only_typed).filter(F.col("typed") == F.col("only")).drop("typed", "only")
