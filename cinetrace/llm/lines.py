"""Corpus-wide line deduplication, all in column expressions.

Only hashes of normalised lines travel: they are exploded from each text once per document,
counted with partial sums, and the frequent ones are joined back.  Each text is then reassembled
from its own lines by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.llm.common import SPACE, Scratch, ascii_lower

MIN_CHARS = 1
MIN_DOCS = 10


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    """Two hashes side by side, so that a chance agreement is out of reach at any corpus size."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(7)).alias("g"))


def drop_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with columns text (rest of the lines), n_lines and n_dropped in place of like-named ones.

    A line whose key has ``min_chars`` code points and is found in ``min_docs`` documents goes from
    every document.  Every row is a document, repeated rows too; null and empty texts have one empty
    line.  The decision about a text depends on its lines alone, so texts are matched by id and
    hash, and null or repeated ids do no harm.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    at = F.struct(F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.xxhash64(F.col(id_col), text_col).alias("g"))
    keys = F.filter(F.transform(_lines(F.col(text_col)), line_key), lambda k: F.length(k) >= min_chars)
    hashed = F.array_distinct(F.transform(keys, _hash))
    exploded = docs.select(at.alias("at"), F.explode(hashed).alias("line"))
    found = exploded.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("line")
    found = scratch.keep(found, "frequent")
    hits = exploded.join(found, "line").groupBy("at").agg(F.collect_set("line").alias("__gone"))
    rows = docs.withColumn("__at", at).join(hits.withColumnRenamed("at", "__at"), "__at", "left")
    # one step at a time, so that no list is built twice; most texts have nothing to drop
    rows = rows.withColumn("__lines", _lines(F.col(text_col)))
    stays = F.filter("__lines", lambda x: ~F.array_contains("__gone", _hash(line_key(x))))
    rows = rows.withColumn("__stays", F.when(F.col("__gone").isNotNull(), stays))
    size, text = F.size("__lines"), F.coalesce(text_col, F.lit(""))
    out = {
        "n_lines": size.cast("long"),
        "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(size - F.size("__stays")).cast("long"),
        text_col: F.when(F.col("__gone").isNull(), text).otherwise(F.array_join("__stays", "\n")),
    }
    return rows.withColumns(out).drop("__at", "__gone", "__lines", "__stays")
