"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinetrace.functions import let


def tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    words = F.split(F.lower(text), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all words: 1.0 for two empty texts, 0.0 when one is empty."""
    both = F.struct(
        tokens(F.coalesce(a, F.lit(""))).alias("a"), tokens(F.coalesce(b, F.lit(""))).alias("b")
    )
    return let(
        both,
        lambda s: F.when((F.size(s["a"]) == 0) & (F.size(s["b"]) == 0), 1.0)
        .when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"]))),
    )


def slug(label: Column, length: int = 40) -> Column:
    """File-name form of a label."""
    bare = F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.substring(F.lower(bare), 1, length)
    return F.when(cut == "", "event").otherwise(cut)


def token_estimate(text: Column) -> Column:
    """Rough prompt size: one token per three characters."""
    return F.floor(F.length(text) / 3)


# Fixed value: what stands in for the text that was cut out.
TRIM_MARK = "\n[... trimmed to fit context ...]\n"


def truncate_middle(text: Column, limit: Column) -> Column:
    """Keep the head and the tail of a text longer than ``limit`` characters."""
    room = F.greatest(F.lit(0), limit - len(TRIM_MARK)).cast("int")
    head = F.floor(room / 2).cast("int")
    tail = room - head
    cut = F.when(tail <= 0, F.substring(text, F.lit(1), head)).otherwise(
        F.concat(F.substring(text, F.lit(1), head), F.lit(TRIM_MARK), F.right(text, tail))
    )
    return F.when(limit <= 0, "").when(F.length(text) <= limit, text).otherwise(cut)


def clean_query(text: Column) -> Column:
    """Search text without quotes, brackets and operators, single-spaced."""
    bare = F.regexp_replace(text, r"""['"\\\[\](){}|!<>]""", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
