"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinetrace.llm.common import Scratch


def _mark(df: DataFrame) -> tuple:
    """A fingerprint of the rows: their number and the exclusive or of their hashes."""
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every linked node; the root is the least node that it reaches.

    ``links`` has columns a and b.  Each round points larger neighbours to the least one (large
    star), then all smaller ones (small star); rounds grow with the logarithm of the diameter.
    Hubs are joined, never collected.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = scratch.keep(e, "links")
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        after = scratch.keep(small, "small")
        scratch.drop(large, e)
        e, before, mark = after, mark, _mark(after)
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
