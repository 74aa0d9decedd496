"""Run-length masks: column-major runs that start with background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.functions import let

SCHEMA = "struct<size:array<int>,counts:array<bigint>>"


def encode(rows: DataFrame, height: int, width: int, mask: str = "mask") -> DataFrame:
    """Row-major 0/1 arrays to ``counts``; a mask is one row, so this needs no shuffle."""
    last = height * width
    column_major = F.transform(
        F.sequence(F.lit(0), F.lit(last - 1)),
        lambda p: F.get(F.col(mask), (p % height) * width + F.floor(p / height).cast("int")),
    )

    def cuts(bits: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(1), F.lit(last)),
            lambda p: (p == last) | (F.get(bits, p) != F.get(bits, p - 1)),
        )
        return F.when(F.get(bits, F.lit(0)) == 1, F.concat(F.array(F.lit(0)), ends)).otherwise(ends)

    lengths = lambda c: F.transform(
        c, lambda v, i: (v - F.when(i == 0, 0).otherwise(F.get(c, i - 1))).cast("bigint")
    )
    counts = let(let(column_major, cuts), lengths)
    rest = [c for c in rows.columns if c != mask]
    return rows.select(
        *rest, counts.alias("counts"), F.array(F.lit(height), F.lit(width)).alias("size")
    )


def to_json(rows: DataFrame, name: str = "mask_rle") -> DataFrame:
    return rows.withColumn(name, F.to_json(F.struct("size", "counts"))).drop("size", "counts")


def _valid(mask: Column) -> Column:
    size, counts = mask["size"], mask["counts"]
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    return F.coalesce(
        (F.size(size) == 2)
        & (total == F.get(size, F.lit(0)) * F.get(size, F.lit(1)))
        & ~F.exists(counts, lambda n: n < 0),
        F.lit(False),
    )


def _runs(mask: Column) -> Column:
    """Fold over the counts: the state holds the offset and the foreground runs so far."""
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    state = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("fg"), empty.alias("runs")
    )
    step = lambda acc, n: F.struct(
        (acc["at"] + n).alias("at"),
        (~acc["fg"]).alias("fg"),
        F.when(
            acc["fg"] & (n > 0),
            F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("start"), n.alias("length")))),
        ).otherwise(acc["runs"]).alias("runs"),
    )
    return F.aggregate(mask["counts"], state, step, lambda acc: acc["runs"])


def decode(rows: DataFrame, source: str = "mask_rle") -> tuple[DataFrame, DataFrame]:
    """Foreground runs (start, length) of every valid mask, and the rejected rows."""
    rest = [c for c in rows.columns if c != source]
    runs = let(F.from_json(source, SCHEMA), lambda m: F.when(_valid(m), _runs(m)))
    marked = rows.select("*", runs.alias("__runs"))
    good = marked.select(*rest, F.inline("__runs"))
    return good, marked.filter("__runs IS NULL").drop("__runs")


def areas(rows: DataFrame, source: str = "mask_rle") -> DataFrame:
    """Foreground cells of every valid mask."""
    total = lambda runs: F.aggregate(
        runs, F.lit(0).cast("bigint"), lambda acc, r: acc + r["length"]
    )
    area = let(F.from_json(source, SCHEMA), lambda m: F.when(_valid(m), total(_runs(m))))
    return rows.withColumn("area", area).filter("area IS NOT NULL")
