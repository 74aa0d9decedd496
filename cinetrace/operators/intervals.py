"""Interval joins and span merging."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinetrace.settings import block_ms

_FACTOR = 8
_LONG = 3  # level from which spans are long: 64 times the base


def interval_join(
    probes: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    probe: tuple[str, str],
    span: tuple[str, str],
    closed: str = "none",
    base: float = 10_000,
) -> DataFrame:
    """Pairs whose ranges meet.

    ``probe`` / ``span`` name the start and end columns.  ``closed``: ``"none"`` is strict
    overlap, ``"both"`` counts touching ends, ``"start"`` is half-open
    (``span.start <= probe.end and span.end > probe.start``).

    Probes must be no longer than ``base``.  A span is filed under cells of the first width, ``base`` times a
    power of eight, that is no shorter than itself: at most two cells.  Long spans, of which a run
    has few, are filed under cells an eighth as wide: at most nine, so that all probes of a run do
    not meet in one.  Probes ask only the widths that occur; a pair that shares two cells is
    reported in the cell of the later start only, which saves a de-duplication shuffle.
    """
    keys = list(keys)
    ps, pe, ss, se = (F.col(c) for c in (*probe, *span))
    level = F.when(se - ss <= base, 0).otherwise(F.ceil(F.log((se - ss) / base) / math.log(_FACTOR) - 1e-9)).cast("int")
    level = F.when(level >= _LONG, level - 1).otherwise(level)
    width = F.lit(float(base)) * F.pow(F.lit(float(_FACTOR)), F.col("__lvl"))
    filed = spans.withColumn("__lvl", level)
    occur = [r[0] for r in filed.select("__lvl").distinct().collect()]  # at most the log of the longest span
    filed = filed.withColumn("__cell", F.explode(F.sequence(F.floor(ss / width), F.floor(se / width))))
    asked = probes.withColumn("__lvl", F.explode(F.array(*[F.lit(i).cast("int") for i in occur]).cast("array<int>")))
    asked = asked.withColumn(
        "__cell", F.explode(F.sequence(F.floor(ps / width), F.floor(pe / width)))
    )
    meets = {
        "none": (ss < pe) & (se > ps),
        "both": (ss <= pe) & (se >= ps),
        "start": (ss <= pe) & (se > ps),
    }[closed]
    return (
        asked.join(filed, keys + ["__lvl", "__cell"])
        .filter(meets & (F.col("__cell") == F.floor(F.greatest(ps, ss) / width)))
        .drop("__lvl", "__cell")
    )


def in_time_range(spans: DataFrame, lo: float, hi: float) -> DataFrame:
    """Spans that touch ``[lo, hi]`` (inclusive on both sides)."""
    return spans.filter((F.col("end_ms") >= lo) & (F.col("start_ms") <= hi))


def pad_and_merge(spans: DataFrame, pad_ms: int = 1500, label: str = "label") -> DataFrame:
    """Pad every span, merge those that overlap or touch, join the distinct labels in order."""
    lo = F.least("start_ms", "end_ms") - pad_ms
    hi = F.greatest("start_ms", "end_ms") + pad_ms
    padded = spans.select(
        "run_id",
        F.greatest(lo, F.lit(0)).cast("bigint").alias("start_ms"),
        hi.cast("bigint").alias("end_ms"),
        F.col(label).alias("label"),
    )
    merged = merge_spans(padded)
    # One row per (island, label) first: the list is as long as the label vocabulary.
    per_label = merged.groupBy("run_id", "island", "label").agg(
        F.min(F.struct("start_ms", "end_ms")).alias("seen"),
        F.max("end_ms").alias("end_ms"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("seen", "label")))
    return per_label.groupBy("run_id", F.col("island").alias("start_ms")).agg(
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(ordered, lambda s: s["label"]), " + ").alias("label"),
    )


def merge_spans(spans: DataFrame) -> DataFrame:
    """Add ``island``: the start of the merged span each row belongs to.

    One pass: a row opens an island if it starts after all ends before it, those inside its block and
    those of earlier blocks.  Of the rows that open one as far as their block goes, the last does so
    for good if any does, so a block's summary (its greatest end, its last opening) tells where the
    island began that the next block goes on with.
    """
    keys = ["run_id", "__blk"]
    start = F.col("start_ms")
    inside = Window.partitionBy(*keys)
    so_far = inside.orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("__blk", F.floor(start / block_ms(spans))).withColumn("__reach", F.max("end_ms").over(so_far))
    fresh = F.col("__reach").isNull() | (start > F.col("__reach"))
    blocks = rows.groupBy(*keys).agg(F.max("end_ms").alias("__end"), F.max(F.when(fresh, start)).alias("__opening"))
    earlier = Window.partitionBy("run_id").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__opening", F.max("__end").over(earlier).alias("__before"))
    beyond = lambda c: F.col("__before").isNull() | (c > F.col("__before"))
    opened = F.when(beyond(F.col("__opening")), F.col("__opening"))
    blocks = blocks.select(*keys, "__before", F.max(opened).over(earlier).alias("__island"))
    # Rows with one start share an island whichever of them happened to open it.
    with_peers = inside.orderBy("start_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.max(F.when(fresh & beyond(start), start)).over(with_peers)
    return rows.join(blocks, keys).withColumn("island", F.coalesce(opens, "__island")).drop("__blk", "__reach", "__before", "__island")
