"""Behaviour labels: bouts, transitions, budgets, clip spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinetrace.functions import round_to
from cinetrace.operators.ordering import (
    drop_halo,
    first_n,
    halo_window,
    islands,
    percentiles,
    position,
    time_buckets,
    with_halo,
)
from cinetrace.settings import block_rows
from cinetrace.sources.readers import Scratch

KEYS = ["run_id", "profile_name"]


def _ordered(labels: DataFrame, keys: list[str]) -> DataFrame:
    block = F.floor(F.col("frame_idx") / block_rows(labels))
    return position(labels, keys, [F.col("frame_idx")], [block])


def _in_bouts(labels: DataFrame) -> DataFrame:
    """Labels with their position, the label after them (``next_*``) and the position their bout starts at.

    Labels are laid out once by profile and block of frames.  What a block needs of its neighbours (how
    many rows came before, the label on either side, where the last bout began) crosses in one
    summary row per block, all of it in one pass over the summaries.
    """
    keys = [*KEYS, "blk"]
    frame = "frame_idx"
    block = F.floor(F.col(frame) / block_rows(labels)).alias("blk")
    inside = Window.partitionBy(*keys).orderBy(frame)
    after = F.struct("behavior", frame, "timestamp_ms")
    rows = labels.select("*", block).repartition(*keys)
    rows = rows.select(
        "*",
        (F.row_number().over(inside) - 1).cast("bigint").alias("at"),
        F.lag("behavior").over(inside).alias("said"),
        F.lead(after).over(inside).alias("next"),
    )
    turned = (F.col("at") > 0) & ~F.col("behavior").eqNullSafe(F.col("said"))
    blocks = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(after, frame).alias("first"),
        F.max_by("behavior", frame).alias("last"),
        F.max(F.when(turned, F.col("at"))).alias("turn"),
    )
    along = Window.partitionBy(*KEYS).orderBy("blk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "*",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
        F.lead("first").over(along).alias("first_after"),
        (F.lag("n").over(along).isNull() | ~F.col("first.behavior").eqNullSafe(F.lag("last").over(along))).alias("opens"),
    )
    began = F.coalesce(F.col("offset") + F.col("turn"), F.when(F.col("opens"), F.col("offset")))
    blocks = blocks.select(*keys, "offset", "first_after", "opens", F.max(began).over(earlier).alias("bout_before"))
    rows = rows.join(blocks, keys)
    starts = F.when(turned | ((F.col("at") == 0) & F.col("opens")), F.col("offset") + F.col("at"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    then = F.coalesce("next", "first_after")
    return rows.select(
        *labels.columns,
        (F.col("offset") + F.col("at")).alias("pos"),
        then["timestamp_ms"].alias("next_ms"),
        then["behavior"].alias("next_behavior"),
        then[frame].alias("next_frame"),
        F.coalesce(F.max(starts).over(so_far), F.col("bout_before")).alias("bout"),
    )


def bouts(labels: DataFrame) -> DataFrame:
    """Stretches of one behaviour: each ends where the next begins.

    The last bout of a profile ends at its last label, and lasts at least 0.1 s.
    """
    start, last = F.min("timestamp_ms"), F.max_by("timestamp_ms", "pos")
    follower = F.max_by("next_ms", "pos")
    end = F.when(follower.isNull(), F.greatest(last, start + 100)).otherwise(follower)
    return (
        _in_bouts(labels)
        .groupBy(*KEYS, "bout", "behavior")
        .agg(
            start.alias("start_ms"),
            end.alias("end_ms"),
            F.count(F.lit(1)).alias("frames"),
            F.min("frame_idx").alias("first_frame"),
            F.max("frame_idx").alias("last_frame"),
        )
    )


def bout_statistics(labels: DataFrame) -> DataFrame:
    """Count and duration figures per behaviour, rounded to 2 places.

    The figures read the bouts several times, so the (much smaller) bout table is written once.
    """
    spans = bouts(labels).select(*KEYS, "behavior", (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    spans = Scratch(labels.sparkSession, "bouts").keep(spans, "bouts")
    keys = [*KEYS, "behavior"]
    seconds = lambda c: round_to(c / 1000.0, 2)
    basic = spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bouts"),
        seconds(F.sum("ms")).alias("total_s"),
        seconds(F.avg("ms")).alias("mean_s"),
        seconds(F.min("ms")).alias("min_s"),
        seconds(F.max("ms")).alias("max_s"),
    )
    middle = percentiles(spans, keys, "ms", {"median_ms": 0.5})
    return basic.join(middle, keys).withColumn("median_s", seconds(F.col("median_ms"))).drop("median_ms")


def bout_frames(labels: DataFrame, limit: int = 20) -> DataFrame:
    """The first frames of every bout."""
    rank = F.col("pos") - F.col("bout")
    return _in_bouts(labels).filter(rank < limit).select(
        *KEYS, "bout", "behavior", "frame_idx", (rank + 1).alias("rank")
    )


def budget(labels: DataFrame) -> DataFrame:
    """Labels per behaviour and their share of the profile."""
    per = labels.groupBy(*KEYS, "behavior").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy(*KEYS).agg(F.sum("n").alias("all"))
    return per.join(whole, KEYS).select(*KEYS, "behavior", "n", (F.col("n") / F.col("all")).alias("share"))


def _changes(labels: DataFrame) -> DataFrame:
    rows = _in_bouts(labels).filter("next_behavior IS NOT NULL AND next_behavior <> behavior")
    return rows.select(
        *KEYS, F.col("behavior").alias("from_behavior"), F.col("next_behavior").alias("to_behavior"), F.col("next_frame").alias("to_frame")
    )


def transitions(labels: DataFrame) -> DataFrame:
    """Square matrix of behaviour changes as rows, zeros included.

    The zero cells come from the list of behaviours a profile uses, exploded twice.
    """
    seen = _changes(labels).groupBy(*KEYS, "from_behavior", "to_behavior").agg(F.count(F.lit(1)).alias("n"))
    cells = (
        labels.groupBy(*KEYS)
        .agg(F.collect_set("behavior").alias("names"))
        .select(*KEYS, F.explode("names").alias("from_behavior"), "names")
        .select(*KEYS, "from_behavior", F.explode("names").alias("to_behavior"))
    )
    return cells.join(seen, [*KEYS, "from_behavior", "to_behavior"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def transition_frames(labels: DataFrame, limit: int = 20) -> DataFrame:
    """The first frames at which each transition happens."""
    keys = [*KEYS, "from_behavior", "to_behavior"]
    return first_n(_changes(labels), keys, [F.col("to_frame")], limit).select(*keys, "to_frame", "rank")


def label_spans(
    labels: DataFrame, behavior: str | None = None, min_confidence: float | None = None, compat: bool = False
) -> DataFrame:
    """Contiguous same-behaviour spans, ending at the span's last label.

    By default spans are formed per profile and filtered afterwards.  ``compat`` filters
    first and mixes profiles, so one behaviour alone becomes a single long span.
    """
    wanted = F.lit(True)
    if behavior is not None:
        wanted = wanted & (F.col("behavior") == behavior)
    if min_confidence is not None:
        wanted = wanted & (F.col("confidence") >= min_confidence)
    keys = ["run_id"] if compat else KEYS
    rows = labels.filter(wanted) if compat else labels
    placed = position(
        rows, keys, [F.col("timestamp_ms"), F.col("frame_idx")], time_buckets("timestamp_ms")
    )
    marked = islands(placed, keys, ["behavior"], name="span")
    if not compat:
        marked = marked.filter(wanted)
    return (
        marked.groupBy(*keys, "span", "behavior")
        .agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))
        .withColumnRenamed("behavior", "label")
    )


def previous_labels(labels: DataFrame, n: int = 10) -> DataFrame:
    """The up to ``n`` labels before each label, as lines of text."""
    line = F.format_string("  frame %d: %s (conf=%.2f)", "frame_idx", "behavior", "confidence")
    rows = with_halo(_ordered(labels.withColumn("line", line), KEYS), KEYS, before=n)
    listed = F.collect_list("line").over(halo_window(KEYS).rowsBetween(-n, -1))
    text = F.when(F.size(listed) == 0, "(this is the start — no previous labels)").otherwise(
        F.array_join(listed, "\n")
    )
    return drop_halo(rows.withColumn("context", text)).drop("line", "pos")


def clean_labels(raw: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Map names to a vocabulary (name, position): exact, else ignoring case, else its last entry.

    The vocabulary is joined by name, so it may be of any size; only its last entry is looked up.
    """
    exact = vocabulary.select(F.col("name").alias("behavior"), F.col("name").alias("exact"))
    folded = vocabulary.groupBy(F.lower("name").alias("folded")).agg(F.max_by("name", "position").alias("loose"))
    last = vocabulary.agg(F.max_by("name", "position")).first()[0]
    return (
        raw.join(exact, "behavior", "left")
        .withColumn("folded", F.lower("behavior"))
        .join(folded, "folded", "left")
        .withColumn("clean", F.coalesce("exact", "loose", F.lit(last)))
        .drop("exact", "loose", "folded")
    )


def export_rows(labels: DataFrame, frames: DataFrame) -> DataFrame:
    """Label table with the frame time in seconds, 0 where the frame is unknown."""
    times = frames.select("run_id", "frame_idx", "timestamp_ms")
    return labels.drop("timestamp_ms").join(times, ["run_id", "frame_idx"], "left").select(
        "run_id",
        "profile_name",
        F.col("frame_idx").alias("frame"),
        round_to(F.coalesce("timestamp_ms", F.lit(0)) / 1000.0, 2).alias("t (s)"),
        F.col("behavior").alias("behaviour"),
        round_to(F.col("confidence"), 2).alias("confidence"),
        F.coalesce("note", F.lit("")).alias("note"),
    )
