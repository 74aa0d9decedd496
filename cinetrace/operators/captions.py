"""Frame captions: review, escalation, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.functions.text import jaccard
from cinetrace.functions.times import clock_text
from cinetrace.operators.frames import _any_near, escalation_threshold
from cinetrace.operators.intervals import interval_join
from cinetrace.operators.ordering import (
    first_n,
    frame_position,
    neighbour,
    position,
    text_parts,
    time_buckets,
)


def effective_caption() -> Column:
    """The reviewer's text where the reviewer disagreed, else the first caption."""
    return F.when(
        F.col("verifier_caption").isNotNull() & (F.col("verifier_agrees") == F.lit(False)),
        F.col("verifier_caption"),
    ).otherwise(F.col("caption"))


def on_frames(captions: DataFrame, frames: DataFrame) -> DataFrame:
    return captions.join(frames, ["run_id", "frame_idx"])


def caption_rows(captions: DataFrame) -> DataFrame:
    """Display rows: time text, effective caption, escalation and verdict marks."""
    verdict = F.when(F.col("verifier_agrees").isNull(), "").when(F.col("verifier_agrees"), "agree").otherwise("disagree")
    return captions.select(
        "run_id",
        "frame_idx",
        clock_text(F.col("timestamp_ms")).alias("time"),
        effective_caption().alias("caption"),
        F.when(F.col("escalated"), "yes").otherwise("").alias("escalated"),
        verdict.alias("verdict"),
    )


def counts(captions: DataFrame) -> DataFrame:
    return captions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("escalated").alias("escalated"),
        F.count("verified_ms").alias("verified"),
        F.count("verifier_agrees").alias("judged"),
    )


def pending_reviews(captions: DataFrame, limit: int = 8) -> DataFrame:
    """First escalated captions without a verdict, per run."""
    waiting = captions.filter("escalated AND verifier_agrees IS NULL")
    return first_n(waiting, ["run_id"], [F.col("frame_idx")], limit)


def nontrivial(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.lower(F.trim(column)) != "(no change)")


def latest(captions: DataFrame, limit: int = 5) -> DataFrame:
    """Most recent captions of each run."""
    order = [F.col("created_ms").desc(), F.col("verified_ms").desc_nulls_last(), F.col("frame_idx").desc()]
    return first_n(captions, ["run_id"], order, limit)


def latest_verdicts(captions: DataFrame, limit: int = 5) -> DataFrame:
    judged = captions.filter("verified_ms IS NOT NULL")
    return first_n(judged, ["run_id"], [F.col("verified_ms").desc(), F.col("frame_idx").desc()], limit)


def with_previous(captions: DataFrame) -> DataFrame:
    """Each caption next to the caption before it in the run."""
    shifted = {"prev_frame": ("frame_idx", -1), "prev_caption": ("caption", -1)}
    return neighbour(frame_position(captions), ["run_id"], shifted)


def similarity(captions: DataFrame) -> DataFrame:
    """Word overlap with the previous captioned frame; NULL for the first."""
    rows = with_previous(captions)
    sim = F.when(F.col("prev_caption").isNotNull(), jaccard(F.col("caption"), F.col("prev_caption")))
    return rows.withColumn("similarity", sim)


def escalations(
    captions: DataFrame, thresholds: DataFrame | None = None, floor: float = 0.3
) -> DataFrame:
    """Frames whose delta reaches the run's threshold or whose caption reads differently."""
    if thresholds is None:
        thresholds = escalation_threshold(captions)
    flag = (F.col("delta_score") >= F.col("threshold")) | F.coalesce(
        F.col("similarity") < floor, F.lit(False)
    )
    return similarity(captions).join(thresholds, "run_id").withColumn("escalate", flag)


def uncaptioned(frames: DataFrame, captions: DataFrame) -> DataFrame:
    return frames.join(captions.select("run_id", "frame_idx"), ["run_id", "frame_idx"], "left_anti")


def dense_timeline(captions: DataFrame, max_lines: int = 120) -> DataFrame:
    """Escalated captions plus evenly spaced others, at most ``max_lines`` per run.

    Escalated rows stay even when they alone exceed the limit.
    """
    sizes = captions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("escalated").alias("kept")
    )
    rows = position(
        captions,
        ["run_id", "escalated"],
        [F.col("timestamp_ms"), F.col("frame_idx")],
        time_buckets("timestamp_ms"),
    ).join(sizes, "run_id")
    regular = F.col("total") - F.col("kept")
    room = F.lit(max_lines) - F.col("kept")
    step = regular / room
    at = lambda i: F.least(F.bround(i * step, 0).cast("bigint"), regular - 1) == F.col("pos")
    thinned = (room > 0) & ((regular <= room) | _any_near(F.col("pos") / step, room, at))
    return rows.filter(
        F.col("escalated") | (F.col("total") <= max_lines) | F.coalesce(thinned, F.lit(False))
    ).select(
        "run_id",
        "frame_idx",
        "timestamp_ms",
        effective_caption().alias("text"),
        "escalated",
        F.col("verifier_agrees").isNotNull().alias("verified"),
    )


def timeline_line() -> Column:
    mark = F.when(F.col("escalated"), "*").otherwise("")
    return F.concat(mark, clock_text(F.col("timestamp_ms")), F.lit(" "), F.col("text"))


def timeline_text(timeline: DataFrame) -> DataFrame:
    """The timeline as numbered text parts, one line per row."""
    return text_parts(_in_time(timeline), ["run_id"], timeline_line())


def timeline_lines(timeline: DataFrame) -> DataFrame:
    """The lines of the timeline with their position."""
    return _in_time(timeline).select("run_id", "pos", timeline_line().alias("line"))


def _in_time(rows: DataFrame, column: str = "timestamp_ms") -> DataFrame:
    return position(rows, ["run_id"], [F.col(column), F.col("frame_idx")], time_buckets(column))


def speech_around(frames: DataFrame, segments: DataFrame, pad_ms: int) -> DataFrame:
    """Speech segments that strictly overlap ``pad_ms`` on either side of a frame."""
    probes = frames.withColumns(
        {"w_start": F.col("timestamp_ms") - pad_ms, "w_end": F.col("timestamp_ms") + pad_ms}
    )
    pairs = interval_join(
        probes, segments, ["run_id"], ("w_start", "w_end"), ("start_ms", "end_ms"), "none", max(10_000, 2 * pad_ms)
    )
    return pairs.drop("w_start", "w_end")


def speech_at(frames: DataFrame, segments: DataFrame, closed: str = "both") -> DataFrame:
    """Speech segments that contain a frame's instant."""
    probes = frames.withColumns({"w_start": F.col("timestamp_ms"), "w_end": F.col("timestamp_ms")})
    pairs = interval_join(
        probes, segments, ["run_id"], ("w_start", "w_end"), ("start_ms", "end_ms"), closed
    )
    return pairs.drop("w_start", "w_end")


def review_tasks(captions: DataFrame, segments: DataFrame, pad_ms: int = 5000, lines: int = 6) -> DataFrame:
    """Escalated captions with the frame before and the speech around them."""
    escalated = with_previous(captions).filter("escalated")
    speech = speech_around(escalated.select("run_id", "frame_idx", "timestamp_ms"), segments, pad_ms)
    heard = (
        first_n(speech, ["run_id", "frame_idx"], [F.col("start_ms"), F.col("segment_id")], lines, "line")
        .groupBy("run_id", "frame_idx")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), " | "
            ).alias("speech")
        )
    )
    return escalated.join(heard, ["run_id", "frame_idx"], "left").select(
        "run_id", "frame_idx", "prev_frame", "prev_caption", "caption", "change_line",
        F.coalesce("speech", F.lit("")).alias("speech"),
    )


def walker_totals(outcomes: DataFrame) -> DataFrame:
    """Counts per run over an outcome table (run_id, kind, outcome)."""
    tally = lambda kind, out: F.count_if(
        (F.col("kind") == kind) & (F.col("outcome") == out)
    )
    return outcomes.groupBy("run_id").agg(
        tally("walk", "captioned").alias("captioned"),
        tally("walk", "skipped").alias("skipped"),
        tally("walk", "error").alias("errors"),
        tally("review", "agreed").alias("agreed"),
        tally("review", "disagreed").alias("disagreed"),
        tally("review", "error").alias("review_errors"),
        F.count_if((F.col("kind") == "review") & F.col("outcome").isin("agreed", "disagreed")).alias("verified"),
    )


def stage_outcome(totals: DataFrame) -> DataFrame:
    """A stage whose every request failed is an error and stays open for a retry."""
    failed = (F.col("captioned") + F.col("skipped") == 0) & (F.col("errors") > 0)
    return totals.select(
        "run_id",
        F.when(failed, "error").otherwise("done").alias("status"),
        (~failed).alias("complete"),
        F.when(failed, F.format_string("all %d caption requests failed", "errors")).alias("error"),
    )
