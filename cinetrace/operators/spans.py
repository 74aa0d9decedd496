"""Event spans: rows, filters, cut lists, joins on time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinetrace.functions import round_to
from cinetrace.functions.text import slug
from cinetrace.functions.times import clock_to_ms, mmss_to_seconds
from cinetrace.operators.intervals import interval_join
from cinetrace.operators.ordering import position, running, time_buckets
from cinetrace.settings import block_ms


def event_rows(events: DataFrame) -> DataFrame:
    """Timeline rows: seconds, at least half a second long, with row and bar labels."""
    start = mmss_to_seconds(F.coalesce("start_time", F.lit("00:00")))
    end = mmss_to_seconds(F.coalesce("end_time", "start_time", F.lit("00:00")))
    names = F.array_join(F.coalesce("entities", F.array().cast("array<string>")), ", ")
    return events.select(
        "run_id",
        "ev_idx",
        F.when(names == "", "—").otherwise(names).alias("row"),
        "type",
        start.alias("start"),
        F.when(end <= start, start + 0.5).otherwise(end).alias("end"),
        F.format_string("%s (%.2f)", F.col("type"), round_to(F.col("confidence"), 2)).alias("label"),
        "description",
        "entities",
    )


def with_entity(events: DataFrame, entity: str | None) -> DataFrame:
    return events if entity is None else events.filter(F.array_contains("entities", entity))


def of_type(events: DataFrame, behavior: str | None) -> DataFrame:
    return events if behavior is None else events.filter(F.col("type") == behavior)


def visual_spans(events: DataFrame, entity: str | None = None, behavior: str | None = None) -> DataFrame:
    """Event spans in milliseconds, labelled "type: entities"."""
    chosen = with_entity(of_type(events, behavior), entity)
    start = clock_to_ms(F.col("start_time"))
    end = clock_to_ms(F.coalesce("end_time", "start_time"))
    names = F.array_join("entities", ", ")
    label = F.when(F.size("entities") == 0, F.col("type")).otherwise(F.concat("type", F.lit(": "), names))
    return chosen.select(
        "run_id", start.alias("start_ms"), F.greatest(start, end).alias("end_ms"), label.alias("label")
    )


def all_spans(
    events: DataFrame, label_spans: DataFrame, entity: str | None = None, behavior: str | None = None
) -> DataFrame:
    """Event spans and label spans.  Labels have no entity, so an entity filter leaves them out."""
    spans = visual_spans(events, entity, behavior)
    if entity is not None:
        return spans
    return spans.unionByName(label_spans.select("run_id", "start_ms", "end_ms", "label"))


def timeline_extent(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Length of the time axis: the later of the last frame and the last event end (seconds)."""
    rows = event_rows(events).groupBy("run_id").agg(F.max("end").alias("last_end"))
    span = frames.groupBy("run_id").agg((F.max("timestamp_ms") / 1000.0).alias("seconds"))
    return span.join(rows, "run_id", "full").select(
        "run_id",
        F.greatest(F.coalesce("seconds", F.lit(0.0)), F.coalesce("last_end", F.lit(1.0))).alias("extent"),
    )


def focused_rows(events: DataFrame, entity: str) -> DataFrame:
    """Rows of one entity, or every row of a run that never shows it."""
    rows = event_rows(events).withColumn("hit", F.array_contains("entities", entity))
    shown = rows.groupBy("run_id").agg(F.max("hit").alias("shown"))
    return rows.join(shown, "run_id").filter("hit OR NOT shown").drop("shown", "hit")


def active_at(instants: DataFrame, events: DataFrame) -> DataFrame:
    """Events active at each instant (run_id, at seconds), both ends included."""
    probes = instants.withColumns({"p0": F.col("at"), "p1": F.col("at")})
    rows = event_rows(events)
    return interval_join(probes, rows, ["run_id"], ("p0", "p1"), ("start", "end"), "both", 10.0).drop("p0", "p1")


def lifespan_frames(entities: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames between an entity's first and last sighting."""
    first = mmss_to_seconds(F.col("first_seen"))
    last = mmss_to_seconds(F.coalesce("last_seen", "first_seen"))
    lives = entities.select(
        "run_id", "id", first.alias("fs"), F.greatest(last, first + 0.001).alias("ls")
    )
    at = F.col("timestamp_ms") / 1000.0
    probes = frames.select("run_id", "frame_idx", "timestamp_ms", at.alias("p0"), at.alias("p1"))
    return interval_join(probes, lives, ["run_id"], ("p0", "p1"), ("fs", "ls"), "both", 10.0).select(
        "run_id", "id", "frame_idx", "timestamp_ms"
    )


def correlated(pairs: DataFrame, visual: DataFrame, audio: DataFrame) -> DataFrame:
    """Texts of correlated events; a position that is missing or out of range shows as a number."""
    v = visual.select("run_id", F.col("ev_idx").alias("visual_idx"), F.col("description").alias("v"))
    a = audio.select("run_id", F.col("ev_idx").alias("audio_idx"), F.col("text").alias("a"))
    shown = lambda text, idx: F.when(
        F.coalesce(F.col(text), F.lit("")) == "",
        F.concat(F.lit("(event #"), F.coalesce(F.col(idx).cast("string"), F.lit("None")), F.lit(")")),
    ).otherwise(F.substring(text, 1, 80))
    return (
        pairs.join(v, ["run_id", "visual_idx"], "left")
        .join(a, ["run_id", "audio_idx"], "left")
        .select(
            *pairs.columns,
            shown("v", "visual_idx").alias("visual_event"),
            shown("a", "audio_idx").alias("audio_event"),
        )
    )


def appearances(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events of each known entity."""
    listed = events.select("run_id", "ev_idx", "type", F.explode(F.array_distinct("entities")).alias("id"))
    return listed.join(entities.select("run_id", "id", F.col("type").alias("entity_type")), ["run_id", "id"])


def cut_list(spans: DataFrame, durations: DataFrame) -> DataFrame:
    """Numbered clips clamped to the source; spans that clamp to nothing are dropped.

    ``durations``: run_id, duration_s.  Numbers count all spans of a run in time order.
    """
    rows = position(
        spans, ["run_id"], [F.col("start_ms"), F.col("end_ms")], time_buckets("start_ms"), "clip"
    ).join(durations, "run_id", "left")
    last_start = F.greatest(F.lit(0.0), F.col("duration_s") - 0.1)
    known = F.col("duration_s").isNotNull()
    raw = F.greatest(F.lit(0.0), F.col("start_ms") / 1000.0)
    start = F.when(known, F.least(raw, last_start)).otherwise(raw)
    end = F.when(known, F.least(F.col("end_ms") / 1000.0, F.col("duration_s"))).otherwise(
        F.col("end_ms") / 1000.0
    )
    return (
        rows.select(
            "run_id",
            "clip",
            start.alias("start_s"),
            (end - start).alias("duration_s"),
            "label",
            F.format_string("clip_%03d_%s.mp4", F.col("clip"), slug(F.col("label"))).alias("file"),
        )
        .filter("duration_s > 0")
    )


def crossfade_offsets(clips: DataFrame, fade_s: float = 0.5) -> DataFrame:
    """Where each clip of a montage fades in: the summed lengths before it less the fades."""
    block = F.floor(F.col("clip") / max(1, block_ms(clips) // 1000))
    offset = running(
        clips, ["run_id"], block, [F.col("clip")], F.col("duration_s") - fade_s, "offset", "sum", "before"
    )
    return offset.withColumn("offset", F.coalesce("offset", F.lit(0.0)))


def play_positions(hits: DataFrame, frames: DataFrame) -> DataFrame:
    """Hits with the time to play from: their frame's time if known, else their own."""
    times = frames.select("run_id", "frame_idx", F.col("timestamp_ms").alias("frame_ms"), "image_path")
    return (
        hits.join(times, ["run_id", "frame_idx"], "left")
        .withColumn("play_ms", F.coalesce("frame_ms", "timestamp_ms", F.lit(0)))
        .drop("frame_ms")
    )


def entity_table(entities: DataFrame) -> DataFrame:
    """Display columns of the entities; missing values are empty."""
    cols = ["id", "type", "first_seen", "last_seen", "description"]
    return entities.select("run_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols])


