"""Scoring and choosing frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinetrace.functions.geometry import iou
from cinetrace.operators.ordering import (
    frame_position,
    neighbour,
    percentiles,
    ranked,
)
from cinetrace.settings import block_rows
from cinetrace.sources.readers import Scratch

# Weights of the frame score.
DELTA_WEIGHT, CLASS_WEIGHT, TRACK_WEIGHT, OVERLAP_WEIGHT = 1.0, 2.0, 2.0, 0.5


def frame_sets(detections: DataFrame) -> DataFrame:
    """Distinct classes and tracks per frame."""
    classes = detections.select("run_id", "frame_idx", F.lit("class").alias("kind"), F.col("class_name").alias("item"))
    tracks = detections.filter("track_id IS NOT NULL").select(
        "run_id", "frame_idx", F.lit("track").alias("kind"), F.col("track_id").cast("string").alias("item")
    )
    return classes.union(tracks).distinct()


def _items(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """One row per frame and class, and per frame and track, with the last box by id."""
    corners = ["x1", "y1", "x2", "y2"]
    kind = lambda name, item: F.struct(
        F.lit(name).alias("kind"), F.col(item).cast("string").alias("item")
    )
    both = F.array(kind("class", "class_name"), kind("track", "track_id"))
    keys = ["run_id", "frame_idx", "pos"]
    return (
        detections.join(
            frame_position(frames).select("run_id", "frame_idx", "pos"), ["run_id", "frame_idx"]
        )
        .select(*keys, "detection_id", *corners, F.inline(both))
        .filter("item IS NOT NULL")
        .groupBy(*keys, "kind", "item")
        .agg(*[F.max_by(c, "detection_id").alias(c) for c in corners])
        .select(*keys, "kind", "item", F.struct(*corners).alias("box"))
    )


def _laid_out(frames: DataFrame, detections: DataFrame, carried: DataFrame | None) -> DataFrame:
    """run_id, blk, frame_idx, home, frame, now: per frame its columns, its classes and the last box by id of each track.

    Frames and detections travel together in one shuffle by run and block; all steps keep that layout.
    Detections of unknown frames fall away.  Frames of ``carried`` also come into their next block, not ``home``.
    """
    block = F.floor(F.col("frame_idx") / block_rows(frames))
    info = F.struct("timestamp_ms", "is_keyframe", "delta_score")
    box = F.struct("x1", "y1", "x2", "y2")
    found = F.struct(F.col("track_id").cast("string").alias("track"), "detection_id", F.col("class_name").cast("string").alias("class"), box.alias("box"))
    seen = detections.select("run_id", "frame_idx", found.alias("found"))
    rows = frames.select("run_id", "frame_idx", info.alias("frame")).unionByName(seen, allowMissingColumns=True)
    rows = rows.withColumn("blk", block)
    if carried is not None:
        rows = rows.join(carried, ["run_id", "frame_idx"], "left")
        rows = rows.withColumn("home", F.col("blk")).withColumn("blk", F.explode(F.array_compact(F.array("blk", "next_blk"))))
        rows = rows.withColumn("home", F.col("home") == F.col("blk")).drop("next_blk")
    else:
        rows = rows.withColumn("home", F.lit(True))
    own = ["run_id", "blk", "frame_idx"]
    listed = F.sort_array(F.collect_list("found"))  # by track and detection
    frame = rows.repartition("run_id", "blk").groupBy(*own, "home").agg(F.max("frame").alias("frame"), listed.alias("found")).filter("frame IS NOT NULL")
    tracked = F.filter("found", lambda d: d["track"].isNotNull())
    newest = lambda d, i: (i == F.size("tracked") - 1) | (F.try_element_at("tracked", (i + 2).cast("int"))["track"] != d["track"])
    boxes = F.map_from_entries(F.transform(F.filter("tracked", newest), lambda d: F.struct(d["track"], d["box"])))
    classes = F.array_compact(F.array_distinct(F.transform("found", lambda d: d["class"])))
    return frame.withColumn("tracked", tracked).select(*own, "home", "frame", F.struct(classes.alias("classes"), boxes.alias("boxes")).alias("now"))


def _carried(frames: DataFrame) -> DataFrame | None:
    """run_id, frame_idx and next_blk of the last frames of blocks that are not their run's last; None if there are none.

    They are as many as the blocks of the runs that have several, so they are found before the detections are read.
    """
    blocks = frames.groupBy("run_id", F.floor(F.col("frame_idx") / block_rows(frames)).alias("blk")).agg(F.max("frame_idx").alias("frame_idx"))
    following = F.lead("blk").over(Window.partitionBy("run_id").orderBy("blk"))
    lasts = blocks.select("run_id", "frame_idx", following.alias("next_blk")).filter("next_blk IS NOT NULL")
    lasts = Scratch(frames.sparkSession, "features").keep(lasts, "lasts")
    return None if lasts.isEmpty() else lasts


def frame_features(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Change against the previous frame: classes, tracks, box overlap.

    Each frame is compared with the one before it inside its block; the last frame of an earlier block is
    copied into the next one.  The detections are shuffled once, a frame's into one list.
    """
    rows = _laid_out(frames, detections, _carried(frames))
    inside = Window.partitionBy("run_id", "blk").orderBy("frame_idx")
    rows = rows.withColumn("before", F.lag("now").over(inside)).filter("home")

    def changed(now: Column, before: Column) -> Column:
        return F.size(F.array_except(now, before)) + F.size(F.array_except(before, now))

    was, now = F.col("before.boxes"), F.col("now.boxes")
    both = F.array_intersect(F.map_keys(now), F.map_keys(was))
    overlap = F.aggregate(both, F.lit(0.0), lambda acc, k: acc + iou(F.element_at(was, k), F.element_at(now, k)))
    later = F.col("before").isNotNull()
    count = lambda c: F.when(later, c).otherwise(0).cast("bigint")
    return rows.select(
        "run_id",
        "frame_idx",
        "frame.timestamp_ms",
        "frame.is_keyframe",
        F.coalesce("frame.delta_score", F.lit(0.0)).alias("delta_score"),
        count(changed(F.col("now.classes"), F.col("before.classes"))).alias("class_change"),
        count(changed(F.map_keys(now), F.map_keys(was))).alias("track_churn"),
        F.when(later & (F.size(both) > 0), 1.0 - overlap / F.size(both)).otherwise(0.0).alias("iou_drop"),
    )


def frame_scores(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Weighted frame score; the first frame of a run counts its delta only."""
    return frame_features(frames, detections).withColumn(
        "score",
        DELTA_WEIGHT * F.col("delta_score")
        + CLASS_WEIGHT * F.col("class_change")
        + TRACK_WEIGHT * F.col("track_churn")
        + OVERLAP_WEIGHT * F.col("iou_drop"),
    )


def select_scored(
    scored: DataFrame,
    frames_per_second: float | None = None,
    k: int | None = None,
    durations: DataFrame | None = None,
) -> DataFrame:
    """All keyframes, then the best others up to ``k`` frames per run.

    Without ``k`` it is ``max(1, round(duration * frames_per_second))``, a duration being at least one
    second.  It comes from ``durations`` (run_id, duration_s), as from the media table; runs that are
    not there, or all without such a table, last up to their last timestamp.

    The scores cost a pass over the detections; they are written once, in the order of their ranks.
    """
    scored = scored.select("run_id", "frame_idx", "timestamp_ms", "is_keyframe", "score")
    forced = F.col("is_keyframe").cast("int")
    placed = ranked(scored, ["run_id"], [forced.desc(), F.col("score").desc(), F.col("frame_idx")])
    runs = placed.groupBy("run_id").agg(
        (F.max("timestamp_ms") / 1000.0).alias("reach"), F.count_if("is_keyframe").alias("forced")
    )
    seconds = F.col("reach")
    if durations is not None:
        runs = runs.join(durations.select("run_id", "duration_s"), "run_id", "left")
        seconds = F.coalesce("duration_s", "reach")
    room = F.lit(k) if k is not None else F.bround(F.greatest(F.lit(1.0), seconds) * frames_per_second, 0)
    runs = runs.select("run_id", F.greatest(F.lit(1), room.cast("bigint"), F.col("forced")).alias("keep"))
    return placed.join(runs, "run_id").filter("rank < keep").select("run_id", "frame_idx", "score", "is_keyframe")


def keyframes_or_all(frames: DataFrame) -> DataFrame:
    """Keyframes of each run, or all its frames (``fallback``) when it has none."""
    has = frames.groupBy("run_id").agg(F.max("is_keyframe").alias("has_keyframes"))
    return (
        frames.join(has, "run_id")
        .filter("is_keyframe OR NOT has_keyframes")
        .withColumn("fallback", ~F.col("has_keyframes"))
        .drop("has_keyframes")
    )


def keyframe_threshold(frames: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Median plus ``multiplier`` population deviations of the non-zero deltas; none gives 0."""
    moving = frames.filter("delta_score <> 0")
    middle = percentiles(moving, ["run_id"], "delta_score", {"median": 0.5})
    spread = moving.groupBy("run_id").agg(F.stddev_pop("delta_score").alias("spread"))
    runs = frames.select("run_id").distinct()
    threshold = F.coalesce(F.col("median") + multiplier * F.col("spread"), F.lit(0.0))
    return (
        runs.join(middle.join(spread, "run_id"), "run_id", "left")
        .select("run_id", threshold.alias("threshold"))
    )


def pick_keyframes(frames: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Frames at or above a positive threshold, and the first frame of every run."""
    first = frames.groupBy("run_id").agg(F.min("frame_idx").alias("first_idx"))
    return (
        frames.join(thresholds, "run_id")
        .join(first, "run_id")
        .filter(
            ((F.col("delta_score") >= F.col("threshold")) & (F.col("threshold") > 0))
            | (F.col("frame_idx") == F.col("first_idx"))
        )
        .drop("first_idx")
    )


def escalation_threshold(frames: DataFrame, percentile: float = 90.0) -> DataFrame:
    """Percentile of the deltas, or their maximum for runs under 10 frames."""
    stats = frames.groupBy("run_id").agg(
        F.count("delta_score").alias("n"), F.max("delta_score").alias("top")
    )
    cut = percentiles(frames, ["run_id"], "delta_score", {"cut": percentile / 100.0})
    return stats.join(cut, "run_id").select(
        "run_id", F.when(F.col("n") < 10, F.col("top")).otherwise(F.col("cut")).alias("threshold")
    )


def uniform_grid(media: DataFrame, rate: float) -> DataFrame:
    """Every ``max(1, round(fps / rate))``-th frame index of each recording; no rate, no frames."""
    if rate <= 0:
        return media.select("run_id", F.lit(0).cast("bigint").alias("frame_idx")).filter("false")
    total = F.floor(F.col("duration_s") * F.col("fps"))
    step = F.greatest(F.lit(1), F.bround(F.col("fps") / rate, 0).cast("bigint"))
    return (
        media.withColumn("total", total)
        .filter("total > 0")
        .select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, step)).alias("frame_idx"))
    )


def _any_near(guess: Column, count: Column, at) -> Column:
    """Whether some i in [0, count) close to ``guess`` satisfies ``at(i)``."""
    near = F.sequence(F.floor(guess) - 2, F.floor(guess) + 2)
    return F.exists(near, lambda i: (i >= 0) & (i < count) & at(i))


def linspace_pick(frames: DataFrame, n: int, order: str = "frame_idx", keys=("run_id",)) -> DataFrame:
    """At most ``n`` evenly spaced rows per run, first and last included.

    A row decides from its own position and the run's size whether it is picked.
    """
    rows = frame_position(frames, order=order, total="total", keys=keys)
    step = (F.col("total") - 1) / F.lit(max(1, n - 1))  # a single pick is the first row
    at = lambda i: (
        F.when((i == n - 1) & (i > 0), F.col("total") - 1).otherwise(F.floor(i * step)) == F.col("pos")
    )
    picked = (F.col("total") <= n) | _any_near(F.col("pos") / step, F.lit(n), at)
    return rows.filter(picked).drop("total", "pos")


def spread_pick(frames: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows per run at positions ``floor(i * total / n)``."""
    rows = frame_position(frames, total="total")
    at = lambda i: F.floor(i * F.col("total") / n) == F.col("pos")
    picked = (F.col("total") <= n) | _any_near(F.col("pos") * n / F.col("total"), F.lit(n), at)
    return rows.filter(picked).drop("total", "pos")


def every_nth(frames: DataFrame, n: int) -> DataFrame:
    return frame_position(frames).filter(F.col("pos") % n == 0).drop("pos")


def keyframes_or_first(frames: DataFrame, n: int = 20) -> DataFrame:
    """Keyframes, or the first ``n`` frames of a run that has none."""
    return (
        frame_position(keyframes_or_all(frames))
        .filter(~F.col("fallback") | (F.col("pos") < n))
        .drop("pos", "fallback")
    )


def merge_selection(keyframes: DataFrame, grid: DataFrame) -> DataFrame:
    """Keyframes and grid frames, each frame once."""
    cols = ["run_id", "frame_idx"]
    return keyframes.select(cols).union(grid.select(cols)).distinct()


def stored_selection(frames: DataFrame) -> DataFrame:
    """Selection rebuilt from stored frames: everything scanned, deltas and threshold 0."""
    return frames.select(
        "run_id",
        "frame_idx",
        "image_path",
        "is_keyframe",
        F.lit(0.0).alias("delta"),
        F.lit(0.0).alias("threshold"),
    )


def thumbnail_delta(thumbs: DataFrame) -> DataFrame:
    """Mean absolute difference between consecutive thumbnails; 0 for the first."""
    rows = neighbour(frame_position(thumbs), ["run_id"], {"before": ("thumb", -1)})
    diff = F.aggregate(
        F.zip_with("thumb", "before", lambda a, b: F.abs(a.cast("double") - b)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    ) / F.size("thumb")
    return rows.select(
        "run_id", "frame_idx", F.when(F.col("pos") == 0, 0.0).otherwise(diff).alias("delta")
    )


def camera_mode(matches: DataFrame, first_pairs: int = 30, share: float = 0.05) -> DataFrame:
    """"moving" when the median mean displacement of the first pairs exceeds a share of the width.

    ``matches``: run_id, pair (from 0), displacement, width.  Runs without a displacement are static.
    A run has no more than ``first_pairs`` means, so their median is taken from a list.
    """
    first = F.when(F.col("pair") < first_pairs, F.col("pair")).alias("first_pair")
    pairs = matches.groupBy("run_id", first).agg(F.avg("displacement").alias("mean_move"), F.max("width").alias("width"))
    counts = F.col("run_id").isNotNull() & F.col("first_pair").isNotNull() & ~F.isnan("mean_move")
    moves = F.array_sort(F.collect_list(F.when(counts, F.col("mean_move")))).alias("moves")
    middle = (F.size("moves") - 1) / 2
    low, high = F.get("moves", F.floor(middle).cast("int")), F.get("moves", F.ceil(middle).cast("int"))
    median = low + (high - low) * (middle - F.floor(middle))
    runs = pairs.groupBy("run_id").agg(moves, F.max("width").alias("width")).select("run_id", "width", median.alias("median_move"))
    return runs.select(
        "run_id",
        F.coalesce("median_move", F.lit(0.0)).alias("median_move"),
        F.when(F.col("median_move") > share * F.col("width"), "moving").otherwise("static").alias("camera_mode"),
    )


def track_pairs(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Boxes of one track in consecutive frames, with their overlap.

    Several boxes of a track in one frame: the last by id counts.
    """
    boxes = _items(frames, detections).filter("kind = 'track'").withColumn("track_id", F.col("item").cast("bigint"))
    shifted = {"p_pos": ("pos", -1), "from_frame": ("frame_idx", -1), "p_box": ("box", -1)}
    return (
        neighbour(boxes, ["run_id", "track_id"], shifted)
        .filter("p_pos = pos - 1")
        .select("run_id", "track_id", "from_frame", "frame_idx", iou(F.col("p_box"), F.col("box")).alias("iou"))
    )


def with_stored_delta(selected: DataFrame, deltas: DataFrame) -> DataFrame:
    """Selected frames with their delta, 0 where none was stored."""
    return selected.join(deltas, ["run_id", "frame_idx"], "left").withColumn(
        "delta_score", F.coalesce("delta_score", F.lit(0.0))
    )


def paged(rows: DataFrame, size: int = 100, order: str = "frame_idx") -> DataFrame:
    """Number the pages of ``size`` rows; filter on ``page`` to show one."""
    return frame_position(rows, order=order).withColumn("page", F.floor(F.col("pos") / size)).drop("pos")
