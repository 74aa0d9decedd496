"""Statistics, repair and lookup over detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.functions.geometry import normalise_box
from cinetrace.operators.ordering import first_n


def per_frame(detections: DataFrame) -> DataFrame:
    return detections.groupBy("run_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"))


def class_distribution(detections: DataFrame) -> DataFrame:
    return detections.groupBy("run_id", "class_name").agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(detections: DataFrame, bins: int = 50) -> DataFrame:
    """Counts per confidence bin over [0, 1]; 1.0 falls into the last bin."""
    cell = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)))
    return detections.groupBy("run_id", cell.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confident(detections: DataFrame, floor: float) -> DataFrame:
    return detections.filter(F.col("confidence") >= floor)


def set_differences(detections: DataFrame) -> DataFrame:
    """Classes that a frame has in common with the frame numbered before it, and those of only one of them.

    A frame travels as one row with the set of its classes; a class that is not known is one of them.
    """
    keys = ["run_id", "frame_idx"]
    own = detections.groupBy(*keys).agg(F.collect_set(F.struct("class_name")).alias("now"))
    earlier = own.select("run_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("now").alias("before"))
    both = own.unionByName(earlier, allowMissingColumns=True).groupBy(*keys)
    pairs = both.agg(F.first("now", True).alias("now"), F.first("before", True).alias("before"))
    only = lambda a, b: F.size(F.array_except(a, b))
    return pairs.filter("now IS NOT NULL AND before IS NOT NULL").select(
        *keys,
        F.size(F.array_intersect("now", "before")).cast("bigint").alias("common"),
        (only("now", "before") + only("before", "now")).cast("bigint").alias("differ"),
    )


def class_lists(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Class list of every keyframe, ordered; NULL where nothing was detected."""
    lists = detections.groupBy("run_id", "frame_idx", "class_name").agg(F.count(F.lit(1)).cast("int").alias("n"))
    lists = lists.groupBy("run_id", "frame_idx").agg(
        F.array_join(
            F.flatten(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("class_name", "n"))),
                    lambda s: F.array_repeat(s["class_name"], s["n"]),
                )
            ),
            ",",
        ).alias("classes")
    )
    return frames.filter("is_keyframe").select("run_id", "frame_idx").join(
        lists, ["run_id", "frame_idx"], "left"
    )


def detection_text(none: str = "(none)") -> Column:
    """Aggregate: the boxes of a frame as one text, in id order."""
    one = lambda s: F.concat(
        F.format_string(
            "%s at [%.2f,%.2f,%.2f,%.2f] conf=%.2f",
            s["class_name"], s["x1"], s["y1"], s["x2"], s["y2"], s["confidence"],
        ),
        F.when(s["mean_depth"].isNotNull(), F.format_string(" depth=%.2f", s["mean_depth"])).otherwise(""),
    )
    cols = ["detection_id", "class_name", "x1", "y1", "x2", "y2", "confidence", "mean_depth"]
    rows = F.sort_array(F.collect_list(F.when(F.col("detection_id").isNotNull(), F.struct(*cols))))
    return F.when(F.size(rows) == 0, none).otherwise(F.array_join(F.transform(rows, one), "; "))


def frame_texts(frames: DataFrame, detections: DataFrame, none: str = "(none)") -> DataFrame:
    """Detection text of every frame, ``none`` for frames without detections."""
    texts = detections.groupBy("run_id", "frame_idx").agg(detection_text(none).alias("text"))
    return frames.join(texts, ["run_id", "frame_idx"], "left").withColumn(
        "text", F.coalesce("text", F.lit(none))
    )


def frame_bundle(frames: DataFrame, detections: DataFrame, depth: DataFrame) -> DataFrame:
    """Every frame with its detections (id order) and depth path."""
    boxes = detections.groupBy("run_id", "frame_idx").agg(
        F.sort_array(F.collect_list(F.struct("detection_id", "class_name", "confidence"))).alias("detections")
    )
    return frames.join(boxes, ["run_id", "frame_idx"], "left").join(depth, ["run_id", "frame_idx"], "left")


def repair_boxes(detections: DataFrame, width: float, height: float) -> DataFrame:
    """Bring runs stored in pixels to the unit square.

    A run counts as pixels when a corner among its first ten detections exceeds 1.
    """
    head = first_n(detections, ["run_id"], [F.col("detection_id")], 10)
    flags = head.groupBy("run_id").agg(
        (F.max(F.greatest("x1", "y1", "x2", "y2")) > 1.0).alias("rescaled")
    )
    rest = [c for c in detections.columns if c not in ("x1", "y1", "x2", "y2")]
    scaled = normalise_box(F.lit(width), F.lit(height))
    fixed = [
        F.when(F.col("rescaled"), new).otherwise(F.col(c)).alias(c)
        for new, c in zip(scaled, ("x1", "y1", "x2", "y2"))
    ]
    return detections.join(flags, "run_id").select(*rest, *fixed, "rescaled")


def repair_report(detections: DataFrame, width: float, height: float) -> DataFrame:
    """What ``repair_boxes`` would touch, per run."""
    return repair_boxes(detections, width, height).groupBy("run_id").agg(
        F.countDistinct("frame_idx").alias("frames"),
        F.count(F.lit(1)).alias("detections"),
        F.max("rescaled").alias("rescaled"),
    )


def with_existing_frame(detections: DataFrame, frames: DataFrame) -> DataFrame:
    return detections.join(frames.select("run_id", "frame_idx"), ["run_id", "frame_idx"], "left_semi")


def _grid_box(width: int, height: int) -> dict[str, Column]:
    return {
        "gx1": F.greatest(F.lit(0), (F.col("x1") * width).cast("int")),
        "gy1": F.greatest(F.lit(0), (F.col("y1") * height).cast("int")),
        "gx2": F.least(F.lit(width), (F.col("x2") * width).cast("int")),
        "gy2": F.least(F.lit(height), (F.col("y2") * height).cast("int")),
    }


def on_grid(detections: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes in whole grid cells; boxes that clamp to nothing are dropped."""
    return detections.withColumns(_grid_box(width, height)).filter("gx2 > gx1 AND gy2 > gy1")


def mean_depths(detections: DataFrame, maps: DataFrame, width: int, height: int) -> DataFrame:
    """Mean raw depth inside each box.  ``maps``: run_id, frame_idx, depth (row-major)."""
    boxes = on_grid(detections, width, height).join(maps, ["run_id", "frame_idx"])
    cells = F.flatten(
        F.transform(
            F.sequence("gy1", F.col("gy2") - 1),
            lambda r: F.slice("depth", r * width + F.col("gx1") + 1, F.col("gx2") - F.col("gx1")),
        )
    )
    total = F.aggregate(cells, F.lit(0.0), lambda acc, v: acc + v)
    return boxes.withColumn("mean_depth", total / F.size(cells)).drop("depth")


def normalised_maps(maps: DataFrame) -> DataFrame:
    """Depth maps scaled to [0, 1]; a flat map becomes zeros."""
    lo, hi = F.array_min("depth").cast("double"), F.array_max("depth").cast("double")
    return maps.withColumn(
        "depth",
        F.when(hi > lo, F.transform("depth", lambda v: (v - lo) / (hi - lo))).otherwise(
            F.transform("depth", lambda v: F.lit(0.0))
        ),
    )
