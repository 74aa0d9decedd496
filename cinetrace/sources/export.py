"""Dataset exports.  Every export is a set of JSON-lines tables, so a run may be of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinetrace.functions import round_to
from cinetrace.operators.detections import confident
from cinetrace.operators.ordering import frame_position, position, ranked
from cinetrace.settings import block_rows, part_rows
from cinetrace.sources.keyed import FOLDER, run_folder
from cinetrace.sources.readers import Scratch


def _class_names(detections: DataFrame) -> DataFrame:
    return detections.groupBy("run_id").agg(F.array_sort(F.collect_set("class_name")).alias("names"))


def categories(detections: DataFrame) -> DataFrame:
    """Category ids 1..k per run by sorted class name.

    A run's class names are few, so they are numbered inside one array.
    """
    return _class_names(detections).select("run_id", F.posexplode("names").alias("at", "name")).select(
        "run_id", (F.col("at") + 1).cast("bigint").alias("id"), "name"
    )


def images(frames: DataFrame, width: int = 640, height: int = 360) -> DataFrame:
    """Image ids 0.. per run in frame order."""
    return frame_position(frames, "id").select(
        "run_id", "id",
        F.substring_index("image_path", "/", -1).alias("file_name"),
        F.lit(width).alias("width"), F.lit(height).alias("height"), "frame_idx", "timestamp_ms",
    )


def annotations(
    frames: DataFrame, detections: DataFrame, min_confidence: float = 0.0, width: int = 640, height: int = 360
) -> DataFrame:
    """Pixel boxes of detections whose frame exists, with image and category ids.

    A frame carries the few class names of its run, so the detections are shuffled once, to their frames.
    """
    image = images(frames, width, height).select("run_id", "frame_idx", F.col("id").alias("image_id"))
    image = image.join(_class_names(detections), "run_id", "left")
    category = F.array_position("names", F.col("class_name"))
    w = F.col("x2") * width - F.col("x1") * width
    h = F.col("y2") * height - F.col("y1") * height
    one = lambda c: round_to(c, 1)
    return (
        confident(detections, min_confidence)
        .join(image, ["run_id", "frame_idx"])
        .select(
            "run_id",
            F.col("detection_id").alias("id"),
            "image_id",
            F.coalesce(category, F.lit(0)).cast("bigint").alias("category_id"),
            F.array(one(F.col("x1") * width), one(F.col("y1") * height), one(w), one(h)).alias("bbox"),
            one(w * h).alias("area"),
            F.lit(0).alias("iscrowd"),
            round_to(F.col("confidence"), 4).alias("confidence"),
            "mean_depth",
        )
    )


def annotation_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """The annotation document of every run in numbered parts: run_id, part, images, annotations, categories.

    A part holds at most ``partRows`` entries of each list; together the parts are the document, and
    none of them grows with the run.  All three tables travel together, once: runs of at most ``blockRows``
    rows are numbered whole, larger ones by range partitions.
    """
    size, most = part_rows(annotations), block_rows(annotations)
    kinds = {
        "images": (images, ["id", "file_name", "width", "height", "frame_idx", "timestamp_ms"]),
        "annotations": (annotations, [c for c in annotations.columns if c != "run_id"]),
        "categories": (categories.withColumn("supercategory", F.lit("object")), ["id", "name", "supercategory"]),
    }
    rows = None
    for name, (df, fields) in kinds.items():
        own = df.select("run_id", F.lit(name).alias("kind"), F.col("id").alias("nr"), F.struct(*fields).alias(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    counts = images.select("run_id").unionByName(annotations.select("run_id")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    large = Scratch(annotations.sparkSession, "documents").keep(counts.filter(F.col("n") > most).select("run_id"), "large")
    keys = ["run_id", "kind"]
    split = not large.isEmpty()
    small = (rows.join(large, "run_id", "left_anti") if split else rows).repartition("run_id")
    placed = small.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("nr")) - 1)
    if split:
        placed = placed.unionByName(ranked(rows.join(large, "run_id", "left_semi"), keys, [F.col("nr")], "pos"))
    listed = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct("pos", F.col(k).alias("entry"))))
    in_order = [F.transform(F.sort_array(listed(k)), lambda s: s["entry"]).alias(k) for k in kinds]
    return placed.groupBy("run_id", F.floor(F.col("pos") / size).alias("part")).agg(*in_order)


def label_documents(rows: DataFrame) -> DataFrame:
    """Exported labels as a JSON array per run and profile, in numbered parts."""
    fields = [c for c in rows.columns if c not in ("run_id", "profile_name")]
    keys = ["run_id", "profile_name"]
    placed = position(rows, keys, [F.col("frame")], [F.floor(F.col("frame") / block_rows(rows))])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(*fields).alias("entry")))), lambda s: s["entry"])
    part = F.floor(F.col("pos") / part_rows(rows)).alias("part")
    return placed.groupBy(*keys, part).agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("labels"))


def write_csv(df: DataFrame, path: str, by: list[str]) -> None:
    """CSV files with a header; fields with separators, quotes or line ends are quoted, quotes doubled.

    In folders by the columns ``by``.  RUNS neighbouring runs share a folder and stand in its rows as the
    last column, so the files do not grow with the runs; a large run is written by many tasks.
    """
    rest = [c for c in df.columns if c not in by]
    folders = [FOLDER if c == "run_id" else c for c in by]
    run = ["run_id"] if "run_id" in by else []
    placed = df.withColumn(FOLDER, run_folder()) if run else df
    order = [*folders, *run, rest[0]]
    ranged = placed.select(*rest, *run, *folders).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").partitionBy(*folders).option("header", True).options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("header", True).option("multiLine", True).options(**_CSV).csv(path)


_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "enforceSchema": "false"}


def caption_lines(
    chunks: DataFrame, visual: DataFrame, audio: DataFrame, correlations: DataFrame, video: str = "unknown"
) -> DataFrame:
    """Tagged rows of one export: chunk captions, events and correlations."""
    tag = lambda name: [F.lit(name).alias("type"), F.lit(video).alias("video")]
    or_ = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    parts = [
        chunks.filter("summary <> ''").select(
            "run_id", *tag("chunk_caption"), "chunk_id", "frame_indices", F.col("summary").alias("caption")
        ),
        visual.select(
            "run_id", *tag("visual_event"), F.col("ev_idx").alias("event_idx"),
            F.coalesce("type", F.lit("other")).alias("event_type"), "entities",
            or_("start_time", "00:00"), or_("end_time", "00:00"), or_("description", ""), or_("confidence", 0.0),
        ),
        audio.select(
            "run_id", *tag("audio_event"), F.col("ev_idx").alias("event_idx"),
            or_("start_time", "00:00"), or_("end_time", "00:00"), or_("text", ""), or_("speaker", "unknown"),
        ),
        correlations.select(
            "run_id", *tag("multimodal_correlation"), "correlation_idx", "audio_idx", "visual_idx", or_("description", "")
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows


def frame_captions(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """Image and caption pairs; empty and "(no change)" captions are dropped."""
    lines = chunks.select("run_id", F.explode("per_frame_lines").alias("frame_idx", "caption"))
    kept = lines.filter((F.trim("caption") != "") & (F.lower(F.trim("caption")) != "(no change)"))
    return kept.join(frames.select("run_id", "frame_idx", "image_path", "timestamp_ms"), ["run_id", "frame_idx"])


def chunk_lines(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """Per-frame chunk lines for display; the time of an unknown frame is 0."""
    lines = chunks.select("run_id", "chunk_id", F.explode("per_frame_lines").alias("frame_idx", "line"))
    times = frames.select("run_id", "frame_idx", "timestamp_ms")
    return lines.join(times, ["run_id", "frame_idx"], "left").withColumn(
        "timestamp_ms", F.coalesce("timestamp_ms", F.lit(0))
    )


def analysis_lines(entities: DataFrame, visual: DataFrame, audio: DataFrame, timeline: DataFrame) -> DataFrame:
    """Analysis document as (section, element) lines, the dense timeline included."""
    def part(df: DataFrame, section: str, columns: list[str]) -> DataFrame:
        return df.select("run_id", F.lit(section).alias("section"), F.to_json(F.struct(*columns)).alias("element"))

    return (
        part(entities, "entities", ["id", "type", "description", "first_seen", "last_seen"])
        .union(part(visual, "visual_events", ["type", "entities", "start_time", "end_time", "description"]))
        .union(part(audio, "audio_events", ["type", "start_time", "end_time", "speaker", "text"]))
        .union(part(timeline, "dense_timeline", ["timestamp_ms", "text", "escalated", "verified"]))
    )


def transcript_documents(segments: DataFrame) -> DataFrame:
    """Transcript sidecar rows in the layout the transcript reader accepts."""
    one = F.struct(
        F.struct(F.col("start_ms").alias("from"), F.col("end_ms").alias("to")).alias("offsets"), "text"
    )
    return segments.select("run_id", "segment_id", F.array(one).alias("transcription"))


def chunk_documents(chunks: DataFrame) -> DataFrame:
    """Chunk documents with text keys, as JSON objects need."""
    return chunks.withColumn("per_frame_lines", F.transform_keys("per_frame_lines", lambda k, _v: k.cast("string")))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, each file compressed with gzip; the files of a large run are written by many tasks."""
    df.write.mode(mode).option("ignoreNullFields", "true").option("compression", "gzip").json(path)


def export_all(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every export under ``path``; returns a manifest of rows per export and run."""
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in tables.items():
        write_json(df, f"{path}/{name}")
        written = spark.read.schema("run_id bigint").json(f"{path}/{name}")
        rows = written.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("export", F.lit(name))
        manifest = rows if manifest is None else manifest.unionByName(rows)
    return manifest


def selected_lists(selected: DataFrame, part_size: int = 1000) -> DataFrame:
    """Selected frame numbers as JSON arrays of at most ``part_size`` entries per row."""
    rows = frame_position(selected)
    return rows.groupBy("run_id", F.floor(F.col("pos") / part_size).alias("part")).agg(
        F.to_json(F.sort_array(F.collect_list("frame_idx"))).alias("value")
    )


def load_lists(meta: DataFrame) -> DataFrame:
    """Frame numbers of stored lists; an unreadable list is empty."""
    parsed = F.coalesce(F.from_json("value", "array<bigint>"), F.array().cast("array<bigint>"))
    return meta.select("run_id", F.explode(parsed).alias("frame_idx")).filter("frame_idx IS NOT NULL")
