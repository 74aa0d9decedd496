"""Planning over a catalogue of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.functions import round_to
from cinetrace.functions.times import duration_text

# Seconds per frame, load times and other costs of the estimate.
DETECT_S_PER_FRAME = {"n": 0.025, "s": 0.045, "m": 0.080, "l": 0.130, "x": 0.220}
SEGMENT_FACTOR = 1.15
DEPTH_S_PER_FRAME = 0.10
SPEECH_RATIO = {
    "tiny": 1 / 32, "tiny.en": 1 / 32, "base": 1 / 16, "base.en": 1 / 16, "small": 1 / 6, "small.en": 1 / 6,
    "medium": 1 / 2, "medium.en": 1 / 2, "large-v1": 1.0, "large-v2": 1.0, "large-v3": 1.0, "large-v3-turbo": 1 / 4,
}
SPEECH_DEFAULT, DETECT_DEFAULT = 1 / 8, 0.05
CHUNK_S, CHUNK_FRAME_S = 5.0, 0.6
MODEL_START_S, SPEECH_LOAD_S, DETECT_LOAD_S, DEPTH_LOAD_S = 12.0, 0.5, 0.8, 1.5
SYNTHESIS_S, SCORING_S = 4.0, 0.5
SCAN_S, FRAME_S = 0.02, 0.015

PROBE = (
    "struct<streams:array<struct<codec_type:string,width:bigint,height:bigint,r_frame_rate:string,nb_frames:string>>,"
    "format:struct<duration:string>>"
)


def media_facts(probes: DataFrame) -> DataFrame:
    """Facts from probe JSON (run_id, probe): first video stream, audio presence, duration.

    Without a duration it is the frame count over the denominator of the frame rate.
    """
    doc = probes.select("run_id", F.from_json("probe", PROBE).alias("p"))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    rows = doc.select(
        "run_id",
        first("video").alias("v"),
        first("audio").isNotNull().alias("has_audio"),
        F.coalesce(F.col("p.format.duration").try_cast("double"), F.lit(0.0)).alias("d"),
    )
    rate = F.split(F.coalesce("v.r_frame_rate", F.lit("30/1")), "/")
    num, den = rate[0].cast("double"), rate[1].cast("double")
    count = F.coalesce(F.col("v.nb_frames").try_cast("bigint"), F.lit(0))
    fallback = F.when(
        F.col("v").isNotNull() & (count > 0), count / F.when(den == 0, 30.0).otherwise(den)
    ).otherwise(0.0)
    return rows.select(
        "run_id",
        F.when(F.col("d") == 0, fallback).otherwise(F.col("d")).alias("duration_s"),
        F.coalesce("v.width", F.lit(0)).alias("width"),
        F.coalesce("v.height", F.lit(0)).alias("height"),
        F.when(F.col("v").isNull(), 0.0).when(den > 0, num / den).otherwise(30.0).alias("fps"),
        "has_audio",
    )


def _clamp(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def derive_plan(facts: DataFrame, depth_available: bool = True) -> DataFrame:
    """Processing knobs of each recording from its facts."""
    d = F.col("duration_s")
    return facts.withColumns(
        {
            "detector_size": F.when(d <= 180, "x").otherwise("n"),
            "segmentation": F.lit(True),
            "detect_fps": F.when(d > 0, _clamp(round_to(d / 30.0, 1), 0.5, 3.0)).otherwise(1.0),
            "confidence": F.lit(0.5),
            "audio_enabled": F.col("has_audio"),
            "speech_model": F.when(F.col("has_audio"), "base.en").otherwise("tiny.en"),
            "depth_enabled": F.lit(depth_available),
            "notes": F.lit("" if depth_available else "depth off: transformers not installed"),
            "caption_fps": F.when(d > 0, _clamp(round_to(d / 120.0, 1), 0.1, 2.0)).otherwise(0.5),
            "frame_mode": F.lit("keyframes"),
            "chunk_size": F.lit(10),
            "dynamic_chunking": F.lit(True),
            "dedup_threshold": F.lit(0.92),
            "threshold_mult": F.lit(1.0),
            "camera_mode": F.lit("auto"),
        }
    )


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def estimate_stages(plans: DataFrame, cold_start: bool = True) -> DataFrame:
    """Seconds per stage of each planned recording; stages that are off are left out."""
    d = F.col("duration_s")
    whole = lambda c: F.greatest(F.lit(1), F.bround(c, 0).cast("bigint"))
    sampled = whole(d * F.col("detect_fps"))
    captioned = whole(d * F.col("caption_fps"))
    chunks = F.ceil(captioned / F.col("chunk_size"))
    per_box = _lookup(DETECT_S_PER_FRAME, F.col("detector_size"), DETECT_DEFAULT) * F.when(
        F.col("segmentation"), SEGMENT_FACTOR
    ).otherwise(1.0)
    ratio = _lookup(SPEECH_RATIO, F.col("speech_model"), SPEECH_DEFAULT)
    costs = [
        ("Frame selection", sampled * SCAN_S + sampled * FRAME_S),
        ("Audio transcription", F.when(F.col("audio_enabled"), SPEECH_LOAD_S + d * ratio)),
        ("YOLO detection", DETECT_LOAD_S + sampled * per_box),
        ("Depth estimation", F.when(F.col("depth_enabled"), DEPTH_LOAD_S + sampled * DEPTH_S_PER_FRAME)),
        ("Frame scoring", F.lit(SCORING_S)),
        ("VLM autostart", F.lit(MODEL_START_S if cold_start else None).cast("double")),
        ("VLM captioning", chunks * (CHUNK_S + F.col("chunk_size") * CHUNK_FRAME_S)),
        ("Aggregation", F.lit(SYNTHESIS_S)),
    ]
    stages = F.array(*[F.struct(F.lit(n).alias("stage"), c.cast("double").alias("seconds")) for n, c in costs])
    return plans.select("run_id", F.inline(stages)).filter("seconds IS NOT NULL")


def estimate_totals(plans: DataFrame) -> DataFrame:
    return estimate_stages(plans).groupBy("run_id").agg(F.sum("seconds").alias("total_s"))


def plan_sentences(plans: DataFrame) -> DataFrame:
    """One sentence per recording: facts, plan and estimated time."""
    on = lambda c: F.when(F.col(c), "on").otherwise("off")
    text = F.concat(
        F.lit("Analyzing `"), "video", F.lit("` ("), F.bround("duration_s", 0).cast("bigint").cast("string"), F.lit("s, "),
        F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string"), F.lit(", "),
        F.when(F.col("has_audio"), "audio").otherwise("silent"), F.lit(") — YOLO"), "detector_size", F.lit("-seg @ "),
        F.col("detect_fps").cast("string"), F.lit(" fps, depth "), on("depth_enabled"), F.lit(", audio "), on("audio_enabled"),
        F.lit(", VLM keyframes @ "), F.col("caption_fps").cast("string"), F.lit(" fps. Estimated time: "),
        duration_text(F.col("total_s")), F.lit("."),
    )
    return plans.join(estimate_totals(plans), "run_id").select("run_id", text.alias("sentence"))
