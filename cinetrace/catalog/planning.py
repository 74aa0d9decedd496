"""Planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.functions import round_to
from cinetrace.plans import media as md

_PLAN = """pl AS (SELECT *, CASE WHEN duration_s<=180 THEN 'x' ELSE 'n' END AS detector_size, greatest(0.5::DOUBLE, least(3.0::DOUBLE, round_even(duration_s/30.0::DOUBLE,1))) AS detect_fps,
  greatest(0.1::DOUBLE, least(2.0::DOUBLE, round_even(duration_s/120.0::DOUBLE,1))) AS caption_fps FROM md)"""
_MEDIA = "md AS (SELECT run_id, video, duration_s*0.5 AS duration_s, fps, has_audio, width, height FROM b_media)"


def _media(t):
    return t.media().withColumn("duration_s", F.col("duration_s") * 0.5)


@query(
    "pln1_media_facts",
    """SELECT run_id, CASE WHEN run_id%4=0 THEN fps*100/1.0 ELSE duration_s END AS duration_s, width, height, fps, has_audio FROM b_media""",
)
def _pln1(t):
    """Probe texts; every fourth lacks a duration and falls back on its frame count."""
    s = lambda c: F.col(c).cast("bigint").cast("string")
    video = F.concat(
        F.lit('{"streams":[{"codec_type":"data"},{"codec_type":"video","width":'), s("width"), F.lit(',"height":'), s("height"),
        F.lit(',"r_frame_rate":"'), s("fps"), F.lit('/1","nb_frames":"'), (F.col("fps") * 100).cast("bigint").cast("string"), F.lit('"}'),
        F.when(F.col("has_audio"), ',{"codec_type":"audio"}').otherwise(""), F.lit('],"format":{'),
        F.when(F.col("run_id") % 4 == 0, "").otherwise(F.concat(F.lit('"duration":"'), F.col("duration_s").cast("string"), F.lit('"'))), F.lit("}}"),
    )
    return md.media_facts(t.media().select("run_id", video.alias("probe")))


@query("pln2_plan", f"WITH {_MEDIA}, {_PLAN} SELECT run_id, detector_size, detect_fps, caption_fps, has_audio AS audio_enabled, CASE WHEN has_audio THEN 'base.en' ELSE 'tiny.en' END AS speech_model FROM pl")
def _pln2(t):
    return md.derive_plan(_media(t)).select("run_id", "detector_size", "detect_fps", "caption_fps", "audio_enabled", "speech_model")


_EST = f"""{_MEDIA}, {_PLAN}, n AS (SELECT *, greatest(1, CAST(round_even(duration_s*detect_fps,0) AS BIGINT)) AS sampled, greatest(1, CAST(round_even(duration_s*caption_fps,0) AS BIGINT)) AS cap FROM pl),
 st AS (SELECT run_id, 'Frame selection' AS stage, sampled*0.02::DOUBLE+sampled*0.015::DOUBLE AS seconds FROM n
  UNION ALL SELECT run_id, 'Audio transcription', 0.5+duration_s/16 FROM n WHERE has_audio
  UNION ALL SELECT run_id, 'YOLO detection', 0.8+sampled*(CASE WHEN detector_size='x' THEN 0.22 ELSE 0.025 END)*1.15 FROM n
  UNION ALL SELECT run_id, 'Depth estimation', 1.5+sampled*0.1 FROM n UNION ALL SELECT run_id, 'Frame scoring', 0.5 FROM n
  UNION ALL SELECT run_id, 'VLM autostart', 12.0 FROM n UNION ALL SELECT run_id, 'VLM captioning', ((cap+9)//10)*11.0 FROM n UNION ALL SELECT run_id, 'Aggregation', 4.0 FROM n)"""


@query("pln3_stage_estimates", f"WITH {_EST} SELECT run_id, stage, round_even(seconds,6) AS seconds FROM st")
def _pln3(t):
    return md.estimate_stages(md.derive_plan(_media(t))).withColumn("seconds", round_to(F.col("seconds"), 6))


@query("pln3_totals", f"WITH {_EST} SELECT run_id, round_even(sum(seconds),8) AS total_s FROM st GROUP BY 1")
def _pln3t(t):
    return md.estimate_totals(md.derive_plan(_media(t))).withColumn("total_s", round_to(F.col("total_s"), 8))


@query(
    "pln4_plan_sentences",
    f"""WITH {_EST}, tt AS (SELECT run_id, CAST(floor(sum(seconds)) AS BIGINT) AS s FROM st GROUP BY 1)
    SELECT run_id, 'Analyzing `'||video||'` ('||CAST(round_even(duration_s,0) AS BIGINT)||'s, '||width||'×'||height||', '||CASE WHEN has_audio THEN 'audio' ELSE 'silent' END||') — YOLO'||detector_size||'-seg @ '||detect_fps
    ||' fps, depth on, audio '||CASE WHEN has_audio THEN 'on' ELSE 'off' END||', VLM keyframes @ '||caption_fps||' fps. Estimated time: '
    ||CASE WHEN s//60>=60 THEN printf('%d:%02d:%02d', s//3600, (s//60)%60, s%60) ELSE printf('%d:%02d', s//60, s%60) END||'.' AS sentence FROM pl JOIN tt USING (run_id)""",
)
def _pln4(t):
    return md.plan_sentences(md.derive_plan(_media(t)))
