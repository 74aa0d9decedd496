"""Dataset exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.catalog.keyed import _LINES, _chunk_docs
from cinetrace.operators import behavior as be
from cinetrace.operators.captions import dense_timeline
from cinetrace.operators.frames import keyframes_or_all
from cinetrace.sources import export as ex
from cinetrace.sources import readers as rd

_CAT = "ct AS (SELECT run_id, class_name, dense_rank() OVER (PARTITION BY run_id ORDER BY class_name) AS id FROM (SELECT DISTINCT run_id, class_name FROM b_detections))"
_IMG = "im AS (SELECT run_id, frame_idx, timestamp_ms, image_path, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx)-1 AS id FROM b_frames)"


@query("win17_category_ids", f"WITH {_CAT} SELECT run_id, id, class_name AS name FROM ct")
def _win17(t):
    return ex.categories(t.detections())


@query("win16_image_ids", f"WITH {_IMG} SELECT run_id, id, image_path AS file_name, 640 AS width, 360 AS height, frame_idx, timestamp_ms FROM im")
def _win16(t):
    return ex.images(t.frames())


_ANN = f"""{_CAT}, {_IMG}, an AS (SELECT d.run_id, d.detection_id AS id, im.id AS image_id, ct.id AS category_id, x1*640 AS px, y1*360 AS py, x2*640-x1*640 AS w, y2*360-y1*360 AS h, confidence, mean_depth
  FROM b_detections d JOIN im USING (run_id, frame_idx) JOIN ct ON ct.run_id=d.run_id AND ct.class_name=d.class_name)"""


def _ann(t):
    return ex.annotations(t.frames(), t.detections())


@query(
    "snk10_coco_annotations",
    f"""WITH {_ANN} SELECT run_id, id, image_id, category_id, round_even(px,1) AS x, round_even(py,1) AS y, round_even(w,1) AS w, round_even(h,1) AS h,
    round_even(w*h,1) AS area, round_even(confidence,4) AS confidence, mean_depth FROM an""",
)
def _snk10(t):
    b = F.col("bbox")
    return _ann(t).select(
        "run_id", "id", "image_id", "category_id", b[0].alias("x"), b[1].alias("y"), b[2].alias("w"), b[3].alias("h"), "area", "confidence", "mean_depth"
    )


_DOCUMENT = """run_id bigint, part bigint, images array<struct<id:bigint,file_name:string,width:bigint,height:bigint,frame_idx:bigint,timestamp_ms:bigint>>,
annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:bigint,confidence:double,mean_depth:double>>,
categories array<struct<id:bigint,name:string,supercategory:string>>"""


@query(
    "snk10_annotation_documents",
    f"""WITH {_ANN} SELECT run_id, 'annotation' AS kind, id, image_id, category_id, round_even(px,1) AS x, round_even(py,1) AS y, round_even(w,1) AS w, round_even(h,1) AS h,
      round_even(w*h,1) AS area, 0::BIGINT AS iscrowd, round_even(confidence,4) AS confidence, mean_depth, NULL AS name, NULL::BIGINT AS width, NULL::BIGINT AS height, NULL::BIGINT AS frame_idx, NULL::BIGINT AS timestamp_ms FROM an
    UNION ALL SELECT run_id, 'image', id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, image_path, 640, 360, frame_idx, timestamp_ms FROM im
    UNION ALL SELECT run_id, 'category', id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, class_name||'/object', NULL, NULL, NULL, NULL FROM ct""",
)
def _snk10d(t):
    """The documents of all runs, written, and every field of every list read back."""
    path, spark = rd.scratch_dir(t.spark, "annotation-documents"), t.spark
    ex.write_json(ex.annotation_documents(ex.images(t.frames()), _ann(t), ex.categories(t.detections())), path)
    docs = rd.read_json(spark, path, _DOCUMENT)
    names = ["id", "image_id", "category_id", "x", "y", "w", "h", "area", "iscrowd", "confidence", "mean_depth", "name", "width", "height", "frame_idx", "timestamp_ms"]
    kinds = {"id": "bigint", "image_id": "bigint", "category_id": "bigint", "iscrowd": "bigint", "name": "string", "width": "bigint", "height": "bigint", "frame_idx": "bigint", "timestamp_ms": "bigint"}

    def rows(column, kind, given):
        own = docs.select("run_id", F.explode(column).alias("e"))
        fields = [(given[n] if n in given else F.lit(None)).cast(kinds.get(n, "double")).alias(n) for n in names]
        return own.select("run_id", F.lit(kind).alias("kind"), *fields)

    e = lambda n: F.col(f"e.{n}")
    boxes = {n: e("bbox")[i] for i, n in enumerate("xywh")}
    plain = lambda *ns: {n: e(n) for n in ns}
    return (
        rows("annotations", "annotation", boxes | plain("id", "image_id", "category_id", "area", "iscrowd", "confidence", "mean_depth"))
        .unionByName(rows("images", "image", plain("id", "width", "height", "frame_idx", "timestamp_ms") | {"name": e("file_name")}))
        .unionByName(rows("categories", "category", {"id": e("id"), "name": F.concat(e("name"), F.lit("/"), e("supercategory"))}))
    )


_LABELS = """SELECT l.run_id, profile_name, l.frame_idx AS frame, round_even(coalesce(f.timestamp_ms,0)/1000.0,2) AS "t (s)", behavior AS behaviour,
    round_even(confidence,2) AS confidence, coalesce(note||', "'||l.frame_idx||'"'||chr(10)||'end','') AS note FROM b_labels l LEFT JOIN b_frames f USING (run_id, frame_idx)"""
_LABEL_FIELDS = "frame bigint, `t (s)` double, behaviour string, confidence double, note string"


def _labels_out(t):
    """Labels with notes that need quoting; frames that are unknown have the time 0."""
    note = F.concat("note", F.lit(', "'), F.col("frame_idx").cast("string"), F.lit('"\nend'))
    return be.export_rows(t.labels().withColumn("note", note), t.frames())


@query("snk14_label_csv", _LABELS)
def _snk14c(t):
    path, rows = rd.scratch_dir(t.spark, "labels-csv"), _labels_out(t)
    ex.write_csv(rows, path, ["run_id", "profile_name"])
    back = ex.read_csv(t.spark, path, f"{_LABEL_FIELDS}, run_id bigint, profile_name string")
    return back.withColumn("note", F.coalesce("note", F.lit(""))).select(*rows.columns)


@query("snk14_label_json", _LABELS)
def _snk14j(t):
    path, rows = rd.scratch_dir(t.spark, "labels-json"), _labels_out(t)
    ex.write_json(ex.label_documents(rows), path)
    docs = rd.read_json(t.spark, path, "run_id bigint, profile_name string, part bigint, labels string")
    entries = F.from_json("labels", f"array<struct<{_LABEL_FIELDS.replace(' bigint', ':bigint').replace(' double', ':double').replace(' string', ':string')}>>")
    return docs.select("run_id", "profile_name", F.inline(entries)).select(*rows.columns)


@query("prj6_pixel_boxes", f"WITH {_ANN} SELECT run_id, id, round_even(w,1) AS w, round_even(h,1) AS h, round_even(w*h,1) AS area FROM an")
def _prj6(t):
    return _ann(t).select("run_id", "id", F.col("bbox")[2].alias("w"), F.col("bbox")[3].alias("h"), "area")


_CORR = "(SELECT run_id, frame_idx AS correlation_idx, frame_idx AS visual_idx, CASE WHEN k%5=0 THEN NULL ELSE frame_idx+k END AS audio_idx FROM b_events)"


def _lines(t):
    k, idx = F.col("k"), F.col("frame_idx")
    corr = t.events().select(
        "run_id", idx.alias("correlation_idx"), idx.alias("visual_idx"), F.when(k % 5 != 0, idx + k).alias("audio_idx"), F.lit(None).cast("string").alias("description")
    )
    return ex.caption_lines(_chunk_docs(t), t.visual(), t.sounds(), corr)


_TAGGED = f"""SELECT run_id, 'chunk_caption' AS type, chunk_id, NULL::BIGINT AS event_idx, behavior AS caption, NULL AS description, NULL AS speaker FROM {_LINES} WHERE k%4<>0
  UNION ALL SELECT run_id, 'visual_event', NULL, ev_idx, NULL, description, NULL FROM b_visual
  UNION ALL SELECT run_id, 'audio_event', NULL, ev_idx, NULL, NULL, coalesce(speaker,'unknown') FROM b_sounds
  UNION ALL SELECT run_id, 'multimodal_correlation', NULL, NULL, NULL, '', NULL FROM {_CORR}"""


@query("set6_tagged_rows", _TAGGED)
def _set6(t):
    return _lines(t).select("run_id", "type", "chunk_id", "event_idx", "caption", "description", "speaker")


_TAG_FIELDS = "run_id bigint, type string, chunk_id bigint, event_idx bigint, caption string, description string, speaker string"


@query("snk11_caption_jsonl", _TAGGED)
def _snk11(t):
    path = rd.scratch_dir(t.spark, "captions-jsonl")
    ex.write_json(_lines(t), path)
    return rd.read_json(t.spark, path, _TAG_FIELDS)


@query("snk12_frame_caption_jsonl", f"SELECT l.run_id, l.frame_idx, l.line AS caption, f.image_path FROM {_LINES} l JOIN b_frames f USING (run_id, frame_idx) WHERE lower(trim(line))<>'(no change)'")
def _snk12(t):
    path = rd.scratch_dir(t.spark, "frame-captions")
    ex.write_json(ex.frame_captions(_chunk_docs(t), t.frames()), path)
    return rd.read_json(t.spark, path, "run_id bigint, frame_idx bigint, caption string, image_path string")


@query(
    "snk13_export_manifest",
    f"""WITH {_ANN} SELECT run_id, count(*) AS rows, 'images' AS export FROM im GROUP BY 1
    UNION ALL SELECT run_id, count(*), 'categories' FROM ct GROUP BY 1
    UNION ALL SELECT run_id, count(*), 'annotations' FROM an GROUP BY 1
    UNION ALL SELECT run_id, count(*), 'captions' FROM ({_TAGGED}) GROUP BY 1""",
)
def _snk13(t):
    tables = {"images": ex.images(t.frames()), "categories": ex.categories(t.detections()), "annotations": _ann(t), "captions": _lines(t)}
    return ex.export_all(tables, rd.scratch_dir(t.spark, "export"))


@query(
    "snk17_analysis_document",
    """SELECT run_id, 'entities' AS section, id, type, description, first_seen AS start_time, last_seen AS end_time, NULL AS text, NULL::BIGINT AS timestamp_ms FROM b_entities
    UNION ALL SELECT run_id, 'visual_events', array_to_string(entities, ','), type, description, start_time, end_time, NULL, NULL FROM b_visual
    UNION ALL SELECT run_id, 'audio_events', speaker, type, NULL, start_time, end_time, text, NULL FROM b_sounds
    UNION ALL SELECT run_id, 'dense_timeline', NULL, NULL, NULL, NULL, NULL, CASE WHEN verifier_agrees=false AND verifier_caption<>'' THEN verifier_caption ELSE caption END, timestamp_ms FROM b_captions""",
)
def _snk17(t):
    path = rd.scratch_dir(t.spark, "analysis")
    ex.write_json(ex.analysis_lines(t.entities(), t.visual(), t.sounds(), dense_timeline(t.captions())), path)
    e = F.from_json(
        "element",
        "struct<id:string,type:string,description:string,first_seen:string,last_seen:string,entities:array<string>,"
        "start_time:string,end_time:string,speaker:string,text:string,timestamp_ms:bigint>",
    )
    rows = rd.read_json(t.spark, path, "run_id bigint, section string, element string").withColumn("e", e)
    return rows.select(
        "run_id", "section",
        F.coalesce("e.id", F.array_join("e.entities", ","), "e.speaker").alias("id"),
        "e.type", "e.description",
        F.coalesce("e.start_time", "e.first_seen").alias("start_time"),
        F.coalesce("e.end_time", "e.last_seen").alias("end_time"),
        "e.text", "e.timestamp_ms",
    )


_SEL = "(SELECT run_id, frame_idx FROM (SELECT *, max(is_keyframe) OVER (PARTITION BY run_id) AS has FROM b_frames) WHERE is_keyframe OR NOT has)"


@query("snk18_selected_lists", f"SELECT run_id, 0 AS part, '['||string_agg(frame_idx, ',' ORDER BY frame_idx)||']' AS value FROM {_SEL} GROUP BY 1")
def _snk18(t):
    return ex.selected_lists(keyframes_or_all(t.frames()))


@query("snk18_load_lists", f"SELECT run_id, frame_idx FROM {_SEL}")
def _snk18l(t):
    broken = t.captions().select("run_id", F.lit("[1, oops").alias("value"))
    stored = ex.selected_lists(keyframes_or_all(t.frames())).select("run_id", "value")
    return ex.load_lists(stored.union(broken))
