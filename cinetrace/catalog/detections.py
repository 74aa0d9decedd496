"""Detection statistics, boxes and depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.functions import round_to
from cinetrace.functions.geometry import iou, normalise_box
from cinetrace.operators import detections as det
from cinetrace.operators import frames as fr
from cinetrace.operators import masks


@query("agg1_detections_per_frame", "SELECT run_id, frame_idx, count(*) AS n FROM b_detections GROUP BY 1,2")
def _agg1(t):
    return det.per_frame(t.detections())


@query("agg6_class_distribution", "SELECT run_id, class_name, count(*) AS n FROM b_detections GROUP BY 1,2")
def _agg6(t):
    return det.class_distribution(t.detections())


@query(
    "agg7_confidence_histogram",
    """SELECT run_id, CAST(greatest(0,least(49,floor(confidence*50))) AS BIGINT) AS bin, count(*) AS n
    FROM b_detections GROUP BY 1,2""",
)
def _agg7(t):
    return det.confidence_histogram(t.detections())


@query(
    "agg26_frame_sets",
    """SELECT DISTINCT run_id, frame_idx, 'class' AS kind, class_name AS item FROM b_detections
    UNION ALL SELECT DISTINCT run_id, frame_idx, 'track', CAST(track_id AS VARCHAR) FROM b_detections WHERE track_id IS NOT NULL""",
)
def _agg26(t):
    return fr.frame_sets(t.detections())


_SETS = """s AS (SELECT DISTINCT run_id, frame_idx, class_name AS v FROM b_detections)"""


@query(
    "set4_frame_set_difference",
    f"""WITH {_SETS}, a AS (SELECT run_id, frame_idx, v, 1 AS here, 0 AS prev FROM s
      UNION ALL SELECT run_id, frame_idx+1, v, 0, 1 FROM s),
    m AS (SELECT run_id, frame_idx, v, sum(here) AS here, sum(prev) AS prev FROM a GROUP BY 1,2,3)
    SELECT run_id, frame_idx, count(*) FILTER (WHERE here=1 AND prev=1) AS common, count(*) FILTER (WHERE here<>prev) AS differ
    FROM m GROUP BY 1,2 HAVING max(here)=1 AND max(prev)=1""",
)
def _set4(t):
    return det.set_differences(t.detections())


@query("flt2_confidence_floor", "SELECT run_id, frame_idx, detection_id, confidence FROM b_detections WHERE confidence>=0.75")
def _flt2(t):
    return det.confident(t.detections(), 0.75).select("run_id", "frame_idx", "detection_id", "confidence")


@query(
    "jon2_keyframe_classes",
    """SELECT f.run_id, f.frame_idx, d.classes FROM b_frames f LEFT JOIN (SELECT run_id, frame_idx,
    string_agg(class_name, ',' ORDER BY class_name) AS classes FROM b_detections GROUP BY 1,2) d USING (run_id,frame_idx) WHERE is_keyframe""",
)
def _jon2(t):
    return det.class_lists(t.frames(), t.detections())


@query(
    "jon4_depth_paths",
    "SELECT f.run_id, f.frame_idx, d.depth_path FROM b_frames f LEFT JOIN b_depth d USING (run_id,frame_idx)",
)
def _jon4(t):
    return t.frames().select("run_id", "frame_idx").join(t.depth(), ["run_id", "frame_idx"], "left")


@query(
    "jon12_detections_of_frames",
    "SELECT run_id, frame_idx, detection_id FROM b_detections d WHERE EXISTS (SELECT 1 FROM b_frames f WHERE f.run_id=d.run_id AND f.frame_idx=d.frame_idx AND f.is_keyframe)",
)
def _jon12(t):
    return det.with_existing_frame(t.detections(), t.frames().filter("is_keyframe")).select("run_id", "frame_idx", "detection_id")


_TEXT = """string_agg(class_name||printf(' at [%.2f,%.2f,%.2f,%.2f] conf=%.2f', x1,y1,x2,y2,confidence)
  ||CASE WHEN mean_depth IS NULL THEN '' ELSE printf(' depth=%.2f', mean_depth) END, '; ' ORDER BY detection_id)"""


def _rounded(d):
    # Two decimals that print alike in both engines.
    return d.withColumns(
        {c: F.floor(F.col(c) * 100 + 0.001) / 100.0 for c in ("x1", "y1", "x2", "y2", "confidence", "mean_depth")}
    )


_ROUNDED = "(SELECT run_id, frame_idx, detection_id, class_name, " + ", ".join(
    f"floor({c}*100+0.001)/100.0::DOUBLE AS {c}" for c in ("x1", "y1", "x2", "y2", "confidence", "mean_depth")
) + " FROM b_detections)"


@query(
    "fn7_detection_text",
    f"""SELECT f.run_id, f.frame_idx, coalesce(d.text,'(none)') AS text FROM b_frames f LEFT JOIN
    (SELECT run_id, frame_idx, {_TEXT} AS text FROM {_ROUNDED} GROUP BY 1,2) d USING (run_id,frame_idx)""",
)
def _fn7(t):
    return det.frame_texts(t.frames().select("run_id", "frame_idx"), _rounded(t.detections()))


@query(
    "src2_run_bundle",
    """SELECT f.run_id, f.frame_idx, f.timestamp_ms, f.is_keyframe, d.detections, p.depth_path FROM b_frames f
    LEFT JOIN (SELECT run_id, frame_idx, string_agg(detection_id||' '||class_name, ',' ORDER BY detection_id) AS detections
      FROM b_detections GROUP BY 1,2) d USING (run_id,frame_idx) LEFT JOIN b_depth p USING (run_id,frame_idx)""",
)
def _src2(t):
    b = det.frame_bundle(t.frames(), t.detections(), t.depth())
    text = F.array_join(F.transform("detections", lambda s: F.concat_ws(" ", s["detection_id"], s["class_name"])), ",")
    return b.select("run_id", "frame_idx", "timestamp_ms", "is_keyframe", text.alias("detections"), "depth_path")


@query(
    "top14_detections_by_confidence",
    """SELECT run_id, frame_idx, detection_id, row_number() OVER (PARTITION BY run_id, frame_idx ORDER BY confidence DESC, detection_id) AS rank
    FROM b_detections""",
)
def _top14(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy("run_id", "frame_idx").orderBy(F.col("confidence").desc(), "detection_id")
    return t.detections().select("run_id", "frame_idx", "detection_id", F.row_number().over(w).alias("rank"))


@query(
    "prj2_normalise_boxes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity*10/640,6) AS x1, round(l_quantity*5/360,6) AS y1 FROM lineitem""",
)
def _prj2(t):
    q = F.col("l_quantity")
    raw = t.read("lineitem").withColumns({"x1": q * 10, "y1": q * 5, "x2": q * 10 + 60, "y2": q * 5 + 40})
    norm = normalise_box(F.lit(640.0), F.lit(360.0))
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *[F.round(c, 6).alias(n) for c, n in zip(norm[:2], ("x1", "y1"))],
    )


_LEGACY = """raw AS (SELECT run_id, frame_idx, detection_id, CASE WHEN run_id%3=0 THEN x1*640 ELSE x1 END AS x1,
  CASE WHEN run_id%3=0 THEN y1*360 ELSE y1 END AS y1, CASE WHEN run_id%3=0 THEN x2*640 ELSE x2/2 END AS x2,
  CASE WHEN run_id%3=0 THEN y2*360 ELSE y2 END AS y2 FROM b_detections),
 fl AS (SELECT run_id, max(greatest(x1,y1,x2,y2))>1.0 AS rescaled FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY detection_id) AS rn FROM raw)
  WHERE rn<=10 GROUP BY 1)"""


def _legacy(t):
    px = F.col("run_id") % 3 == 0
    pick = lambda c, size, other: F.when(px, F.col(c) * size).otherwise(other).alias(c)
    return t.detections().select(
        "run_id", "frame_idx", "detection_id",
        pick("x1", 640, F.col("x1")), pick("y1", 360, F.col("y1")),
        pick("x2", 640, F.col("x2") / 2), pick("y2", 360, F.col("y2")),
    )


@query(
    "prj3_repair_boxes",
    f"""WITH {_LEGACY} SELECT run_id, detection_id, rescaled, round(CASE WHEN rescaled THEN x1/640 ELSE x1 END,6) AS x1,
    round(CASE WHEN rescaled THEN y2/360 ELSE y2 END,6) AS y2 FROM raw JOIN fl USING (run_id)""",
)
def _prj3(t):
    return det.repair_boxes(_legacy(t), 640.0, 360.0).select(
        "run_id", "detection_id", "rescaled", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2")
    )


@query(
    "prj3_repair_corners",
    f"""WITH {_LEGACY} SELECT run_id, detection_id, rescaled, round(CASE WHEN rescaled THEN x1/640 ELSE x1 END,6) AS x1, round(CASE WHEN rescaled THEN y1/360 ELSE y1 END,6) AS y1,
    round(CASE WHEN rescaled THEN x2/640 ELSE x2 END,6) AS x2, round(CASE WHEN rescaled THEN y2/360 ELSE y2 END,6) AS y2 FROM raw JOIN fl USING (run_id)""",
)
def _prj3c(t):
    corners = [F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return det.repair_boxes(_legacy(t), 640.0, 360.0).select("run_id", "detection_id", "rescaled", *corners)


@query(
    "prj2_normalised_corners",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity*10/640,6) AS x1, round(l_quantity*5/360,6) AS y1,
    round((l_quantity*10+60)/640,6) AS x2, round((l_quantity*5+40)/360,6) AS y2 FROM lineitem""",
)
def _prj2c(t):
    q = F.col("l_quantity")
    raw = t.read("lineitem").withColumns({"x1": q * 10, "y1": q * 5, "x2": q * 10 + 60, "y2": q * 5 + 40})
    corners = zip(normalise_box(F.lit(640.0), F.lit(360.0)), ("x1", "y1", "x2", "y2"))
    return raw.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 6).alias(n) for c, n in corners])


@query(
    "prj3_repair_report",
    f"""WITH {_LEGACY} SELECT run_id, count(DISTINCT frame_idx) AS frames, count(*) AS detections, bool_or(rescaled) AS rescaled
    FROM raw JOIN fl USING (run_id) GROUP BY 1""",
)
def _prj3r(t):
    return det.repair_report(_legacy(t), 640.0, 360.0)


_GRID = """g AS (SELECT run_id, frame_idx, detection_id, greatest(0, CAST(trunc(x1*8) AS INT)) AS gx1, greatest(0, CAST(trunc(y1*8) AS INT)) AS gy1,
  least(8, CAST(trunc(x2*8) AS INT)) AS gx2, least(8, CAST(trunc(y2*8) AS INT)) AS gy2 FROM b_detections)"""


@query("flt10_boxes_on_grid", f"WITH {_GRID} SELECT run_id, detection_id, gx1, gy1, gx2, gy2 FROM g WHERE gx2>gx1 AND gy2>gy1")
def _flt10(t):
    return det.on_grid(t.detections(), 8, 8).select("run_id", "detection_id", "gx1", "gy1", "gx2", "gy2")


@query(
    "jon16_mean_depth",
    f"""WITH {_GRID}, cells AS (SELECT run_id, frame_idx, i//8 AS r, i%8 AS c, thumb[i+1] AS v FROM b_thumbs, range(64) q(i))
    SELECT g.run_id, g.detection_id, round(avg(CAST(v AS DOUBLE)),6) AS mean_depth FROM g JOIN cells c
    ON g.run_id=c.run_id AND g.frame_idx=c.frame_idx AND c.r>=gy1 AND c.r<gy2 AND c.c>=gx1 AND c.c<gx2 GROUP BY 1,2""",
)
def _jon16(t):
    maps = t.thumbs().select("run_id", "frame_idx", F.col("thumb").alias("depth"))
    return det.mean_depths(t.detections(), maps, 8, 8).select(
        "run_id", "detection_id", F.round("mean_depth", 6).alias("mean_depth")
    )


@query(
    "jon16_normalised_map",
    """WITH m AS (SELECT run_id, frame_idx, i, CAST(thumb[i+1] AS DOUBLE) AS v FROM b_thumbs, range(64) q(i)),
    s AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM m WINDOW w AS (PARTITION BY run_id, frame_idx))
    SELECT run_id, frame_idx, CAST(i AS BIGINT) AS i, round(CASE WHEN hi>lo THEN (v-lo)/(hi-lo) ELSE 0 END,6) AS v FROM s""",
)
def _norm(t):
    maps = t.thumbs().select("run_id", "frame_idx", F.col("thumb").alias("depth"))
    return det.normalised_maps(maps).select("run_id", "frame_idx", F.posexplode("depth").alias("i", "v")).select(
        "run_id", "frame_idx", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v")
    )


@query(
    "fn14_box_iou",
    """SELECT run_id, detection_id, round_even(greatest(0,least(x2,0.7)-greatest(x1,0.2))*greatest(0,least(y2,0.7)-greatest(y1,0.2)) /
    ((x2-x1)*(y2-y1)+(0.7::DOUBLE-0.2::DOUBLE)*(0.7::DOUBLE-0.2::DOUBLE)-greatest(0,least(x2,0.7)-greatest(x1,0.2))*greatest(0,least(y2,0.7)-greatest(y1,0.2))),6) AS iou FROM b_detections""",
)
def _fn14(t):
    centre = F.struct(F.lit(0.2).alias("x1"), F.lit(0.2).alias("y1"), F.lit(0.7).alias("x2"), F.lit(0.7).alias("y2"))
    box = F.struct("x1", "y1", "x2", "y2")
    return t.detections().select("run_id", "detection_id", round_to(iou(box, centre), 6).alias("iou"))


# --- masks: vectors thresholded at 0 are 8 x 8 masks -----------------------------------

_PIX = "SELECT run_id, frame_idx, i//8 AS r, i%8 AS c, (i%8)*8+i//8 AS p, CAST(thumb[i+1]>0 AS INT) AS bit FROM b_thumbs, range(64) q(i)"
_RUNS = f"""px AS ({_PIX}),
 ch AS (SELECT *, CASE WHEN bit IS DISTINCT FROM lag(bit) OVER (PARTITION BY run_id, frame_idx ORDER BY p) THEN 1 ELSE 0 END AS s FROM px),
 il AS (SELECT *, sum(s) OVER (PARTITION BY run_id, frame_idx ORDER BY p) AS isl FROM ch),
 rn AS (SELECT run_id, frame_idx, isl, bit, min(p) AS start, count(*) AS n FROM il GROUP BY 1,2,3,4),
 en AS (SELECT run_id, frame_idx, CASE WHEN bool_or(isl=1 AND bit=1) THEN '0,' ELSE '' END||string_agg(n, ',' ORDER BY isl) AS counts FROM rn GROUP BY 1,2)"""


def _mask_rows(t):
    return t.thumbs().select(
        "run_id", "frame_idx", F.transform("thumb", lambda v: (v > 0).cast("int")).alias("mask")
    )


@query("par8_encode_masks", f"WITH {_RUNS} SELECT run_id, frame_idx, counts FROM en")
def _par8e(t):
    enc = masks.encode(_mask_rows(t), 8, 8)
    return enc.select("run_id", "frame_idx", F.array_join("counts", ",").alias("counts"))


@query(
    "par8_decode_masks",
    f"""WITH {_RUNS} SELECT run_id, frame_idx, CAST(start AS BIGINT) AS start, n AS length FROM rn WHERE bit=1""",
)
def _par8d(t):
    good, _ = masks.decode(masks.to_json(masks.encode(_mask_rows(t), 8, 8)))
    return good.select("run_id", "frame_idx", "start", "length")


@query(
    "par8_mask_area",
    f"""WITH px AS ({_PIX}) SELECT run_id, frame_idx, sum(bit)::BIGINT AS area FROM px GROUP BY 1,2""",
)
def _par8a(t):
    return masks.areas(masks.to_json(masks.encode(_mask_rows(t), 8, 8))).select("run_id", "frame_idx", "area")
