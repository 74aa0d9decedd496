"""Frame scoring, selection and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.functions import round_to
from cinetrace.operators import frames as fr

_FEATURES = """
pos AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx)-1 AS pos FROM b_frames),
lastbox AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id,frame_idx,track_id ORDER BY detection_id DESC) AS rn
   FROM b_detections WHERE track_id IS NOT NULL) WHERE rn=1),
boxpos AS (SELECT b.*, p.pos FROM lastbox b JOIN pos p USING (run_id, frame_idx)),
pairs AS (SELECT c.run_id, c.frame_idx, c.track_id, p.frame_idx AS from_frame,
   greatest(0, least(c.x2,p.x2)-greatest(c.x1,p.x1))*greatest(0, least(c.y2,p.y2)-greatest(c.y1,p.y1)) AS inter,
   (c.x2-c.x1)*(c.y2-c.y1)+(p.x2-p.x1)*(p.y2-p.y1) AS areas
   FROM boxpos c JOIN boxpos p ON c.run_id=p.run_id AND c.track_id=p.track_id AND c.pos=p.pos+1),
ious AS (SELECT run_id, frame_idx, track_id, from_frame,
   CASE WHEN areas-inter<=0 THEN 0 ELSE inter/(areas-inter) END AS iou FROM pairs),
drops AS (SELECT run_id, frame_idx, 1-avg(iou) AS d FROM ious GROUP BY 1,2),
clsp AS (SELECT DISTINCT d.run_id, p.pos, class_name AS v FROM b_detections d JOIN pos p USING (run_id,frame_idx)),
trkp AS (SELECT DISTINCT d.run_id, p.pos, track_id AS v FROM b_detections d JOIN pos p USING (run_id,frame_idx) WHERE track_id IS NOT NULL),
cchg AS (SELECT run_id, pos, count(*) AS n FROM (
   SELECT run_id, pos, v FROM clsp c WHERE NOT EXISTS (SELECT 1 FROM clsp q WHERE q.run_id=c.run_id AND q.pos=c.pos-1 AND q.v=c.v)
   UNION ALL SELECT run_id, pos+1, v FROM clsp c WHERE NOT EXISTS (SELECT 1 FROM clsp q WHERE q.run_id=c.run_id AND q.pos=c.pos+1 AND q.v=c.v)) GROUP BY 1,2),
tchg AS (SELECT run_id, pos, count(*) AS n FROM (
   SELECT run_id, pos, v FROM trkp c WHERE NOT EXISTS (SELECT 1 FROM trkp q WHERE q.run_id=c.run_id AND q.pos=c.pos-1 AND q.v=c.v)
   UNION ALL SELECT run_id, pos+1, v FROM trkp c WHERE NOT EXISTS (SELECT 1 FROM trkp q WHERE q.run_id=c.run_id AND q.pos=c.pos+1 AND q.v=c.v)) GROUP BY 1,2),
feat AS (SELECT p.run_id, p.frame_idx, p.timestamp_ms, p.is_keyframe, p.delta_score,
   CASE WHEN p.pos=0 THEN 0 ELSE coalesce(c.n,0) END AS class_change,
   CASE WHEN p.pos=0 THEN 0 ELSE coalesce(t.n,0) END AS track_churn,
   CASE WHEN p.pos=0 THEN 0.0 ELSE coalesce(d.d,0.0) END AS iou_drop
   FROM pos p LEFT JOIN cchg c USING (run_id,pos) LEFT JOIN tchg t USING (run_id,pos) LEFT JOIN drops d USING (run_id,frame_idx)),
scored AS (SELECT *, 1.0*delta_score+2.0*class_change+2.0*track_churn+0.5*iou_drop AS score FROM feat)
"""

RATE = 0.2


def _features(t):
    return fr.frame_features(t.frames(), t.detections())


@query("win2_class_change", f"WITH {_FEATURES} SELECT run_id, frame_idx, class_change FROM feat")
def _win2(t):
    return _features(t).select("run_id", "frame_idx", "class_change")


@query("win3_track_churn", f"WITH {_FEATURES} SELECT run_id, frame_idx, track_churn FROM feat")
def _win3(t):
    return _features(t).select("run_id", "frame_idx", "track_churn")


@query("win4_iou_drop", f"WITH {_FEATURES} SELECT run_id, frame_idx, round_even(iou_drop,6) AS iou_drop FROM feat")
def _win4(t):
    return _features(t).select("run_id", "frame_idx", round_to(F.col("iou_drop"), 6).alias("iou_drop"))


@query("win5_frame_score", f"WITH {_FEATURES} SELECT run_id, frame_idx, round_even(score,6) AS score FROM scored")
def _win5(t):
    return fr.frame_scores(t.frames(), t.detections()).select(
        "run_id", "frame_idx", round_to(F.col("score"), 6).alias("score")
    )


@query("jon14_track_pairs", f"WITH {_FEATURES} SELECT run_id, track_id, from_frame, frame_idx, round_even(iou,6) AS iou FROM ious")
def _jon14(t):
    return fr.track_pairs(t.frames(), t.detections()).withColumn("iou", round_to(F.col("iou"), 6))


_SELECT = """
runs AS (SELECT run_id, greatest(1, CAST(round_even(greatest(1.0, max(timestamp_ms)/1000.0)*{rate},0) AS BIGINT)) AS k,
  count(*) FILTER (WHERE is_keyframe) AS forced FROM scored GROUP BY 1),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.run_id ORDER BY score DESC, frame_idx) AS rk FROM scored s WHERE NOT is_keyframe)
SELECT run_id, frame_idx, round_even(score,6) AS score, is_keyframe FROM scored WHERE is_keyframe
UNION ALL SELECT r.run_id, r.frame_idx, round_even(r.score,6), r.is_keyframe FROM ranked r JOIN runs USING (run_id) WHERE rk <= greatest(0, {room})
"""


@query("top1_frame_scorer", f"WITH {_FEATURES}, {_SELECT.format(rate=RATE, room='k-forced')}")
def _top1(t):
    scored = fr.frame_scores(t.frames(), t.detections())
    return fr.select_scored(scored, RATE).withColumn("score", round_to(F.col("score"), 6))


_MEDIA = _SELECT.replace(
    "greatest(1.0, max(timestamp_ms)/1000.0)*{rate}", "greatest(1.0, coalesce(max(duration_s), max(timestamp_ms)/1000.0))*{rate}"
).replace("FROM scored GROUP BY 1", "FROM scored LEFT JOIN (SELECT run_id, duration_s FROM b_media) USING (run_id) GROUP BY 1")


@query("top1_media_length", f"WITH {_FEATURES}, {_MEDIA.format(rate=0.02, room='k-forced')}")
def _top1m(t):
    """Run lengths from the media table; runs without one last up to their last frame."""
    scored = fr.frame_scores(t.frames(), t.detections())
    return fr.select_scored(scored, 0.02, durations=t.media()).withColumn("score", round_to(F.col("score"), 6))


@query("top1_fixed_k", f"WITH {_FEATURES}, {_SELECT.format(rate=RATE, room='12-forced')}")
def _top1k(t):
    scored = fr.frame_scores(t.frames(), t.detections())
    return fr.select_scored(scored, k=12).withColumn("score", round_to(F.col("score"), 6))


@query(
    "top2_keyframes_or_all",
    """SELECT run_id, frame_idx, NOT has AS fallback FROM (SELECT *, max(is_keyframe) OVER (PARTITION BY run_id) AS has FROM b_frames)
    WHERE is_keyframe OR NOT has""",
)
def _top2(t):
    return fr.keyframes_or_all(t.frames()).select("run_id", "frame_idx", "fallback")


_THRESHOLD = """thr AS (SELECT run_id, coalesce(median(delta_score) FILTER (WHERE delta_score<>0)
   + stddev_pop(delta_score) FILTER (WHERE delta_score<>0), 0.0) AS threshold FROM b_frames GROUP BY 1)"""


@query("agg11_keyframe_threshold", f"WITH {_THRESHOLD} SELECT run_id, round(threshold,6) AS threshold FROM thr")
def _agg11(t):
    return fr.keyframe_threshold(t.frames()).withColumn("threshold", F.round("threshold", 6))


@query(
    "top7_pick_keyframes",
    f"""WITH {_THRESHOLD} SELECT run_id, frame_idx FROM (SELECT f.*, threshold, min(frame_idx) OVER (PARTITION BY f.run_id) AS f0
    FROM b_frames f JOIN thr USING (run_id)) WHERE (delta_score>=threshold AND threshold>0) OR frame_idx=f0""",
)
def _top7(t):
    f = t.frames()
    return fr.pick_keyframes(f, fr.keyframe_threshold(f)).select("run_id", "frame_idx")


@query(
    "agg12_escalation_threshold",
    """SELECT run_id, round(CASE WHEN count(*)<10 THEN max(delta_score) ELSE quantile_cont(delta_score,0.9) END,6) AS threshold
    FROM b_frames GROUP BY 1""",
)
def _agg12(t):
    return fr.escalation_threshold(t.frames()).withColumn("threshold", F.round("threshold", 6))


_GRID = """SELECT run_id, unnest(range(0, CAST(floor(duration_s*fps) AS BIGINT),
   greatest(1, CAST(round_even(fps/{rate},0) AS BIGINT)))) AS frame_idx FROM b_media"""


@query("top6_uniform_grid", _GRID.format(rate=0.05))
def _top6(t):
    return fr.uniform_grid(t.media(), 0.05)


@query(
    "set1_merge_selection",
    f"SELECT run_id, frame_idx FROM b_frames WHERE is_keyframe UNION SELECT run_id, frame_idx FROM ({_GRID.format(rate=0.02)})",
)
def _set1(t):
    return fr.merge_selection(t.frames().filter("is_keyframe"), fr.uniform_grid(t.media(), 0.02))


_PICK_LINSPACE = """WITH p AS (SELECT run_id, frame_idx, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx)-1 AS pos,
      count(*) OVER (PARTITION BY run_id) AS total FROM b_frames),
    i AS (SELECT DISTINCT run_id, CAST({at} AS BIGINT) AS pos, 1 AS hit FROM (SELECT DISTINCT run_id, total FROM p), range(7) r(i))
    SELECT run_id, frame_idx FROM p LEFT JOIN i USING (run_id, pos) WHERE total<=7 OR hit=1"""


@query(
    "top8_linspace_sample",
    _PICK_LINSPACE.format(at="CASE WHEN i=6 THEN total-1 ELSE floor(i*((total-1)/6.0::DOUBLE)) END"),
)
def _top8(t):
    return fr.linspace_pick(t.frames(), 7).select("run_id", "frame_idx")


@query("top12_even_subset", _PICK_LINSPACE.format(at="floor(i*total/7.0::DOUBLE)"))
def _top12(t):
    return fr.spread_pick(t.frames(), 7).select("run_id", "frame_idx")


@query(
    "top11_every_nth",
    """SELECT run_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx)-1 AS pos FROM b_frames)
    WHERE pos%3=0""",
)
def _top11(t):
    return fr.every_nth(t.frames(), 3).select("run_id", "frame_idx")


@query(
    "top11_keyframes_or_first",
    """SELECT run_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx)-1 AS pos,
    max(is_keyframe) OVER (PARTITION BY run_id) AS has FROM b_frames) WHERE is_keyframe OR (NOT has AND pos<5)""",
)
def _top11b(t):
    return fr.keyframes_or_first(t.frames(), 5).select("run_id", "frame_idx")


@query("flt1_keyframes", "SELECT run_id, frame_idx, timestamp_ms FROM b_frames WHERE is_keyframe")
def _flt1(t):
    return t.frames().filter("is_keyframe").select("run_id", "frame_idx", "timestamp_ms")


@query(
    "src10_stored_selection",
    "SELECT run_id, frame_idx, image_path, is_keyframe, 0.0::DOUBLE AS delta, 0.0::DOUBLE AS threshold FROM b_frames",
)
def _src10(t):
    return fr.stored_selection(t.frames())


@query(
    "jon17_stored_delta",
    """SELECT f.run_id, f.frame_idx, coalesce(d.delta_score, 0.0) AS delta_score FROM b_frames f
    LEFT JOIN (SELECT run_id, frame_idx, delta_score FROM b_frames WHERE is_keyframe) d USING (run_id, frame_idx)""",
)
def _jon17(t):
    f = t.frames()
    known = f.filter("is_keyframe").select("run_id", "frame_idx", "delta_score")
    return fr.with_stored_delta(f.select("run_id", "frame_idx"), known)


@query(
    "win1_thumbnail_delta",
    """WITH p AS (SELECT run_id, frame_idx, thumb, lag(thumb) OVER (PARTITION BY run_id ORDER BY frame_idx) AS b FROM b_thumbs)
    SELECT run_id, frame_idx, CASE WHEN b IS NULL THEN 0.0 ELSE
      round(list_sum(list_transform(list_zip(thumb,b), lambda x: abs(CAST(x[1] AS DOUBLE)-CAST(x[2] AS DOUBLE))))/len(thumb),6) END AS delta FROM p""",
)
def _win1(t):
    return fr.thumbnail_delta(t.thumbs()).withColumn("delta", F.round("delta", 6))


@query(
    "agg13_camera_mode",
    """WITH pr AS (SELECT l_orderkey AS run_id, l_linenumber AS pair, avg(l_quantity) AS mean_move FROM lineitem
       WHERE l_linenumber<30 GROUP BY 1,2),
    md AS (SELECT run_id, median(mean_move) AS m FROM pr GROUP BY 1),
    rn AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem)
    SELECT run_id, round(coalesce(m,0.0),6) AS median_move, CASE WHEN m>0.05*480 THEN 'moving' ELSE 'static' END AS camera_mode
    FROM rn LEFT JOIN md USING (run_id)""",
)
def _agg13(t):
    matches = t.read("lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("pair"),
        F.col("l_quantity").alias("displacement"),
        F.lit(480.0).alias("width"),
    )
    return fr.camera_mode(matches).withColumn("median_move", F.round("median_move", 6))


@query(
    "agg13_camera_mode_long",
    """WITH pr AS (SELECT run_id, frame_idx AS pair, avg(value/(1+frame_idx%7)) AS mean_move FROM b_events WHERE frame_idx<30 GROUP BY 1,2),
    md AS (SELECT run_id, median(mean_move) AS m FROM pr GROUP BY 1),
    rn AS (SELECT DISTINCT run_id FROM b_events)
    SELECT run_id, round(coalesce(m,0.0),6) AS median_move, CASE WHEN m>0.05*1920 THEN 'moving' ELSE 'static' END AS camera_mode
    FROM rn LEFT JOIN md USING (run_id)""",
)
def _agg13l(t):
    """Runs of 64 pairs, of which the first 30 count."""
    matches = t.events().select(
        "run_id", F.col("frame_idx").alias("pair"), (F.col("value") / (1 + F.col("frame_idx") % 7)).alias("displacement"), F.lit(1920.0).alias("width")
    )
    return fr.camera_mode(matches).withColumn("median_move", F.round("median_move", 6))


@query("prj1_frame_time", """SELECT run_id, frame_idx, CAST(floor(frame_idx*1000.0/greatest(fps,1)) AS BIGINT) AS timestamp_ms FROM
  (SELECT m.run_id, f.frame_idx, m.fps FROM b_frames f JOIN b_media m USING (run_id))""")
def _prj1(t):
    from cinetrace.functions.times import frame_time_ms

    joined = t.frames().select("run_id", "frame_idx").join(t.media().select("run_id", "fps"), "run_id")
    return joined.select("run_id", "frame_idx", frame_time_ms(F.col("frame_idx"), F.col("fps")).alias("timestamp_ms"))


@query("flt9_point_lookup", "SELECT run_id, frame_idx, timestamp_ms, image_path FROM b_frames WHERE run_id=3 AND frame_idx=42")
def _flt9(t):
    return t.frames().filter("run_id = 3 AND frame_idx = 42").select("run_id", "frame_idx", "timestamp_ms", "image_path")


@query("agg18_duration", "SELECT run_id, coalesce(max(timestamp_ms),0)/1000.0 AS duration_s FROM b_frames GROUP BY 1")
def _agg18(t):
    return t.frames().groupBy("run_id").agg((F.coalesce(F.max("timestamp_ms"), F.lit(0)) / 1000.0).alias("duration_s"))


@query(
    "top15_page",
    """SELECT run_id, frame_idx, pos // 4 AS page FROM (SELECT run_id, frame_idx,
    row_number() OVER (PARTITION BY run_id ORDER BY frame_idx)-1 AS pos FROM b_frames)""",
)
def _top15(t):
    return fr.paged(t.frames(), 4).select("run_id", "frame_idx", "page")
