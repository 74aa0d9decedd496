"""Behaviour labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.operators import behavior as be

_BOUTS = """ord AS (SELECT *, row_number() OVER w - 1 AS pos, lag(behavior) OVER w AS pb, lead(timestamp_ms) OVER w AS next_ms
   FROM b_labels WINDOW w AS (PARTITION BY run_id, profile_name ORDER BY frame_idx)),
 isl AS (SELECT *, max(CASE WHEN pb IS DISTINCT FROM behavior THEN pos END) OVER (PARTITION BY run_id, profile_name ORDER BY pos) AS bout FROM ord),
 bt AS (SELECT run_id, profile_name, bout, behavior, min(timestamp_ms) AS start_ms,
   CASE WHEN arg_max(coalesce(next_ms,-1), pos)=-1 THEN greatest(max(timestamp_ms), min(timestamp_ms)+100)
     ELSE arg_max(next_ms,pos) END AS end_ms, count(*) AS frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame
   FROM isl GROUP BY 1,2,3,4)"""


@query("win6_bouts", f"WITH {_BOUTS} SELECT * FROM bt")
def _win6(t):
    return be.bouts(t.labels())


@query(
    "agg9_bout_statistics",
    f"""WITH {_BOUTS} SELECT run_id, profile_name, behavior, count(*) AS bouts, round_even(sum(end_ms-start_ms)/1000.0,2) AS total_s,
    round_even(avg(end_ms-start_ms)/1000.0,2) AS mean_s, round_even(median(end_ms-start_ms)/1000.0,2) AS median_s, round_even(min(end_ms-start_ms)/1000.0,2) AS min_s,
    round_even(max(end_ms-start_ms)/1000.0,2) AS max_s FROM bt GROUP BY 1,2,3""",
)
def _agg9(t):
    return be.bout_statistics(t.labels())


@query(
    "jon19_bout_frames",
    f"WITH {_BOUTS} SELECT run_id, profile_name, bout, behavior, frame_idx, pos-bout+1 AS rank FROM isl WHERE pos-bout<20",
)
def _jon19(t):
    return be.bout_frames(t.labels())


@query(
    "agg8_behavior_budget",
    """SELECT run_id, profile_name, behavior, n, round(n/sum(n) OVER (PARTITION BY run_id, profile_name),6) AS share FROM
    (SELECT run_id, profile_name, behavior, count(*) AS n FROM b_labels GROUP BY 1,2,3)""",
)
def _agg8(t):
    return be.budget(t.labels()).withColumn("share", F.round("share", 6))


_CHG = """nx AS (SELECT *, lead(behavior) OVER w AS nb, lead(frame_idx) OVER w AS nf FROM b_labels
  WINDOW w AS (PARTITION BY run_id, profile_name ORDER BY frame_idx)), ch AS (SELECT * FROM nx WHERE nb<>behavior)"""


@query(
    "agg10_transitions",
    f"""WITH {_CHG}, nm AS (SELECT DISTINCT run_id, profile_name, behavior FROM b_labels),
    s AS (SELECT run_id, profile_name, behavior AS a, nb AS b, count(*) AS n FROM ch GROUP BY 1,2,3,4)
    SELECT x.run_id, x.profile_name, x.behavior AS from_behavior, y.behavior AS to_behavior, coalesce(s.n,0) AS n
    FROM nm x JOIN nm y ON x.run_id=y.run_id AND x.profile_name=y.profile_name
    LEFT JOIN s ON s.run_id=x.run_id AND s.profile_name=x.profile_name AND s.a=x.behavior AND s.b=y.behavior""",
)
def _agg10(t):
    return be.transitions(t.labels())


@query(
    "jon19_transition_frames",
    f"""WITH {_CHG} SELECT run_id, profile_name, behavior AS from_behavior, nb AS to_behavior, nf AS to_frame, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY run_id, profile_name, behavior, nb ORDER BY nf) AS rank FROM ch) WHERE rank<=20""",
)
def _jon19t(t):
    return be.transition_frames(t.labels())


def _spans(part: str, before: str = "true", after: str = "true") -> str:
    return f"""o AS (SELECT *, row_number() OVER w - 1 AS pos, lag(behavior) OVER w AS pb FROM b_labels WHERE {before}
      WINDOW w AS (PARTITION BY {part} ORDER BY timestamp_ms, frame_idx)),
    i AS (SELECT *, max(CASE WHEN pb IS DISTINCT FROM behavior THEN pos END) OVER (PARTITION BY {part} ORDER BY pos) AS span FROM o),
    sp AS (SELECT {part}, span, behavior AS label, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms FROM i WHERE {after} GROUP BY ALL)"""


@query("win7_label_spans", f"WITH {_spans('run_id, profile_name', after=chr(34) + 'confidence' + chr(34) + '>=0.1')} SELECT * FROM sp")
def _win7(t):
    return be.label_spans(t.labels(), min_confidence=0.1)


@query("win7_label_spans_compat", f"WITH {_spans('run_id', before='behavior=' + chr(39) + 'click' + chr(39))} SELECT * FROM sp")
def _win7c(t):
    return be.label_spans(t.labels(), behavior="click", compat=True)


@query(
    "win11_previous_labels",
    """SELECT run_id, profile_name, frame_idx, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY run_id, profile_name ORDER BY frame_idx
      ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '(this is the start — no previous labels)') AS context
    FROM (SELECT *, printf('  frame %d: %s (conf=%.2f)', frame_idx, behavior, floor(confidence*100+0.001)/100.0::DOUBLE) AS line FROM b_labels)""",
)
def _win11(t):
    labels = t.labels().withColumn("confidence", F.floor(F.col("confidence") * 100 + 0.001) / 100.0)
    return be.previous_labels(labels).select("run_id", "profile_name", "frame_idx", "context")


_VOCAB = "(VALUES ('Click',0),('view',1),('purchase',2),('idle',3)) v(name, position)"


@query(
    "jon15_vocabulary",
    f"""SELECT run_id, frame_idx, b.behavior, coalesce(e.name, l.name, 'idle') AS clean FROM b_labels b
    LEFT JOIN {_VOCAB.replace(' v(', ' e(')} ON e.name=b.behavior LEFT JOIN {_VOCAB.replace(' v(', ' l(')} ON lower(l.name)=lower(b.behavior)""",
)
def _jon15(t):
    words = t.spark.createDataFrame([("Click", 0), ("view", 1), ("purchase", 2), ("idle", 3)], "name string, position int")
    return be.clean_labels(t.labels(), words).select("run_id", "frame_idx", "behavior", "clean")


@query(
    "jon3_labels_on_frames",
    "SELECT l.run_id, l.frame_idx, l.behavior, f.timestamp_ms FROM b_labels l JOIN b_frames f USING (run_id, frame_idx)",
)
def _jon3(t):
    times = t.frames().select("run_id", "frame_idx", "timestamp_ms")
    return t.labels().select("run_id", "frame_idx", "behavior").join(times, ["run_id", "frame_idx"])


@query(
    "snk14_label_export",
    """SELECT l.run_id, profile_name, l.frame_idx AS frame, round_even(coalesce(f.timestamp_ms,0)/1000.0,2) AS "t (s)", behavior AS behaviour,
    round_even(confidence,2) AS confidence, coalesce(note,'') AS note FROM b_labels l
    LEFT JOIN (SELECT * FROM b_frames WHERE is_keyframe) f USING (run_id, frame_idx)""",
)
def _snk14(t):
    return be.export_rows(t.labels(), t.frames().filter("is_keyframe"))


@query(
    "set5_behavior_names",
    "SELECT DISTINCT run_id, type AS name FROM b_visual UNION SELECT run_id, behavior FROM b_labels UNION SELECT run_id, profile_name FROM b_labels",
)
def _set5(t):
    names = t.visual().select("run_id", F.col("type").alias("name"))
    labels = t.labels()
    return names.union(labels.select("run_id", "behavior")).union(labels.select("run_id", "profile_name")).distinct()


@query(
    "agg19_sorted_names",
    """SELECT run_id, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT run_id, type AS name FROM b_visual
    UNION SELECT DISTINCT run_id, unnest(entities) FROM b_visual UNION SELECT DISTINCT run_id, class_name FROM b_detections) GROUP BY 1""",
)
def _agg19(t):
    v = t.visual()
    names = (
        v.select("run_id", F.col("type").alias("name"))
        .union(v.select("run_id", F.explode("entities")))
        .union(t.detections().select("run_id", "class_name"))
        .distinct()
    )
    return names.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
