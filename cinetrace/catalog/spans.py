"""Event spans, merged clips and time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.functions.geometry import playback_time
from cinetrace.operators import behavior as be
from cinetrace.operators import spans as sp
from cinetrace.operators.frames import linspace_pick
from cinetrace.operators.intervals import in_time_range, pad_and_merge

_SEC = "CAST(split_part({0},':',1) AS DOUBLE)*60+CAST(split_part({0},':',2) AS DOUBLE)"
_ROWS = f"""ev AS (SELECT *, {_SEC.format('start_time')} AS s, {_SEC.format('end_time')} AS e FROM b_visual),
 rw AS (SELECT run_id, ev_idx, array_to_string(entities, ', ') AS row, type, s AS start, CASE WHEN e<=s THEN s+0.5 ELSE e END AS "end",
   type||printf(' (%.2f)', round_even(confidence,2)) AS label, description, entities FROM ev)"""
_VSP = f"""vs AS (SELECT run_id, CAST(s*1000 AS BIGINT) AS start_ms, CAST(greatest(s,e)*1000 AS BIGINT) AS end_ms,
  type||': '||array_to_string(entities, ', ') AS label, type, entities FROM ev)"""


@query("prj5_event_rows", f"""WITH {_ROWS} SELECT run_id, ev_idx, row, type, start, "end", label, description FROM rw""")
def _prj5(t):
    return sp.event_rows(t.visual()).drop("entities")


@query("flt3_events_of_entity", "SELECT run_id, ev_idx FROM b_visual WHERE list_contains(entities, 'E2')")
def _flt3(t):
    return sp.with_entity(t.visual(), "E2").select("run_id", "ev_idx")


@query("flt4_events_of_type", "SELECT run_id, ev_idx FROM b_visual WHERE type='purchase'")
def _flt4(t):
    return sp.of_type(t.visual(), "purchase").select("run_id", "ev_idx")


@query(
    "flt5_spans_in_range",
    f"WITH {_ROWS}, {_VSP} SELECT run_id, start_ms, end_ms, label FROM vs WHERE end_ms>=300000 AND start_ms<=600000",
)
def _flt5(t):
    return in_time_range(sp.visual_spans(t.visual()), 300_000, 600_000)


_MERGE = """pd AS (SELECT run_id, greatest(least(start_ms,end_ms)-1500,0) AS s, greatest(start_ms,end_ms)+1500 AS e, label FROM {src}),
 ro AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s, e, label) AS rn FROM pd),
 rm AS (SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ro),
 ri AS (SELECT *, sum(CASE WHEN reach IS NULL OR s>reach THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY rn) AS isl FROM rm),
 lb AS (SELECT run_id, isl, label, min(rn) AS rn FROM ri GROUP BY 1,2,3),
 mg AS (SELECT run_id, isl, min(s) AS start_ms, max(e) AS end_ms FROM ri GROUP BY 1,2),
 out AS (SELECT run_id, start_ms, end_ms, (SELECT string_agg(label, ' + ' ORDER BY rn) FROM lb WHERE lb.run_id=mg.run_id AND lb.isl=mg.isl) AS label FROM mg)"""


@query("win8_pad_merge", f"WITH {_ROWS}, {_VSP}, {_MERGE.format(src='vs')} SELECT * FROM out")
def _win8(t):
    return pad_and_merge(sp.visual_spans(t.visual()))


_LAB = """o AS (SELECT *, row_number() OVER w - 1 AS pos, lag(behavior) OVER w AS pb FROM b_labels
  WINDOW w AS (PARTITION BY run_id, profile_name ORDER BY timestamp_ms, frame_idx)),
 i AS (SELECT *, max(CASE WHEN pb IS DISTINCT FROM behavior THEN pos END) OVER (PARTITION BY run_id, profile_name ORDER BY pos) AS span FROM o),
 lsp AS (SELECT run_id, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, behavior AS label FROM i GROUP BY run_id, profile_name, span, behavior),
 un AS (SELECT run_id, start_ms, end_ms, label FROM vs UNION ALL SELECT * FROM lsp)"""


@query("set2_all_spans", f"WITH {_ROWS}, {_VSP}, {_LAB} SELECT * FROM un")
def _set2(t):
    return sp.all_spans(t.visual(), be.label_spans(t.labels()))


@query("win8_clip_selection", f"WITH {_ROWS}, {_VSP}, {_LAB}, {_MERGE.format(src='un')} SELECT * FROM out")
def _clips(t):
    return pad_and_merge(sp.all_spans(t.visual(), be.label_spans(t.labels())))


_CUT = f"""{_ROWS}, {_VSP}, {_MERGE.format(src='vs')}, du AS (SELECT run_id, max(timestamp_ms)/1000.0 AS d FROM b_frames GROUP BY 1),
 cu AS (SELECT o.run_id, row_number() OVER (PARTITION BY o.run_id ORDER BY start_ms, end_ms)-1 AS clip, d, label,
   CASE WHEN d IS NULL THEN start_ms/1000.0 ELSE least(start_ms/1000.0, greatest(0.0, d-0.1)) END AS start_s,
   CASE WHEN d IS NULL THEN end_ms/1000.0 ELSE least(end_ms/1000.0, d) END AS end_s FROM out o LEFT JOIN du USING (run_id)),
 cl AS (SELECT run_id, clip, start_s, end_s-start_s AS duration_s, label, printf('clip_%03d_', clip)||
   left(lower(trim(regexp_replace(label,'[^A-Za-z0-9]+','_','g'),'_')),40)||'.mp4' AS file FROM cu WHERE end_s-start_s>0)"""


def _cuts(t):
    d = t.frames().groupBy("run_id").agg((F.max("timestamp_ms") / 1000.0).alias("duration_s"))
    return sp.cut_list(pad_and_merge(sp.visual_spans(t.visual())), d)


@query("prj8_cut_list", f"WITH {_CUT} SELECT run_id, clip, round(start_s,6) AS start_s, round(duration_s,6) AS duration_s, label, file FROM cl")
def _prj8(t):
    return _cuts(t).withColumns({c: F.round(c, 6) for c in ("start_s", "duration_s")})


@query(
    "win18_crossfade_offsets",
    f"""WITH {_CUT} SELECT run_id, clip, round(coalesce(sum(duration_s-0.5) OVER (PARTITION BY run_id ORDER BY clip
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0.0),6) AS "offset" FROM cl""",
)
def _win18(t):
    return sp.crossfade_offsets(_cuts(t)).select("run_id", "clip", F.round("offset", 6).alias("offset"))


@query(
    "prj10_timeline_extent",
    f"""WITH {_ROWS}, r AS (SELECT run_id, max("end") AS le FROM rw GROUP BY 1), f AS (SELECT run_id, max(timestamp_ms)/1000.0 AS s FROM b_frames GROUP BY 1)
    SELECT run_id, greatest(coalesce(s,0.0), coalesce(le,1.0)) AS extent FROM f FULL JOIN r USING (run_id)""",
)
def _prj10(t):
    return sp.timeline_extent(t.visual(), t.frames())


@query(
    "prj10_focused_rows",
    f"""WITH {_ROWS}, h AS (SELECT *, list_contains(entities,'E6') AS hit FROM rw) SELECT run_id, ev_idx, label FROM
    (SELECT *, max(hit) OVER (PARTITION BY run_id) AS shown FROM h) WHERE hit OR NOT shown""",
)
def _prj10f(t):
    return sp.focused_rows(t.visual(), "E6").select("run_id", "ev_idx", "label")


@query(
    "jon8_active_events",
    f"""WITH {_ROWS} SELECT f.run_id, f.frame_idx, r.ev_idx FROM b_frames f JOIN rw r ON r.run_id=f.run_id
    AND r.start<=f.timestamp_ms/1000.0 AND r."end">=f.timestamp_ms/1000.0""",
)
def _jon8(t):
    at = t.frames().select("run_id", "frame_idx", (F.col("timestamp_ms") / 1000.0).alias("at"))
    return sp.active_at(at, t.visual()).select("run_id", "frame_idx", "ev_idx")


_LIFE = f"""lf AS (SELECT run_id, id, {_SEC.format('first_seen')} AS fs, greatest({_SEC.format('last_seen')}, {_SEC.format('first_seen')}+0.001) AS ls FROM b_entities),
 lfr AS (SELECT l.run_id, l.id, f.frame_idx, f.timestamp_ms FROM lf l JOIN b_frames f ON f.run_id=l.run_id AND f.timestamp_ms/1000.0 BETWEEN fs AND ls)"""


@query("jon10_lifespan_frames", f"WITH {_LIFE} SELECT run_id, id, frame_idx FROM lfr")
def _jon10(t):
    return sp.lifespan_frames(t.entities(), t.frames()).select("run_id", "id", "frame_idx")


_CORR = """co AS (SELECT run_id, ev_idx AS visual_idx, CASE WHEN k%5=0 THEN NULL ELSE ev_idx+k END AS audio_idx FROM b_visual JOIN b_events USING (run_id)
  WHERE frame_idx=ev_idx)"""


def _pairs(t):
    return t.events().select(
        "run_id",
        F.col("frame_idx").alias("visual_idx"),
        F.when(F.col("k") % 5 != 0, F.col("frame_idx") + F.col("k")).alias("audio_idx"),
    )


@query(
    "jon13_correlated_events",
    f"""WITH {_CORR} SELECT c.run_id, c.visual_idx, c.audio_idx, coalesce(v.description[1:80], '(event #'||coalesce(CAST(c.visual_idx AS VARCHAR),'None')||')') AS visual_event,
    coalesce(a.text[1:80], '(event #'||coalesce(CAST(c.audio_idx AS VARCHAR),'None')||')') AS audio_event FROM co c
    LEFT JOIN b_visual v ON v.run_id=c.run_id AND v.ev_idx=c.visual_idx LEFT JOIN b_sounds a ON a.run_id=c.run_id AND a.ev_idx=c.audio_idx""",
)
def _jon13(t):
    return sp.correlated(_pairs(t), t.visual(), t.sounds())


@query(
    "jon18_entity_appearances",
    """SELECT v.run_id, v.ev_idx, v.type, v.id, e.type AS entity_type FROM (SELECT DISTINCT run_id, ev_idx, type, unnest(entities) AS id FROM b_visual) v
    JOIN b_entities e ON e.run_id=v.run_id AND e.id=v.id""",
)
def _jon18(t):
    return sp.appearances(t.visual(), t.entities())


@query("prj9_entity_table", "SELECT run_id, id, type, first_seen, last_seen, description FROM b_entities")
def _prj9(t):
    return sp.entity_table(t.entities())


@query(
    "prj7_playback_time",
    """SELECT f.run_id, f.frame_idx, round(CASE WHEN d.s<=0 THEN 0 ELSE least(greatest(f.timestamp_ms/1000.0*25/d.s,0),25.0) END,6) AS play_s
    FROM b_frames f JOIN (SELECT run_id, max(timestamp_ms)/2000.0 AS s FROM b_frames GROUP BY 1) d USING (run_id)""",
)
def _prj7(t):
    d = t.frames().groupBy("run_id").agg((F.max("timestamp_ms") / 2000.0).alias("s"))
    at = playback_time(F.col("timestamp_ms") / 1000.0, F.lit(25.0), F.col("s"))
    return t.frames().join(d, "run_id").select("run_id", "frame_idx", F.round(at, 6).alias("play_s"))


@query(
    "top8_entity_frames",
    f"""WITH {_LIFE}, p AS (SELECT run_id, id, frame_idx, row_number() OVER (PARTITION BY run_id, id ORDER BY frame_idx)-1 AS pos, count(*) OVER (PARTITION BY run_id, id) AS total FROM lfr),
    i AS (SELECT DISTINCT run_id, id, CAST(CASE WHEN i=11 THEN total-1 ELSE floor(i*((total-1)/11.0::DOUBLE)) END AS BIGINT) AS pos, 1 AS hit
      FROM (SELECT DISTINCT run_id, id, total FROM p), range(12) r(i))
    SELECT run_id, id, frame_idx FROM p LEFT JOIN i USING (run_id, id, pos) WHERE total<=12 OR hit=1""",
)
def _top8e(t):
    return linspace_pick(sp.lifespan_frames(t.entities(), t.frames()), 12, keys=["run_id", "id"]).select("run_id", "id", "frame_idx")
