"""Captions, reviews and speech around frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.functions.text import jaccard
from cinetrace.operators import captions as ca
from cinetrace.operators.frames import escalation_threshold

_EFF = "CASE WHEN verifier_caption IS NOT NULL AND verifier_agrees=false THEN verifier_caption ELSE caption END"
_CLOCK = "printf('%02d:%05.2f', {0}//60000, ({0}%60000)/1000.0)"
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[ \\t\\n\\r\\f]+'), lambda w: w<>''))"


@query("prj4_effective_caption", f"SELECT run_id, frame_idx, {_EFF} AS caption FROM b_captions")
def _prj4(t):
    return t.captions().select("run_id", "frame_idx", ca.effective_caption().alias("caption"))


@query(
    "prj11_caption_rows",
    f"""SELECT run_id, frame_idx, {_CLOCK.format('timestamp_ms')} AS time, {_EFF} AS caption,
    CASE WHEN escalated THEN 'yes' ELSE '' END AS escalated,
    CASE WHEN verifier_agrees IS NULL THEN '' WHEN verifier_agrees THEN 'agree' ELSE 'disagree' END AS verdict FROM b_captions""",
)
def _prj11(t):
    return ca.caption_rows(t.captions())


@query(
    "jon1_captions_on_frames",
    "SELECT c.run_id, c.frame_idx, f.timestamp_ms, f.delta_score, c.caption FROM b_captions c JOIN b_frames f USING (run_id, frame_idx)",
)
def _jon1(t):
    frames = t.frames().select("run_id", "frame_idx", "timestamp_ms", "delta_score")
    return ca.on_frames(t.captions().select("run_id", "frame_idx", "caption"), frames)


@query(
    "agg4_caption_counts",
    """SELECT run_id, count(*) AS total, count(*) FILTER (WHERE escalated) AS escalated, count(verified_ms) AS verified,
    count(verifier_agrees) AS judged FROM b_captions GROUP BY 1""",
)
def _agg4(t):
    return ca.counts(t.captions())


@query(
    "flt6_pending_reviews",
    """SELECT run_id, frame_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx) AS rank FROM b_captions
    WHERE escalated AND verifier_agrees IS NULL) WHERE rank<=2""",
)
def _flt6(t):
    return ca.pending_reviews(t.captions(), 2).select("run_id", "frame_idx", "rank")


@query("flt7_nontrivial_captions", "SELECT run_id, frame_idx, change_line FROM b_captions WHERE lower(trim(change_line)) <> '(no change)'")
def _flt7(t):
    return ca.nontrivial(t.captions().select("run_id", "frame_idx", "change_line"), "change_line")


@query(
    "top4_latest_captions",
    """SELECT run_id, frame_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_ms DESC, verified_ms DESC NULLS LAST, frame_idx DESC) AS rank
    FROM b_captions) WHERE rank<=5""",
)
def _top4(t):
    return ca.latest(t.captions()).select("run_id", "frame_idx", "rank")


@query(
    "top5_latest_verdicts",
    """SELECT run_id, frame_idx, verifier_agrees, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY verified_ms DESC, frame_idx DESC) AS rank
    FROM b_captions WHERE verified_ms IS NOT NULL) WHERE rank<=5""",
)
def _top5(t):
    return ca.latest_verdicts(t.captions()).select("run_id", "frame_idx", "verifier_agrees", "rank")


_PREV = """pv AS (SELECT *, lag(frame_idx) OVER w AS prev_frame, lag(caption) OVER w AS prev_caption FROM b_captions
  WINDOW w AS (PARTITION BY run_id ORDER BY frame_idx))"""


@query("jon9_previous_caption", f"WITH {_PREV} SELECT run_id, frame_idx, prev_frame, prev_caption FROM pv")
def _jon9(t):
    return ca.with_previous(t.captions()).select("run_id", "frame_idx", "prev_frame", "prev_caption")


_SIM = f"""{_PREV}, tk AS (SELECT *, {_TOK.format('caption')} AS ta, {_TOK.format("coalesce(prev_caption,'')")} AS tb FROM pv),
 sm AS (SELECT *, CASE WHEN prev_caption IS NULL THEN NULL WHEN len(ta)=0 AND len(tb)=0 THEN 1.0 WHEN len(ta)=0 OR len(tb)=0 THEN 0.0
   ELSE len(list_intersect(ta,tb))/len(list_distinct(list_concat(ta,tb))) END AS similarity FROM tk)"""


@query("win9_caption_similarity", f"WITH {_SIM} SELECT run_id, frame_idx, round(similarity,6) AS similarity FROM sm")
def _win9(t):
    return ca.similarity(t.captions()).select("run_id", "frame_idx", F.round("similarity", 6).alias("similarity"))


@query(
    "win10_escalation",
    f"""WITH {_SIM}, th AS (SELECT run_id, CASE WHEN count(*)<10 THEN max(delta_score) ELSE quantile_cont(delta_score,0.9) END AS threshold
      FROM b_captions GROUP BY 1) SELECT run_id, frame_idx, (delta_score>=threshold OR coalesce(similarity<0.3,false)) AS escalate FROM sm JOIN th USING (run_id)""",
)
def _win10(t):
    return ca.escalations(t.captions()).select("run_id", "frame_idx", "escalate")


@query(
    "fn13_caption_change_overlap",
    f"""WITH k AS (SELECT run_id, frame_idx, {_TOK.format('caption')} AS ta, {_TOK.format("coalesce(verifier_caption,'')")} AS tb FROM b_captions)
    SELECT run_id, frame_idx, round(CASE WHEN len(ta)=0 AND len(tb)=0 THEN 1.0 WHEN len(ta)=0 OR len(tb)=0 THEN 0.0
    ELSE len(list_intersect(ta,tb))/len(list_distinct(list_concat(ta,tb))) END,6) AS overlap FROM k""",
)
def _fn13(t):
    return t.captions().select("run_id", "frame_idx", F.round(jaccard(F.col("caption"), F.col("verifier_caption")), 6).alias("overlap"))


_DENSE = f"""sz AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE escalated) AS kept FROM b_captions GROUP BY 1),
 ps AS (SELECT c.*, row_number() OVER (PARTITION BY run_id, escalated ORDER BY timestamp_ms, frame_idx)-1 AS pos FROM b_captions c),
 pk AS (SELECT DISTINCT run_id, least(CAST(round_even(i*((total-kept)/(4-kept)::DOUBLE),0) AS BIGINT), total-kept-1) AS pos, 1 AS hit
   FROM sz, range(4) r(i) WHERE 4-kept>0 AND i<4-kept AND total-kept>4-kept),
 dt AS (SELECT p.run_id, p.frame_idx, p.timestamp_ms, {_EFF} AS text, escalated, verifier_agrees IS NOT NULL AS verified
   FROM ps p JOIN sz USING (run_id) LEFT JOIN pk ON pk.run_id=p.run_id AND pk.pos=p.pos AND NOT p.escalated
   WHERE escalated OR total<=4 OR (4-kept>0 AND (total-kept<=4-kept OR hit=1)))"""


@query("top10_dense_timeline", f"WITH {_DENSE} SELECT * FROM dt")
def _top10(t):
    return ca.dense_timeline(t.captions(), 4)


@query(
    "fn9_timeline_text",
    f"""WITH {_DENSE}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ms, frame_idx)-1 AS pos FROM dt)
    SELECT run_id, pos//1000 AS part, string_agg(CASE WHEN escalated THEN '*' ELSE '' END||{_CLOCK.format('timestamp_ms')}||' '||text, chr(10) ORDER BY pos) AS text
    FROM o GROUP BY 1,2""",
)
def _fn9(t):
    return ca.timeline_text(ca.dense_timeline(t.captions(), 4))


_UNC = "SELECT run_id, frame_idx FROM b_frames f WHERE NOT EXISTS (SELECT 1 FROM b_captions c WHERE c.run_id=f.run_id AND c.frame_idx=f.frame_idx)"


@query("jon11_uncaptioned_frames", _UNC)
def _jon11(t):
    return ca.uncaptioned(t.frames(), t.captions()).select("run_id", "frame_idx")


@query("set7_frame_difference", _UNC)
def _set7(t):
    cols = ["run_id", "frame_idx"]
    return t.frames().select(cols).exceptAll(t.captions().select(cols))


@query(
    "jon6_speech_around_5s",
    """SELECT l.run_id, l.frame_idx, a.segment_id FROM b_labels l JOIN b_audio a ON a.run_id=l.run_id
    AND a.start_ms < l.timestamp_ms+5000 AND a.end_ms > l.timestamp_ms-5000""",
)
def _jon6(t):
    return ca.speech_around(t.labels(), t.audio(), 5000).select("run_id", "frame_idx", "segment_id")


@query(
    "jon6_speech_around_1s",
    """SELECT l.run_id, l.frame_idx, a.segment_id FROM b_frames l JOIN b_audio a ON a.run_id=l.run_id
    AND a.start_ms < l.timestamp_ms+1000 AND a.end_ms > l.timestamp_ms-1000""",
)
def _jon6b(t):
    return ca.speech_around(t.frames(), t.audio(), 1000).select("run_id", "frame_idx", "segment_id")


@query(
    "jon7_speech_at_closed",
    """SELECT l.run_id, l.frame_idx, a.segment_id FROM b_labels l JOIN b_audio a ON a.run_id=l.run_id
    AND a.start_ms <= l.timestamp_ms AND a.end_ms >= l.timestamp_ms""",
)
def _jon7(t):
    return ca.speech_at(t.labels(), t.audio()).select("run_id", "frame_idx", "segment_id")


@query(
    "jon7_speech_at_half_open",
    """SELECT l.run_id, l.frame_idx, a.segment_id FROM b_labels l JOIN b_audio a ON a.run_id=l.run_id
    AND a.start_ms <= l.timestamp_ms AND a.end_ms > l.timestamp_ms""",
)
def _jon7b(t):
    return ca.speech_at(t.labels(), t.audio(), "start").select("run_id", "frame_idx", "segment_id")


@query(
    "ctx6_review_tasks",
    f"""WITH {_PREV}, sp AS (SELECT c.run_id, c.frame_idx, a.text, a.start_ms, a.segment_id,
      row_number() OVER (PARTITION BY c.run_id, c.frame_idx ORDER BY a.start_ms, a.segment_id) AS line
      FROM pv c JOIN b_audio a ON a.run_id=c.run_id AND a.start_ms<c.timestamp_ms+5000 AND a.end_ms>c.timestamp_ms-5000 WHERE c.escalated),
    h AS (SELECT run_id, frame_idx, string_agg(text, ' | ' ORDER BY line) AS speech FROM sp WHERE line<=6 GROUP BY 1,2)
    SELECT p.run_id, p.frame_idx, prev_frame, prev_caption, caption, change_line, coalesce(speech,'') AS speech
    FROM pv p LEFT JOIN h USING (run_id, frame_idx) WHERE escalated""",
)
def _ctx6(t):
    return ca.review_tasks(t.captions(), t.audio())


_OUT = """oc AS (SELECT run_id, 'walk' AS kind, CASE WHEN behavior='error' THEN 'error' WHEN behavior='view' THEN 'skipped' ELSE 'captioned' END AS outcome FROM b_events
  UNION ALL SELECT run_id, 'review', CASE WHEN k%9=0 THEN 'error' WHEN k%2=0 THEN 'agreed' ELSE 'disagreed' END FROM b_events
  UNION ALL SELECT 1000000+run_id, 'walk', 'error' FROM b_captions),
 tt AS (SELECT run_id, count(*) FILTER (WHERE kind='walk' AND outcome='captioned') AS captioned, count(*) FILTER (WHERE kind='walk' AND outcome='skipped') AS skipped,
  count(*) FILTER (WHERE kind='walk' AND outcome='error') AS errors, count(*) FILTER (WHERE kind='review' AND outcome='agreed') AS agreed,
  count(*) FILTER (WHERE kind='review' AND outcome='disagreed') AS disagreed, count(*) FILTER (WHERE kind='review' AND outcome='error') AS review_errors,
  count(*) FILTER (WHERE kind='review' AND outcome IN ('agreed','disagreed')) AS verified FROM oc GROUP BY 1)"""


def _outcomes(t):
    e = t.events()
    walk = F.when(F.col("behavior") == "error", "error").when(F.col("behavior") == "view", "skipped").otherwise("captioned")
    review = F.when(F.col("k") % 9 == 0, "error").when(F.col("k") % 2 == 0, "agreed").otherwise("disagreed")
    return (
        e.select("run_id", F.lit("walk").alias("kind"), walk.alias("outcome"))
        .union(e.select("run_id", F.lit("review"), review))
        .union(t.captions().select(F.col("run_id") + 1000000, F.lit("walk"), F.lit("error")))
    )


@query("agg24_walker_totals", f"WITH {_OUT} SELECT * FROM tt")
def _agg24(t):
    return ca.walker_totals(_outcomes(t))


@query(
    "agg24b_stage_outcome",
    f"""WITH {_OUT} SELECT run_id, CASE WHEN captioned+skipped=0 AND errors>0 THEN 'error' ELSE 'done' END AS status,
    NOT (captioned+skipped=0 AND errors>0) AS complete, CASE WHEN captioned+skipped=0 AND errors>0 THEN 'all '||errors||' caption requests failed' END AS error FROM tt""",
)
def _agg24b(t):
    return ca.stage_outcome(ca.walker_totals(_outcomes(t)))
