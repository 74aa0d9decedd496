"""Streams run to the end of their input, and their batch twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.catalog.captions import _SIM
from cinetrace.catalog.summaries import _FACTS, _facts
from cinetrace.operators import summaries as su
from cinetrace.plans import hooks
from cinetrace.sources import keyed as kw
from cinetrace.sources.readers import scratch_dir
from cinetrace.streaming import live



def _deliver(spark, rows, parts, root, start):
    """Deliver ``parts`` one after the other; after each the stream takes what is there and stops.

    ``start(stream, checkpoint)`` starts the query; it goes on where it stopped.
    """
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        start(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), f"{root}/ckpt").awaitTermination()


def _thirds(rows):
    """All rows in three parts by frame, and the middle part again."""
    parts = [rows.filter(F.pmod("frame_idx", F.lit(3)) == k) for k in range(3)]
    return [*parts, parts[1]]


_LIVE = """r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_ms DESC, verified_ms DESC NULLS LAST, frame_idx DESC) AS rank FROM b_captions),
 v AS (SELECT run_id, string_agg(frame_idx, ',' ORDER BY rank) AS verdicts FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY verified_ms DESC, frame_idx DESC) AS rank FROM b_captions WHERE verified_ms IS NOT NULL) WHERE rank<=5 GROUP BY 1),
 s AS (SELECT r.run_id, count(*) AS speech FROM r JOIN b_audio a ON a.run_id=r.run_id AND a.start_ms<r.timestamp_ms+1000 AND a.end_ms>r.timestamp_ms-1000 WHERE rank=1 GROUP BY 1)
 SELECT r.run_id, r.frame_idx, r.caption, r.change_line, l.recent, coalesce(v.verdicts,'') AS verdicts, coalesce(s.speech,0) AS speech, c.total, c.escalated, c.verified FROM r
 JOIN (SELECT run_id, string_agg(frame_idx, ',' ORDER BY rank) AS recent FROM r WHERE rank<=5 GROUP BY 1) l USING (run_id) LEFT JOIN v USING (run_id) LEFT JOIN s USING (run_id)
 JOIN (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE escalated) AS escalated, count(verified_ms) AS verified FROM b_captions GROUP BY 1) c USING (run_id) WHERE rank=1"""


@query("str1_live_state", f"WITH {_LIVE}")
def _str1(t):
    return live.live_state(t.captions(), t.audio())


@query("str1_live_feed", f"WITH {_LIVE}")
def _str1f(t):
    """The same rows through a stream of caption files: four deliveries, the last one repeated.

    Captions and speech lie in stores by runs, of which each micro-batch reads the touched ones.
    """
    root, spark = scratch_dir(t.spark, "feed"), t.spark
    caps, said = t.captions(), t.audio()
    kw.write_runs(caps, f"{root}/captions", "frame_idx")
    kw.write_runs(said, f"{root}/audio", "segment_id")
    stored = lambda name, like: kw.read_runs(spark, f"{root}/{name}", like)
    _deliver(
        spark, caps, _thirds(caps), root,
        lambda stream, ckpt: live.live_feed(stream, lambda: stored("captions", caps), lambda: stored("audio", said), f"{root}/out", ckpt, None),
    )
    return t.spark.read.parquet(f"{root}/out").drop(kw.FOLDER)


@query("str2_walker", f"WITH {_SIM} SELECT run_id, frame_idx, (delta_score>=9.0 OR coalesce(similarity<0.3,false)) AS escalate FROM sm")
def _str2(t):
    """Later frames first, and some of them twice; repeated deliveries are dropped before the walk."""
    root = scratch_dir(t.spark, "walk")
    at = F.timestamp_millis("created_ms").alias("at")
    rows = t.captions().select("run_id", "frame_idx", "caption", "delta_score", F.lit(9.0).alias("threshold"), at)
    out = live.Publication(f"{root}/out", ["run_id", "frame_idx"], every=2)

    def start(stream, ckpt):
        return out.start(live.walk(live.deduplicated(stream, "at"), size=4), ckpt, None)

    _deliver(t.spark, rows, _thirds(rows)[::-1], root, start)
    return out.read(t.spark)


_TRIES = "tries AS (SELECT run_id, frame_idx, count(*) AS n FROM (SELECT run_id, frame_idx, unnest(range(length(caption)%5)) FROM b_captions) GROUP BY 1,2)"


def _attempts(t):
    n = F.length("caption") % 5
    return t.captions().filter(n > 0).select("run_id", "frame_idx", F.explode(F.sequence(F.lit(1), n)).alias("attempt"))


@query(
    "str3_review_queue",
    f"""WITH {_TRIES} SELECT run_id, frame_idx, rank FROM (SELECT run_id, frame_idx, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx) AS rank FROM b_captions c
    WHERE escalated AND verifier_agrees IS NULL AND NOT EXISTS (SELECT 1 FROM tries a WHERE a.run_id=c.run_id AND a.frame_idx=c.frame_idx AND a.n>=3)) WHERE rank<=2""",
)
def _str3(t):
    return live.review_queue(t.captions(), _attempts(t), 2).select("run_id", "frame_idx", "rank")


@query(
    "str3_review_drain",
    f"""WITH {_TRIES} SELECT run_id, frame_idx FROM b_captions c WHERE escalated AND verifier_agrees IS NULL
    AND NOT EXISTS (SELECT 1 FROM tries a WHERE a.run_id=c.run_id AND a.frame_idx=c.frame_idx AND a.n>=3)""",
)
def _str3d(t):
    return live.review_queue(t.captions(), _attempts(t), None).select("run_id", "frame_idx")


def _review_stream(t, batch):
    """Captions in three deliveries and again the second, with the tries one by one beside them."""
    root = scratch_dir(t.spark, "reviews")
    at = F.timestamp_millis("created_ms").alias("at")
    caps = t.captions().select("run_id", "frame_idx", "escalated", "verifier_agrees", at)
    tries = _attempts(t).join(caps.select("run_id", "frame_idx", "at"), ["run_id", "frame_idx"])
    none = tries.filter("false")
    parts = [
        live.review_events(caption, tries.filter(F.col("attempt") == n) if n else none)
        for caption, n in zip(_thirds(caps), (4, 1, 3, 2))
    ]
    out = live.Publication(f"{root}/out", ["run_id", "block"], every=3)

    def start(stream, ckpt):
        return out.start(live.review_stream(stream.withWatermark("at", "2 minutes"), batch, size=4), ckpt, None)

    _deliver(t.spark, parts[0], parts, root, start)
    return live.next_reviews(out.read(t.spark), batch)


_QUEUE = f"""WITH {_TRIES} SELECT run_id, frame_idx, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx) AS rank FROM b_captions c
    WHERE escalated AND verifier_agrees IS NULL AND NOT EXISTS (SELECT 1 FROM tries a WHERE a.run_id=c.run_id AND a.frame_idx=c.frame_idx AND a.n>=3)"""


@query("str3_review_stream", f"SELECT * FROM ({_QUEUE}) WHERE rank<=2")
def _str3s(t):
    return _review_stream(t, 2).select("run_id", "frame_idx", "rank")


@query("str3_review_stream_drain", f"SELECT run_id, frame_idx FROM ({_QUEUE})")
def _str3sd(t):
    return _review_stream(t, None)


@query("str3_attempt_counts", f"WITH {_TRIES} SELECT * FROM tries")
def _str3a(t):
    root = scratch_dir(t.spark, "attempts")
    tries = _attempts(t)
    parts = [tries.filter(F.col("attempt") == n) for n in range(1, 5)]  # a frame's tries come one by one
    out = live.Publication(f"{root}/out", ["run_id", "frame_idx"], every=2)
    _deliver(t.spark, tries, parts, root, lambda stream, ckpt: out.start(live.attempt_counts(stream), ckpt, None))
    return out.read(t.spark)


_STATUS = """SELECT run_id, stage, max(event_id) AS seq, arg_max(CASE WHEN n_units=0 THEN 'error' ELSE 'done' END, event_id) AS status, arg_max(n_units, event_id) AS n_units, count(*) AS updates
  FROM b_timings GROUP BY 1,2"""


def _stage_events(t):
    n = F.col("n_units")
    return t.timings().select("run_id", "stage", F.col("event_id").alias("seq"), F.when(n == 0, "error").otherwise("done").alias("status"), "n_units")


@query("str4_stage_status", _STATUS)
def _str4(t):
    return live.stage_status_batch(_stage_events(t))


@query("str4_status_stream", _STATUS)
def _str4s(t):
    root = scratch_dir(t.spark, "status")
    events = _stage_events(t)
    # the newest third comes first: late events count, but do not hide newer ones
    parts = [events.filter(F.pmod("seq", F.lit(3)) == k) for k in (2, 0, 1)]
    out = live.Publication(f"{root}/out", ["run_id", "stage"], every=2)
    _deliver(t.spark, events, parts, root, lambda stream, ckpt: out.start(live.stage_status(stream), ckpt, None))
    return out.read(t.spark)


@query("str5_catch_up", "SELECT run_id, frame_idx, delta_score FROM b_frames")
def _str5(t):
    """Two deliveries, two calls: each frame arrives once."""
    root = scratch_dir(t.spark, "catchup")
    rows = t.frames().select("run_id", "frame_idx", "delta_score")
    for part in (rows.filter("delta_score < 10"), rows.filter("delta_score >= 10")):
        part.write.mode("append").parquet(f"{root}/in")
        live.catch_up(t.spark.readStream.schema(rows.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/ckpt")
    return t.spark.read.parquet(f"{root}/out")


class _Shout:
    """A stand-in for a model."""

    name = "shout"

    def is_available(self) -> bool:
        return True

    def analyse(self, texts: pd.Series) -> pd.Series:
        return texts.str.upper()

    def cleanup(self) -> None:
        pass


@query("udf1_text_model", f"WITH {_FACTS} SELECT run_id, upper(coalesce(event_types,'none')) AS answer FROM fc")
def _udf1(t):
    rows = _facts(t).select("run_id", F.coalesce("event_types", F.lit("none")).alias("prompt"), F.lit("").alias("fallback"))
    return hooks.enrich(rows, "prompt", "answer", _Shout, "fallback").select("run_id", "answer")


@query("udf2_without_model", f"WITH {_FACTS} SELECT run_id, coalesce(nullif(summary,''),'Video analysis completed.') AS answer FROM fc")
def _udf2(t):
    lines = su.five_lines(_facts(t)).withColumn("text", F.split("text", "\n")[0])
    return hooks.enrich(lines, "text", "answer", None, "text").select("run_id", "answer")


@query("udf3_observed", "SELECT run_id, frame_idx FROM b_frames")
def _udf3(t):
    rows, _seen = hooks.observed(t.frames().select("run_id", "frame_idx"), "frames")
    return rows


@query(
    "udf3_job_metrics",
    """SELECT 'scores' AS job, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM b_frames
    UNION ALL SELECT 'scores', 'keyframes', CAST(count(*) FILTER (WHERE is_keyframe) AS DOUBLE) FROM b_frames
    UNION ALL SELECT 'feed', 'input_rows', CAST(count(*) AS DOUBLE) FROM b_frames
    UNION ALL SELECT 'feed', 'high', CAST(count(*) FILTER (WHERE delta_score >= 10) AS DOUBLE) FROM b_frames
    UNION ALL SELECT 'feed', 'state_rows', CAST(0 AS DOUBLE)""",
)
def _udf3m(t):
    """Figures that a batch job and a stream in two deliveries leave in the table of metrics."""
    root = scratch_dir(t.spark, "metrics")
    rows = t.frames().select("run_id", "frame_idx", "delta_score", "is_keyframe")
    seen_rows, seen = hooks.observed(rows, "scores", keyframes=F.count_if("is_keyframe"))
    seen_rows.write.parquet(f"{root}/scores")
    hooks.record(t.spark, f"{root}/metrics", "scores", seen.get)
    progress = hooks.Progress()
    t.spark.streams.addListener(progress)
    try:
        for part in (rows.filter("delta_score < 10"), rows.filter("delta_score >= 10")):
            part.write.mode("append").parquet(f"{root}/in")
            stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
            stream = stream.observe("feed", F.count_if(F.col("delta_score") >= 10).alias("high"))
            last = live.append_new(stream, f"{root}/out", f"{root}/ckpt")
            reports = progress.finished(last)
        for batch, figures in reports:
            hooks.record(t.spark, f"{root}/metrics", "feed", figures, batch)
    finally:
        t.spark.streams.removeListener(progress)
    return t.spark.read.parquet(f"{root}/metrics").groupBy("job", "metric").agg(F.sum("value").alias("value"))
