"""Run overviews, totals and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.operators import summaries as su
from cinetrace.sources import readers as rd
from cinetrace.sources.keyed import write_run_folders as _write_run_folders

_N = "(SELECT run_id, count(*) AS n FROM {0} GROUP BY 1)"


@query(
    "agg2_run_overview",
    f"""SELECT f.run_id, f.frames, f.span_s, coalesce(d.n,0) AS detections, coalesce(p.n,0) AS depth_maps, coalesce(e.n,0) AS entities, coalesce(v.n,0) AS events
    FROM (SELECT run_id, count(*) AS frames, (max(timestamp_ms)-min(timestamp_ms))/1000.0 AS span_s FROM b_frames GROUP BY 1) f
    LEFT JOIN {_N.format('b_detections')} d USING (run_id) LEFT JOIN {_N.format('b_depth')} p USING (run_id)
    LEFT JOIN {_N.format('b_entities')} e USING (run_id) LEFT JOIN {_N.format('b_visual')} v USING (run_id)""",
)
def _agg2(t):
    return su.overview(t.frames(), detections=t.detections(), depth_maps=t.depth(), entities=t.entities(), events=t.visual())


@query(
    "agg3_run_gallery",
    f"""SELECT f.run_id, frames, finished_ms, coalesce(d.n,0) AS detections, coalesce(e.n,0) AS entities, coalesce(v.n,0) AS events, coalesce(c.n,0) AS captions
    FROM (SELECT run_id, count(*) AS frames, max(timestamp_ms) AS finished_ms FROM b_frames GROUP BY 1) f
    LEFT JOIN {_N.format('b_detections')} d USING (run_id) LEFT JOIN {_N.format('b_entities')} e USING (run_id) LEFT JOIN {_N.format('b_visual')} v USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) AS n FROM b_captions WHERE caption<>'' GROUP BY 1) c USING (run_id) ORDER BY finished_ms DESC, run_id LIMIT 8""",
)
def _agg3(t):
    f = t.frames()
    newest = f.groupBy("run_id").agg(F.max("timestamp_ms").alias("finished_ms"))
    runs = su.overview(
        f, detections=t.detections(), entities=t.entities(), events=t.visual(), captions=t.captions().filter("caption <> ''")
    ).drop("span_s")
    return su.gallery(runs.join(newest, "run_id"))


@query(
    "src1_run_catalogue",
    "SELECT run_id, max(at_ms) AS finished_ms, count(*) AS files, sum(n_units)::BIGINT AS bytes FROM b_timings GROUP BY 1",
)
def _src1(t):
    files = t.timings().select("run_id", F.col("at_ms").alias("modified_ms"), F.col("n_units").alias("length"))
    return su.newest_runs(files)


@query(
    "src1_run_folders",
    """SELECT run_id, run_id%3=0 AS has_document, CASE WHEN run_id%3=0 THEN 2 ELSE 1 END AS files FROM (SELECT DISTINCT run_id FROM b_frames)""",
)
def _src1f(t):
    """Folders of runs, listed: stores, documents of every third run, and documents of runs without a store."""
    root = rd.scratch_dir(t.spark, "runs")
    frames = t.frames().select("run_id", "frame_idx", "timestamp_ms")
    _write_run_folders(frames, f"{root}/frames", "parquet")
    runs = frames.select("run_id").distinct()
    documents = runs.filter("run_id % 3 = 0").unionByName(runs.select((F.col("run_id") + 10**6).alias("run_id")))
    _write_run_folders(documents.select("run_id", F.lit("{}").alias("value")), f"{root}/analysis", "text")
    return su.run_catalogue(rd.run_files(t.spark, root)).select("run_id", "has_document", "files")


@query(
    "agg5_table_counts",
    """SELECT run_id, 'frames' AS name, count(*) AS n FROM b_frames GROUP BY 1 UNION ALL SELECT run_id, 'detections', count(*) FROM b_detections GROUP BY 1
    UNION ALL SELECT run_id, 'captions', count(*) FROM b_captions GROUP BY 1 UNION ALL SELECT run_id, 'audio', count(*) FROM b_audio GROUP BY 1""",
)
def _agg5(t):
    return su.table_counts({"frames": t.frames(), "detections": t.detections(), "captions": t.captions(), "audio": t.audio()})


@query(
    "agg14_stage_costs",
    """SELECT stage, round(sum(elapsed_s)/sum(n_units),6) AS s_per_unit FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY at_ms DESC, event_id DESC) AS rn FROM b_timings)
    WHERE rn<=50 AND n_units>0 GROUP BY 1""",
)
def _agg14(t):
    return su.stage_costs(t.timings()).withColumn("s_per_unit", F.round("s_per_unit", 6))


_RES = "(SELECT event_id AS video, CASE WHEN n_units%3=0 THEN 'skipped' WHEN n_units%5=0 THEN 'error' ELSE 'done' END AS status, elapsed_s FROM b_timings)"


def _results(t):
    n = F.col("n_units")
    status = F.when(n % 3 == 0, "skipped").when(n % 5 == 0, "error").otherwise("done")
    return t.timings().select(F.col("event_id").alias("video"), status.alias("status"), "elapsed_s")


@query(
    "agg15_batch_summary",
    f"""SELECT count(*) AS total_videos, count(*) FILTER (WHERE status='done') AS done, count(*) FILTER (WHERE status='skipped') AS skipped,
    count(*) FILTER (WHERE status='error') AS errors, round(sum(elapsed_s),1) AS total_time_s FROM {_RES}""",
)
def _agg15(t):
    return su.batch_summary(_results(t))


@query(
    "agg16_transcript_stats",
    """SELECT run_id, count(*) AS segments, sum(length(text))::BIGINT AS characters,
    (arg_max(end_ms, start_ms*1000000+segment_id)-arg_min(start_ms, start_ms*1000000+segment_id))/1000.0 AS span_s FROM b_audio GROUP BY 1""",
)
def _agg16(t):
    return su.transcript_stats(t.audio())


_CH = "(SELECT run_id, frame_idx AS chunk_id, CASE WHEN k%4=0 THEN '' ELSE behavior END AS summary, [frame_idx, frame_idx+k] AS fi FROM b_events)"


def _chunks(t):
    idx, k = F.col("frame_idx"), F.col("k")
    return t.events().select(
        "run_id", idx.alias("chunk_id"), F.when(k % 4 == 0, "").otherwise(F.col("behavior")).alias("summary"),
        F.array(idx, idx + k).alias("frame_indices"),
    )


@query(
    "agg17_chunk_health",
    f"SELECT run_id, count(*) AS chunks, count(*) FILTER (WHERE summary<>'') AS described, count(*) FILTER (WHERE summary='') AS empty FROM {_CH} GROUP BY 1",
)
def _agg17(t):
    return su.chunk_health(_chunks(t))


@query(
    "agg17_chunk_spans",
    f"""SELECT c.run_id, c.chunk_id, 2::BIGINT AS frames, coalesce(a.timestamp_ms/1000.0, 0.0) AS first_s, coalesce(b.timestamp_ms/1000.0, 0.0) AS last_s FROM {_CH} c
    LEFT JOIN b_frames a ON a.run_id=c.run_id AND a.frame_idx=fi[1] LEFT JOIN b_frames b ON b.run_id=c.run_id AND b.frame_idx=fi[2]""",
)
def _agg17s(t):
    return su.chunk_spans(_chunks(t), t.frames())


@query(
    "agg25_usage_totals",
    """SELECT run_id, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
    sum(prompt_tokens+completion_tokens)::BIGINT AS total_tokens FROM b_usage GROUP BY 1""",
)
def _agg25(t):
    return su.usage_totals(t.usage())


_ST = "(SELECT run_id, stage, event_id AS seq, n_units AS done, n_units+20 AS total, elapsed_s FROM b_timings)"


def _status(t):
    n = F.col("n_units")
    return t.timings().select("run_id", "stage", F.col("event_id").alias("seq"), n.alias("done"), (n + 20).alias("total"), "elapsed_s")


_LATEST = f"lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY seq DESC) AS rn FROM {_ST}) WHERE rn=1)"


@query("agg23_live_counters", f"WITH {_LATEST} SELECT run_id, stage, seq, done, total FROM lt")
def _agg23(t):
    return su.latest_status(_status(t)).drop("elapsed_s")


@query(
    "agg28_progress",
    f"""WITH {_LATEST} SELECT run_id, stage, round(done/greatest(elapsed_s,0.01),6) AS rate,
    round(greatest(0.0,(total-done)/greatest(done/greatest(elapsed_s,0.01),0.1)),6) AS eta_s FROM lt""",
)
def _agg28(t):
    return su.progress(su.latest_status(_status(t))).withColumns({c: F.round(c, 6) for c in ("rate", "eta_s")})


@query(
    "agg27_reconcile",
    f"""WITH c AS (SELECT f.run_id, f.n AS frames, coalesce(i.n,0) AS images, coalesce(d.n,0) AS depth_rows FROM {_N.format('b_frames')} f
      LEFT JOIN (SELECT run_id, count(*) AS n FROM b_frames WHERE delta_score>=0.2 GROUP BY 1) i USING (run_id)
      LEFT JOIN (SELECT run_id, count(*) AS n FROM b_depth JOIN b_frames USING (run_id, frame_idx) WHERE delta_score>=45 GROUP BY 1) d USING (run_id))
    SELECT run_id, CASE WHEN images<>frames OR depth_rows>0 THEN 'FAIL' ELSE 'PASS' END AS result,
    CASE WHEN images<>frames THEN 'image count mismatch: '||images||' files vs '||frames||' rows' WHEN depth_rows>0 THEN 'depth table should be empty' END AS reason FROM c""",
)
def _agg27(t):
    f = t.frames()
    count = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    runs = (
        count(f, "frames")
        .join(count(f.filter("delta_score >= 0.2"), "images"), "run_id", "left")
        .join(count(t.depth().join(f.filter("delta_score >= 45").select("run_id", "frame_idx"), ["run_id", "frame_idx"]), "depth_rows"), "run_id", "left")
        .fillna(0)
        .withColumn("analyses", F.lit(0))
    )
    return su.reconcile(runs)


_FACTS = """rs AS (SELECT run_id, CASE WHEN run_id%2=0 THEN 'Run '||run_id||' was filmed.' ELSE '' END AS summary, count(*) AS n_chunks FROM b_frames GROUP BY 1),
 fe AS (SELECT run_id, count(*) AS n_entities, string_agg(DISTINCT type, ', ' ORDER BY type) AS entity_types FROM b_entities GROUP BY 1),
 fv AS (SELECT run_id, count(*) AS n_events, string_agg(DISTINCT type, ', ' ORDER BY type) AS event_types FROM b_visual GROUP BY 1),
 fa AS (SELECT run_id, count(*) AS n_audio, count(*) FILTER (WHERE type='speech') AS n_speech FROM b_sounds GROUP BY 1),
 fc AS (SELECT rs.run_id, summary, n_chunks, coalesce(n_entities,0) AS n_entities, entity_types, coalesce(n_events,0) AS n_events, event_types,
   coalesce(n_audio,0) AS n_audio, coalesce(n_speech,0) AS n_speech FROM rs LEFT JOIN fe USING (run_id) LEFT JOIN fv USING (run_id) LEFT JOIN fa USING (run_id))"""


def _facts(t):
    run = F.col("run_id")
    text = F.when(run % 2 == 0, F.concat(F.lit("Run "), run.cast("string"), F.lit(" was filmed."))).otherwise("")
    runs = t.frames().groupBy("run_id").agg(F.count(F.lit(1)).alias("n_chunks")).select("run_id", text.alias("summary"), "n_chunks")
    return su.run_facts(runs, t.entities(), t.visual(), t.sounds())


@query(
    "agg20_five_lines",
    f"""WITH {_FACTS} SELECT run_id, concat_ws(chr(10), CASE WHEN summary<>'' THEN summary ELSE 'Video analysis completed.' END,
    'Entities: '||coalesce(entity_types,'none detected'), 'Events: '||coalesce(event_types,'none recorded'),
    CASE WHEN n_entities>1 THEN 'Multi-entity interaction across '||n_entities||' entities.' WHEN n_entities=1 THEN 'Single entity tracked throughout the video.' ELSE 'No significant spatial or temporal patterns detected.' END,
    CASE WHEN n_speech>0 THEN 'Audio: '||n_speech||' speech segment(s) detected.' WHEN n_audio>0 THEN 'Audio: '||n_audio||' non-speech event(s) detected.' ELSE 'No audio track or audio not transcribed.' END) AS text FROM fc""",
)
def _agg20(t):
    return su.five_lines(_facts(t))


_ASKED = [
    (1, "How many entities are there?"), (2, "what types of events?"), (3, "Summarize the video"), (4, "When was it?"),
    (5, "which actions"), (6, "hello"), (7, "total captions"), (8, "How many audio events"),
]


@query(
    "agg21_answers",
    f"""WITH {_FACTS}, off AS (
      SELECT 1 AS question_id, run_id, '' AS line, 'There are '||n_entities||' entity/entities detected in this run.' AS text FROM fc
      UNION ALL SELECT 2, run_id, '', CASE WHEN n_entities=0 THEN 'No entities were detected in this run.' ELSE 'Entity types detected: '||entity_types||'.' END FROM fc
      UNION ALL SELECT 2, run_id, id, '- **'||id||'** ('||type||'): '||description FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id) AS rn FROM b_entities) WHERE rn<=10
      UNION ALL SELECT 3, run_id, '', CASE WHEN summary='' THEN 'No summary available for this run.' ELSE summary END FROM fc
      UNION ALL SELECT 4, run_id, '', CASE WHEN n_entities=0 THEN 'No entities detected.' ELSE 'Entity timeline:' END FROM fc
      UNION ALL SELECT 4, run_id, id, '- '||id||': first seen '||first_seen||', last seen '||last_seen FROM b_entities
      UNION ALL SELECT 5, run_id, '', CASE WHEN n_events=0 THEN 'No visual events detected.' ELSE 'Detected events:' END FROM fc
      UNION ALL SELECT 5, run_id, lpad(CAST(ev_idx AS VARCHAR),12,'0'), '- ['||start_time||'–'||end_time||'] '||type||': '||description FROM b_visual WHERE ev_idx<15
      UNION ALL SELECT 6, run_id, '', 'Based on the analysis:'||chr(10)||chr(10)||summary||chr(10)||chr(10)||'- Entities: '||n_entities||chr(10)||'- Events: '||n_events||chr(10)||'- Audio events: '||n_audio||chr(10)||chr(10)||'Try asking more specific questions like ''how many entities?'' or ''what types of events?''' FROM fc
      UNION ALL SELECT 7, run_id, '', 'There are '||n_chunks||' VLM caption chunks.' FROM fc
      UNION ALL SELECT 8, run_id, '', 'There are '||n_events||' visual events detected.' FROM fc)
    SELECT question_id, run_id, line, text FROM off""",
)
def _agg21(t):
    asked = t.spark.createDataFrame(_ASKED, "question_id int, question string")
    return su.answers(asked, _facts(t), t.entities(), t.visual())


@query(
    "agg21_answers_of_runs",
    f"""WITH {_FACTS} SELECT run_id*2 AS question_id, run_id, 'There are '||n_entities||' entity/entities detected in this run.' AS text FROM fc WHERE run_id%3=0
    UNION ALL SELECT run_id*2+1, run_id, 'There are '||n_events||' visual events detected.' FROM fc WHERE run_id%3=1""",
)
def _agg21r(t):
    """Questions put to one run each: one about entities, others about events."""
    facts, run = _facts(t), F.col("run_id")
    asked = facts.filter("run_id % 3 < 2").select(
        (run * 2 + run % 3).alias("question_id"), F.when(run % 3 == 0, _ASKED[0][1]).otherwise(_ASKED[-1][1]).alias("question"), "run_id"
    )
    return su.answers(asked, facts, t.entities(), t.visual()).select("question_id", "run_id", "text")


@query(
    "agg22_query_context",
    """SELECT run_id, 'entities' AS section, id AS key, id||' ('||type||'): '||description||' [first_seen='||first_seen||', last_seen='||last_seen||']' AS text FROM b_entities
    UNION ALL SELECT run_id, 'visual', lpad(CAST(ev_idx AS VARCHAR),12,'0'), '['||start_time||'–'||end_time||'] '||type||': '||description FROM b_visual
    UNION ALL SELECT run_id, 'audio', lpad(CAST(ev_idx AS VARCHAR),12,'0'), '['||start_time||'–'||end_time||'] '||type||': '||text FROM b_sounds""",
)
def _agg22(t):
    return su.context_lines(t.entities(), t.visual(), t.sounds())


@query("top16_first_events", "SELECT run_id, ev_idx, description FROM b_visual WHERE ev_idx<15")
def _top16(t):
    from cinetrace.operators.ordering import first_n

    return first_n(t.visual(), ["run_id"], [F.col("ev_idx")], 15).select("run_id", "ev_idx", "description")
