"""Keyed writes, resume and store readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.schema import CHUNKS, TABLES, TIMINGS, TRANSCRIPT
from cinetrace.sources import export as ex
from cinetrace.sources import keyed as kw
from cinetrace.sources import readers as rd

FR = ["run_id", "frame_idx", "timestamp_ms", "image_path", "is_keyframe", "delta_score"]


def _new_frames(t):
    """Keyframes written again twice, one frame later and with other scores."""
    again = t.frames().filter("is_keyframe").select(*FR)
    first = again.select(*[c for c in FR if c != "delta_score"], F.lit(1.0).alias("delta_score"), F.lit(1).cast("bigint").alias("seq"))
    second = again.select(
        "run_id", (F.col("frame_idx") + 1).alias("frame_idx"), *FR[2:5], F.lit(2.0).alias("delta_score"), F.lit(2).cast("bigint").alias("seq")
    )
    return first.unionByName(second)


@query(
    "snk1_upsert_frames",
    """WITH a AS (SELECT run_id, frame_idx, timestamp_ms, delta_score, -1 AS seq FROM b_frames
      UNION ALL SELECT run_id, frame_idx, timestamp_ms, 1.0, 1 FROM b_frames WHERE is_keyframe
      UNION ALL SELECT run_id, frame_idx+1, timestamp_ms, 2.0, 2 FROM b_frames WHERE is_keyframe)
    SELECT run_id, frame_idx, arg_max(timestamp_ms, seq) AS timestamp_ms, arg_max(delta_score, seq) AS delta_score FROM a GROUP BY 1,2""",
)
def _snk1(t):
    got = kw.upsert(t.frames().select(*FR), _new_frames(t), ["run_id", "frame_idx"])
    return got.select("run_id", "frame_idx", "timestamp_ms", "delta_score")


@query("snk1_write_runs", "SELECT run_id, count(*) AS n, max(frame_idx) AS last FROM b_frames GROUP BY 1")
def _snk1w(t):
    """Write all runs, write them again, and read the store back: each row is there once."""
    path = rd.scratch_dir(t.spark, "frames")
    frames = t.frames().select(*FR)
    kw.write_runs(frames, path, "frame_idx")
    kw.write_runs(frames, path, "frame_idx")
    stored = rd.read_or_empty(t.spark, path, TABLES["frames"])
    return stored.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("frame_idx").alias("last"))


@query(
    "snk2_append_detections",
    """WITH o AS (SELECT run_id, detection_id, frame_idx, class_name FROM b_detections WHERE confidence>=0.75),
    n AS (SELECT run_id, frame_idx, class_name, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx, detection_id) AS rn FROM b_detections WHERE confidence<0.75)
    SELECT * FROM o UNION ALL SELECT n.run_id, coalesce(m.top,0)+rn, frame_idx, class_name FROM n LEFT JOIN (SELECT run_id, max(detection_id) AS top FROM o GROUP BY 1) m USING (run_id)""",
)
def _snk2(t):
    d = t.detections().select("run_id", "detection_id", "frame_idx", "class_name", "confidence")
    old = d.filter("confidence >= 0.75").drop("confidence")
    new = d.filter("confidence < 0.75").withColumnRenamed("detection_id", "batch_pos")
    return kw.append_with_ids(old, new, "detection_id", ["frame_idx", "batch_pos"])


@query(
    "snk3_upsert_depth",
    "SELECT run_id, frame_idx, CASE WHEN delta_score>=20 THEN 'new/'||frame_idx ELSE 'depth/'||frame_idx||'.npy' END AS depth_path FROM b_frames WHERE is_keyframe OR delta_score>=20",
)
def _snk3(t):
    new = t.frames().filter("delta_score >= 20").select(
        "run_id", "frame_idx", F.concat(F.lit("new/"), F.col("frame_idx").cast("string")).alias("depth_path"), F.lit(1).cast("bigint").alias("seq")
    )
    return kw.upsert(t.depth(), new, ["run_id", "frame_idx"])


@query(
    "snk4_append_segments",
    """SELECT run_id, segment_id, start_ms, text FROM b_audio UNION ALL SELECT v.run_id, m.top + row_number() OVER (PARTITION BY v.run_id ORDER BY ev_idx), ev_idx*1000, description
    FROM b_visual v JOIN (SELECT run_id, max(segment_id) AS top FROM b_audio GROUP BY 1) m USING (run_id)""",
)
def _snk4(t):
    old = t.audio().select("run_id", "segment_id", "start_ms", "text")
    new = t.visual().select("run_id", "ev_idx", (F.col("ev_idx") * 1000).alias("start_ms"), F.col("description").alias("text"))
    return kw.append_with_ids(old, new, "segment_id", ["ev_idx"])


@query(
    "snk5_replace_caption",
    """SELECT run_id, frame_idx, CASE WHEN escalated THEN 'again' ELSE caption END AS caption, CASE WHEN escalated THEN NULL ELSE verifier_agrees END AS verifier_agrees FROM b_captions""",
)
def _snk5(t):
    c = t.captions()
    new = c.filter("escalated").select("run_id", "frame_idx", F.lit("again").alias("caption"), F.lit(1).cast("bigint").alias("seq"))
    return kw.replace_caption(c, new).select("run_id", "frame_idx", "caption", "verifier_agrees")


@query(
    "snk6_update_columns",
    """SELECT run_id, frame_idx, CASE WHEN escalated THEN NULL ELSE change_line END AS change_line, CASE WHEN escalated THEN true ELSE verifier_agrees END AS verifier_agrees FROM b_captions""",
)
def _snk6(t):
    c = t.captions()
    keys = ["run_id", "frame_idx"]
    updates = c.filter("escalated").select(*keys, F.lit(None).cast("string").alias("change_line"), F.lit(True).alias("verifier_agrees"))
    unknown = t.frames().select((F.col("run_id") + 10**9).alias("run_id"), "frame_idx", F.lit("x").alias("change_line"), F.lit(False).alias("verifier_agrees"))
    return kw.update_columns(c, updates.union(unknown), keys).select(*keys, "change_line", "verifier_agrees")


_LEDGER = "lg AS (SELECT run_id, stage AS stage_name, arg_max(elapsed_s, event_id) AS elapsed_s, arg_max(n_units, event_id) AS n_units FROM b_timings GROUP BY 1,2)"


def _ledger(t):
    rows = t.timings().select("run_id", F.col("stage").alias("stage_name"), "elapsed_s", "n_units", F.col("event_id").alias("seq"))
    return kw.upsert(rows.drop("seq").filter("false"), rows, ["run_id", "stage_name"])


@query("snk7_stage_ledger", f"WITH {_LEDGER} SELECT * FROM lg")
def _snk7(t):
    return _ledger(t)


@query("snk7_complete_runs", f"WITH {_LEDGER} SELECT DISTINCT o_custkey AS run_id FROM orders WHERE o_custkey IN (SELECT run_id FROM lg WHERE stage_name='purchase')")
def _snk7c(t):
    runs = t.read("orders").select(F.col("o_custkey").alias("run_id")).distinct()
    return kw.complete_runs(runs, _ledger(t), "purchase")


@query("snk7_clear_stages", f"WITH {_LEDGER} SELECT * FROM lg WHERE run_id NOT IN (SELECT run_id FROM lg WHERE stage_name='error' AND n_units=0)")
def _snk7x(t):
    led = _ledger(t)
    return kw.clear_stages(led, led.filter("stage_name = 'error' AND n_units = 0"))


@query(
    "snk8_run_meta",
    """SELECT run_id, stage AS key, arg_max(CASE WHEN n_units=0 THEN '' ELSE CAST(n_units AS VARCHAR) END, event_id) AS value FROM b_timings GROUP BY 1,2
    HAVING arg_max(n_units, event_id)<>0""",
)
def _snk8(t):
    n = F.col("n_units")
    rows = t.timings().select("run_id", F.col("stage").alias("key"), F.when(n != 0, n.cast("string")).alias("value"), F.col("event_id").alias("seq"))
    return kw.set_meta(rows.drop("seq").filter("false"), rows)


_NEW_LABELS = "nl AS (SELECT run_id, frame_idx, 'redone' AS behavior, 'alt' AS profile_name FROM b_labels WHERE behavior='click')"


def _new_labels(t):
    return t.labels().filter("behavior = 'click'").select("run_id", "frame_idx", F.lit("redone").alias("behavior"), F.lit("alt").alias("profile_name"))


@query(
    "snk9_replace_profiles",
    f"""WITH {_NEW_LABELS} SELECT run_id, frame_idx, behavior, profile_name FROM b_labels l WHERE NOT EXISTS (SELECT 1 FROM nl WHERE nl.run_id=l.run_id AND nl.profile_name=l.profile_name)
    UNION ALL SELECT * FROM nl""",
)
def _snk9(t):
    return kw.replace_profiles(t.labels().select("run_id", "frame_idx", "behavior", "profile_name"), _new_labels(t))


@query(
    "snk9_cleared_profiles",
    "SELECT run_id, profile_name, count(*) AS removed FROM b_labels WHERE profile_name='alt' GROUP BY 1,2",
)
def _snk9c(t):
    labels = t.labels()
    return kw.cleared_profiles(labels, labels.filter("profile_name = 'alt'").select("run_id", "profile_name").distinct())


@query("jon11_open_stages", f"WITH {_LEDGER}, al AS (SELECT DISTINCT r.run_id, s.stage AS stage_name FROM (SELECT DISTINCT run_id FROM b_timings) r, (SELECT DISTINCT stage FROM b_timings) s) SELECT * FROM al ANTI JOIN (SELECT * FROM lg WHERE n_units>0) d USING (run_id, stage_name)")
def _jon11s(t):
    led = _ledger(t)
    stages = [r[0] for r in led.select("stage_name").distinct().collect()]  # the vocabulary of stages
    wanted = led.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage_name"))
    return wanted.join(led.filter("n_units > 0"), ["run_id", "stage_name"], "left_anti")


# --- stores in folders by run and key range ----------------------------------------------


def _stored(t, name, keys, order, old, new):
    """A store that is written whole, then gets the new rows in two upserts; its rows."""
    store = kw.KeyedStore(t.spark, rd.scratch_dir(t.spark, name), keys, order, rows=32)
    store.upsert(old.withColumn("seq", F.lit(0).cast("bigint")), old)
    for k in (0, 1):
        store.upsert(new.filter(F.pmod("run_id", F.lit(2)) == k), old)
    return store.read(old)


@query(
    "snk1_store",
    """WITH a AS (SELECT run_id, frame_idx, timestamp_ms, delta_score, -1 AS seq FROM b_frames
      UNION ALL SELECT run_id, frame_idx, timestamp_ms, 1.0, 1 FROM b_frames WHERE is_keyframe
      UNION ALL SELECT run_id, frame_idx+1, timestamp_ms, 2.0, 2 FROM b_frames WHERE is_keyframe)
    SELECT run_id, frame_idx, arg_max(timestamp_ms, seq) AS timestamp_ms, arg_max(delta_score, seq) AS delta_score FROM a GROUP BY 1,2""",
)
def _snk1t(t):
    got = _stored(t, "frame-store", ["run_id", "frame_idx"], "frame_idx", t.frames().select(*FR), _new_frames(t))
    return got.select("run_id", "frame_idx", "timestamp_ms", "delta_score")


@query(
    "snk3_store",
    "SELECT run_id, frame_idx, CASE WHEN delta_score>=20 THEN 'new/'||frame_idx ELSE 'depth/'||frame_idx||'.npy' END AS depth_path FROM b_frames WHERE is_keyframe OR delta_score>=20",
)
def _snk3t(t):
    new = t.frames().filter("delta_score >= 20").select(
        "run_id", "frame_idx", F.concat(F.lit("new/"), F.col("frame_idx").cast("string")).alias("depth_path"), F.lit(1).cast("bigint").alias("seq")
    )
    return _stored(t, "depth-store", ["run_id", "frame_idx"], "frame_idx", t.depth(), new)


@query(
    "snk5_store",
    """SELECT run_id, frame_idx, CASE WHEN escalated THEN 'again' ELSE caption END AS caption, CASE WHEN escalated THEN NULL ELSE verifier_agrees END AS verifier_agrees FROM b_captions""",
)
def _snk5t(t):
    """A caption written again replaces the whole row, its verdict too."""
    c = t.captions()
    new = c.filter("escalated").select("run_id", "frame_idx", F.lit("again").alias("caption"), F.lit(1).cast("bigint").alias("seq"))
    for field in c.schema.fields:
        if field.name not in new.columns:
            new = new.withColumn(field.name, F.lit(None).cast(field.dataType))
    return _stored(t, "caption-store", ["run_id", "frame_idx"], "frame_idx", c, new).select("run_id", "frame_idx", "caption", "verifier_agrees")


@query("snk7_store", f"WITH {_LEDGER} SELECT * FROM lg")
def _snk7t(t):
    """Stages in the order they finish, a third of all runs at a time."""
    rows = t.timings().select("run_id", F.col("stage").alias("stage_name"), "elapsed_s", "n_units", F.col("event_id").alias("seq"))
    like = rows.drop("seq")
    store = kw.KeyedStore(t.spark, rd.scratch_dir(t.spark, "ledger-store"), ["run_id", "stage_name"])
    for k in range(3):
        store.upsert(rows.filter(F.pmod("run_id", F.lit(3)) == k), like)
    return store.read(like)


@query(
    "snk8_store",
    """SELECT run_id, stage AS key, arg_max(CASE WHEN n_units=0 THEN '' ELSE CAST(n_units AS VARCHAR) END, event_id) AS value FROM b_timings GROUP BY 1,2
    HAVING arg_max(n_units, event_id)<>0""",
)
def _snk8t(t):
    """Set once with a value for every key, then with the true ones, among which NULL deletes."""
    n = F.col("n_units")
    rows = t.timings().select("run_id", F.col("stage").alias("key"), F.when(n != 0, n.cast("string")).alias("value"), F.col("event_id").alias("seq"))
    like = rows.drop("seq")
    store = kw.KeyedStore(t.spark, rd.scratch_dir(t.spark, "meta-store"), ["run_id", "key"])
    store.set_values(rows.withColumn("value", F.lit("first")), like)
    store.set_values(rows, like)
    return store.read(like)


# --- readers ---------------------------------------------------------------------------


def _transcripts(t):
    """Documents of both layouts, written as JSON with broken lines between them, and read back."""
    path = rd.scratch_dir(t.spark, "transcripts")
    ex.write_json(ex.transcript_documents(t.audio()), path)
    turn = F.col("turn")
    other = t.read("conversations").select(
        F.col("conv_id").alias("run_id"),
        F.array(F.struct((turn + 0.5).alias("start"), (turn + 2.25).alias("end"), F.concat(F.lit(" "), "text").alias("text"))).alias("segments"),
    )
    ex.write_json(other, path, "append")
    broken = t.frames().filter("frame_idx = 0").select(F.format_string('{"run_id": %d, "segments": [', "run_id").alias("value"))
    broken.write.mode("append").text(path)
    return rd.read_documents(t.spark, path, TRANSCRIPT)


@query("src4_transcripts", "SELECT run_id, start_ms, end_ms, trim(text) AS text FROM b_audio UNION ALL SELECT conv_id, turn*1000+500, turn*1000+2250, trim(text) FROM conversations")
def _src4(t):
    return rd.transcript_segments(_transcripts(t)[0]).drop("at")


@query("src4_quarantine", """SELECT '{"run_id": '||run_id||', "segments": [' AS line FROM b_frames WHERE frame_idx=0""")
def _src4q(t):
    return _transcripts(t)[1]


@query("snk15_transcript_sidecar", "SELECT run_id, segment_id, start_ms, end_ms, text FROM b_audio")
def _snk15(t):
    path = rd.scratch_dir(t.spark, "sidecar")
    ex.write_json(ex.transcript_documents(t.audio()), path)
    docs = rd.read_json(t.spark, path, TRANSCRIPT.replace("run_id bigint", "run_id bigint, segment_id bigint"))
    return docs.select(
        "run_id", "segment_id", F.col("transcription")[0]["offsets"]["from"].alias("start_ms"),
        F.col("transcription")[0]["offsets"]["to"].alias("end_ms"), F.col("transcription")[0]["text"].alias("text"),
    )


def _chunk_docs(t):
    idx, k = F.col("frame_idx"), F.col("k")
    return t.events().select(
        "run_id", idx.alias("chunk_id"), F.array(idx, idx + 1).alias("frame_indices"),
        F.create_map(idx, F.when(k % 5 == 0, "(No change) ").otherwise(F.concat("behavior", F.lit(" "), k.cast("string")))).alias("per_frame_lines"),
        F.when(k % 4 == 0, "").otherwise(F.col("behavior")).alias("summary"), F.lit("raw").alias("raw_response"),
    )


_LINES = "(SELECT run_id, frame_idx, frame_idx AS chunk_id, CASE WHEN k%5=0 THEN '(No change) ' ELSE behavior||' '||k END AS line, k, behavior FROM b_events)"


@query("src6_chunk_documents", f"SELECT run_id, chunk_id, frame_idx, line FROM {_LINES}")
def _src6(t):
    path = rd.scratch_dir(t.spark, "chunks")
    ex.write_json(ex.chunk_documents(_chunk_docs(t)), path)
    docs = rd.chunk_documents(rd.read_json(t.spark, path, CHUNKS))
    return docs.select("run_id", "chunk_id", F.explode("per_frame_lines").alias("frame_idx", "line"))


def _analyses(t):
    """Documents of two places: in the first every third run is readable, in the second all are."""
    path, run = rd.scratch_dir(t.spark, "analyses"), F.col("run_id")
    runs = t.frames().select("run_id").distinct()
    document = lambda text: F.to_json(F.struct("run_id", F.struct(F.lit(text).alias("summary")).alias("doc")))
    broken = F.format_string("{broken %d", run)
    runs.select(F.when(run % 3 == 0, document("main")).otherwise(broken).alias("value")).write.text(f"{path}/main")
    runs.select(document("other").alias("value")).write.text(f"{path}/other")
    return [rd.read_documents(t.spark, f"{path}/{p}", "run_id bigint, doc struct<summary:string>") for p in ("main", "other")]


@query(
    "src5_analysis_fallback",
    """SELECT run_id, CASE WHEN run_id%3=0 THEN 'main' ELSE 'other' END AS summary FROM (SELECT DISTINCT run_id FROM b_frames)""",
)
def _src5(t):
    (main, _), (other, _) = _analyses(t)
    return rd.with_fallback(main, other).select("run_id", F.col("doc.summary").alias("summary"))


@query("src5_quarantine", "SELECT DISTINCT '{broken '||run_id AS line FROM b_frames WHERE run_id%3<>0")
def _src5q(t):
    return _analyses(t)[0][1]


@query("src7_schema_evolution", "SELECT run_id, frame_idx, caption, CAST(NULL AS VARCHAR) AS prompt FROM b_captions UNION ALL SELECT run_id, frame_idx, caption, 'p' FROM b_captions")
def _src7(t):
    """Files of an older and a newer shape in one folder."""
    path = rd.scratch_dir(t.spark, "captions")
    old = t.captions().select("run_id", "frame_idx", "caption")
    old.write.parquet(path)
    old.withColumn("prompt", F.lit("p")).write.mode("append").parquet(path)
    return rd.read_or_empty(t.spark, path, TABLES["frame_captions"]).select("run_id", "frame_idx", "caption", "prompt")


@query("src7_missing_table", "SELECT f.run_id, f.frame_idx, CAST(NULL AS VARCHAR) AS depth_path FROM b_frames f")
def _src7m(t):
    none = rd.read_or_empty(t.spark, rd.scratch_dir(t.spark, "absent"), TABLES["depth_frames"])
    return t.frames().select("run_id", "frame_idx").join(none, ["run_id", "frame_idx"], "left")


@query("src9_timing_log", "SELECT run_id, stage, count(*) AS n, sum(n_units)::BIGINT AS units FROM b_timings GROUP BY 1,2")
def _src9(t):
    log = _written_log(t)
    return log.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("n_units").alias("units"))


def _written_log(t):
    path = rd.scratch_dir(t.spark, "timings")
    rows = t.timings().select("run_id", "stage", "elapsed_s", "n_units")
    ex.write_json(rows.filter("stage = 'view'"), path, "append")
    ex.write_json(rows.filter("stage <> 'view'"), path, "append")
    return rd.read_json(t.spark, path, TIMINGS)


@query("snk16_append_timings", "SELECT stage, count(*) AS n, round(sum(elapsed_s),4) AS elapsed_s FROM b_timings GROUP BY 1")
def _snk16(t):
    return _written_log(t).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("elapsed_s"), 4).alias("elapsed_s"))


@query("jon5_exported_lines", f"SELECT l.run_id, l.frame_idx, l.line AS caption, f.image_path FROM {_LINES} l JOIN b_frames f USING (run_id, frame_idx) WHERE lower(trim(line))<>'(no change)'")
def _jon5(t):
    return ex.frame_captions(_chunk_docs(t), t.frames()).select("run_id", "frame_idx", "caption", "image_path")


@query("jon5_displayed_lines", f"SELECT l.run_id, l.chunk_id, l.frame_idx, l.line, coalesce(f.timestamp_ms,0) AS timestamp_ms FROM {_LINES} l LEFT JOIN b_frames f USING (run_id, frame_idx)")
def _jon5d(t):
    return ex.chunk_lines(_chunk_docs(t), t.frames())


@query("src9_timing_rows", "SELECT run_id, stage, elapsed_s, n_units FROM b_timings")
def _src9r(t):
    return _written_log(t).select("run_id", "stage", "elapsed_s", "n_units")
