"""Run overviews, totals and text answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.operators.ordering import first_n, first_per_key


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))


def _side_by_side(runs: DataFrame, parts: list[DataFrame], names: list[str]) -> DataFrame:
    for part in parts:
        runs = runs.join(part, "run_id", "left")
    return runs.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per run and table, one shuffle for all tables."""
    union = None
    for name, df in tables.items():
        part = df.select("run_id", F.lit(name).alias("name"))
        union = part if union is None else union.union(part)
    return union.groupBy("run_id", "name").agg(F.count(F.lit(1)).alias("n"))


def overview(frames: DataFrame, **tables: DataFrame) -> DataFrame:
    """Sizes of a run's tables and its span in seconds."""
    span = (F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000.0
    runs = frames.groupBy("run_id").agg(F.count(F.lit(1)).alias("frames"), span.alias("span_s"))
    return _side_by_side(runs, [_count(df, n) for n, df in tables.items()], list(tables))


def gallery(runs: DataFrame, limit: int = 8) -> DataFrame:
    """The newest runs (run_id, finished_ms, sizes)."""
    return runs.orderBy(F.col("finished_ms").desc(), F.col("run_id")).limit(limit)


def newest_runs(files: DataFrame) -> DataFrame:
    """Run catalogue: files (run_id, modified_ms, length) to runs, newest first."""
    runs = files.groupBy("run_id").agg(
        F.max("modified_ms").alias("finished_ms"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
    return runs.orderBy(F.col("finished_ms").desc(), F.col("run_id"))


def run_catalogue(files: DataFrame, store: str = "frames", document: str = "analysis") -> DataFrame:
    """Runs whose folder has a store, newest first: whether they have a document, their files and bytes."""
    of = lambda name: F.max((F.col("table") == name).cast("int"))
    runs = files.groupBy("run_id").agg(
        of(store).alias("stored"),
        (of(document) == 1).alias("has_document"),
        F.max(F.when(F.col("table") == store, F.col("modified_ms"))).alias("finished_ms"),
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
    )
    return runs.filter("stored = 1").drop("stored").orderBy(F.col("finished_ms").desc(), F.col("run_id"))


def stage_costs(timings: DataFrame, last: int = 50) -> DataFrame:
    """Seconds per unit of each stage over its last records."""
    recent = first_n(timings, ["stage"], [F.col("at_ms").desc(), F.col("event_id").desc()], last)
    return (
        recent.filter("n_units > 0")
        .groupBy("stage")
        .agg((F.sum("elapsed_s") / F.sum("n_units")).alias("s_per_unit"))
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts by status and total time of a batch (video, status, elapsed_s)."""
    return results.agg(
        F.count(F.lit(1)).alias("total_videos"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.round(F.sum("elapsed_s"), 1).alias("total_time_s"),
    )


def transcript_stats(segments: DataFrame) -> DataFrame:
    first = F.min_by("start_ms", F.struct("start_ms", "segment_id"))
    last = F.max_by("end_ms", F.struct("start_ms", "segment_id"))
    return segments.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.length("text")).alias("characters"),
        ((last - first) / 1000.0).alias("span_s"),
    )


def chunk_health(chunks: DataFrame) -> DataFrame:
    """Chunks with and without a summary."""
    empty = F.coalesce(F.col("summary"), F.lit("")) == ""
    return chunks.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(~empty).alias("described"), F.count_if(empty).alias("empty")
    )


def chunk_spans(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame count and first/last frame time of each chunk, 0 where the frame is unknown."""
    at = frames.select("run_id", "frame_idx", (F.col("timestamp_ms") / 1000.0).alias("s"))
    first = at.withColumnsRenamed({"frame_idx": "first_frame", "s": "first_s"})
    last = at.withColumnsRenamed({"frame_idx": "last_frame", "s": "last_s"})
    return (
        chunks.select(
            "run_id", "chunk_id",
            F.size("frame_indices").cast("bigint").alias("frames"),
            F.element_at("frame_indices", 1).alias("first_frame"),
            F.element_at("frame_indices", -1).alias("last_frame"),
        )
        .join(first, ["run_id", "first_frame"], "left")
        .join(last, ["run_id", "last_frame"], "left")
        .select(
            "run_id", "chunk_id", "frames",
            F.coalesce("first_s", F.lit(0.0)).alias("first_s"), F.coalesce("last_s", F.lit(0.0)).alias("last_s"),
        )
    )


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def latest_status(events: DataFrame) -> DataFrame:
    """The newest event of every run and stage (run_id, stage, seq, status, done, total)."""
    return first_per_key(events, ["run_id", "stage"], [F.col("seq").desc()])


def progress(latest: DataFrame) -> DataFrame:
    """Rate and remaining seconds from the newest progress row (done, total, elapsed_s)."""
    rate = F.col("done") / F.greatest("elapsed_s", F.lit(0.01))
    eta = (F.col("total") - F.col("done")) / F.greatest(rate, F.lit(0.1))
    return latest.select(
        "run_id", "stage", rate.alias("rate"), F.greatest(F.lit(0.0), eta).alias("eta_s")
    )


def reconcile(runs: DataFrame, expect_depth: bool = False) -> DataFrame:
    """PASS or FAIL with the first broken rule (frames, images, depth_rows, analyses per run)."""
    reason = (
        F.when(F.col("frames") < 1, "frames table is empty")
        .when(
            F.col("images") != F.col("frames"),
            F.format_string("image count mismatch: %d files vs %d rows", "images", "frames"),
        )
        .when(F.col("analyses") > 0, "analysis should not exist")
    )
    reason = (
        reason.when(F.col("depth_rows") < 1, "depth table is empty")
        if expect_depth
        else reason.when(F.col("depth_rows") > 0, "depth table should be empty")
    )
    return runs.select(
        "run_id", F.when(reason.isNull(), "PASS").otherwise("FAIL").alias("result"), reason.alias("reason")
    )


def run_facts(runs: DataFrame, entities: DataFrame, events: DataFrame, audio: DataFrame) -> DataFrame:
    """Counts and type lists per run; ``runs`` has run_id and summary."""
    types = lambda df: df.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types")
    )
    e, v = types(entities), types(events)
    a = audio.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_audio"), F.count_if(F.col("type") == "speech").alias("n_speech")
    )
    return (
        runs.join(e.withColumnsRenamed({"n": "n_entities", "types": "entity_types"}), "run_id", "left")
        .join(v.withColumnsRenamed({"n": "n_events", "types": "event_types"}), "run_id", "left")
        .join(a, "run_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_entities", "n_events", "n_audio", "n_speech")})
    )


def five_lines(facts: DataFrame) -> DataFrame:
    """Five-line run summary from the facts."""
    lines = [
        F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise("Video analysis completed."),
        F.concat(F.lit("Entities: "), F.coalesce("entity_types", F.lit("none detected"))),
        F.concat(F.lit("Events: "), F.coalesce("event_types", F.lit("none recorded"))),
        F.when(F.col("n_entities") > 1, F.format_string("Multi-entity interaction across %d entities.", "n_entities"))
        .when(F.col("n_entities") == 1, "Single entity tracked throughout the video.")
        .otherwise("No significant spatial or temporal patterns detected."),
        F.when(F.col("n_speech") > 0, F.format_string("Audio: %d speech segment(s) detected.", "n_speech"))
        .when(F.col("n_audio") > 0, F.format_string("Audio: %d non-speech event(s) detected.", "n_audio"))
        .otherwise("No audio track or audio not transcribed."),
    ]
    return facts.select("run_id", F.concat_ws("\n", *lines).alias("text"))


def _says(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def intents(questions: DataFrame) -> DataFrame:
    """What each question (question_id, question) asks for, by the first keyword rule that fits."""
    q = F.lower(F.trim("question"))
    counted = (
        F.when(_says(q, "entit"), "count_entities")
        .when(_says(q, "event"), "count_events")
        .when(_says(q, "audio"), "count_audio")
        .when(_says(q, "detect"), "count_detections")
        .when(_says(q, "frame"), "count_frames")
        .when(_says(q, "caption"), "count_captions")
        .otherwise("facts")
    )
    intent = (
        F.when(_says(q, "how many", "count", "total"), counted)
        .when(_says(q, "what type", "types of", "list entity", "who"), "types")
        .when(_says(q, "summarize", "summary", "what happens", "describe"), "summary")
        .when(_says(q, "when", "time", "timestamp", "first", "last"), "times")
        .when(_says(q, "event", "action", "behavior"), "events")
        .otherwise("facts")
    )
    return questions.select("question_id", intent.alias("intent"))


def answers(questions: DataFrame, facts: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Answer lines of every question for every run: question_id, run_id, line, text.

    Each run offers its answer to each intent once; questions pick theirs by an equi-join.  With a
    ``run_id`` a question is put to that run, without one (or with NULL) to every run.
    """
    n = lambda c: F.col(c).cast("string")
    none = F.lit("No summary available for this run.")
    said = F.coalesce("summary", F.lit(""))
    # The answer sentences.
    single = {
        "count_entities": F.concat(F.lit("There are "), n("n_entities"), F.lit(" entity/entities detected in this run.")),
        "count_events": F.concat(F.lit("There are "), n("n_events"), F.lit(" visual events detected.")),
        "count_audio": F.concat(F.lit("There are "), n("n_audio"), F.lit(" audio events detected.")),
        "count_detections": F.lit("See the Overview tab for the total detection count."),
        "count_frames": F.lit("See the Overview tab for the total frame count."),
        "count_captions": F.concat(F.lit("There are "), n("n_chunks"), F.lit(" VLM caption chunks.")),
        "summary": F.when(said == "", none).otherwise(said),
        "types": F.when(F.col("n_entities") == 0, "No entities were detected in this run.").otherwise(
            F.concat(F.lit("Entity types detected: "), "entity_types", F.lit("."))
        ),
        "times": F.when(F.col("n_entities") == 0, "No entities detected.").otherwise("Entity timeline:"),
        "events": F.when(F.col("n_events") == 0, "No visual events detected.").otherwise("Detected events:"),
        "facts": F.concat(
            F.lit("Based on the analysis:\n\n"), said, F.lit("\n\n- Entities: "), n("n_entities"),
            F.lit("\n- Events: "), n("n_events"), F.lit("\n- Audio events: "), n("n_audio"),
            F.lit("\n\nTry asking more specific questions like 'how many entities?' or 'what types of events?'"),
        ),
    }
    heads = facts.select(
        "run_id",
        F.inline(F.array(*[F.struct(F.lit(k).alias("intent"), v.alias("text")) for k, v in single.items()])),
    ).select("run_id", "intent", F.lit("").alias("line"), "text")
    listed = first_n(entities, ["run_id"], [F.col("id")], 10).select(
        "run_id", F.lit("types").alias("intent"), F.col("id").alias("line"),
        F.format_string("- **%s** (%s): %s", "id", "type", "description").alias("text"),
    )
    seen = entities.select(
        "run_id", F.lit("times").alias("intent"), F.col("id").alias("line"),
        F.format_string("- %s: first seen %s, last seen %s", "id", "first_seen", "last_seen").alias("text"),
    )
    happened = first_n(events, ["run_id"], [F.col("ev_idx")], 15).select(
        "run_id", F.lit("events").alias("intent"), F.lpad(F.col("ev_idx").cast("string"), 12, "0").alias("line"),
        F.format_string("- [%s–%s] %s: %s", "start_time", "end_time", "type", "description").alias("text"),
    )
    offers = heads.union(listed).union(seen).union(happened)
    asked = intents(questions)
    if "run_id" not in questions.columns:
        return asked.join(offers, "intent").select("question_id", "run_id", "line", "text")
    asked = asked.join(questions.select("question_id", F.col("run_id").alias("of_run")), "question_id")
    one = asked.filter("of_run IS NOT NULL").join(
        offers, (F.col("of_run") == offers["run_id"]) & (asked["intent"] == offers["intent"])
    )
    every = asked.filter("of_run IS NULL").drop("of_run").join(offers, "intent")
    columns = ["question_id", "run_id", "line", "text"]
    return one.select(*columns).unionByName(every.select(*columns))


def context_lines(entities: DataFrame, events: DataFrame, audio: DataFrame) -> DataFrame:
    """Lines of a run's question context: section, key, text."""
    e = entities.select(
        "run_id", F.lit("entities").alias("section"), F.col("id").alias("key"),
        F.format_string("%s (%s): %s [first_seen=%s, last_seen=%s]", "id", "type", "description", "first_seen", "last_seen").alias("text"),
    )
    v = events.select(
        "run_id", F.lit("visual").alias("section"), F.lpad(F.col("ev_idx").cast("string"), 12, "0").alias("key"),
        F.format_string("[%s–%s] %s: %s", "start_time", "end_time", "type", "description").alias("text"),
    )
    a = audio.select(
        "run_id", F.lit("audio").alias("section"), F.lpad(F.col("ev_idx").cast("string"), 12, "0").alias("key"),
        F.format_string("[%s–%s] %s: %s", "start_time", "end_time", "type", "text").alias("text"),
    )
    return e.union(v).union(a)


