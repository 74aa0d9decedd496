"""Typed rows from model replies (run_id, unit_id, text), with a quarantine for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinetrace.functions.times import clean_clock

# The behaviours and sounds that are kept as they are.
BEHAVIORS = (
    "approach", "depart", "interact", "follow", "idle", "group", "avoid", "chase", "observe",
    "moving", "walking", "running", "standing", "sitting", "playing", "jumping", "other",
)
SOUNDS = ("speech", "music", "animal_sound", "vehicle", "impact", "environmental", "silence")

UNIT = ["run_id", "unit_id"]


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|\n|\r"), lambda s: F.trim(s))


def _matching(text: Column, pattern: str) -> Column:
    return F.filter(_lines(text), lambda s: s.rlike(pattern))


def _last(text: Column, pattern: str) -> Column:
    """Group 1 of the last matching line."""
    hits = _matching(text, pattern)
    return F.when(F.size(hits) > 0, F.trim(F.regexp_extract(F.element_at(hits, -1), pattern, 1)))


def _first(text: Column, pattern: str) -> Column:
    hits = _matching(text, pattern)
    return F.when(F.size(hits) > 0, F.trim(F.regexp_extract(F.element_at(hits, 1), pattern, 1)))


# Line formats of the replies.
_FRAME = r"(?i)^FRAME[_ ]?(\d+)\s*[:\-]\s*(.+)$"
_SUMMARY = r"(?i)^SUMMARY\s*[:\-]\s*(.+)$"
_NEW = r"(?i)^NEW_ENTITIES\s*[:\-]\s*(.+)$"
_CAPTION_LINE = r"(?i)^FRAME\s*:\s*(.+)$"
_CHANGE_LINE = r"(?i)^CHANGE\s*:\s*(.+)$"


def chunk_frames(replies: DataFrame) -> DataFrame:
    """Frame lines of chunk replies; the last line of a frame counts."""
    line = F.posexplode(_matching(F.col("text"), _FRAME)).alias("at", "line")
    return (
        replies.select(*UNIT, line)
        .select(
            *UNIT, "at",
            F.regexp_extract("line", _FRAME, 1).cast("bigint").alias("frame_idx"),
            F.trim(F.regexp_extract("line", _FRAME, 2)).alias("caption"),
        )
        .groupBy(*UNIT, "frame_idx")
        .agg(F.max_by("caption", "at").alias("caption"))
    )


def chunk_summaries(replies: DataFrame) -> DataFrame:
    return replies.select(*UNIT, F.coalesce(_last(F.col("text"), _SUMMARY), F.lit("")).alias("summary"))


def new_entities(replies: DataFrame) -> DataFrame:
    """Id and description pairs of the first entity line; the last pair of an id counts."""
    raw = _first(F.col("text"), _NEW)
    pair = F.posexplode(F.split("raw", ",")).alias("at", "pair")
    eq = F.instr(F.trim("pair"), "=")
    return (
        replies.select(*UNIT, raw.alias("raw"))
        .filter(F.col("raw").isNotNull() & ~F.lower("raw").isin("none", "n/a", "-", ""))
        .select(*UNIT, pair)
        .filter(eq > 1)
        .select(
            *UNIT, "at",
            F.trim(F.substring_index(F.trim("pair"), "=", 1)).alias("id"),
            F.trim(F.substring(F.trim("pair"), eq + 1, F.length("pair"))).alias("description"),
        )
        .groupBy(*UNIT, "id")
        .agg(F.max_by("description", "at").alias("description"))
    )


def two_lines(replies: DataFrame) -> DataFrame:
    """Caption and change line; without a marker the first line is the caption."""
    text = F.col("text")
    first = F.get(F.filter(_lines(text), lambda s: s != ""), F.lit(0))
    caption = F.coalesce(_last(text, _CAPTION_LINE), first, F.lit("(no caption)"))
    return replies.select(*UNIT, caption.alias("caption"), _last(text, _CHANGE_LINE).alias("change_line"))


def verdicts(replies: DataFrame) -> DataFrame:
    """Whether the reviewer agrees (yes unless the first verdict says otherwise) and its caption."""
    text = F.trim(F.col("text"), F.lit(" \n\r\t"))
    lines = _lines(text)
    verdict = F.lower(F.get(F.filter(lines, lambda s: F.lower(s).contains("verdict:")), F.lit(0)))
    agrees = F.when(verdict.isNull(), True).otherwise(verdict.contains("agree") & ~verdict.contains("disagree"))
    line = F.get(F.filter(lines, lambda s: F.lower(s).contains("caption:")), F.lit(0))
    after = F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    whole = F.when(F.col("whole") == "", "(no caption)").otherwise(F.col("whole"))
    return (
        replies.select(*UNIT, agrees.alias("agrees"), line.alias("line"), text.alias("whole"))
        .withColumn("caption", F.when(F.coalesce(after, F.lit("")) != "", after).otherwise(whole))
        .select(*UNIT, "agrees", "caption")
    )


_LABELS = "array<struct<frame:bigint,behavior:string,confidence:double,note:string>>"


def label_replies(replies: DataFrame) -> DataFrame:
    """Labels from array replies; a missing frame number is taken by position from ``frame_ids``."""
    direct = F.from_json("text", _LABELS)
    inner = F.from_json(F.regexp_extract("text", r"(?s)\[.*\]", 0), _LABELS)
    parsed = F.coalesce(F.when(F.trim("text").startswith("["), direct), inner)
    rows = replies.select(*UNIT, "frame_ids", F.posexplode(parsed).alias("at", "label"))
    by_place = F.coalesce(F.get("frame_ids", F.col("at")), F.element_at("frame_ids", -1))
    return rows.select(
        *UNIT,
        F.coalesce("label.frame", by_place).alias("frame_idx"),
        F.coalesce("label.behavior", F.lit("unknown")).alias("behavior"),
        F.coalesce("label.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("label.note", F.lit("")).alias("note"),
    )


_ONE = "struct<behavior:string,confidence:double,note:string>"


def single_labels(replies: DataFrame) -> DataFrame:
    """One label per reply; unreadable replies are "unknown" with the text as a note."""
    readable = lambda c: F.when(F.from_json(c, "map<string,string>").isNotNull(), F.from_json(c, _ONE))
    inner = F.regexp_extract("text", r"\{[^}]+\}", 0)
    got = F.coalesce(readable(F.col("text")), readable(inner))
    return replies.select(*UNIT, "text", got.alias("g")).select(
        *UNIT,
        F.coalesce("g.behavior", F.lit("unknown")).alias("behavior"),
        F.coalesce("g.confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("g").isNull(), F.concat(F.lit("unparseable: "), F.substring("text", 1, 100)))
        .otherwise(F.coalesce("g.note", F.lit("")))
        .alias("note"),
    )


@F.pandas_udf(T.StringType())
def _balanced(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """First balanced ``{...}`` of each text, found from brace to brace."""

    def cut(text: str | None) -> str | None:
        depth, start = 0, None
        for brace in _BRACES.finditer(text or ""):
            if start is None and brace.group() == "}":
                continue
            start = brace.start() if start is None else start
            depth += 1 if brace.group() == "{" else -1
            if depth == 0:
                return text[start : brace.end()]
        return None

    for batch in texts:
        yield batch.map(cut)


_BRACES = re.compile("[{}]")


def json_text(replies: DataFrame) -> DataFrame:
    """The JSON of analysis replies, repaired; NULL where there is none."""
    opened = replies.withColumn("bare", F.regexp_replace("text", r"(?s)<think>.*?</think>", "")).withColumn("bare", _from_brace())
    # The order of fences and the repairs.
    marked, plain = r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```"
    bare = F.col("bare")
    raw = (
        F.when(bare.rlike(marked), F.regexp_extract(bare, marked, 1))
        .when(bare.rlike(plain), F.regexp_extract(bare, plain, 1))
        .otherwise(_balanced("bare"))
    )
    fixed = F.regexp_replace(raw, r",\s*([}\]])", "$1")
    fixed = F.regexp_replace(F.replace(fixed, F.lit("'"), F.lit('"')), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return opened.select(*UNIT, fixed.alias("json"))


def _from_brace() -> Column:
    """After an unclosed thinking block keep the text from the first brace, else drop the block."""
    open_block = F.col("bare").contains("<think>")
    return (
        F.when(open_block & F.col("bare").contains("{"), F.expr("substring(bare, instr(bare, '{'))"))
        .when(open_block, F.trim(F.regexp_replace("bare", r"<think>.*", "")))
        .otherwise(F.trim("bare", F.lit(" \n\r\t")))
    )


ANALYSIS = (
    "struct<entities:array<struct<id:string,type:string,description:string,first_seen:string,last_seen:string>>,"
    "visual_events:array<struct<type:string,entities:array<string>,start_time:string,end_time:string,"
    "description:string,confidence:double>>,"
    "audio_events:array<struct<type:string,start_time:string,end_time:string,speaker:string,text:string,"
    "label:string,emotion:string,confidence:double>>,"
    "multimodal_correlations:array<struct<visual_event:bigint,audio_event:bigint,visual_idx:bigint,audio_idx:bigint,"
    "description:string>>,summary:string>"
)


def parse_analysis(replies: DataFrame) -> DataFrame:
    """Analysis replies as one struct column ``doc``, with the reason where it is empty."""
    found = json_text(replies)
    readable = F.from_json("json", "map<string,string>").isNotNull()
    doc = F.when(readable, F.from_json("json", ANALYSIS))
    problem = F.when(F.col("json").isNull() | (F.col("json") == ""), "Unable to extract JSON").when(
        ~readable, "JSON parse error"
    )
    return found.select(*UNIT, doc.alias("doc"), problem.alias("problem"))


def _rows(parsed: DataFrame, part: str, required: list[str]) -> DataFrame:
    item = F.posexplode(f"doc.{part}").alias("at", "item")
    rows = parsed.select(*UNIT, item).select(*UNIT, "at", "item.*")
    for column in required:
        rows = rows.filter(F.col(column).isNotNull())
    return rows


def valid_entities(parsed: DataFrame) -> DataFrame:
    rows = _rows(parsed, "entities", ["id", "type", "description"])
    return rows.withColumns({c: F.coalesce(c, F.lit("00:00")) for c in ("first_seen", "last_seen")})


def valid_visual(parsed: DataFrame) -> DataFrame:
    rows = _rows(parsed, "visual_events", ["type", "entities", "start_time", "end_time"])
    return rows.withColumns(
        {
            "type": F.when(F.col("type").isin(*BEHAVIORS), F.col("type")).otherwise("other"),
            "start_time": clean_clock(F.col("start_time")),
            "end_time": clean_clock(F.col("end_time")),
            "description": F.coalesce("description", F.lit("")),
            "confidence": F.coalesce("confidence", F.lit(0.5)),
        }
    )


def valid_audio(parsed: DataFrame) -> DataFrame:
    rows = _rows(parsed, "audio_events", ["type", "start_time", "end_time"])
    return rows.withColumns(
        {
            "type": F.when(F.col("type").isin(*SOUNDS), F.col("type")).otherwise("silence"),
            "start_time": clean_clock(F.col("start_time")),
            "end_time": clean_clock(F.col("end_time")),
            "confidence": F.coalesce("confidence", F.lit(0.5)),
        }
    )


def valid_correlations(parsed: DataFrame) -> DataFrame:
    """Correlated positions; both spellings of the position fields are read."""
    rows = _rows(parsed, "multimodal_correlations", []).select(
        *UNIT, "at",
        F.coalesce("visual_idx", "visual_event").alias("visual_idx"),
        F.coalesce("audio_idx", "audio_event").alias("audio_idx"),
        F.coalesce("description", F.lit("")).alias("description"),
    )
    return rows.filter("visual_idx IS NOT NULL AND audio_idx IS NOT NULL")


def parse_rates(parsed: DataFrame) -> DataFrame:
    """Replies and failures per run."""
    return parsed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("replies"), F.count("problem").alias("failed")
    )
