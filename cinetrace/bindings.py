"""Domain tables derived from the sample tables, in Spark and as DuckDB views.

The sample data has no recordings, so orders stand in for frames, line items for
detections, conversations for captions and user events for labels, speech segments,
events and entities.  Each method has a twin of the same meaning in ``VIEWS``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS: dict[str, str] = {
    "b_frames": """
SELECT o_orderkey//100 AS run_id, o_orderkey%100 AS frame_idx, (o_orderkey%100)*1000 + o_custkey%900 AS timestamp_ms,
  'frame_'||lpad(CAST(o_orderkey%100 AS VARCHAR),6,'0')||'.jpg' AS image_path,
  (o_orderstatus='F' AND o_custkey%4=0) AS is_keyframe, o_totalprice/10000.0 AS delta_score FROM orders""",
    "b_detections": """
SELECT l_orderkey//100 AS run_id, l_orderkey%100 AS frame_idx,
  ((((l_orderkey%100)*10+l_linenumber)*200000+l_partkey)*10000+l_suppkey)*100+CAST(l_quantity AS BIGINT) AS detection_id,
  CASE WHEN l_suppkey%5=0 THEN NULL ELSE l_suppkey%6 END AS track_id,
  l_returnflag||l_linestatus AS class_name,
  l_quantity/100.0 AS x1, l_discount*4 AS y1, l_quantity/100.0+0.3 AS x2, l_discount*4+0.4 AS y2,
  1-l_tax*8 AS confidence,
  CASE WHEN l_partkey%3=0 THEN NULL ELSE l_extendedprice/100000.0 END AS mean_depth
FROM lineitem""",
    "b_depth": """
SELECT run_id, frame_idx, 'depth/'||CAST(frame_idx AS VARCHAR)||'.npy' AS depth_path
FROM b_frames WHERE is_keyframe""",
    "b_captions": """
SELECT conv_id AS run_id, turn AS frame_idx, turn*2000 AS timestamp_ms, text AS caption,
  role AS change_line, (length(text)*37 % 101)/10.0 AS delta_score,
  length(text)%3=0 AS escalated,
  CASE WHEN length(text)%2=0 THEN role||' review: '||text END AS verifier_caption,
  CASE WHEN length(text)%2=0 THEN length(text)%5<>0 END AS verifier_agrees,
  turn*2000 + length(text)%700 AS created_ms,
  CASE WHEN length(text)%2=0 THEN turn*2000 + length(text)%700 + (length(text)%50)*100 END AS verified_ms
FROM conversations""",
    "b_events": """
SELECT event_id//64 AS run_id, event_id, event_type AS behavior, value, event_id%64 AS frame_idx,
  (event_id%64)*20000 + (epoch_us(ts)//1000)%15000 AS timestamp_ms,
  CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS k FROM events""",
    "b_labels": """
SELECT run_id, frame_idx, timestamp_ms, behavior, value/500.0 AS confidence,
  CASE WHEN k%7=0 THEN NULL ELSE 'note '||k END AS note,
  CASE WHEN k%2=0 THEN 'default' ELSE 'alt' END AS profile_name FROM b_events""",
    "b_audio": """
SELECT run_id, event_id AS segment_id, timestamp_ms AS start_ms,
  timestamp_ms + CAST(floor(value*100) AS BIGINT) AS end_ms, behavior||' '||k AS text FROM b_events""",
    "b_visual": """
SELECT run_id, frame_idx AS ev_idx, behavior AS type,
  CASE WHEN k%3=0 THEN ['E'||k%7] ELSE ['E'||k%7,'E'||event_id%5] END AS entities,
  lpad(CAST((timestamp_ms//60000)%60 AS VARCHAR),2,'0')||':'||lpad(CAST((timestamp_ms//1000)%60 AS VARCHAR),2,'0') AS start_time,
  lpad(CAST((timestamp_ms//60000)%60 AS VARCHAR),2,'0')||':'||lpad(CAST(least(59,(timestamp_ms//1000)%60+k%20) AS VARCHAR),2,'0') AS end_time,
  behavior||' k'||k AS description, value/500.0 AS confidence FROM b_events""",
    "b_sounds": """
SELECT run_id, frame_idx AS ev_idx, CASE WHEN k%4=0 THEN 'speech' ELSE 'music' END AS type,
  lpad(CAST((timestamp_ms//60000)%60 AS VARCHAR),2,'0')||':'||lpad(CAST((timestamp_ms//1000)%60 AS VARCHAR),2,'0') AS start_time,
  lpad(CAST((timestamp_ms//60000)%60 AS VARCHAR),2,'0')||':'||lpad(CAST(least(59,(timestamp_ms//1000)%60+k%5) AS VARCHAR),2,'0') AS end_time,
  behavior||' '||k AS text, CASE WHEN k%2=0 THEN 'S'||k%3 END AS speaker, value/500.0 AS confidence FROM b_events""",
    "b_entities": """
SELECT run_id, id, CASE id WHEN 'E0' THEN 'person' WHEN 'E1' THEN 'dog' WHEN 'E2' THEN 'cat'
    WHEN 'E3' THEN 'vehicle' ELSE 'object' END AS type,
  min(start_time) AS first_seen, max(end_time) AS last_seen, 'seen '||count(*)||' times' AS description
FROM (SELECT run_id, entities[1] AS id, start_time, end_time FROM b_visual) GROUP BY run_id, id""",
    "b_usage": """
SELECT run_id, frame_idx AS chunk_id, CAST(floor(value*100) AS BIGINT) AS prompt_tokens, k*5 AS completion_tokens,
  1+k%10 AS n_images FROM b_events""",
    "b_timings": """
SELECT event_type AS stage, value AS elapsed_s,
  CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)%12 AS n_units,
  epoch_us(ts)//1000 AS at_ms, event_id, user_id AS run_id FROM events""",
    "b_thumbs": """
SELECT vec_id//50 AS run_id, vec_id%50 AS frame_idx, embedding AS thumb, label=0 AS is_keyframe FROM embeddings""",
    "b_replies": """
SELECT conv_id AS run_id, turn AS unit_id, role AS kind, 'FRAME: '||replace(text,chr(10),' ')||chr(10)
  ||'FRAME_'||turn*3||': at '||turn||chr(10)||'frame '||(turn*3+1)||' - then '||role||chr(10)
  ||'CHANGE: '||role||chr(10)||'SUMMARY: '||role||' '||turn||chr(10)
  ||CASE WHEN turn%3=0 THEN 'NEW_ENTITIES: E'||turn||'=red car '||conv_id%4||', E'||(turn+1)%3||'=brown dog '||turn
      WHEN turn%3=1 THEN 'NEW_ENTITIES: none' ELSE '' END||chr(10)
  ||'VERDICT: '||CASE WHEN turn%3=0 THEN 'DISAGREE' ELSE 'AGREE' END||chr(10)
  ||CASE WHEN turn%4=3 THEN '' ELSE 'CAPTION: '||replace(text,chr(10),' ') END AS text FROM conversations""",
    "b_media": """
SELECT p_partkey AS run_id, p_name AS video, p_retailprice/4.0 AS duration_s, CAST(24+p_size%37 AS DOUBLE) AS fps,
  p_size%2=0 AS has_audio, 640+p_size*16 AS width, 360+p_size*9 AS height FROM part""",
}

_ORDER = list(VIEWS)
_BASE = re.compile(r"\bb_[a-z]+\b")


def oracle(body: str) -> str:
    """Prefix a query with the views it needs, dependencies first."""
    need: set[str] = set()
    todo = [body]
    while todo:
        for name in _BASE.findall(todo.pop()):
            if name in VIEWS and name not in need:
                need.add(name)
                todo.append(VIEWS[name])
    if not need:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in _ORDER if n in need)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _str(c: Column) -> Column:
    return c.cast("string")


def _pad2(c: Column) -> Column:
    return F.lpad(_str(c), 2, "0")


def _div(c: Column, n: int) -> Column:
    return F.floor(c / n)


def clock_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    in_day = (F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000
    return days * 86_400_000 + in_day + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")


class Tables:
    """Domain tables over one directory of sample Parquet files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def frames(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        idx = key % 100
        return self.read("orders").select(
            _div(key, 100).alias("run_id"),
            idx.alias("frame_idx"),
            (idx * 1000 + cust % 900).alias("timestamp_ms"),
            F.concat(F.lit("frame_"), F.lpad(_str(idx), 6, "0"), F.lit(".jpg")).alias("image_path"),
            ((F.col("o_orderstatus") == "F") & (cust % 4 == 0)).alias("is_keyframe"),
            (F.col("o_totalprice") / 10000.0).alias("delta_score"),
        )

    def detections(self) -> DataFrame:
        key = F.col("l_orderkey")
        idx = key % 100
        ident = ((idx * 10 + F.col("l_linenumber")) * 200000 + F.col("l_partkey")) * 10000
        ident = (ident + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("bigint")
        q, d = F.col("l_quantity") / 100.0, F.col("l_discount") * 4
        return self.read("lineitem").select(
            _div(key, 100).alias("run_id"),
            idx.alias("frame_idx"),
            ident.alias("detection_id"),
            F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 6).alias("track_id"),
            F.concat("l_returnflag", "l_linestatus").alias("class_name"),
            q.alias("x1"),
            d.alias("y1"),
            (q + 0.3).alias("x2"),
            (d + 0.4).alias("y2"),
            (1 - F.col("l_tax") * 8).alias("confidence"),
            F.when(F.col("l_partkey") % 3 != 0, F.col("l_extendedprice") / 100000.0).alias("mean_depth"),
        )

    def depth(self) -> DataFrame:
        path = F.concat(F.lit("depth/"), _str(F.col("frame_idx")), F.lit(".npy"))
        return self.frames().filter("is_keyframe").select(
            "run_id", "frame_idx", path.alias("depth_path")
        )

    def captions(self) -> DataFrame:
        n = F.length("text")
        turn = F.col("turn")
        reviewed = n % 2 == 0
        created = turn * 2000 + n % 700
        return self.read("conversations").select(
            F.col("conv_id").alias("run_id"),
            turn.alias("frame_idx"),
            (turn * 2000).alias("timestamp_ms"),
            F.col("text").alias("caption"),
            F.col("role").alias("change_line"),
            ((n * 37 % 101) / 10.0).alias("delta_score"),
            (n % 3 == 0).alias("escalated"),
            F.when(reviewed, F.concat("role", F.lit(" review: "), "text")).alias("verifier_caption"),
            F.when(reviewed, n % 5 != 0).alias("verifier_agrees"),
            created.alias("created_ms"),
            F.when(reviewed, created + (n % 50) * 100).alias("verified_ms"),
        )

    def caption_frames(self) -> DataFrame:
        """The frames that the captions belong to."""
        return self.captions().select("run_id", "frame_idx", "timestamp_ms", "delta_score")

    def events(self) -> DataFrame:
        ident = F.col("event_id")
        idx = ident % 64
        return self.read("events").select(
            _div(ident, 64).alias("run_id"),
            "event_id",
            F.col("event_type").alias("behavior"),
            "value",
            idx.alias("frame_idx"),
            (idx * 20000 + clock_ms(F.col("ts")) % 15000).alias("timestamp_ms"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        )

    def labels(self) -> DataFrame:
        k = F.col("k")
        return self.events().select(
            "run_id",
            "frame_idx",
            "timestamp_ms",
            "behavior",
            (F.col("value") / 500.0).alias("confidence"),
            F.when(k % 7 != 0, F.concat(F.lit("note "), _str(k))).alias("note"),
            F.when(k % 2 == 0, "default").otherwise("alt").alias("profile_name"),
        )

    def audio(self) -> DataFrame:
        start = F.col("timestamp_ms")
        return self.events().select(
            "run_id",
            F.col("event_id").alias("segment_id"),
            start.alias("start_ms"),
            (start + F.floor(F.col("value") * 100)).alias("end_ms"),
            F.concat("behavior", F.lit(" "), _str(F.col("k"))).alias("text"),
        )

    @staticmethod
    def _span(extra: Column) -> list[Column]:
        ms = F.col("timestamp_ms")
        minute = _pad2(_div(ms, 60000) % 60)
        second = _div(ms, 1000) % 60
        return [
            F.concat(minute, F.lit(":"), _pad2(second)).alias("start_time"),
            F.concat(minute, F.lit(":"), _pad2(F.least(F.lit(59), second + extra))).alias("end_time"),
        ]

    def visual(self) -> DataFrame:
        k = F.col("k")
        one = F.concat(F.lit("E"), _str(k % 7))
        two = F.concat(F.lit("E"), _str(F.col("event_id") % 5))
        return self.events().select(
            "run_id",
            F.col("frame_idx").alias("ev_idx"),
            F.col("behavior").alias("type"),
            F.when(k % 3 == 0, F.array(one)).otherwise(F.array(one, two)).alias("entities"),
            *self._span(k % 20),
            F.concat("behavior", F.lit(" k"), _str(k)).alias("description"),
            (F.col("value") / 500.0).alias("confidence"),
        )

    def sounds(self) -> DataFrame:
        k = F.col("k")
        return self.events().select(
            "run_id",
            F.col("frame_idx").alias("ev_idx"),
            F.when(k % 4 == 0, "speech").otherwise("music").alias("type"),
            *self._span(k % 5),
            F.concat("behavior", F.lit(" "), _str(k)).alias("text"),
            F.when(k % 2 == 0, F.concat(F.lit("S"), _str(k % 3))).alias("speaker"),
            (F.col("value") / 500.0).alias("confidence"),
        )

    def entities(self) -> DataFrame:
        kind = F.when(F.col("id") == "E0", "person")
        for name, value in (("E1", "dog"), ("E2", "cat"), ("E3", "vehicle")):
            kind = kind.when(F.col("id") == name, value)
        return (
            self.visual()
            .groupBy("run_id", F.col("entities")[0].alias("id"))
            .agg(
                F.min("start_time").alias("first_seen"),
                F.max("end_time").alias("last_seen"),
                F.concat(F.lit("seen "), _str(F.count(F.lit(1))), F.lit(" times")).alias("description"),
            )
            .select("run_id", "id", kind.otherwise("object").alias("type"), "first_seen", "last_seen", "description")
        )

    def usage(self) -> DataFrame:
        return self.events().select(
            "run_id",
            F.col("frame_idx").alias("chunk_id"),
            F.floor(F.col("value") * 100).alias("prompt_tokens"),
            (F.col("k") * 5).alias("completion_tokens"),
            (F.col("k") % 10 + 1).alias("n_images"),
        )

    def timings(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_type").alias("stage"),
            F.col("value").alias("elapsed_s"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") % 12).alias("n_units"),
            clock_ms(F.col("ts")).alias("at_ms"),
            "event_id",
            F.col("user_id").alias("run_id"),
        )

    def thumbs(self) -> DataFrame:
        v = F.col("vec_id")
        return self.read("embeddings").select(
            _div(v, 50).alias("run_id"),
            (v % 50).alias("frame_idx"),
            F.col("embedding").alias("thumb"),
            (F.col("label") == 0).alias("is_keyframe"),
        )

    def replies(self) -> DataFrame:
        turn, role = F.col("turn"), F.col("role")
        flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
        new = (
            F.when(
                turn % 3 == 0,
                F.concat(
                    F.lit("NEW_ENTITIES: E"), _str(turn), F.lit("=red car "), _str(F.col("conv_id") % 4),
                    F.lit(", E"), _str((turn + 1) % 3), F.lit("=brown dog "), _str(turn),
                ),
            )
            .when(turn % 3 == 1, "NEW_ENTITIES: none")
            .otherwise("")
        )
        lines = [
            F.concat(F.lit("FRAME: "), flat),
            F.concat(F.lit("FRAME_"), _str(turn * 3), F.lit(": at "), _str(turn)),
            F.concat(F.lit("frame "), _str(turn * 3 + 1), F.lit(" - then "), role),
            F.concat(F.lit("CHANGE: "), role),
            F.concat(F.lit("SUMMARY: "), role, F.lit(" "), _str(turn)),
            new,
            F.concat(F.lit("VERDICT: "), F.when(turn % 3 == 0, "DISAGREE").otherwise("AGREE")),
            F.when(turn % 4 == 3, "").otherwise(F.concat(F.lit("CAPTION: "), flat)),
        ]
        return self.read("conversations").select(
            F.col("conv_id").alias("run_id"),
            turn.alias("unit_id"),
            role.alias("kind"),
            F.concat_ws("\n", *lines).alias("text"),
        )

    def media(self) -> DataFrame:
        size = F.col("p_size")
        return self.read("part").select(
            F.col("p_partkey").alias("run_id"),
            F.col("p_name").alias("video"),
            (F.col("p_retailprice") / 4.0).alias("duration_s"),
            (size % 37 + 24).cast("double").alias("fps"),
            (size % 2 == 0).alias("has_audio"),
            (size * 16 + 640).cast("bigint").alias("width"),
            (size * 9 + 360).cast("bigint").alias("height"),
        )
