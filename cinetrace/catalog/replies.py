"""Model replies to typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.functions import times
from cinetrace.operators import replies as rp

_L = """ln AS (SELECT run_id, unit_id, nr, trim(l[nr]) AS line, text FROM (SELECT *, unnest(range(1, len(l)+1)) AS nr
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM b_replies)))"""


@query(
    "par3_chunk_frames",
    f"""WITH {_L} SELECT run_id, unit_id, CAST(regexp_extract(line, '(?i)^FRAME[_ ]?([0-9]+)\\s*[:-]\\s*(.+)$', 1) AS BIGINT) AS frame_idx,
    arg_max(trim(regexp_extract(line, '(?i)^FRAME[_ ]?([0-9]+)\\s*[:-]\\s*(.+)$', 2)), nr) AS caption FROM ln
    WHERE regexp_matches(line, '(?i)^FRAME[_ ]?([0-9]+)\\s*[:-]\\s*(.+)$') GROUP BY 1,2,3""",
)
def _par3(t):
    return rp.chunk_frames(t.replies())


@query(
    "par3_chunk_summaries",
    f"""WITH {_L} SELECT run_id, unit_id, coalesce(arg_max(trim(regexp_extract(line, '(?i)^SUMMARY\\s*[:-]\\s*(.+)$', 1)), nr) FILTER (WHERE regexp_matches(line, '(?i)^SUMMARY\\s*[:-]\\s*(.+)$')), '') AS summary
    FROM ln GROUP BY 1,2""",
)
def _par3s(t):
    return rp.chunk_summaries(t.replies())


@query(
    "par4_new_entities",
    f"""WITH {_L}, f AS (SELECT run_id, unit_id, arg_min(trim(regexp_extract(line, '^NEW_ENTITIES: (.+)$', 1)), nr) AS raw FROM ln WHERE line LIKE 'NEW_ENTITIES: %' GROUP BY 1,2),
    p AS (SELECT run_id, unit_id, trim(unnest(string_split(raw, ','))) AS pair, generate_subscripts(string_split(raw, ','),1) AS nr FROM f WHERE lower(raw) NOT IN ('none','n/a','-',''))
    SELECT run_id, unit_id, trim(split_part(pair,'=',1)) AS id, arg_max(trim(substr(pair, instr(pair,'=')+1)), nr) AS description FROM p WHERE instr(pair,'=')>1 GROUP BY 1,2,3""",
)
def _par4(t):
    return rp.new_entities(t.replies())


@query(
    "par5_two_lines",
    f"""WITH {_L} SELECT run_id, unit_id, coalesce(arg_max(trim(substr(line,7)), nr) FILTER (WHERE line LIKE 'FRAME: %'), '(no caption)') AS caption,
    arg_max(trim(substr(line,8)), nr) FILTER (WHERE line LIKE 'CHANGE: %') AS change_line FROM ln GROUP BY 1,2""",
)
def _par5(t):
    return rp.two_lines(t.replies())


@query(
    "par6_verdicts",
    f"""WITH {_L}, v AS (SELECT run_id, unit_id, any_value(text) AS text, arg_min(lower(line), nr) FILTER (WHERE lower(line) LIKE '%verdict:%') AS vl,
      arg_min(line, nr) FILTER (WHERE lower(line) LIKE '%caption:%') AS cl FROM ln GROUP BY 1,2)
    SELECT run_id, unit_id, coalesce(vl LIKE '%agree%' AND vl NOT LIKE '%disagree%', true) AS agrees,
    CASE WHEN cl IS NOT NULL AND trim(substr(cl, instr(cl,':')+1))<>'' THEN trim(substr(cl, instr(cl,':')+1)) ELSE trim(text, chr(10)||' ') END AS caption FROM v""",
)
def _par6(t):
    return rp.verdicts(t.replies())


_LABEL_REPLY = """lr AS (SELECT run_id, frame_idx AS unit_id, frame_idx, behavior, value, k FROM b_events)"""


def _label_replies(t):
    """Array replies of two labels: the second has no frame number and no confidence."""
    e = t.events()
    text = F.concat(
        F.lit('Sure: [{"frame": '), F.col("frame_idx").cast("string"), F.lit(', "behavior": "'), "behavior",
        F.lit('", "confidence": 0.5, "note": "k'), F.col("k").cast("string"), F.lit('"}, {"behavior": "idle"}]'),
    )
    return e.select(
        "run_id", F.col("frame_idx").alias("unit_id"), text.alias("text"),
        F.array(F.col("frame_idx"), F.col("frame_idx") + 100).alias("frame_ids"),
    )


@query(
    "par7_label_replies",
    f"""WITH {_LABEL_REPLY} SELECT run_id, unit_id, frame_idx, behavior, 0.5 AS confidence, 'k'||k AS note FROM lr
    UNION ALL SELECT run_id, unit_id, frame_idx+100, 'idle', 0.0, '' FROM lr""",
)
def _par7(t):
    return rp.label_replies(_label_replies(t))


@query(
    "par7_single_labels",
    """SELECT run_id, frame_idx AS unit_id, CASE WHEN k%4=0 THEN 'unknown' ELSE behavior END AS behavior, CASE WHEN k%4=0 THEN 0.0 ELSE 0.25 END AS confidence,
    CASE WHEN k%4=0 THEN 'unparseable: nothing '||k ELSE '' END AS note FROM b_events""",
)
def _par7s(t):
    k = F.col("k")
    good = F.concat(F.lit('It is {"behavior": "'), "behavior", F.lit('", "confidence": 0.25}'))
    text = F.when(k % 4 == 0, F.concat(F.lit("nothing "), k.cast("string"))).otherwise(good)
    return rp.single_labels(t.events().select("run_id", F.col("frame_idx").alias("unit_id"), text.alias("text")))


def _analysis_replies(t):
    """Replies of several shapes: thinking, fences, single quotes, trailing commas, prose, cut off."""
    k = F.col("k")
    k_text, idx = k.cast("string"), F.col("frame_idx").cast("string")
    body = F.concat(
        F.lit('{"entities": [{"id": "E'), k_text, F.lit('", "type": "dog", "description": "d"}, {"id": "x"}], "visual_events": [{"type": "'),
        F.when(k % 2 == 0, "walking").otherwise(F.col("behavior")),
        F.lit('", "entities": ["E1"], "start_time": "'), idx, F.lit('", "end_time": "1:'), idx,
        F.lit('.5s"}], "audio_events": [{"type": "'), F.when(k % 3 == 0, "speech").otherwise("hum"),
        F.lit('", "start_time": "0:3", "end_time": "00:04", "text": "hi"}], "multimodal_correlations": [{"visual_idx": 0, "audio_event": 0}], "summary": "s'),
        k_text, F.lit('",}'),
    )
    shape = k % 6
    text = (
        F.when(shape == 0, F.concat(F.lit("<think>{ maybe }</think>\n"), body))
        .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, F.replace(body, F.lit('"'), F.lit("'")))
        .when(shape == 3, F.concat(F.lit("The answer is "), body, F.lit(" as asked.")))
        .when(shape == 4, F.concat(F.lit("nothing to see "), k_text))
        .otherwise(F.concat(F.lit('{"entities": ['), k_text))
    )
    return t.events().select("run_id", F.col("frame_idx").alias("unit_id"), text.alias("text"))


@query(
    "par1_recover_json",
    """SELECT run_id, frame_idx AS unit_id, CASE WHEN k%6 NOT IN (4,5) THEN
      '{"entities": [{"id": "E'||k||'", "type": "dog", "description": "d"}, {"id": "x"}], "visual_events": [{"type": "'
      ||CASE WHEN k%2=0 THEN 'walking' ELSE behavior END||'", "entities": ["E1"], "start_time": "'||frame_idx||'", "end_time": "1:'||frame_idx
      ||'.5s"}], "audio_events": [{"type": "'||CASE WHEN k%3=0 THEN 'speech' ELSE 'hum' END
      ||'", "start_time": "0:3", "end_time": "00:04", "text": "hi"}], "multimodal_correlations": [{"visual_idx": 0, "audio_event": 0}], "summary": "s'||k||'"}' END AS json FROM b_events""",
)
def _par1(t):
    return rp.json_text(_analysis_replies(t))


@query(
    "par1_parse_problems",
    """SELECT run_id, frame_idx AS unit_id, CASE WHEN k%6 IN (4,5) THEN 'Unable to extract JSON' END AS problem FROM b_events""",
)
def _par1p(t):
    return rp.parse_analysis(_analysis_replies(t)).select("run_id", "unit_id", "problem")


@query(
    "par1_parse_rates",
    "SELECT run_id, count(*) AS replies, count(*) FILTER (WHERE k%6 IN (4,5)) AS failed FROM b_events GROUP BY 1",
)
def _par1r(t):
    return rp.parse_rates(rp.parse_analysis(_analysis_replies(t)))


@query(
    "par2_valid_entities",
    "SELECT run_id, frame_idx AS unit_id, 'E'||k AS id, 'dog' AS type, '00:00' AS first_seen FROM b_events WHERE k%6 NOT IN (4,5)",
)
def _par2e(t):
    return rp.valid_entities(rp.parse_analysis(_analysis_replies(t))).select("run_id", "unit_id", "id", "type", "first_seen")


@query(
    "par2_valid_visual",
    """SELECT run_id, frame_idx AS unit_id, CASE WHEN k%2=0 THEN 'walking' ELSE 'other' END AS type, '00:'||lpad(CAST(frame_idx AS VARCHAR),2,'0') AS start_time,
    '01:'||lpad(CAST(frame_idx AS VARCHAR),2,'0') AS end_time, 0.5::DOUBLE AS confidence FROM b_events WHERE k%6 NOT IN (4,5)""",
)
def _par2v(t):
    return rp.valid_visual(rp.parse_analysis(_analysis_replies(t))).select("run_id", "unit_id", "type", "start_time", "end_time", "confidence")


@query(
    "par2_valid_audio",
    """SELECT run_id, frame_idx AS unit_id, CASE WHEN k%3=0 THEN 'speech' ELSE 'silence' END AS type, '00:03' AS start_time, 'hi' AS text FROM b_events WHERE k%6 NOT IN (4,5)""",
)
def _par2a(t):
    return rp.valid_audio(rp.parse_analysis(_analysis_replies(t))).select("run_id", "unit_id", "type", "start_time", "text")


@query(
    "par2_valid_correlations",
    "SELECT run_id, frame_idx AS unit_id, 0::BIGINT AS visual_idx, 0::BIGINT AS audio_idx FROM b_events WHERE k%6 NOT IN (4,5)",
)
def _par2c(t):
    return rp.valid_correlations(rp.parse_analysis(_analysis_replies(t))).select("run_id", "unit_id", "visual_idx", "audio_idx")


# --- time texts -------------------------------------------------------------------------

_TS = """tx AS (SELECT run_id, ev_idx, start_time AS a, CASE ev_idx%5 WHEN 0 THEN '1:'||start_time WHEN 1 THEN CAST(ev_idx AS VARCHAR)||'.5' WHEN 2 THEN 'x'||ev_idx
   WHEN 3 THEN ev_idx||':7.25s' ELSE end_time END AS b FROM b_visual)"""


def _times(t):
    idx = F.col("ev_idx")
    s = idx.cast("string")
    other = (
        F.when(idx % 5 == 0, F.concat(F.lit("1:"), "start_time"))
        .when(idx % 5 == 1, F.concat(s, F.lit(".5")))
        .when(idx % 5 == 2, F.concat(F.lit("x"), s))
        .when(idx % 5 == 3, F.concat(s, F.lit(":7.25s")))
        .otherwise(F.col("end_time"))
    )
    return t.visual().select("run_id", "ev_idx", F.col("start_time").alias("a"), other.alias("b"))


_MMSS = "(CAST(split_part({0},':',1) AS BIGINT)*60+CAST(split_part({0},':',2) AS BIGINT))*1000"


@query("fn1_mmss_to_ms", f"WITH {_TS} SELECT run_id, ev_idx, {_MMSS.format('a')} AS a_ms, CASE WHEN ev_idx%5=4 THEN {_MMSS.format('b')} ELSE 0 END AS b_ms FROM tx")
def _fn1(t):
    return _times(t).select("run_id", "ev_idx", times.mmss_to_ms(F.col("a")).alias("a_ms"), times.mmss_to_ms(F.col("b")).alias("b_ms"))


@query(
    "fn2_clock_to_ms",
    f"""WITH {_TS} SELECT run_id, ev_idx, CASE ev_idx%5 WHEN 0 THEN 3600000+{_MMSS.format('a')} WHEN 1 THEN ev_idx*1000+500 WHEN 2 THEN 0 WHEN 3 THEN 0
    ELSE {_MMSS.format('b')} END AS ms FROM tx""".replace("ELSE (CAST(split_part(b", "ELSE (TRY_CAST(split_part(b").replace("+CAST(split_part(b", "+TRY_CAST(split_part(b"),
)
def _fn2(t):
    return _times(t).select("run_id", "ev_idx", times.clock_to_ms(F.col("b")).alias("ms"))


@query("fn3_mmss_to_seconds", f"WITH {_TS} SELECT run_id, ev_idx, {_MMSS.format('a')}/1000.0 AS s FROM tx")
def _fn3(t):
    return _times(t).select("run_id", "ev_idx", times.mmss_to_seconds(F.col("a")).alias("s"))


@query(
    "fn4_clean_clock",
    f"""WITH {_TS} SELECT run_id, ev_idx, CASE ev_idx%5 WHEN 0 THEN '01:'||left(a,2) WHEN 1 THEN '00:'||lpad(CAST(ev_idx AS VARCHAR),2,'0') WHEN 2 THEN '00:'||lpad(CAST(ev_idx AS VARCHAR),2,'0')
    WHEN 3 THEN lpad(CAST(ev_idx AS VARCHAR),2,'0')||':07' ELSE b END AS clock FROM tx""",
)
def _fn4(t):
    return _times(t).select("run_id", "ev_idx", times.clean_clock(F.col("b")).alias("clock"))


@query("fn5_clock_text", "SELECT run_id, frame_idx, printf('%02d:%05.2f', timestamp_ms*60//60000, (timestamp_ms*60%60000)/1000.0) AS clock FROM b_frames")
def _fn5(t):
    return t.frames().select("run_id", "frame_idx", times.clock_text(F.col("timestamp_ms") * 60).alias("clock"))


@query(
    "fn6_duration_text",
    """SELECT run_id, s, CASE WHEN s//60>=60 THEN printf('%d:%02d:%02d', s//3600, (s//60)%60, s%60) ELSE printf('%d:%02d', s//60, s%60) END AS text
    FROM (SELECT run_id, CAST(floor(duration_s*20) AS BIGINT) AS s FROM b_media)""",
)
def _fn6(t):
    s = F.floor(F.col("duration_s") * 20)
    return t.media().select("run_id", s.alias("s"), times.duration_text(s).alias("text"))
