"""Context blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.catalog.detections import _ROUNDED, _TEXT, _rounded
from cinetrace.functions import text as tx
from cinetrace.operators import captions as ca
from cinetrace.operators.ordering import frame_position, text_parts
from cinetrace.plans import context as cx

_CLOCK = "printf('%02d:%05.2f', {0}//60000, ({0}%60000)/1000.0)"
_SM = """sm AS (SELECT run_id, frame_idx AS chunk_id, CASE WHEN k%4=0 THEN '' ELSE behavior||' near e'||k%50 END AS summary FROM b_events),
 mn AS (SELECT run_id, frame_idx AS chunk_id, 'E'||k AS id, behavior||' '||k AS description FROM b_events)"""


def _summaries(t):
    k = F.col("k")
    text = F.when(k % 4 == 0, "").otherwise(F.concat("behavior", F.lit(" near e"), (k % 50).cast("string")))
    return t.events().select("run_id", F.col("frame_idx").alias("chunk_id"), text.alias("summary"))


def _mentions(t):
    k = F.col("k").cast("string")
    return t.events().select(
        "run_id", F.col("frame_idx").alias("chunk_id"),
        F.concat(F.lit("E"), k).alias("id"), F.concat("behavior", F.lit(" "), k).alias("description"),
    )


_FEW = """few AS (SELECT run_id, frame_idx AS chunk_id, 'E'||k%9 AS id, behavior||' '||k AS description FROM b_events)"""


def _few_entities(t):
    """Nine entities a run, described anew again and again."""
    k = F.col("k")
    return t.events().select(
        "run_id", F.col("frame_idx").alias("chunk_id"), F.concat(F.lit("E"), (k % 9).cast("string")).alias("id"),
        F.concat("behavior", F.lit(" "), k.cast("string")).alias("description"),
    )


@query("ctx1_chunks", "SELECT run_id, frame_idx, (row_number() OVER (PARTITION BY run_id ORDER BY frame_idx)-1)//10 AS chunk_id FROM b_frames")
def _ctx1(t):
    return cx.assign_chunks(t.frames()).select("run_id", "frame_idx", "chunk_id")


@query(
    "ctx2_chunk_blocks",
    f"""WITH c AS (SELECT run_id, frame_idx, timestamp_ms, (row_number() OVER (PARTITION BY run_id ORDER BY frame_idx)-1)//10 AS chunk_id FROM b_frames),
    d AS (SELECT run_id, frame_idx, {_TEXT} AS text FROM {_ROUNDED} GROUP BY 1,2)
    SELECT run_id, chunk_id, string_agg('[frame '||frame_idx||' — t='||{_CLOCK.format('timestamp_ms')}||'] YOLO: '||coalesce(text,'(none)'), chr(10) ORDER BY frame_idx) AS block
    FROM c LEFT JOIN d USING (run_id, frame_idx) GROUP BY 1,2""",
)
def _ctx2(t):
    return cx.chunk_blocks(t.frames(), _rounded(t.detections()))


@query(
    "ctx3_caption_log",
    f"""WITH {_SM}, a AS (SELECT run_id, chunk_id, 0 AS kind, '[frame '||(chunk_id*10)||'] '||description AS line FROM mn
      UNION ALL SELECT run_id, chunk_id, 1, '[chunk '||chunk_id||' summary] '||summary FROM sm WHERE summary<>''),
    o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY chunk_id, kind)-1 AS pos FROM a)
    SELECT run_id, pos//1000 AS part, string_agg(line, chr(10) ORDER BY pos) AS text FROM o GROUP BY 1,2""",
)
def _ctx3(t):
    lines = _mentions(t).select("run_id", "chunk_id", (F.col("chunk_id") * 10).alias("frame_idx"), F.col("description").alias("line"))
    return cx.caption_log(lines, _summaries(t))


@query(
    "ctx4_summary_groups",
    f"""WITH {_SM}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY chunk_id)-1 AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM sm)
    SELECT run_id, pos//10 AS group_id, coalesce(string_agg('[chunk '||chunk_id||'] '||summary, chr(10) ORDER BY pos) FILTER (WHERE summary<>''),'') AS block FROM o WHERE n>30 GROUP BY 1,2""",
)
def _ctx4(t):
    return cx.summary_groups(_summaries(t))


@query(
    "win12_seeds",
    f"""WITH {_SM} SELECT run_id, chunk_id, coalesce(last_value(nullif(summary,'') IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY chunk_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'this is the start') AS seed FROM sm""",
)
def _win12(t):
    return cx.seeds(_summaries(t))


_VER = """ve AS (SELECT run_id, id, description, chunk_id+1 AS valid_from, lead(chunk_id) OVER (PARTITION BY run_id, id ORDER BY chunk_id) AS valid_to FROM mn)"""


@query("win13_registry_versions", f"WITH {_SM}, {_VER} SELECT * FROM ve")
def _win13(t):
    return cx.registry_versions(_mentions(t))


_KNOWN = "kn AS (SELECT m.run_id, m.chunk_id, v.id, v.description FROM sm m JOIN ve v ON v.run_id=m.run_id AND v.valid_from<=m.chunk_id AND coalesce(v.valid_to, 1000000)>=m.chunk_id)"


@query("win13_registry_at_chunk", f"WITH {_SM}, {_VER}, {_KNOWN} SELECT * FROM kn")
def _win13a(t):
    return cx.registry_at(cx.registry_versions(_mentions(t)), _summaries(t))


@query(
    "win13_registry_snapshots",
    f"""WITH {_FEW}, lg AS (SELECT m.*, row_number() OVER (PARTITION BY run_id ORDER BY chunk_id, id, description)-1 AS pos, k.known
      FROM few m JOIN (SELECT run_id, count(DISTINCT id) AS known FROM few GROUP BY 1) k USING (run_id)),
    bl AS (SELECT DISTINCT run_id, pos//known AS block, (pos//known)*known AS start FROM lg)
    SELECT b.run_id, b.block, l.id, arg_max(l.description, l.pos) AS description FROM bl b JOIN lg l ON l.run_id=b.run_id AND l.pos<b.start GROUP BY 1,2,3""",
)
def _win13s(t):
    return cx.registry_snapshots(cx.registry_log(_few_entities(t)))


@query(
    "ctx7_registry_blocks",
    f"""WITH {_SM}, {_VER}, {_KNOWN}, l AS (SELECT run_id, chunk_id, string_agg('  '||id||': '||description, chr(10) ORDER BY id) AS lines FROM kn GROUP BY 1,2)
    SELECT run_id, chunk_id, CASE WHEN lines IS NULL THEN 'Known entities so far: (none — this is the first segment)'||chr(10)||chr(10)
    ELSE 'Known entities so far (reuse these IDs if you see the same entity):'||chr(10)||lines||chr(10)||chr(10) END AS block FROM sm LEFT JOIN l USING (run_id, chunk_id)""",
)
def _ctx7(t):
    chunks = _summaries(t)
    return cx.registry_blocks(cx.registry_at(cx.registry_versions(_mentions(t)), chunks, listed=True), chunks)


@query(
    "ctx7_summary_lines",
    """SELECT run_id, id AS key, id||' ('||type||'): '||description[1:80] AS line FROM b_entities
    UNION ALL SELECT run_id, 'v'||ev_idx, '['||start_time||'–'||end_time||'] '||type||': '||array_to_string(entities,', ')||' — '||description[1:60] FROM b_visual WHERE ev_idx<20
    UNION ALL SELECT run_id, 'a'||ev_idx, '['||start_time||'–'||end_time||'] '||type||': '||text[1:80] FROM b_sounds WHERE ev_idx<10""",
)
def _ctx7s(t):
    named = lambda df, p: df.select("run_id", F.concat(F.lit(p), F.col("ev_idx").cast("string")).alias("key"), "line")
    return (
        cx.entity_lines(t.entities()).withColumnRenamed("id", "key")
        .union(named(cx.event_lines(t.visual()), "v"))
        .union(named(cx.audio_lines(t.sounds()), "a"))
    )


_REC = """rc AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY chunk_id DESC) AS rn FROM sm WHERE summary<>'')"""


@query("ctx8_compact_seed", f"WITH {_SM}, {_REC} SELECT run_id, right(string_agg(summary, '; ' ORDER BY chunk_id), 300) AS seed FROM rc WHERE rn<=3 GROUP BY 1")
def _ctx8(t):
    return cx.compact_seed(_summaries(t))


@query(
    "top13_pruned_registry",
    f"""WITH {_SM}, {_REC}, x AS (SELECT run_id, lower(string_agg(summary, ' ' ORDER BY chunk_id)) AS r FROM rc WHERE rn<=5 GROUP BY 1),
    la AS (SELECT run_id, id, arg_max(description, chunk_id) AS description FROM mn GROUP BY 1,2),
    sc AS (SELECT la.*, coalesce(contains(r, lower(id)),false)::INT + coalesce(contains(r, lower(description)[1:20]),false)::INT AS score FROM la LEFT JOIN x USING (run_id))
    SELECT run_id, id, description, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, id DESC, description DESC) AS rank FROM sc) WHERE rank<=20""",
)
def _top13(t):
    return cx.pruned_registry(_mentions(t), _summaries(t))


@query(
    "top9_thin_lines",
    """WITH p AS (SELECT run_id, frame_idx, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx)-1 AS pos, count(*) OVER (PARTITION BY run_id) AS total FROM b_frames),
    k AS (SELECT DISTINCT run_id, least(total-1, CAST(round_even(i*(total/8.0::DOUBLE),0) AS BIGINT)) AS pos, 1 AS hit FROM (SELECT DISTINCT run_id, total FROM p), range(1,8) r(i))
    SELECT run_id, frame_idx FROM p LEFT JOIN k USING (run_id, pos) WHERE total<=9 OR pos=0 OR pos=total-1 OR hit=1""",
)
def _top9(t):
    return cx.thin_lines(frame_position(t.frames(), total="total"), 9).select("run_id", "frame_idx")


@query(
    "fn8_transcript_lines",
    f"""SELECT run_id, segment_id, '['||{_CLOCK.format('start_ms')}||'-'||{_CLOCK.format('end_ms')}||'] '||trim(text) AS line FROM b_audio WHERE trim(text)<>''""",
)
def _fn8(t):
    return cx.transcript_lines(t.audio()).select("run_id", "segment_id", "line")


@query("fn10_token_estimate", "SELECT doc_id, length(text)//3 AS n FROM documents")
def _fn10(t):
    return t.read("documents").select("doc_id", tx.token_estimate(F.col("text")).alias("n"))


@query(
    "fn11_truncate_middle",
    """WITH m AS (SELECT doc_id, text, chr(10)||'[... trimmed to fit context ...]'||chr(10) AS mk FROM documents)
    SELECT doc_id, CASE WHEN length(text)<=200 THEN text ELSE left(text, (200-length(mk))//2)||mk||right(text, 200-length(mk)-(200-length(mk))//2) END AS text FROM m""",
)
def _fn11(t):
    return t.read("documents").select("doc_id", tx.truncate_middle(F.col("text"), F.lit(200)).alias("text"))


@query("fn12_slug", "SELECT p_partkey, left(lower(trim(regexp_replace(p_name||' & '||p_brand,'[^A-Za-z0-9]+','_','g'),'_')),40) AS slug FROM part")
def _fn12(t):
    label = F.concat("p_name", F.lit(" & "), "p_brand")
    return t.read("part").select("p_partkey", tx.slug(label).alias("slug"))


@query(
    "fn15_clean_query",
    """SELECT page_id, trim(regexp_replace(regexp_replace(url||' ("x") [y] {z} <a|b!>', '[''"\\\\\\[\\](){}|!<>]', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM pages""",
)
def _fn15(t):
    noisy = F.concat("url", F.lit(' ("x") [y] {z} <a|b!>'))
    return t.read("pages").select("page_id", tx.clean_query(noisy).alias("q"))


@query("fn17_prompt_budget", "SELECT run_id, greatest(1024, least(CAST(floor((width*20)*0.7::DOUBLE) AS BIGINT), width*20-4096-512)) AS budget FROM b_media")
def _fn17(t):
    return t.media().select("run_id", cx.prompt_budget(F.col("width") * 20).alias("budget"))


@query("ctx5_fit_blocks")
def _ctx5(t):
    """Prompts of every conversation turn: its text as lines, as transcript and as captions."""
    lines = F.replace(F.col("caption"), F.lit(". "), F.lit(".\n"))
    prompts = t.captions().select(
        "run_id", "frame_idx", lines.alias("dense"),
        F.coalesce("verifier_caption", F.lit("")).alias("transcript"), F.col("caption").alias("captions"),
    )
    return cx.fit_blocks(prompts, 300, 40)


_MARK = "chr(10)||'[... trimmed to fit context ...]'||chr(10)"


def _cut_sql(text: str, limit: str) -> str:
    room = f"greatest(0, {limit}-length({_MARK}))"
    return f"""CASE WHEN {limit}<=0 THEN '' WHEN length({text})<={limit} THEN {text} WHEN {room}=0 THEN ''
      ELSE left({text}, CAST({room}//2 AS INTEGER))||{_MARK}||right({text}, CAST({room}-{room}//2 AS INTEGER)) END"""


# The same steps on whole texts: timeline of 24 lines, speech and log of every run, halved and cut.
_FIT = f"""WITH RECURSIVE {_SM},
 cp AS (SELECT run_id, frame_idx, timestamp_ms, behavior||' k'||k AS caption, k%5=0 AS escalated FROM b_events WHERE k%11<>3),
 sz AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE escalated) AS kept FROM cp GROUP BY 1),
 ps AS (SELECT c.*, row_number() OVER (PARTITION BY run_id, escalated ORDER BY timestamp_ms, frame_idx)-1 AS pos FROM cp c),
 pk AS (SELECT DISTINCT run_id, least(CAST(round_even(i*((total-kept)/(24-kept)::DOUBLE),0) AS BIGINT), total-kept-1) AS pos, 1 AS hit
   FROM sz, range(24) r(i) WHERE 24-kept>0 AND i<24-kept AND total-kept>24-kept),
 dt AS (SELECT p.run_id, p.frame_idx, p.timestamp_ms, CASE WHEN escalated THEN '*' ELSE '' END||{_CLOCK.format('timestamp_ms')}||' '||caption AS line
   FROM ps p JOIN sz USING (run_id) LEFT JOIN pk ON pk.run_id=p.run_id AND pk.pos=p.pos AND NOT p.escalated
   WHERE escalated OR total<=24 OR (24-kept>0 AND (total-kept<=24-kept OR hit=1))),
 dl AS (SELECT run_id, list(line ORDER BY timestamp_ms, frame_idx) AS l FROM dt GROUP BY 1),
 tr AS (SELECT run_id, string_agg('['||{_CLOCK.format('start_ms')}||'-'||{_CLOCK.format('end_ms')}||'] '||trim(text), chr(10) ORDER BY start_ms, segment_id) AS t FROM b_audio WHERE trim(text)<>'' GROUP BY 1),
 lg AS (SELECT run_id, chunk_id, 0 AS kind, '[frame '||(chunk_id*10)||'] '||description AS line FROM mn
   UNION ALL SELECT run_id, chunk_id, 1, '[chunk '||chunk_id||' summary] '||summary FROM sm WHERE summary<>''),
 cl AS (SELECT run_id, string_agg(line, chr(10) ORDER BY chunk_id, kind) AS c FROM lg GROUP BY 1),
 b AS (SELECT run_id, 300+(run_id%9)*260 AS budget FROM (SELECT DISTINCT run_id FROM b_events)),
 h AS (SELECT b.run_id, b.budget, coalesce(l, []) AS l, coalesce(t,'') AS t, coalesce(c,'') AS c, 0 AS step FROM b LEFT JOIN dl USING (run_id) LEFT JOIN tr USING (run_id) LEFT JOIN cl USING (run_id)
   UNION ALL SELECT run_id, budget, list_transform(list_sort(list_distinct(list_concat([0, len(l)-1],
     list_transform(range(1, greatest(6, len(l)//2)-1), lambda i: least(len(l)-1, CAST(round_even(i*(len(l)/(greatest(6, len(l)//2)-1)::DOUBLE),0) AS BIGINT)))))), lambda i: l[i+1]), t, c, step+1
   FROM h WHERE len(l)>6 AND 40+length(array_to_string(l,chr(10)))//3+length(t)//3+length(c)//3>budget),
 d1 AS (SELECT run_id, budget, coalesce(array_to_string(l, chr(10)),'') AS d, t, c FROM h QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC)=1),
 d2 AS (SELECT *, 40+length(d)//3+length(t)//3+length(c)//3-budget AS over FROM d1),
 d3 AS (SELECT run_id, budget, d, c, CASE WHEN t<>'' AND over>0 THEN {_cut_sql('t', '(greatest(0, length(t)//3-over)*3)')} ELSE t END AS t FROM d2),
 d4 AS (SELECT *, 40+length(d)//3+length(t)//3+length(c)//3-budget AS over FROM d3),
 d5 AS (SELECT run_id, d, t, CASE WHEN over>0 THEN {_cut_sql('c', '(greatest(1, length(c)//3-over)*3)')} ELSE c END AS c FROM d4)
 SELECT run_id, 'dense' AS block, d AS text FROM d5 WHERE d<>'' UNION ALL SELECT run_id, 'transcript', t FROM d5 WHERE t<>'' UNION ALL SELECT run_id, 'captions', c FROM d5 WHERE c<>''"""


@query("ctx5_fit_runs", _FIT)
def _ctx5r(t):
    """The timeline, the speech lines and the caption log of every run, fitted to a budget of its own."""
    said = t.events().filter("k % 11 <> 3").select(
        "run_id", "frame_idx", "timestamp_ms", F.concat("behavior", F.lit(" k"), F.col("k").cast("string")).alias("caption"),
        (F.col("k") % 5 == 0).alias("escalated"), F.lit(None).cast("string").alias("verifier_caption"), F.lit(None).cast("boolean").alias("verifier_agrees"),
    )
    mentions = _mentions(t).select("run_id", "chunk_id", (F.col("chunk_id") * 10).alias("frame_idx"), F.col("description").alias("line"))
    blocks = {
        "dense": ca.timeline_lines(ca.dense_timeline(said, 24)),
        "transcript": cx.transcript_lines(t.audio()),
        "captions": cx.caption_log_lines(mentions, _summaries(t)),
    }
    lines = [df.select("run_id", F.lit(name).alias("block"), "pos", "line") for name, df in blocks.items()]
    budgets = t.events().select("run_id", (300 + F.col("run_id") % 9 * 260).alias("budget")).distinct()
    fitted = cx.fit_run_blocks(lines[0].unionByName(lines[1]).unionByName(lines[2]), budgets, 40)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part", "line"))), lambda s: s["line"]), "\n")
    return fitted.groupBy("run_id", "block").agg(text.alias("text")).filter("text <> ''")


@query(
    "agg16_transcript_text",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY start_ms, segment_id)-1 AS pos FROM b_audio)
    SELECT run_id, pos//1000 AS part, string_agg(text, ' ' ORDER BY pos) AS text FROM o GROUP BY 1,2""",
)
def _agg16t(t):
    from cinetrace.operators.ordering import position, time_buckets

    rows = position(t.audio(), ["run_id"], [F.col("start_ms"), F.col("segment_id")], time_buckets("start_ms"))
    return text_parts(rows, ["run_id"], F.col("text"), separator=" ")
