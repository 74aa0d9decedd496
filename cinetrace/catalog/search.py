"""Search over transcripts, captions, detections and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.operators import search as se
from cinetrace.operators.spans import play_positions
from cinetrace.sources.readers import print_of, scratch_dir, shared_dir

_QUERIES = [
    (1, "click purchase"),
    (2, "view OR signup"),
    (3, "error 7"),
    (4, "der, die?"),
    (5, "assistant"),
    (6, "transcript 45"),
]

_DOCS = """dc AS (
 SELECT run_id, 'transcript:'||segment_id AS doc_id, trim(text) AS content, 'transcript' AS source_type, start_ms AS timestamp_ms, CAST(NULL AS BIGINT) AS frame_idx FROM b_audio
 UNION ALL SELECT 2000000+doc_id//20, 'transcript:'||doc_id, trim(text), 'transcript', (doc_id%20)*1000, NULL FROM documents
 UNION ALL SELECT run_id, 'caption:'||frame_idx, trim(caption), 'caption', timestamp_ms, frame_idx FROM b_captions
 UNION ALL SELECT run_id, 'change:'||frame_idx, trim(change_line), 'change', timestamp_ms, frame_idx FROM b_captions
 UNION ALL SELECT run_id, 'verifier:'||frame_idx, trim(verifier_caption), 'verifier', timestamp_ms, frame_idx FROM b_captions
 UNION ALL SELECT DISTINCT run_id, 'detection:'||frame_idx||'/'||class_name, class_name, 'detection', {det_ts}, frame_idx FROM {det}
 UNION ALL SELECT run_id, 'event:'||ev_idx, trim(description), 'event', (CAST(split_part(start_time,':',1) AS BIGINT)*60+CAST(split_part(start_time,':',2) AS BIGINT))*1000, NULL FROM b_visual),
 dx AS (SELECT * FROM dc WHERE content<>'')"""
_COMPAT = _DOCS.format(det_ts="CAST(NULL AS BIGINT)", det="b_detections")
_CLEAN = _DOCS.format(det_ts="timestamp_ms", det="(SELECT d.*, f.timestamp_ms FROM b_detections d JOIN b_frames f USING (run_id, frame_idx))")

_IDX = """pt AS (SELECT run_id, doc_id, term, count(*) AS tf FROM (SELECT run_id, doc_id, unnest(list_filter(regexp_split_to_array(lower(strip_accents(
   {text})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w<>'')) AS term FROM dx) GROUP BY 1,2,3),
 ln AS (SELECT run_id, doc_id, sum(tf) AS len FROM pt GROUP BY 1,2),
 rn AS (SELECT run_id, count(*) AS docs, avg(len) AS avg_len FROM ln GROUP BY 1)"""
_ALL = "concat_ws(' ', content, source_type, timestamp_ms, frame_idx)"

_RANK = """df AS (SELECT run_id, term, count(*) AS df FROM pt WHERE term IN (SELECT term FROM qt) GROUP BY 1,2),
 wt AS (SELECT q.query_id, q.clause, p.run_id, p.doc_id, p.term, (CASE WHEN ln((docs-df+0.5)/(df+0.5))<=0 THEN 1e-6 ELSE ln((docs-df+0.5)/(df+0.5)) END)
   *tf*2.2/(tf+1.2*(0.25+0.75*len/avg_len)) AS w FROM pt p JOIN qt q USING (term) JOIN df USING (run_id, term) JOIN rn USING (run_id) JOIN ln USING (run_id, doc_id)),
 cs AS (SELECT query_id, clause, count(*) AS size FROM qt GROUP BY 1,2),
 ok AS (SELECT DISTINCT query_id, run_id, doc_id FROM (SELECT query_id, clause, run_id, doc_id, count(*) AS n FROM wt GROUP BY 1,2,3,4) JOIN cs USING (query_id, clause) WHERE n=size),
 sc AS (SELECT query_id, run_id, doc_id, -sum(w) AS score FROM (SELECT DISTINCT query_id, run_id, doc_id, term, w FROM wt) JOIN ok USING (query_id, run_id, doc_id) GROUP BY 1,2,3),
 rk AS (SELECT s.*, d.source_type, d.timestamp_ms, d.frame_idx, d.content, row_number() OVER (PARTITION BY query_id, s.run_id ORDER BY round(score,9), s.doc_id) AS rank
   FROM sc s JOIN dx d USING (run_id, doc_id) {where})"""
_TERMS = """qt(query_id, clause, term) AS (VALUES (1,0,'click'),(1,0,'purchase'),(2,0,'view'),(2,1,'signup'),(3,0,'error'),(3,0,'7'),
 (4,0,'der'),(4,1,'die'),(5,0,'assistant'),(6,0,'transcript'),(6,0,'45'))"""


def _docs(t, clean=False):
    doc = F.col("doc_id")
    audio = t.audio().select("run_id", "segment_id", "start_ms", "text")
    long_texts = t.read("documents").select(
        (F.floor(doc / 20) + 2000000).alias("run_id"), doc.alias("segment_id"), ((doc % 20) * 1000).alias("start_ms"), "text"
    )
    det = t.detections()
    if clean:
        det = det.join(t.frames().select("run_id", "frame_idx", "timestamp_ms"), ["run_id", "frame_idx"])
    return se.documents(t.captions(), audio.unionByName(long_texts), det, t.visual(), clean)


def _index(t, clean=False):
    """The stored index that all searches share; built by the first of them."""
    docs = _docs(t, clean)
    kind = "clean" if clean else "compat"
    return se.ensure_index(docs, f"{shared_dir(t.spark)}/search-{kind}-{print_of(docs)}", clean)


def _search(t, queries, clean=False, **kw):
    index = _index(t, clean)
    return se.search(index.docs, index.postings, queries, runs=index.runs, **kw)


def _queries(t):
    return t.spark.createDataFrame(_QUERIES, "query_id long, query string")


@query("set3_search_documents", f"WITH {_COMPAT} SELECT * FROM dx")
def _set3(t):
    return _docs(t).drop("len")


@query("txt1_index_counts", f"WITH {_COMPAT} SELECT run_id, source_type, count(*) AS rows FROM dx GROUP BY 1,2")
def _txt1c(t):
    return se.index_counts(_docs(t))


@query("txt1_index", f"WITH {_COMPAT}, {_IDX.format(text=_ALL)} SELECT run_id, term, count(*) AS docs, sum(tf)::BIGINT AS words FROM pt GROUP BY 1,2")
def _txt1(t):
    return _index(t).postings.groupBy("run_id", "term").agg(F.sum("n").alias("docs"), F.sum("words").alias("words"))


_OUT = "SELECT query_id, run_id, rank, doc_id, coalesce(timestamp_ms,0) AS timestamp_ms, round(score,6) AS score FROM rk WHERE rank<=20"


def _shown(df):
    return df.select("query_id", "run_id", "rank", "doc_id", "timestamp_ms", F.round("score", 6).alias("score"))


@query("txt2_search", f"WITH {_COMPAT}, {_IDX.format(text=_ALL)}, {_TERMS}, {_RANK.format(where='')} {_OUT}")
def _txt2(t):
    return _shown(_search(t, _queries(t)))


@query("txt2_search_clean", f"WITH {_CLEAN}, {_IDX.format(text='content')}, {_TERMS}, {_RANK.format(where='')} {_OUT}")
def _txt2c(t):
    return _shown(_search(t, _queries(t), clean=True))


_EVENTS_ONLY = " WHERE d.source_type='event'"


@query("flt8_search_source", f"WITH {_COMPAT}, {_IDX.format(text=_ALL)}, {_TERMS}, {_RANK.format(where=_EVENTS_ONLY)} {_OUT}")
def _flt8(t):
    return _shown(_search(t, _queries(t), source="event"))


_BENCH = """qt AS (SELECT DISTINCT query_id, row_number() OVER (PARTITION BY query_id ORDER BY term) AS clause, term FROM (SELECT DISTINCT item_id AS query_id,
   unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda w: w<>'')) AS term FROM benchmark))"""


@query("txt3_any_word_fallback", f"WITH {_COMPAT}, {_IDX.format(text=_ALL)}, {_BENCH}, {_RANK.format(where='')} {_OUT}")
def _txt3(t):
    """Whole passages as queries: their punctuation is not query syntax, so any word may match."""
    words = t.read("benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.array_join(se.tokens(F.col("text")), " "), F.lit(" ?")).alias("query"),
    )
    return _shown(_search(t, words))


@query(
    "txt4_build_if_missing",
    f"SELECT query_id, run_id, rank, doc_id FROM (WITH {_COMPAT}, {_IDX.format(text=_ALL)}, {_TERMS}, {_RANK.format(where='')} {_OUT})",
)
def _txt4(t):
    """Built on the first call, found on the second."""
    path = scratch_dir(t.spark, "index")
    for _ in range(2):
        index = se.ensure_index(_docs(t), path)
    return se.search(index.docs, index.postings, _queries(t), runs=index.runs).select("query_id", "run_id", "rank", "doc_id")


_SYN_PLAIN = "qt(query_id, clause, term) AS (VALUES (1,0,'click'),(2,0,'view'),(3,0,'assistant'))"


_WIDE_SQL = "qt(query_id, clause, term) AS (VALUES (1,0,'click'),(1,0,'purchase'),(2,0,'view'),(2,0,'transcript'),(3,0,'assistant'))"


@query(
    "txt5_synonyms",
    f"""WITH {_COMPAT}, {_IDX.format(text=_ALL)}, w AS (WITH {_WIDE_SQL}, {_RANK.format(where='')} {_OUT}),
    p AS (WITH {_SYN_PLAIN}, {_RANK.format(where='')} {_OUT})
    SELECT * FROM w UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.query_id=p.query_id AND w.run_id=p.run_id)""",
)
def _txt5(t):
    index = _index(t)
    queries = t.spark.createDataFrame([(1, "click"), (2, "view"), (3, "assistant")], "query_id long, query string")
    synonyms = t.spark.createDataFrame([("click", "purchase"), ("view", "transcript")], "word string, synonym string")
    return _shown(se.search_expanded(index.docs, index.postings, queries, synonyms, runs=index.runs))


@query(
    "jon20_play_position",
    f"""WITH {_COMPAT}, {_IDX.format(text=_ALL)}, {_TERMS}, {_RANK.format(where='')}
    SELECT query_id, r.run_id, rank, coalesce(f.timestamp_ms, r.timestamp_ms, 0) AS play_ms FROM rk r LEFT JOIN b_frames f ON f.run_id=r.run_id AND f.frame_idx=r.frame_idx WHERE rank<=20""",
)
def _jon20(t):
    hits = _search(t, _queries(t))
    return play_positions(hits, t.frames()).select("query_id", "run_id", "rank", "play_ms")
