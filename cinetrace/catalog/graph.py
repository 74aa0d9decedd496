"""Entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.operators import graph as gr

_S = "CAST(split_part({0},':',1) AS DOUBLE)*60+CAST(split_part({0},':',2) AS DOUBLE)"
_E = f"""ed AS (SELECT run_id, 've_'||ev_idx AS key, entities[1] AS source, entities[2] AS target, type AS behavior,
  {_S.format('start_time')} AS start, {_S.format('end_time')} AS "end" FROM b_visual WHERE len(entities)>=2)"""
_V = """en AS (SELECT run_id, id, type, CASE type WHEN 'person' THEN '#4A90D9' WHEN 'dog' THEN '#E8943A' WHEN 'cat' THEN '#9B59B6' WHEN 'vehicle' THEN '#2ECC71'
   WHEN 'object' THEN '#95A5A6' ELSE '#BDC3C7' END AS colour FROM b_entities),
 ends AS (SELECT run_id, source AS id FROM ed UNION ALL SELECT run_id, target FROM ed),
 ve AS (SELECT * FROM en UNION ALL SELECT DISTINCT run_id, id, NULL, NULL FROM ends e WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.run_id=e.run_id AND en.id=e.id))"""


@query("grf1_edges", f"""WITH {_E} SELECT run_id, key, source, target, behavior, start, "end", '#7F8C8D' AS colour FROM ed""")
def _e(t):
    return gr.edges(t.visual()).drop("ev_idx", "description", "confidence")


def _vertices(t):
    return gr.vertices(t.entities(), gr.edges(t.visual()))


@query("grf1_vertices", f"WITH {_E}, {_V} SELECT run_id, id, type, colour FROM ve")
def _v(t):
    return _vertices(t).drop("description")


@query(
    "grf2_document",
    f"""WITH {_E}, {_V} SELECT run_id, 'nodes' AS section, id AS name, '{{"id":"'||id||'"'||coalesce(',"type":"'||type||'"','')||coalesce(',"colour":"'||colour||'"','')||'}}' AS element FROM ve
    UNION ALL SELECT run_id, 'links', key, '{{"key":"'||key||'","source":"'||source||'","target":"'||target||'","behavior":"'||behavior||'"}}' FROM ed""",
)
def _doc(t):
    return gr.document_parts(_vertices(t), gr.edges(t.visual()))


@query("grf3_between", f"WITH {_E} SELECT run_id, key FROM ed WHERE (source='E1' AND target='E2') OR (source='E2' AND target='E1')")
def _b(t):
    return gr.between(gr.edges(t.visual()), "E1", "E2").select("run_id", "key")


@query("grf4_active_edges", f"""WITH {_E} SELECT run_id, key FROM ed WHERE start<=300 AND "end">=300""")
def _a(t):
    return gr.active_edges(gr.edges(t.visual()), 300.0).select("run_id", "key")


@query(
    "grf5_merged_timeline",
    f"""SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY start, source DESC, ev_idx)-1 AS pos FROM (
    SELECT run_id, 'visual' AS source, ev_idx, type, {_S.format('start_time')} AS start FROM b_visual
    UNION ALL SELECT run_id, 'audio', ev_idx, type, {_S.format('start_time')} FROM b_sounds)""",
)
def _t(t):
    return gr.merged_timeline(t.visual(), t.sounds())


@query(
    "grf6_stats",
    f"""WITH {_E}, {_V}, dg AS (SELECT run_id, id, count(*) AS n FROM ends GROUP BY 1,2),
    hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, id) AS rn FROM dg) WHERE rn=1),
    bh AS (SELECT * FROM (SELECT run_id, behavior, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, behavior) AS rn FROM ed GROUP BY 1,2) WHERE rn=1)
    SELECT r.run_id, coalesce(e.n,0) AS entities, coalesce(l.n,0) AS edges, hb.id AS most_connected, hb.n AS degree, bh.behavior AS dominant_behavior
    FROM (SELECT run_id FROM b_entities UNION SELECT run_id FROM ed) r LEFT JOIN (SELECT run_id, count(*) AS n FROM b_entities GROUP BY 1) e USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) AS n FROM ed GROUP BY 1) l USING (run_id) LEFT JOIN hb USING (run_id) LEFT JOIN bh USING (run_id)""",
)
def _st(t):
    return gr.stats(t.entities(), gr.edges(t.visual()))


@query(
    "fn16_colours",
    """SELECT run_id, id, CASE type WHEN 'person' THEN '#4A90D9' WHEN 'dog' THEN '#E8943A' WHEN 'cat' THEN '#9B59B6' WHEN 'vehicle' THEN '#2ECC71'
    WHEN 'object' THEN '#95A5A6' ELSE '#BDC3C7' END AS colour, ['red','green','blue'][CAST(substr(id,2) AS INT)%3+1] AS palette FROM b_entities""",
)
def _col(t):
    number = F.substring("id", 2, 9).cast("int")
    return t.entities().select(
        "run_id", "id",
        gr.colour(F.lower("type"), gr.ENTITY_COLOURS, gr.ENTITY_DEFAULT).alias("colour"),
        gr.palette_colour(number, ["red", "green", "blue"]).alias("palette"),
    )
