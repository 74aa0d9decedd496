"""Order-dependent passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.catalog import query
from cinetrace.operators import folds as fo
from cinetrace.operators import passes

_HIGH = """WITH RECURSIVE rk AS (SELECT run_id, timestamp_ms AS ts, row_number() OVER (PARTITION BY run_id ORDER BY delta_score DESC, frame_idx) AS rn FROM b_frames),
 cand AS (SELECT run_id, rn, greatest(0, ts-1500) AS s, ts+1500 AS e FROM rk),
 st AS (SELECT DISTINCT run_id, 0::BIGINT AS rn, 0::BIGINT AS total, []::STRUCT(s BIGINT, e BIGINT)[] AS spans FROM rk
  UNION ALL SELECT st.run_id, c.rn, CASE WHEN ok THEN total+c.e-c.s ELSE total END, CASE WHEN ok THEN list_append(spans, {'s': c.s, 'e': c.e}) ELSE spans END
  FROM st JOIN cand c ON c.run_id=st.run_id AND c.rn=st.rn+1,
  LATERAL (SELECT total<20000 AND len(list_filter(spans, lambda x: (c.s<=x.e AND x.s<=c.e) OR greatest(x.s-c.e, c.s-x.e)<3000))=0 AS ok) q),
 fin AS (SELECT run_id, arg_max(spans, rn) AS spans FROM st GROUP BY 1)
SELECT run_id, u.s AS start_ms, u.e AS end_ms FROM (SELECT run_id, unnest(spans) AS u FROM fin)"""


@query("top3_highlight_spans", _HIGH)
def _top3(t):
    return fo.highlight_spans(t.frames(), target_s=20.0)


_TH = "(SELECT run_id, frame_idx, is_keyframe, CASE WHEN (run_id+frame_idx)%17=5 THEN NULL ELSE thumb END AS thumb FROM b_thumbs)"
_PRUNE = f"""WITH RECURSIVE th AS (SELECT * FROM {_TH}),
 w AS (SELECT run_id, frame_idx, thumb AS last, true AS kept, thumb IS NULL AS keep_all FROM th WHERE frame_idx=0
  UNION ALL SELECT w.run_id, t.frame_idx, CASE WHEN t.thumb IS NOT NULL AND k THEN t.thumb ELSE w.last END, keep_all OR k, keep_all
  FROM w JOIN th t ON t.run_id=w.run_id AND t.frame_idx=w.frame_idx+1,
  LATERAL (SELECT t.thumb IS NULL OR t.is_keyframe OR 1.0-(list_sum(list_transform(list_zip(w.last, t.thumb), lambda z: abs(CAST(z[1] AS DOUBLE)-CAST(z[2] AS DOUBLE))))/64)/0.5 < 0.72 AS k) q)
SELECT run_id, frame_idx FROM w WHERE kept"""


@query("win19_prune_redundant", _PRUNE)
def _win19(t):
    broken = (F.col("run_id") + F.col("frame_idx")) % 17 == 5
    thumbs = t.thumbs().withColumn("thumb", F.when(~broken, F.col("thumb")))
    return fo.prune_redundant(thumbs, threshold=0.72, scale=0.5)


_PASS = """WITH RECURSIVE u AS (SELECT *, prompt_tokens+completion_tokens AS tot FROM b_usage),
 f AS (SELECT run_id, -1::BIGINT AS chunk_id, 0::BIGINT AS pass_id, 0::BIGINT AS cumulative, 1500::BIGINT AS image_tokens, 500::BIGINT AS reply_tokens, 0::BIGINT AS chunk_size, 0::BIGINT AS next_pass, 0::BIGINT AS carry FROM (SELECT DISTINCT run_id FROM u)
  UNION ALL SELECT f.run_id, u.chunk_id, f.next_pass, f.carry+u.tot, i2, r2, sz, CASE WHEN f.carry+u.tot+650+sz*i2+r2>400000 THEN f.next_pass+1 ELSE f.next_pass END,
   CASE WHEN f.carry+u.tot+650+sz*i2+r2>400000 THEN 0 ELSE f.carry+u.tot END
  FROM f JOIN u ON u.run_id=f.run_id AND u.chunk_id=f.chunk_id+1,
  LATERAL (SELECT greatest(2, least(50, (400000-650-f.reply_tokens)//greatest(1, f.image_tokens))) AS sz,
   CASE WHEN u.prompt_tokens>0 THEN CAST(trunc(0.3::DOUBLE*f.image_tokens+0.7::DOUBLE*greatest(500::DOUBLE,(u.prompt_tokens-650)/u.n_images::DOUBLE)) AS BIGINT) ELSE f.image_tokens END AS i2,
   CASE WHEN u.completion_tokens>0 THEN CAST(trunc(0.3::DOUBLE*f.reply_tokens+0.7::DOUBLE*u.completion_tokens) AS BIGINT) ELSE f.reply_tokens END AS r2) q)
"""


@query("win14_token_passes", _PASS + "SELECT run_id, chunk_id, pass_id, cumulative FROM f WHERE chunk_id>=0")
def _win14(t):
    return passes.token_passes(t.usage(), 400_000).select("run_id", "chunk_id", "pass_id", "cumulative")


@query("win15_calibration", _PASS + "SELECT run_id, chunk_id, image_tokens, reply_tokens, chunk_size FROM f WHERE chunk_id>=0")
def _win15(t):
    return passes.token_passes(t.usage(), 400_000).select("run_id", "chunk_id", "image_tokens", "reply_tokens", "chunk_size")


# The description of a run's first entities stands in for its entity list; 650 becomes 600 + max(50, length / 3).
_OWN = """(SELECT u.*, coalesce(e.n, 0) AS entity_length FROM b_usage u LEFT JOIN (SELECT run_id, sum(length(description))*12 AS n FROM b_entities GROUP BY 1) e ON e.run_id=u.run_id)"""
_ENTITY_PASS = (
    _PASS.replace("FROM b_usage", f"FROM {_OWN}").replace("650", "(600+greatest(50, u.entity_length//3))").replace("400000", "90000")
)


@query("win14_entity_budget", _ENTITY_PASS + "SELECT run_id, chunk_id, pass_id, cumulative, chunk_size FROM f WHERE chunk_id>=0")
def _win14e(t):
    """Long entity lists leave less room for images."""
    length = t.entities().groupBy("run_id").agg((F.sum(F.length("description")) * 12).alias("entity_length"))
    usage = t.usage().join(length, "run_id", "left")
    return passes.token_passes(usage, 90_000).select("run_id", "chunk_id", "pass_id", "cumulative", "chunk_size")
