"""The domain tables themselves, so that a wrong binding shows up as its own failure."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinetrace.bindings import VIEWS
from cinetrace.catalog import query

for _view in VIEWS:
    _table = _view[2:]
    if _table in ("visual", "thumbs"):
        continue
    query(f"table_{_table}", f"SELECT * FROM {_view}")(lambda t, n=_table: getattr(t, n)())


@query(
    "table_visual",
    """SELECT run_id, ev_idx, type, array_to_string(entities, ',') AS entities, start_time, end_time,
    description, confidence FROM b_visual""",
)
def _visual(t):
    return t.visual().withColumn("entities", F.array_join("entities", ","))
