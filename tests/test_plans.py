"""Physical plans: what must and must not be in them."""

import pytest
from conftest import DATA

import __spark_entry__ as entry
from cinetrace.bindings import Tables
from cinetrace.operators import detections


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_registered_query_crosses_rows(spark):
    bad = []
    for name, fn in entry.queries().items():
        if name.startswith(("op", "pipeline")):  # tested apart
            continue
        text = plan(fn(spark, DATA))
        if "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text:
            bad.append(name)
    assert bad == []


def test_confidence_floor_reads_few_columns(spark):
    df = detections.per_frame(detections.confident(Tables(spark, DATA).detections(), 0.5))
    text = plan(df)
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_extendedprice" not in schema and "l_returnflag" not in schema


def test_point_filter_reaches_the_scan(spark):
    f = Tables(spark, DATA).read("orders").filter("o_orderkey = 7").select("o_custkey")
    assert "EqualTo(o_orderkey,7)" in plan(f)


@pytest.mark.parametrize("name", ["flt6_pending_reviews", "top4_latest_captions", "agg14_stage_costs"])
def test_top_n_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(entry.queries()[name](spark, DATA))


def test_upserts_do_not_sort_the_stored_table(spark):
    """Only the new rows are ranked: the window reads the changes, not the store."""
    from cinetrace.sources import keyed

    old = spark.range(100).selectExpr("id AS run_id", "id AS frame_idx", "'old' AS v")
    new = spark.range(10).selectExpr("id AS run_id", "id AS frame_idx", "'new' AS v", "id AS seq")
    df = keyed.upsert(old, new, ["run_id", "frame_idx"])
    assert df.filter("v = 'new'").count() == 10 and df.count() == 100
    window = df._jdf.queryExecution().optimizedPlan().toString().split("Window")[1:]
    assert window and all("old AS v" not in w.split("Join")[0] for w in window)
