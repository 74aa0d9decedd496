"""Keyed stores: only touched folders are read and rewritten."""

from pathlib import Path

from pyspark.sql import functions as F

from cinetrace.catalog.summaries import _write_run_folders
from cinetrace.sources import export, keyed, readers
from cinetrace.streaming import live

ROWS = "run_id long, frame_idx long, v string"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_upsert_leaves_other_folders_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    like = spark.createDataFrame([], ROWS)
    store = keyed.KeyedStore(spark, path, ["run_id", "frame_idx"], "frame_idx", rows=10)
    rows = [(run, i, "old") for run in (1, 2, 700) for i in range(35)]
    store.upsert(spark.createDataFrame([(*r, 0) for r in rows], ROWS + ", seq long"), like)
    before = files(path)
    new = spark.createDataFrame([(2, 12, "a", 1), (2, 12, "b", 2), (2, 99, "c", 1), (700, 0, "d", 1)], ROWS + ", seq long")
    plan = store.touched(new, like)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__runs" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.touched(new, like).select("__runs", "__keys").distinct().count() == 2
    store.upsert(new, like)
    after = files(path)
    touched = ["__runs=0/__keys=1", "__runs=0/__keys=9", "__runs=2/__keys=0"]
    for name in set(before) | set(after):
        if not any(t in name for t in touched):
            assert before.get(name) == after.get(name)
    want = {(r, i): v for r, i, v in rows} | {(2, 12): "b", (2, 99): "c", (700, 0): "d"}
    assert {(r.run_id, r.frame_idx): r.v for r in store.read(like).collect()} == want


def test_many_touched_folders_and_deleted_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_PARTS", 1)
    like = spark.createDataFrame([], "run_id long, key string, value string")
    store = keyed.KeyedStore(spark, str(tmp_path / "meta"), ["run_id", "key"])
    schema = "run_id long, key string, value string, seq long"
    store.set_values(spark.createDataFrame([(r, "k", "x", 0) for r in (1, 300, 600)], schema), like)
    store.set_values(spark.createDataFrame([(1, "k", None, 1), (300, "k", "y", 1), (300, "k", None, 0)], schema), like)
    assert sorted(tuple(r) for r in store.read(like).collect()) == [(300, "k", "y"), (600, "k", "x")]
    store.set_values(spark.createDataFrame([(1, "k", "z", 1)], schema), like)
    assert {r.run_id: r.value for r in store.read(like).collect()} == {1: "z", 300: "y", 600: "x"}


def test_empty_changes(spark, tmp_path):
    like = spark.createDataFrame([], ROWS)
    store = keyed.KeyedStore(spark, str(tmp_path / "none"), ["run_id", "frame_idx"], "frame_idx")
    store.upsert(like.withColumn("seq", F.lit(0)), like)
    assert store.read(like).count() == 0


def test_folders_of_many_runs_are_named_flat(spark, tmp_path):
    """Nearly as many folders as are named in the scan, each of other runs: one list, not a condition per run."""
    like = spark.createDataFrame([], ROWS)
    store = keyed.KeyedStore(spark, str(tmp_path / "wide"), ["run_id", "frame_idx"], "frame_idx", rows=10)
    wide = spark.range(keyed.MOST_PARTS - 1).select((F.col("id") * keyed.RUNS).alias("run_id"), F.lit(0).cast("long").alias("frame_idx"))
    store.upsert(wide.filter("run_id < 1024").withColumns({"v": F.lit("old"), "seq": F.lit(0).cast("long")}), like)
    touched = store.touched(wide, like)
    assert touched._jdf.queryExecution().analyzed().toString().count(" OR ") == 0
    assert touched.count() == 4


def test_runs_share_folders_and_are_rewritten_whole(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda runs, v: spark.createDataFrame([(r, i, v) for r in runs for i in range(3)], ROWS)
    keyed.write_runs(rows(range(600), "old"), path, "frame_idx")
    assert len(list(Path(path).glob("__runs=*"))) == 3  # 600 runs, not 600 folders
    before = files(path)
    keyed.write_runs(rows([5, 300], "new").filter("frame_idx < 2"), path, "frame_idx")
    assert all(before[n] == files(path).get(n) for n in before if "__runs=2/" in n)
    want = {(r, i): "old" for r in range(600) if r not in (5, 300) for i in range(3)}
    want |= {(r, i): "new" for r in (5, 300) for i in range(2)}
    assert {(r.run_id, r.frame_idx): r.v for r in spark.read.parquet(path).collect()} == want


def test_touched_runs_are_read_from_their_folders(spark, tmp_path):
    """The stores of the live feed lie in folders by runs; the scan names those of the touched runs."""
    path = str(tmp_path / "runs")
    like = spark.createDataFrame([(r, i) for r in (1, 2, 700) for i in range(3)], "run_id long, frame_idx long")
    keyed.write_runs(like, path, "frame_idx")
    got = live.of_runs(keyed.read_runs(spark, path, like), spark.createDataFrame([(2,)], "run_id long"))
    assert got.columns == like.columns and sorted(r.run_id for r in got.collect()) == [2, 2, 2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__runs" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_csv_of_many_runs_lies_in_few_folders(spark, tmp_path):
    path = str(tmp_path / "csv")
    note = 'a, "b"\nend'
    rows = [(r, p, i, note) for r in range(600) for p in ("alt", "default") for i in range(2)]
    export.write_csv(spark.createDataFrame(rows, "run_id long, profile_name string, frame long, note string"), path, ["run_id", "profile_name"])
    assert len([p for p in Path(path).glob("*/*") if p.is_dir()]) == 6  # 1200 runs and profiles
    back = export.read_csv(spark, path, "frame bigint, note string, run_id bigint, profile_name string")
    assert sorted(tuple(r) for r in back.select("run_id", "profile_name", "frame", "note").collect()) == sorted(rows)


def test_run_folders_are_written_by_many_tasks(spark, tmp_path):
    """Rows too small to fill a task are spread all the same; a run has one file."""
    path = tmp_path / "frames"
    _write_run_folders(spark.range(600).select(F.col("id").alias("run_id"), F.lit("{}").alias("value")), str(path), "text")
    found = list(path.glob("run_id=*/part-*"))
    assert len(found) == 600 and len({p.parent for p in found}) == 600
    assert len({p.name.split("-")[1] for p in found}) > 1


def test_files_of_runs_are_written_without_a_process_each(spark, tmp_path, monkeypatch):
    """In a folder of plain files tasks write by themselves, a large run piece by piece; elsewhere Spark writes the same."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(900).selectExpr("CASE WHEN id < 300 THEN 7 WHEN id = 300 THEN NULL ELSE id END AS run_id", "id AS frame_idx", "'\u00e4' AS value")
    read = lambda name: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").select("run_id", "frame_idx", "value").collect() if r.run_id)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        _write_run_folders(rows, str(tmp_path / "own"), "parquet")
        _write_run_folders(rows.select("run_id", "value"), f"file://{tmp_path}/text", "text")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert not [p for p in tmp_path.rglob("*") if p.name.startswith("_") or p.name.endswith(".crc")]
    monkeypatch.setattr(keyed, "local_path", lambda *a: None)
    _write_run_folders(rows, str(tmp_path / "spark"), "parquet")
    folders = lambda name: sorted(p.name for p in (tmp_path / name).iterdir() if p.is_dir())
    assert read("own") == read("spark") and folders("own") == folders("spark") == folders("text") and len(folders("own")) == 601
    assert all(len(list(p.iterdir())) == 1 for p in (tmp_path / "own").iterdir())
    (seven,) = (tmp_path / "text" / "run_id=7").iterdir()
    assert seven.read_text(encoding="utf-8") == "\u00e4\n" * 300
    found = readers.run_files(spark, str(tmp_path)).groupBy("table").count().collect()
    assert {r["table"]: r["count"] for r in found} == {"own": 600, "spark": 600, "text": 600}
