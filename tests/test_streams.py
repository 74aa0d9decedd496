"""Streams over many micro-batches: states that go, publications that stay short."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cinetrace.plans import hooks
from cinetrace.streaming import live

CAPTIONS = "run_id long, frame_idx long, caption string, delta_score double, threshold double, at timestamp"


def deliver(spark, schema, batches, root, start):
    """One micro-batch per list of rows; what the queries reported."""
    progress = hooks.Progress()
    spark.streams.addListener(progress)
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
            query = start(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/ckpt")
            reports = progress.finished(query)
        return reports
    finally:
        spark.streams.removeListener(progress)


def at(spark, seconds):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_walker_state_stays_flat_over_many_runs(spark, tmp_path):
    """Each delivery brings a run an hour later than the one before; states of old runs go."""
    words = "a b c d e f".split()
    rnd = random.Random(3)
    batches = [
        [(run, i, " ".join(rnd.choices(words, k=4)), rnd.random(), 0.9, at(spark, run * 3600 + i)) for i in range(30)] for run in range(8)
    ]
    out = live.Publication(f"{tmp_path}/out", ["run_id", "frame_idx"], every=3)

    def start(stream, ckpt):
        return out.start(live.walk(stream.withWatermark("at", "1 minute"), size=8, idle_ms=60_000), ckpt, None)

    reports = deliver(spark, CAPTIONS, batches, tmp_path, start)
    sizes = [figures["state_rows"] for _, figures in reports if figures["input_rows"]]
    assert max(sizes[2:]) <= 2 * sizes[0], sizes
    got = {(r.run_id, r.frame_idx): r.escalate for r in out.read(spark).collect()}
    for rows in batches:
        before = None
        for run, i, caption, delta, threshold, _ in rows:
            a, b = set(caption.split()), set((before or "").split())
            assert got[run, i] == (delta >= threshold or (before is not None and len(a & b) / len(a | b) < 0.3))
            before = caption


def test_late_frame_decides_its_successor_again(spark, tmp_path):
    rows = [(1, i, c, 0.0, 1.0, at(spark, i)) for i, c in enumerate(["x y", "x y", "p q", "p q"])]
    out = live.Publication(f"{tmp_path}/out", ["run_id", "frame_idx"])

    def start(stream, ckpt):
        return out.start(live.walk(live.deduplicated(stream, "at"), size=2), ckpt, None)

    deliver(spark, CAPTIONS, [[rows[2], rows[0]], [rows[3], rows[2]], [rows[1]]], tmp_path, start)
    assert {r.frame_idx: r.escalate for r in out.read(spark).collect()} == {0: False, 1: False, 2: True, 3: False}


def test_short_runs_share_a_state_but_are_forgotten_apart(spark, tmp_path):
    """Neighbouring short runs are one stored value; run 1 is forgotten while its neighbours go on."""
    first = [(run, 0, "a b", 0.0, 1.0, at(spark, 0)) for run in range(live.PACK_RUNS)]
    later = [[(2, 1, "a b", 0.0, 1.0, at(spark, hour * 3600))] for hour in (1, 2)]
    last = [(run, 1 if run == 1 else 2, "x y", 0.0, 1.0, at(spark, 2 * 3600 + 60)) for run in (1, 2)]
    out = live.Publication(f"{tmp_path}/out", ["run_id", "frame_idx"])

    def start(stream, ckpt):
        return out.start(live.walk(stream.withWatermark("at", "1 minute"), size=8, idle_ms=600_000), ckpt, None)

    reports = deliver(spark, CAPTIONS, [first, *later, last], tmp_path, start)
    assert max(figures["state_rows"] for _, figures in reports) == 1
    got = {(r.run_id, r.frame_idx): r.escalate for r in out.read(spark).collect()}
    assert len(got) == live.PACK_RUNS + 3
    assert not got[1, 1] and got[2, 2]


EVENTS = "run_id long, frame_idx long, kind string, at timestamp"


@pytest.mark.parametrize("batch", [2, None])
def test_review_queue_equals_its_batch_twin(spark, tmp_path, batch):
    """Four deliveries in random order; frames leave by verdict or third failure."""
    rnd = random.Random(5)
    events = []
    for run in (1, 2):
        for i in range(25):
            events.append((run, i, rnd.choice(["escalated", "escalated", "settled"]), at(spark, i)))
            events += [(run, i, "failed", at(spark, i))] * rnd.choice([0, 0, 1, 2, 3, 4])
    rnd.shuffle(events)
    out = live.Publication(f"{tmp_path}/out", ["run_id", "block"], every=2)

    def start(stream, ckpt):
        return out.start(live.review_stream(stream.withWatermark("at", "1 hour"), batch, size=4), ckpt, None)

    deliver(spark, EVENTS, [events[k::4] for k in range(4)], tmp_path, start)
    all_ = spark.createDataFrame(events, EVENTS)
    captions = all_.filter("kind <> 'failed'").select(
        "run_id", "frame_idx", (F.col("kind") == "escalated").alias("escalated"), F.lit(None).cast("boolean").alias("verifier_agrees")
    )
    want = live.review_queue(captions, all_.filter("kind = 'failed'"), batch).select("run_id", "frame_idx")
    got = live.next_reviews(out.read(spark), batch).select("run_id", "frame_idx")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_files_read_do_not_grow_with_batches(spark, tmp_path):
    out = live.Publication(str(tmp_path / "out"), ["k"], every=4)
    opened, kept = [], []
    for i in range(19):
        out.write(spark.createDataFrame([(i % 5, i)], "k long, v long"), i)
        opened.append(len(out.folders(spark)))
        kept.append(len(list(Path(out.path).iterdir())))
    assert max(opened) <= 4 and max(kept) <= 2 + 2 * 4
    assert {r.k: r.v for r in out.read(spark).collect()} == {k: max(i for i in range(19) if i % 5 == k) for k in range(5)}
    out.write(spark.createDataFrame([(3, 100)], "k long, v long"), 18)  # tried again
    assert {r.k: r.v for r in out.read(spark).collect()}[3] == 100


def test_progress_reports_every_batch(spark, tmp_path):
    rows = [[(i, 1.0 * i)] for i in range(3)]

    def start(stream, ckpt):
        return live.append_new(stream.observe("seen", F.sum("v").alias("total")), f"{tmp_path}/out", ckpt)

    reports = deliver(spark, "k long, v double", rows, tmp_path, start)
    assert sum(f["input_rows"] for _, f in reports) == 3 and sum(f.get("total") or 0 for _, f in reports) == 3.0
