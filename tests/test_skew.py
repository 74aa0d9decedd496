"""One run with most of the rows, against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from cinetrace.operators import folds, ordering, passes
from cinetrace.operators.intervals import interval_join, merge_spans


def hot_rows(seed, n=400):
    rnd = random.Random(seed)
    return [(1 if rnd.random() < 0.7 else rnd.randint(2, 5), i, rnd.choice([0.0, 1.0, rnd.random() * 3])) for i in range(n)]


def by_run(rows):
    runs = {}
    for r in rows:
        runs.setdefault(r[0], []).append(r)
    return runs


def test_positions_with_tied_scores(spark):
    rows = hot_rows(1)
    df = spark.createDataFrame(rows, "run_id long, frame_idx long, score double")
    got = ordering.position(
        df, ["run_id"], [F.col("score").desc(), F.col("frame_idx")],
        ordering.score_buckets(F.col("score"), F.floor(F.col("frame_idx") / 7)), "rank", "total",
    ).collect()
    for run, part in by_run(rows).items():
        want = [r[1] for r in sorted(part, key=lambda r: (-r[2], r[1]))]
        mine = sorted((r for r in got if r.run_id == run), key=lambda r: r["rank"])
        assert [r.frame_idx for r in mine] == want and {r.total for r in mine} == {len(part)}


def test_percentiles(spark):
    rows = hot_rows(2)
    df = spark.createDataFrame(rows, "run_id long, frame_idx long, score double")
    got = {r.run_id: r for r in ordering.percentiles(df, ["run_id"], "score", {"a": 0.5, "b": 0.9}).collect()}
    for run, part in by_run(rows).items():
        values = [r[2] for r in part]
        assert np.isclose(got[run].a, np.percentile(values, 50)) and np.isclose(got[run].b, np.percentile(values, 90))


def test_islands_and_neighbours(spark):
    rows = [(r[0], r[1], "abc"[int(r[2] * 10) % 3 if r[2] > 1 else 0]) for r in hot_rows(3)]
    df = ordering.frame_position(spark.createDataFrame(rows, "run_id long, frame_idx long, label string"))
    df = ordering.neighbour(df, ["run_id"], {"before": ("label", -2), "after": ("label", 1)})
    got = ordering.islands(df, ["run_id"], ["label"]).collect()
    for run, part in by_run(rows).items():
        mine = sorted((r for r in got if r.run_id == run), key=lambda r: r.pos)
        labels = [r[2] for r in part]
        start = 0
        for i, r in enumerate(mine):
            start = i if i == 0 or labels[i] != labels[i - 1] else start
            assert r.island == start
            assert r.before == (labels[i - 2] if i >= 2 else None)
            assert r.after == (labels[i + 1] if i + 1 < len(labels) else None)


def test_merged_spans_are_disjoint_and_cover(spark):
    rnd = random.Random(4)
    rows = [(1, s, s + rnd.choice([0, 10, 50_000])) for s in (rnd.randrange(0, 2_000_000, 1000) for _ in range(150))]
    got = merge_spans(spark.createDataFrame(rows, "run_id long, start_ms long, end_ms long")).collect()
    want, reach = {}, None
    for s, e in sorted((s, e) for _, s, e in rows):
        if reach is None or s > reach:
            opened, reach = s, e
        reach = max(reach, e)
        want[(s, e)] = opened
    assert {(r.start_ms, r.end_ms): r.island for r in got} == want


def test_interval_join_equals_nested_loop(spark):
    rnd = random.Random(5)
    points = [(rnd.randint(1, 2), i, rnd.randrange(0, 3_000_000, 500)) for i in range(80)]
    spans = [(rnd.randint(1, 2), i, s, s + rnd.choice([0, 500, 9000, 700_000, 90_000_000])) for i, s in ((i, rnd.randrange(0, 3_000_000, 500)) for i in range(80))]
    p = spark.createDataFrame([(r, i, t - 5000, t + 5000) for r, i, t in points], "run_id long, p long, a long, b long")
    s = spark.createDataFrame(spans, "run_id long, s long, c long, d long")
    rules = {
        "none": lambda a, b, c, d: c < b and d > a,
        "both": lambda a, b, c, d: c <= b and d >= a,
        "start": lambda a, b, c, d: c <= b and d > a,
    }
    for closed, rule in rules.items():
        got = sorted((r.p, r.s) for r in interval_join(p, s, ["run_id"], ("a", "b"), ("c", "d"), closed).collect())
        want = sorted((i, j) for r, i, t in points for q, j, c, d in spans if r == q and rule(t - 5000, t + 5000, c, d))
        assert got == want


def test_prune_equals_loop(spark):
    rnd = random.Random(6)
    rows = [(1, i, [rnd.random() * 255 for _ in range(4)] if rnd.random() > 0.1 else None, rnd.random() < 0.1) for i in range(120)]
    rows[0] = (1, 0, [0.0] * 4, False)
    df = spark.createDataFrame(rows, "run_id long, frame_idx long, thumb array<double>, is_keyframe boolean")
    got = sorted(r.frame_idx for r in folds.prune_redundant(df, threshold=0.7).collect())
    kept, last = [0], np.array(rows[0][2])
    for _, i, thumb, key in rows[1:]:
        if thumb is None:
            kept.append(i)
            continue
        if key or 1 - np.abs(last - np.array(thumb)).mean() / 255 < 0.7:
            kept.append(i)
            last = np.array(thumb)
    assert got == kept


def test_unreadable_first_thumbnail_keeps_everything(spark):
    rows = [(1, i, None if i == 0 else [1.0, 1.0], False) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id long, frame_idx long, thumb array<double>, is_keyframe boolean")
    assert folds.prune_redundant(df).count() == 60


def test_token_passes_of_many_blocks(spark, monkeypatch):
    """One run of 64 blocks settles in a few rounds and equals the plain loop."""
    rows = [(1, i, 900 + (i * 7919) % 5000, (i * 104729) % 700, 1 + i % 4, (i * 31) % 900) for i in range(64 * 25)]
    df = spark.createDataFrame(
        rows, "run_id long, chunk_id long, prompt_tokens long, completion_tokens long, n_images long, entity_length long"
    )
    rounds = []
    real = folds.checkpointed
    monkeypatch.setattr(folds, "checkpointed", lambda d: rounds.append(1) or real(d))
    got = passes.token_passes(df, 60_000).collect()
    assert len(rounds) <= 2 + 2 * 8
    image, reply, spent, number, want = 1500, 500, 0, 0, []
    for run, chunk, prompt, said, n, length in rows:
        fixed = 600 + max(50, length // 3)
        size = max(2, min(50, (60_000 - fixed - reply) // max(1, image)))
        image = int(0.3 * image + 0.7 * max(500, (prompt - fixed) / n))
        reply = int(0.3 * reply + 0.7 * said) if said else reply
        spent += prompt + said
        want.append((run, chunk, number, spent, image, reply, size))
        if spent + fixed + size * image + reply > 60_000:
            number, spent = number + 1, 0
    assert sorted(tuple(r) for r in got) == want


def test_percentiles_with_an_outlier_split_only_the_cell_that_matters(spark, monkeypatch):
    """One far value puts all others into one cell: it is cut again, and no window sees more than its cells."""
    rnd = random.Random(12)
    values = [rnd.random() for _ in range(3000)] + [1e12, -1e300]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 5.0)] * 50 + [(3, float("nan")), (3, None), (3, 1.0)], "run_id long, v double")
    monkeypatch.setattr(ordering, "CELLS", 16)
    rounds = []
    real = ordering.Scratch.keep
    monkeypatch.setattr(ordering.Scratch, "keep", lambda self, d, name: rounds.append(name) or real(self, d, name))
    got = {r.run_id: r for r in ordering.percentiles(df, ["run_id"], "v", {"a": 0.5, "b": 0.9, "c": 1.0, "d": 0.0}).collect()}
    assert np.isclose(got[1].a, np.percentile(values, 50)) and np.isclose(got[1].b, np.percentile(values, 90))
    assert (got[1].c, got[1].d) == (1e12, -1e300) and (got[2].a, got[3].a) == (5.0, 1.0)
    assert rounds.count("ranks") < 12


def test_ranks_of_a_constant_score_are_spread(spark):
    """All rows of a run share a score off any grid; range partitions cut the run all the same."""
    rows = [(1, i, 0.123456789) for i in range(2000)] + [(2, i, float(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "run_id long, frame_idx long, score double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.ranked(df, ["run_id"], [F.col("score").desc(), F.col("frame_idx")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for run, part in by_run(rows).items():
        want = [r[1] for r in sorted(part, key=lambda r: (-r[2], r[1]))]
        assert [r.frame_idx for r in sorted((r for r in got if r.run_id == run), key=lambda r: r["rank"])] == want


def test_frame_comparison_has_few_exchanges(spark):
    """Frames and detections are laid out once each; one row per block crosses a block edge."""
    from conftest import DATA

    from cinetrace.bindings import Tables
    from cinetrace.operators import frames

    t = Tables(spark, DATA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = frames.frame_scores(t.frames(), t.detections())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = [x for x in plan.splitlines() if "Exchange" in x and "Reused" not in x]
    assert len(lines) <= 5, plan


def test_registry_log_is_no_longer_than_its_changes(spark):
    """Snapshots grow with the changes, not with chunks times entities."""
    from cinetrace.plans import context

    rnd = random.Random(8)
    rows = [(1, c, f"E{rnd.randrange(12)}", f"v{c}") for c in range(0, 900, 3)] + [(2, 5, "E1", "x")]
    mentions = spark.createDataFrame(rows, "run_id long, chunk_id long, id string, description string")
    chunks = spark.createDataFrame([(r, c) for r in (1, 2, 3) for c in range(0, 905, 7)], "run_id long, chunk_id long")
    log = context.registry_log(mentions)
    snapshots = context.registry_snapshots(log)
    assert snapshots.count() <= len(rows)
    got = {(r.run_id, r.chunk_id, r.id): r.description for r in context.registry_of(log, snapshots, chunks).collect()}
    want = {}
    for run, chunk in ((r, c) for r in (1, 2, 3) for c in range(0, 905, 7)):
        for r, c, i, d in rows:
            if r == run and c < chunk:
                want[run, chunk, i] = d
    assert got == want
