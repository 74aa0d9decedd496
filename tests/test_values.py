"""Hand-checked values."""

import pytest
from pyspark.sql import functions as F

from cinetrace.functions import times
from cinetrace.functions.geometry import iou, playback_time
from cinetrace.functions.text import jaccard, slug, token_estimate, truncate_middle
from cinetrace.operators import behavior, captions, folds, frames, masks, replies, spans
from cinetrace.operators.intervals import in_time_range, pad_and_merge
from cinetrace.plans import context, media


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def span_frame(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "run_id long, start_ms long, end_ms long, label string")


def merged(spark, rows, pad=1500):
    got = pad_and_merge(span_frame(spark, rows), pad).collect()
    return sorted((r.start_ms, r.end_ms, r.label) for r in got)


@pytest.mark.parametrize(
    "rows, want",
    [
        # padded by 1,500 on either side, cut at 0
        ([(42_000, 47_250, "perch")], [(40_500, 48_750, "perch")]),
        ([(1_100, 1_900, "perch")], [(0, 3_400, "perch")]),
        # 20,000-24,100 and 24,100-30,500 touch; 33,000 is beyond them
        ([(21_500, 22_600, "p"), (25_600, 29_000, "q"), (34_500, 35_000, "r")], [(20_000, 30_500, "p + q"), (33_000, 36_500, "r")]),
        # labels in order of first appearance, each once
        ([(9_000, 9_100, "z"), (8_000, 8_100, "b"), (8_500, 8_600, "z")], [(6_500, 10_600, "b + z")]),
        # ends given in the wrong order
        ([(77_000, 71_000, "swap")], [(69_500, 78_500, "swap")]),
    ],
)
def test_pad_and_merge(spark, rows, want):
    assert merged(spark, rows) == want


def test_other_padding(spark):
    assert merged(spark, [(300, 310, "a"), (331, 340, "b")], 10) == [(290, 320, "a"), (321, 350, "b")]
    assert merged(spark, [(300, 310, "a"), (331, 340, "b")], 11) == [(289, 351, "a + b")]


def test_merge_opened_by_a_tied_start(spark):
    rows = [(0, 1000, "a"), (5000, 5000, "b"), (5000, 9000, "c"), (5000, 5000, "d")]
    assert [r[:2] for r in merged(spark, rows, 0)] == [(0, 1000), (5000, 9000)]


def clip_run(spark):
    labels = spark.createDataFrame(
        [(1, n, n * 400, "nesting", 0.75, None, "default") for n in (100, 101, 102, 103)],
        "run_id long, frame_idx long, timestamp_ms long, behavior string, confidence double, note string, profile_name string",
    )
    events = spark.createDataFrame(
        [
            (1, 0, "chase", ["owl_7"], "00:12", "00:14", "", 0.5),
            (1, 1, "group", ["owl_7", "hare_2"], "00:37", "00:39", "", 0.5),
        ],
        "run_id long, ev_idx long, type string, entities array<string>, start_time string, end_time string, description string, confidence double",
    )
    return labels, events


def test_clip_selection(spark):
    labels, events = clip_run(spark)

    def pick(entity=None, name=None, time=None):
        s = spans.all_spans(events, behavior.label_spans(labels, name), entity, name)
        s = s if time is None else in_time_range(s, *time)
        return sorted((r.start_ms, r.end_ms, r.label) for r in pad_and_merge(s).collect())

    # labels run from 40,000 to 41,200, the second event ends at 39,000: padded they overlap
    assert pick() == [(10_500, 15_500, "chase: owl_7"), (35_500, 42_700, "group: owl_7, hare_2 + nesting")]
    assert pick(entity="hare_2") == [(35_500, 40_500, "group: owl_7, hare_2")]
    assert pick(name="nesting") == [(38_500, 42_700, "nesting")]
    assert pick(time=(13_000, 20_000)) == [(10_500, 15_500, "chase: owl_7")]
    assert pick(name="preening") == []


def highlights(spark, rows, **kw):
    df = spark.createDataFrame(
        [(1, i, ts, float(d)) for i, (ts, d) in enumerate(rows)], "run_id long, frame_idx long, timestamp_ms long, delta_score double"
    )
    return sorted((r.start_ms, r.end_ms) for r in folds.highlight_spans(df, **kw).collect())


def test_highlights(spark):
    # best first: 40 s, then 43 s ends within 3 s of it, then 50 s; 60 s is not needed for 6 s
    run = [(40_000, 30), (43_000, 29), (50_000, 20), (60_000, 10)]
    assert highlights(spark, run, target_s=6.0) == [(38_500, 41_500), (48_500, 51_500)]
    assert highlights(spark, run, target_s=6.1) == [(38_500, 41_500), (48_500, 51_500), (58_500, 61_500)]
    assert highlights(spark, [(700, 3)]) == [(0, 2_200)]
    assert highlights(spark, []) == []


def test_highlights_in_rounds(spark):
    run = [(i * 130, (i * 37) % 211) for i in range(240)]
    whole = highlights(spark, run, target_s=14.0)
    assert highlights(spark, run, target_s=14.0, at_once=3) == whole and len(whole) >= 4


def test_highlights_of_a_static_run(spark):
    """All scores equal: frames go by index, and each round clears what clashes."""
    assert highlights(spark, [(i * 10, 1) for i in range(2_000)], target_s=9.0, at_once=50) == [
        (0, 1_500), (4_500, 7_500), (10_500, 13_500), (16_500, 19_500)
    ]


def test_touching_highlights_without_gap(spark):
    assert highlights(spark, [(11_000, 5), (14_000, 4), (17_001, 3)], gap_s=0.0) == [(9_500, 12_500), (15_501, 18_501)]


def test_scorer_prefers_what_is_new(spark):
    f = spark.createDataFrame(
        [(1, i, i * 700, False, 0.2) for i in range(4)],
        "run_id long, frame_idx long, timestamp_ms long, is_keyframe boolean, delta_score double",
    )
    seen = {0: ["bike"], 1: ["bike"], 2: ["bike", "tram"], 3: ["bike", "tram"]}
    d = spark.createDataFrame(
        [(1, i, i * 10 + j, j, c, 0.3, 0.3, 0.5, 0.5, 0.8) for i, classes in seen.items() for j, c in enumerate(classes)],
        "run_id long, frame_idx long, detection_id long, track_id long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double",
    )
    got = {r.frame_idx for r in frames.select_scored(frames.frame_scores(f, d), k=2).collect()}
    assert 2 in got and len(got) == 2


def test_threshold(spark):
    f = spark.createDataFrame([(1, i, float(i + 1)) for i in range(10)], "run_id long, frame_idx long, delta_score double")
    assert frames.escalation_threshold(f).first().threshold == pytest.approx(9.1)


@pytest.mark.parametrize(
    "a, b, want",
    [("red kite soars", "soars kite red", 1.0), ("kite", "owl", 0.0), ("one two three four", "one two five", 0.4), ("", "", 1.0), ("", "owl", 0.0)],
)
def test_jaccard(spark, a, b, want):
    assert value(spark, jaccard(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_token_estimate(spark):
    texts = ["", "z", "kit", "kites", "kestrel", "k" * 3_001]
    assert [value(spark, token_estimate(F.lit(s))) for s in texts] == [len(s) // 3 for s in texts]


def test_truncate(spark):
    assert value(spark, truncate_middle(F.lit("x" * 100), F.lit(0))) == ""
    cut = value(spark, truncate_middle(F.lit("x" * 100), F.lit(60)))
    assert len(cut) <= 60 and "trimmed" in cut


@pytest.mark.parametrize("keep, want", [(0, list(range(10))), (-1, list(range(10))), (1, [0]), (2, [0, 9])])
def test_thin_lines(spark, keep, want):
    lines = spark.range(10).select(F.lit(1).alias("run_id"), F.col("id").alias("pos"), F.lit(10).cast("long").alias("total"))
    assert sorted(r.pos for r in context.thin_lines(lines, keep).collect()) == want


def test_thin_lines_count(spark):
    lines = spark.range(100).select(F.lit(1).alias("run_id"), F.col("id").alias("pos"), F.lit(100).cast("long").alias("total"))
    assert context.thin_lines(lines, 10).count() == 10


def test_fit_blocks_budget(spark):
    dense = "\n".join(f"line {i} of the dense timeline" for i in range(200))
    df = spark.createDataFrame([(1, dense, "t" * 900, "c" * 900)], "run_id long, dense string, transcript string, captions string")
    row = context.fit_blocks(df, 700).first()
    lines = row.dense.split("\n")
    assert lines[0].startswith("line 0 ") and lines[-1].startswith("line 199 ") and len(lines) < 200
    assert len(row.transcript) == 900 and sum(len(x) // 3 for x in row[1:]) <= 700
    row = context.fit_blocks(df, 300).first()
    assert len(row.dense.split("\n")) >= 6 and sum(len(x) // 3 for x in row[1:]) <= 300


@pytest.mark.parametrize(
    "ms, want", [(0, "00:00.00"), (59996, "00:60.00"), (61235, "01:01.24"), (8625, "00:08.62"), (235, "00:00.23")]
)
def test_clock_text(spark, ms, want):
    assert value(spark, times.clock_text(F.lit(ms).cast("bigint"))) == want


def test_clock_text_prints_like_binary_rounding(spark):
    got = spark.range(0, 60000, 5).select("id", times.clock_text(F.col("id")).alias("t")).collect()
    assert [r.t for r in got] == [f"00:{r.id / 1000.0:05.2f}" for r in got]


@pytest.mark.parametrize("t, strip, src, want", [(40, 25, 100, 10), (200, 25, 100, 25), (-5, 25, 100, 0), (3, 25, 0, 0), (20, 100, 10, 100)])
def test_playback_time(spark, t, strip, src, want):
    assert value(spark, playback_time(F.lit(float(t)), F.lit(float(strip)), F.lit(float(src)))) == pytest.approx(want)


def test_slug(spark):
    assert value(spark, slug(F.lit("Dog & Cat: play!"))) == "dog_cat_play"
    assert value(spark, slug(F.lit("!!"))) == "event"


def reply(spark, text):
    return spark.createDataFrame([(1, 1, text)], "run_id long, unit_id long, text string")


@pytest.mark.parametrize(
    "text, want",
    [
        ("FRAME: a dog\nCHANGE: moved", ("a dog", "moved")),
        ("frame: a dog", ("a dog", None)),
        ("just text\nmore", ("just text", None)),
        ("", ("(no caption)", None)),
    ],
)
def test_two_lines(spark, text, want):
    assert tuple(replies.two_lines(reply(spark, text)).first()[2:]) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("VERDICT: AGREE\nCAPTION: ok", (True, "ok")),
        ("VERDICT: DISAGREE\nCAPTION: a cat", (False, "a cat")),
        ("nothing here", (True, "nothing here")),
        ("", (True, "(no caption)")),
        ("verdict: disagree\ncaption: low", (False, "low")),
    ],
)
def test_verdict(spark, text, want):
    assert tuple(replies.verdicts(reply(spark, text)).first()[2:]) == want


@pytest.mark.parametrize(
    "text, entities",
    [
        ('{"entities": [{"id": "E1", "type": "dog", "description": "d"}], "summary": "s"}', 1),
        ('Here:\n```json\n{"entities": [{"id": "E1", "type": "dog", "description": "d"},]}\n```', 1),
        ("<think>{x}</think>{'entities': [{'id': 'E1', 'type': 'dog', 'description': 'd'}]} tail }", 1),
        ("no json at all", 0),
        ('{"entities": [', 0),
    ],
)
def test_analysis_reply(spark, text, entities):
    parsed = replies.parse_analysis(reply(spark, text))
    assert replies.valid_entities(parsed).count() == entities
    assert (parsed.first().problem is None) == (entities > 0)


def test_masks(spark):
    df = spark.createDataFrame([(1, [1, 0, 0, 1])], "run_id long, mask array<int>")
    assert masks.encode(df, 2, 2).first().counts == [0, 1, 2, 1]
    bad = spark.createDataFrame(
        [(1, '{"size":[2,2],"counts":[1,1]}'), (2, '{"size":[2,2],"counts":[5,-1]}'), (3, "junk")], "run_id long, mask_rle string"
    )
    good, rejected = masks.decode(bad)
    assert good.count() == 0 and rejected.count() == 3


def test_plan(spark):
    facts = spark.createDataFrame(
        [(1, 180.0, True), (2, 181.0, False), (3, 0.0, False)], "run_id long, duration_s double, has_audio boolean"
    )
    plans = {r.run_id: r for r in media.derive_plan(facts).collect()}
    assert [plans[i].detector_size for i in (1, 2, 3)] == ["x", "n", "x"]
    assert (plans[3].detect_fps, plans[3].caption_fps) == (1.0, 0.5)
    assert (plans[1].chunk_size, plans[1].dedup_threshold) == (10, 0.92)


def caption_rows(spark, rows):
    return spark.createDataFrame(
        rows, "run_id long, frame_idx long, timestamp_ms long, caption string, escalated boolean, verifier_caption string, verifier_agrees boolean"
    )


def test_dense_timeline(spark):
    rows = [
        (1, i, i * 1000, f"frame {i}", i in (0, 3, 7), "verified frame 5" if i == 5 else None, {5: False, 2: True}.get(i))
        for i in range(10)
    ]
    few = captions.dense_timeline(caption_rows(spark, rows), 5).collect()
    assert len(few) <= 5 and {0, 3, 7} <= {r.frame_idx for r in few}
    text = {r.frame_idx: r.text for r in captions.dense_timeline(caption_rows(spark, rows), 100).collect()}
    assert text[5] == "verified frame 5" and text[2] == "frame 2"


def test_overlap_is_strict(spark):
    f = spark.createDataFrame([(1, 0, 60_000)], "run_id long, frame_idx long, timestamp_ms long")
    rows = [(1, 4, 50_000, 57_500), (1, 5, 50_000, 57_501), (1, 6, 62_499, 80_000), (1, 7, 62_500, 80_000)]
    a = spark.createDataFrame(rows, "run_id long, segment_id long, start_ms long, end_ms long")
    assert sorted(r.segment_id for r in captions.speech_around(f, a, 2_500).collect()) == [5, 6]


def test_one_pick_is_the_first(spark):
    f = spark.createDataFrame([(1, i) for i in range(9)], "run_id long, frame_idx long")
    assert [r.frame_idx for r in frames.linspace_pick(f, 1).collect()] == [0]


def test_marked_fence_goes_first(spark):
    text = 'see ```sh\nls {a}\n``` and\n```json\n{"entities": [{"id": "E9", "type": "t", "description": "d"}]}\n```'
    assert replies.valid_entities(replies.parse_analysis(reply(spark, text))).first().id == "E9"


def test_inverted_boxes_have_no_area(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), v)])
    assert value(spark, iou(box(0.9, 0.1, 0.2, 0.8), box(0.0, 0.0, 0.5, 0.5))) == 0.0


def test_registry_versions_stay_open_at_any_chunk_number(spark):
    mentions = spark.createDataFrame([(1, 5, "E1", "owl"), (1, 2**33, "E2", "hare")], "run_id long, chunk_id long, id string, description string")
    chunks = spark.createDataFrame([(1, 6), (1, 2**33), (1, 2**33 + 4)], "run_id long, chunk_id long")
    got = context.registry_at(context.registry_versions(mentions), chunks).collect()
    assert sorted((r.chunk_id, r.id) for r in got) == [(6, "E1"), (2**33, "E1"), (2**33 + 4, "E1"), (2**33 + 4, "E2")]


def test_every_catalogue_module_loads_in_any_order():
    import subprocess
    import sys
    from pathlib import Path

    code = "import cinetrace.catalog.search as s; import __spark_entry__ as e; assert 'win8_pad_merge' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)


def test_camera_mode_reads_its_matches_once(spark, monkeypatch):
    """The first pairs of a run are few: their median takes no rounds over stored tables."""
    from cinetrace.operators import ordering

    kept, real = [], ordering.Scratch.keep
    monkeypatch.setattr(ordering.Scratch, "keep", lambda *a: kept.append(1) or real(*a))
    nan = float("nan")
    rows = [(1, 0, 1.0), (1, 0, 3.0), (1, 1, 8.0), (1, 2, 5.0), (1, 30, 90.0), (2, 0, 4.0), (2, 1, 7.0), (2, 2, nan), (3, 40, 9.0), (4, 0, None), (4, None, 9.0)]
    matches = spark.createDataFrame(rows, "run_id long, pair long, displacement double").withColumn("width", F.lit(100.0))
    got = {r.run_id: (r.median_move, r.camera_mode) for r in frames.camera_mode(matches).collect()}
    assert got == {1: (5.0, "static"), 2: (5.5, "moving"), 3: (0.0, "static"), 4: (0.0, "static")}
    assert not kept


def test_frames_travel_as_one_row_to_the_next(spark):
    """Classes shared with the frame before and of one of both only; an unknown class is one, repeats are not."""
    from cinetrace.operators import detections

    rows = [(1, 0, "a"), (1, 0, "a"), (1, 0, None), (1, 1, "a"), (1, 1, "b"), (1, 2, None), (1, 4, "a"), (2, 1, "a"), (2, 2, "a")]
    seen = spark.createDataFrame(rows, "run_id long, frame_idx long, class_name string")
    got = sorted(tuple(r) for r in detections.set_differences(seen).collect())
    assert got == [(1, 1, 1, 2), (1, 2, 0, 3), (2, 2, 1, 0)]


def test_features_read_detections_once(spark):
    """Detections are scanned once, also where the last frame of a block is carried into the next one."""
    from cinetrace.operators import frames as fr

    frames = spark.range(30).selectExpr("id % 2 AS run_id", "id * 3 AS frame_idx", "id AS timestamp_ms", "false AS is_keyframe", "0.0D AS delta_score")
    rows = [(f["run_id"], f["frame_idx"], f["frame_idx"] * 10 + k, k, f"c{(f['frame_idx'] // 9 + k) % 3}", 0.0, 0.0, 1.0, 1.0) for f in frames.collect() for k in range(2)]
    seen = spark.createDataFrame(rows, "run_id long, frame_idx long, detection_id long, track_id long, class_name string, x1 double, y1 double, x2 double, y2 double")
    got = fr.frame_features(frames, seen)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("detection_id#") > 0
    scans = [line for line in got._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").splitlines() if "detection_id#" in line]
    assert len(scans) == 1, scans
    by_run = {run: sorted(r[1] for r in rows if r[0] == run and r[3] == 0) for run in (0, 1)}
    classes = {}
    for r in rows:
        classes.setdefault((r[0], r[1]), set()).add(r[4])
    want = {}
    for run, order in by_run.items():
        for i, f in enumerate(order):
            want[run, f] = len(classes[run, f] ^ classes[run, order[i - 1]]) if i else 0
    assert {(r.run_id, r.frame_idx): r.class_change for r in got.collect()} == want


def test_documents_of_small_and_large_runs(spark):
    """Boxes are joined to frames only; parts hold every entry once, in the order of ids, for runs on both sides of blockRows."""
    from cinetrace.sources import export as ex

    sizes = {1: 2, 2: 20}  # blockRows is 7 in tests
    frames = spark.createDataFrame([(r, i, i * 10, f"a/{i}.jpg") for r, n in sizes.items() for i in range(n)], "run_id long, frame_idx long, timestamp_ms long, image_path string")
    boxes = [(r, i, 1000 * i - k, "ba"[k], 0.0, 0.0, 0.5, 0.5, 0.9, 1.0) for r, n in sizes.items() for i in range(n) for k in range(2)]
    seen = spark.createDataFrame(boxes, "run_id long, frame_idx long, detection_id long, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double, mean_depth double")
    boxed = ex.annotations(frames, seen)
    joins = [line for line in boxed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("class_name" in line for line in joins), joins
    spark.conf.set("cinetrace.partRows", "6")
    try:
        docs = ex.annotation_documents(ex.images(frames), boxed, ex.categories(seen)).collect()
    finally:
        spark.conf.unset("cinetrace.partRows")
    for r, n in sizes.items():
        parts = sorted((d for d in docs if d.run_id == r), key=lambda d: d.part)
        assert all(len(d[k]) <= 6 for d in parts for k in ("images", "annotations", "categories"))
        assert [e.id for d in parts for e in d.annotations] == sorted(b[2] for b in boxes if b[0] == r)
        assert [e.id for d in parts for e in d.images] == list(range(n))
        assert [(e.id, e.name) for d in parts for e in d.categories] == [(1, "a"), (2, "b")]
        assert {e.id: e.category_id for d in parts for e in d.annotations} == {b[2]: 1 + (b[3] == "b") for b in boxes if b[0] == r}


def test_registry_blocks_from_lists(spark):
    """The lists of chunks give the texts that their rows give, and no row is made per chunk and entity."""
    from cinetrace.plans import context

    mentions = spark.createDataFrame([(1, c, f"E{c * 7 % 5}", f"d{c}") for c in range(40)], "run_id long, chunk_id long, id string, description string")
    chunks = spark.range(45).selectExpr("1L AS run_id", "id AS chunk_id")
    versions = context.registry_versions(mentions)
    listed = context.registry_at(versions, chunks, listed=True)
    assert listed.count() == 44  # all but the first one
    got = context.registry_blocks(listed, chunks)
    assert "Generate" not in listed._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    want = context.registry_blocks(context.registry_at(versions, chunks), chunks)
    texts = lambda df: {r.chunk_id: r.block for r in df.collect()}
    assert texts(got) == texts(want)
    assert "  E0: d35\n" in texts(got)[44] and "E1" not in texts(got)[1]


def test_registry_of_a_block_is_sorted_once(spark):
    """Not for every chunk, and not once more per element of its list; answers are those of a plain walk."""
    import random

    rnd = random.Random(5)
    told = [(run, c, f"E{rnd.randrange(6)}", f"d{c}") for run in (1, 2) for c in range(0, 60, rnd.choice([1, 2]))]
    mentions = spark.createDataFrame(told, "run_id long, chunk_id long, id string, description string")
    chunks = spark.createDataFrame([(run, c) for run in (1, 2, 3) for c in range(0, 70, 3)], "run_id long, chunk_id long")
    got = context.registry_at(context.registry_versions(mentions), chunks)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1 and "sort_array" not in "".join(line for line in plan.splitlines() if " Filter " in line)
    want = set()
    for run, chunk in ((r.run_id, r.chunk_id) for r in chunks.collect()):
        known = {i: d for r, c, i, d in told if r == run and c < chunk}
        want |= {(run, chunk, i, d) for i, d in known.items()}
    rows = [tuple(r) for r in got.select("run_id", "chunk_id", "id", "description").collect()]
    assert len(rows) == len(want) and set(rows) == want
