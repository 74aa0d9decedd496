"""Streaming jobs.  Each has a batch function that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinetrace.operators.captions import counts, latest, latest_verdicts, speech_around
from cinetrace.operators.ordering import first_n, first_per_key
from cinetrace.sources.keyed import FOLDER, RUNS, write_runs
from cinetrace.sources.readers import children, exists, remove


def deduplicated(stream: DataFrame, time_column: str, delay: str = "2 minutes") -> DataFrame:
    """Drop repeated deliveries of a frame.  (An addition: file sources deliver at least once.)"""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["run_id", "frame_idx"])


def live_state(captions: DataFrame, segments: DataFrame, recent: int = 5, pad_ms: int = 1000) -> DataFrame:
    """Per run: current caption, recent frames, speech around now, last verdicts, counts."""
    newest = latest(captions, recent)
    now = newest.filter("rank = 1")
    listed = lambda c: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", c))), lambda s: s[c].cast("string")), ","
    )
    shown = newest.groupBy("run_id").agg(listed("frame_idx").alias("recent"))
    verdicts = latest_verdicts(captions).groupBy("run_id").agg(listed("frame_idx").alias("verdicts"))
    heard = (
        speech_around(now.select("run_id", "frame_idx", "timestamp_ms"), segments, pad_ms)
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("speech"))
    )
    text = lambda c, none: F.when(F.coalesce(F.col(c), F.lit("")) == "", none).otherwise(F.col(c)).alias(c)
    return (
        now.select("run_id", "frame_idx", text("caption", "(no caption)"), text("change_line", "(no change)"))
        .join(shown, "run_id")
        .join(verdicts, "run_id", "left")
        .join(heard, "run_id", "left")
        .join(counts(captions).drop("judged"), "run_id")
        .withColumns({"verdicts": F.coalesce("verdicts", F.lit("")), "speech": F.coalesce("speech", F.lit(0))})
    )


MOST_RUNS = 2000  # touched runs up to which they are named in the scans


def of_runs(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of the touched runs.

    Few runs are named in the scan: of a store in folders by runs only theirs are read, of another one the
    row groups that may hold them.
    """
    named = [r[0] for r in touched.select("run_id").limit(MOST_RUNS + 1).collect() if r[0] is not None]
    if len(named) > MOST_RUNS:
        return rows.join(touched, "run_id", "left_semi").drop(FOLDER)
    if FOLDER in rows.columns:
        rows = rows.filter(F.col(FOLDER).isin(sorted({run // RUNS for run in named}))).drop(FOLDER)
    return rows.filter(F.col("run_id").isin(named))


def live_feed(
    stream: DataFrame, read_captions: Callable[[], DataFrame], read_segments: Callable[[], DataFrame],
    path: str, checkpoint: str, every: str | None = "1 second",
) -> StreamingQuery:
    """Recompute the live state of the runs that each micro-batch touches.

    Results of other runs stay as they are, and their captions and segments are not read.  The state of
    a run lies in the folder of its neighbours, see ``write_runs``.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("run_id").distinct()
        state = live_state(of_runs(read_captions(), touched), of_runs(read_segments(), touched))
        write_runs(state, path, "frame_idx", touched)

    return _started(stream.writeStream.foreachBatch(refresh), checkpoint, every)


def _started(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    """``every`` throttles, None drains what is there."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


WALK_FRAMES = 1024  # frames of a run that share a state
IDLE_MS = 600_000  # event time after its last frame for which a state is kept


PACK_RUNS = 32  # neighbouring runs whose blocks of the same number share a call and a stored value


def _with_states(rows: DataFrame, step: Callable, fields: dict[str, str], out: str, idle: int) -> DataFrame:
    """``step(run_id, block, rows, frames)`` over the new rows of every run and block.

    ``frames`` is what is known of the block, values in the order of ``fields`` by frame_idx, which ``step``
    brings up to date; it gives the rows to put out.  A call of Python costs far more than a short block, so
    blocks of PACK_RUNS neighbouring runs travel and are stored together.  Each is still forgotten by
    itself, once the watermark is ``idle`` past its newest row (``at_ms``).
    """
    rows.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    columns = [name.split()[0] for name in out.split(", ")]

    def call(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        known = _unpacked(*state.get) if state.exists else {}
        new: dict[int, list] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                new.setdefault(int(r.run_id), []).append(r)
        found = []
        for run, given in new.items():
            due, frames = known.get(run, (0, {}))
            found += step(run, int(key[1]), given, frames)
            known[run] = max(due, max(int(r.at_ms) for r in given) + idle), frames
        mark = state.getCurrentWatermarkMs()
        known = {run: k for run, k in known.items() if k[0] >= mark}
        if known:
            state.update(_packed(known, len(fields)))
            state.setTimeoutTimestamp(max(min(due for due, _ in known.values()), 1))
        else:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=columns)

    kept = ", ".join(["run_id array<bigint>, due array<bigint>, n array<int>, frame_idx array<bigint>"] + [f"{c} array<{t}>" for c, t in fields.items()])
    packs = rows.withColumn("pack", F.floor(F.col("run_id") / PACK_RUNS)).groupBy("pack", "block")
    return packs.applyInPandasWithState(call, out, kept, "update", GroupStateTimeout.EventTimeTimeout)


def _packed(known: dict[int, tuple[int, dict]], width: int) -> tuple:
    """Due times and frames by run as lists, those of the frames one after the other."""
    runs, dues, sizes, at = [], [], [], []
    values: list[list] = [[] for _ in range(width)]
    for run, (due, frames) in known.items():
        runs.append(run)
        dues.append(due)
        sizes.append(len(frames))
        for i, now in frames.items():
            at.append(i)
            for column, value in zip(values, now):
                column.append(value)
    return (runs, dues, sizes, at, *values)


def _unpacked(runs: list, dues: list, sizes: list, at: list, *values: list) -> dict[int, tuple[int, dict]]:
    entries = iter(zip(at, zip(*values)))
    return {run: (due, dict(islice(entries, n))) for run, due, n in zip(runs, dues, sizes)}


def _walked(run: int, block: int, rows: list, frames: dict, floor: float) -> list[tuple]:
    """Flags of the frames that arrive or follow one that does; ``frames``: caption, moved, own."""
    changed = set()
    for r in rows:
        at, now = int(r.frame_idx), (r.caption, bool(r.delta_score >= r.threshold), bool(r.own))
        if frames.get(at) != now:
            frames[at] = now
            changed |= {at, at + 1}
    out = []
    for i in sorted(changed & frames.keys()):
        caption, flag, own = frames[i]
        if not own:
            continue
        if i - 1 in frames:
            flag = flag or _overlap(caption, frames[i - 1][0]) < floor
        out.append((run, i, flag))
    return out


def _overlap(one: str | None, other: str | None) -> float:
    a, b = _words(one), _words(other)
    return 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0


def walk(stream: DataFrame, floor: float = 0.3, size: int = WALK_FRAMES, idle_ms: int = IDLE_MS) -> DataFrame:
    """Escalation flags as captions arrive in any order, against the previous frame of the run.

    ``stream``: run_id, frame_idx, caption, delta_score, threshold and, with a watermark, the event time
    ``at``.  A run is cut into blocks of ``size`` frames with a state each, so a long run is walked by
    many tasks; the last frame of a block is sent to the next one too.  A frame is decided against
    the frame before it; one that arrives late, or twice, decides its successor again.  Rows are
    updates, see ``Publication``.  A block's state goes once the watermark is ``idle_ms`` past its
    newest frame, so the state holds the blocks in work and not all that ever were.
    """
    block = F.floor(F.col("frame_idx") / size)
    edge = (F.col("frame_idx") + 1) % size == 0
    sent = stream.withColumn(
        "block", F.explode(F.when(edge, F.array(block, block + 1)).otherwise(F.array(block)))
    ).withColumns({"own": F.col("block") == block, "at_ms": F.unix_millis("at")})
    fields = {"caption": "string", "moved": "boolean", "own": "boolean"}
    return _with_states(sent, partial(_walked, floor=floor), fields, "run_id bigint, frame_idx bigint, escalate boolean", idle_ms)


class Publication:
    """Rows published batch by batch, of which the newest of every key counts.

    Every ``every`` batches the newest rows of all keys are written together, and what they replace is
    removed one round later, when no reader of the snapshot before can need it.  So a reader opens one
    snapshot and fewer than ``every`` batches, however many there have been.  A batch or snapshot that is
    tried again is written again under its own number.
    """

    def __init__(self, path: str, keys: list[str], every: int = 8):
        self.path, self.keys, self.every = path, keys, every

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}-{number:012d}"

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the folders of a kind that are whole."""
        names = [n for n in children(spark, self.path) if n.startswith(f"{kind}-")]
        return sorted(int(n.rsplit("-", 1)[1]) for n in names if exists(spark, f"{self.path}/{n}/_SUCCESS"))

    def folders(self, spark: SparkSession, upto: int | None = None) -> list[str]:
        """What a reader opens: the last snapshot and the batches after it."""
        whole = [n for n in self._numbers(spark, "snapshot") if upto is None or n <= upto]
        last = whole[-1] if whole else -1
        later = [n for n in self._numbers(spark, "batch") if n > last and (upto is None or n <= upto)]
        return [self._folder("snapshot", n) for n in whole[-1:]] + [self._folder("batch", n) for n in later]

    def _newest(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        rows = spark.read.parquet(*self.folders(spark, upto))
        return first_per_key(rows, self.keys, [F.col("published").desc()])

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The sink of a stream, for ``foreachBatch``."""
        spark = batch.sparkSession
        rows = batch.withColumn("published", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").parquet(self._folder("batch", batch_id))
        if (batch_id + 1) % self.every == 0:
            self.compact(spark, batch_id)

    def compact(self, spark: SparkSession, upto: int) -> None:
        earlier = [n for n in self._numbers(spark, "snapshot") if n < upto]
        self._newest(spark, upto).write.mode("overwrite").parquet(self._folder("snapshot", upto))
        if earlier:
            for kind, numbers in (("snapshot", earlier[:-1]), ("batch", self._numbers(spark, "batch"))):
                for n in numbers:
                    if n <= earlier[-1]:
                        remove(spark, self._folder(kind, n))

    def read(self, spark: SparkSession) -> DataFrame:
        return self._newest(spark).drop("published")

    def start(self, rows: DataFrame, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
        """Publish the changed rows of each trigger."""
        return _started(rows.writeStream.outputMode("update").foreachBatch(self.write), checkpoint, every)


def review_queue(captions: DataFrame, attempts: DataFrame, batch: int | None = 8, retries: int = 3) -> DataFrame:
    """Next reviews per run: pending escalations that failed fewer than ``retries`` times.

    Exhausted frames are removed before the limit, so they never hide later ones.  Without
    ``batch`` everything that is left is drained.
    """
    spent = attempts.groupBy("run_id", "frame_idx").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= retries)
    waiting = captions.filter("escalated AND verifier_agrees IS NULL").join(spent, ["run_id", "frame_idx"], "left_anti")
    return waiting if batch is None else first_n(waiting, ["run_id"], [F.col("frame_idx")], batch)


def _queued(run: int, block: int, rows: list, frames: dict, batch: int | None, retries: int) -> list[tuple]:
    """The frames of a block that wait for a review; ``frames``: waiting, failed attempts."""
    for r in rows:
        at = int(r.frame_idx)
        waiting, failed = frames.get(at, (False, 0))
        frames[at] = (waiting, failed + 1) if r.kind == "failed" else (r.kind == "escalated", failed)
    ready = sorted(i for i, (waiting, failed) in frames.items() if waiting and failed < retries)
    return [(run, block, ready[:batch])]


def review_events(captions: DataFrame, attempts: DataFrame) -> DataFrame:
    """What happens to the queue: frames are escalated, settled by a verdict or found fine, and attempts fail.

    Both inputs carry their event time ``at``.
    """
    kind = F.when(F.col("escalated") & F.col("verifier_agrees").isNull(), "escalated").otherwise("settled")
    return captions.select("run_id", "frame_idx", "at", kind.alias("kind")).unionByName(
        attempts.select("run_id", "frame_idx", "at", F.lit("failed").alias("kind"))
    )


def review_stream(
    events: DataFrame, batch: int | None = 8, retries: int = 3, size: int = WALK_FRAMES, idle_ms: int = IDLE_MS
) -> DataFrame:
    """The review queue kept up to date: per run and block of frames the first ``batch`` that wait.

    ``events``: run_id, frame_idx, kind and, with a watermark, ``at``.  A frame leaves the queue with its
    verdict or with its ``retries``-th failure, whichever order they come in.  Published with keys run_id
    and block; ``next_reviews`` puts the blocks together.
    """
    rows = events.withColumns({"block": F.floor(F.col("frame_idx") / size), "at_ms": F.unix_millis("at")})
    step = partial(_queued, batch=batch, retries=retries)
    return _with_states(rows, step, {"waiting": "boolean", "failed": "int"}, "run_id bigint, block bigint, frames array<bigint>", idle_ms)


def next_reviews(published: DataFrame, batch: int | None = 8) -> DataFrame:
    """The next reviews of every run from the published blocks; all of them without ``batch``."""
    waiting = published.select("run_id", F.explode("frames").alias("frame_idx"))
    return waiting if batch is None else first_n(waiting, ["run_id"], [F.col("frame_idx")], batch)


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """Failed attempts per frame, as a running aggregate over a stream of attempts."""
    return attempts.groupBy("run_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"))


def stage_status(events: DataFrame) -> DataFrame:
    """Newest status of every run and stage; works on a table and on a stream."""
    newest = F.max(F.struct("seq", "status", "n_units"))
    return events.groupBy("run_id", "stage").agg(newest.alias("last"), F.count(F.lit(1)).alias("updates")).select(
        "run_id", "stage", "last.seq", "last.status", "last.n_units", "updates"
    )


def stage_status_batch(events: DataFrame) -> DataFrame:
    counted = events.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("updates"))
    return first_per_key(events, ["run_id", "stage"], [F.col("seq").desc()]).join(counted, ["run_id", "stage"])


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what arrived since the last call, then stop."""
    return _started(stream.writeStream.format("parquet").option("path", path), checkpoint, None)


def catch_up(stream: DataFrame, path: str, checkpoint: str) -> None:
    """``append_new``, and wait for its end."""
    append_new(stream, path, checkpoint).awaitTermination()
