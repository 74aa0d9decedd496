"""Order-dependent passes whose state depends on everything before a row.

A run is cut into blocks of ``foldRows`` rows that are folded in parallel, each from a guessed
state.  Blocks whose true entry state turns out different are folded again until none
changes; by induction from the first block the result then equals the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cinetrace.operators.ordering import first_n, frame_position
from cinetrace.settings import fold_rows
from cinetrace.sources.readers import checkpointed

State = list[float] | None
Step = Callable[[State, bool, dict[str, np.ndarray]], tuple[dict[str, Sequence], State]]

PACK_ROWS = 65536  # rows of blocks that travel to Python together


def packed(rows: int, block: Sequence[str]) -> Column:
    """Of a block the pack it travels in, where all blocks hold ``rows`` rows.

    Most runs are shorter than a block.  A call per run would cost more than its rows, so whole blocks
    share a call; packs do not grow with the input, there are more of them.
    """
    return F.pmod(F.xxhash64(*block), F.lit(max(1, -(-rows // PACK_ROWS)))).alias("pack")


def each_block(pdf: pd.DataFrame, block: Sequence[str], order: Sequence[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Blocks of a pack with their keys: the columns of each in ``order``."""
    if not len(pdf):
        return
    pdf = pdf.sort_values([*block, *order])
    columns = {c: pdf[c].to_numpy() for c in pdf.columns}
    new = np.zeros(len(pdf), bool)
    for c in block:
        new[1:] |= columns[c][1:] != columns[c][:-1]
    new[0] = True
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.append(starts[1:], len(pdf))):
        yield tuple(columns[c][a] for c in block), {c: v[a:b] for c, v in columns.items()}


def put_together(parts: list[dict[str, Sequence]], names: Sequence[str]) -> pd.DataFrame:
    """One table of the rows that blocks gave."""
    return pd.DataFrame({c: np.concatenate([np.asarray(p[c]) for p in parts]) if parts else [] for c in names})


def carried_fold(
    df: DataFrame, keys: Sequence[str], order: str, step: Step, out: str, columns: Sequence[str]
) -> DataFrame:
    """Fold every key's rows in ``order``.

    ``step(state, first, rows)`` gets the entry state (None: unknown or start), whether the block
    opens its key, and the columns of the block's rows in order; it returns the columns of the output
    rows and the exit state (None: as it was on entry).
    ``out`` is the schema of the output rows, ``columns`` the input columns it reads.  Each output
    row also gets ``block``, the number of its block.  Rounds are few where states from different
    guesses fall into step inside a block.
    """
    keys = list(keys)
    size = fold_rows(df)
    rows = frame_position(df.select(*keys, order, *[c for c in columns if c != order]), "__pos", order, keys=keys)
    rows = rows.withColumn("__blk", F.floor(F.col("__pos") / size)).drop("__pos")
    block = [*keys, "__blk"]
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    names = T.StructType.fromDDL(out).names
    pack = packed(rows.count(), block)

    def folded_of(pdf: pd.DataFrame, entered: pd.DataFrame | None) -> Iterator[tuple]:
        """Key, output rows and exit state of each block; with ``entered`` only of the blocks that it names."""
        entry = {} if entered is None else dict(zip(zip(*[entered[c] for c in block]), entered["entry"]))
        for key, own in each_block(pdf, block, [order]):
            if entered is None or key in entry:
                value = entry.get(key)
                yield key, *step(None if value is None else [float(x) for x in value], int(key[-1]) == 0, own)

    def exits(pdf: pd.DataFrame, entered: pd.DataFrame | None = None) -> pd.DataFrame:
        heads = [(*key, state) for key, _, state in folded_of(pdf, entered)]
        return pd.DataFrame(heads, columns=[*block, "exit"])

    def outputs(pdf: pd.DataFrame, entered: pd.DataFrame | None = None) -> pd.DataFrame:
        made = [given | {"block": np.full(len(given[names[0]]), int(key[-1]))} for key, given, _ in folded_of(pdf, entered)]
        return put_together(made, [*names, "block"])

    out = f"{out}, block bigint"
    nothing = F.lit(None).cast("array<double>")
    if rows.filter("__blk > 0").isEmpty():
        return rows.groupBy(pack).applyInPandas(lambda pdf: outputs(pdf), out)

    exit_ddl = f"{key_ddl}, __blk bigint, exit array<double>"
    folded = rows.groupBy(pack).applyInPandas(lambda pdf: exits(pdf), exit_ddl)
    states = checkpointed(folded.withColumn("entry", nothing))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        linked = states.withColumn("new_entry", F.last("exit", True).over(before))
        stale = linked.filter(~F.col("entry").eqNullSafe(F.col("new_entry"))).select(*block, "new_entry")
        stale = checkpointed(stale)
        if stale.isEmpty():
            break
        again = (
            rows.join(stale.select(*block), block)
            .groupBy(pack)
            .cogroup(stale.withColumnRenamed("new_entry", "entry").groupBy(pack))
            .applyInPandas(lambda pdf, entered: exits(pdf, entered), exit_ddl)
            .withColumnRenamed("exit", "new_exit")
        )
        fresh = stale.join(again, block).select(*block, "new_entry", "new_exit", F.lit(True).alias("hit"))
        states = checkpointed(
            states.join(fresh, block, "left").select(
                *block,
                F.when(F.col("hit"), F.col("new_exit")).otherwise(F.col("exit")).alias("exit"),
                F.when(F.col("hit"), F.col("new_entry")).otherwise(F.col("entry")).alias("entry"),
            )
        )
    entered = states.select(*block, "entry").groupBy(pack)
    return rows.groupBy(pack).cogroup(entered).applyInPandas(lambda pdf, entered: outputs(pdf, entered), out)


def prune_redundant(thumbs: DataFrame, threshold: float = 0.92, scale: float = 255.0) -> DataFrame:
    """Frames kept after dropping those too similar to the last kept one.

    ``thumbs``: run_id, frame_idx, thumb (array, NULL if unreadable), is_keyframe.  Keyframes and
    unreadable frames stay; the latter do not become the reference.  A run whose first
    thumbnail is unreadable keeps everything (exit state ``[nan]``).
    """

    def step(state: State, first: bool, rows: dict[str, np.ndarray]) -> tuple[dict[str, Sequence], State]:
        last = None if state is None else np.asarray(state)
        keep_all = last is not None and last.size == 1 and np.isnan(last[0])
        kept = []
        for at, (thumb, forced) in enumerate(zip(rows["thumb"], rows["is_keyframe"])):
            if keep_all or thumb is None:
                kept.append(True)
                if first and at == 0:
                    keep_all = True
                continue
            now = np.asarray(thumb, dtype="float64")
            similar = (
                last is not None
                and not forced
                and 1.0 - float(np.abs(last - now).mean()) / scale >= threshold
            )
            kept.append(not similar)
            if not similar:
                last = now
        out = {c: rows[c][np.array(kept, bool)] for c in ("run_id", "frame_idx")}
        if keep_all:
            return out, [float("nan")]
        return out, None if last is None else [float(x) for x in last]

    return carried_fold(
        thumbs, ["run_id"], "frame_idx", step, "run_id bigint, frame_idx bigint", ["frame_idx", "thumb", "is_keyframe"]
    ).drop("block")


def highlight_spans(
    frames: DataFrame, target_s: float = 60.0, gap_s: float = 3.0, pad_s: float = 1.5, at_once: int = 1000
) -> DataFrame:
    """Padded spans around the most changing frames, kept apart, up to a total duration.

    Frames are taken best first; a span that overlaps, touches or comes within the gap of an
    accepted one is passed over.  The best ``at_once`` frames of every run are decided in order; then
    all frames that clash with an accepted span are filtered out and the next best are taken, until
    the target is met or no frame is left.  So a row never holds more than ``at_once`` frames, and
    the accepted spans are bounded by the target.
    """
    pad, gap, target = int(pad_s * 1000), int(gap_s * 1000), int(target_s * 1000)
    span = "array<struct<start_ms:bigint,end_ms:bigint>>"

    def clash(a, b):
        meet = (a["start_ms"] <= b["end_ms"]) & (b["start_ms"] <= a["end_ms"])
        near = F.greatest(b["start_ms"] - a["end_ms"], a["start_ms"] - b["end_ms"]) < gap
        return meet | near

    def padded(ts):
        return F.struct(F.greatest(F.lit(0), ts - pad).cast("bigint").alias("start_ms"), (ts + pad).alias("end_ms"))

    def add(acc, f):
        new = padded(f["ts"])
        taken = (acc["total"] < target) & ~F.exists(acc["spans"], lambda s: clash(new, s))
        return F.when(
            taken,
            F.struct(
                (acc["total"] + new["end_ms"] - new["start_ms"]).alias("total"),
                F.concat(acc["spans"], F.array(new)).alias("spans"),
            ),
        ).otherwise(acc)

    order = [F.col("delta_score").desc(), F.col("frame_idx")]
    frames = frames.select("run_id", "frame_idx", "timestamp_ms", "delta_score")
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col("timestamp_ms").alias("ts")))).alias("best")
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast(span).alias("spans"))
    chosen = None
    while True:
        left = frames
        if chosen is not None:
            free = ~F.exists("r.spans", lambda s: clash(padded(F.col("timestamp_ms")), s))
            left = frames.join(chosen.filter(F.col("r.total") < target), "run_id").filter(free).drop("r")
        best = first_n(left, ["run_id"], order, at_once).groupBy("run_id").agg(listed)
        if chosen is None:
            tried = best.select("run_id", F.aggregate("best", start, add).alias("r"), F.size("best").alias("n"))
        else:
            tried = chosen.join(best, "run_id", "left").select(
                "run_id",
                F.when(F.col("best").isNull(), F.col("r")).otherwise(F.aggregate("best", F.col("r"), add)).alias("r"),
                F.coalesce(F.size("best"), F.lit(0)).alias("n"),
            )
        tried = checkpointed(tried)
        chosen = tried.select("run_id", "r")
        if tried.filter((F.col("n") >= at_once) & (F.col("r.total") < target)).isEmpty():
            return chosen.select("run_id", F.inline("r.spans"))
