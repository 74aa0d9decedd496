"""Token passes along a run: where each pass of a model's context begins and ends.

Two things are carried from chunk to chunk.  The estimates (tokens per image and per reply) change
only with chunks that were measured, so they are folded over those alone.  Where a pass begins
depends on where all passes before it ended; that is settled with jump pointers, in a number of
rounds that grows with the logarithm of the blocks and not with what the passes do.

With S(i) the tokens up to row i and need(i) the estimate for the chunk after it, a pass begun at row a
ends at the first i >= a with S(i) + need(i) > budget + S(a-1).  A row whose need alone exceeds
the budget ends every pass.  Between such rows no row before a passes that threshold, so "first i >= a"
is "first i" and running maxima and prefix sums, both growing, are searched for each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinetrace.operators import folds
from cinetrace.operators.ordering import frame_position
from cinetrace.settings import fold_rows
from cinetrace.sources.readers import Scratch

# First guesses and template sizes of the token bookkeeping.
IMAGE_TOKENS, TEMPLATE_TOKENS, REPLY_TOKENS, ENTITY_TOKENS = 1500, 600, 500, 50
LEAST_PER_IMAGE, OLD, NEW = 500, 0.3, 0.7
LEAST_CHUNK, MOST_CHUNK = 2, 50

BLOCK = ["run_id", "blk"]
_BEYOND = 2**62
_WALKED = (*BLOCK, "chunk_id", "pos", "image_tokens", "reply_tokens", "chunk_size", "spent")


def _estimates(usage: DataFrame) -> DataFrame:
    """run_id, chunk_id, image, reply: the estimates after each chunk that changed them."""
    fixed, n = F.col("fixed"), F.col("n_images")
    measured = (F.col("prompt_tokens") - fixed) / n
    per_image = F.when((F.col("prompt_tokens") > 0) & (n > 0), F.greatest(F.lit(float(LEAST_PER_IMAGE)), measured))
    per_reply = F.when(F.col("completion_tokens") > 0, F.col("completion_tokens").cast("double"))
    both = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in ((0, per_image), (1, per_reply))])
    rows = usage.select("run_id", "chunk_id", F.inline(both)).filter("value IS NOT NULL")

    def step(state, first, rows):
        now = (IMAGE_TOKENS, REPLY_TOKENS)[int(rows["kind"][0])] if state is None else int(state[0])
        out = []
        for value in rows["value"].tolist():
            now = int(OLD * now + NEW * value)
            out.append(now)
        return {c: rows[c] for c in ("run_id", "kind", "chunk_id")} | {"estimate": out}, [float(now)]

    found = folds.carried_fold(
        rows, ["run_id", "kind"], "chunk_id", step, "run_id bigint, kind int, chunk_id bigint, estimate bigint", ["value"]
    )
    value = lambda k, name: F.max(F.when(F.col("kind") == k, F.col("estimate"))).alias(name)
    return found.groupBy("run_id", "chunk_id").agg(value(0, "image"), value(1, "reply"))


def _steps(usage: DataFrame, budget: int) -> DataFrame:
    """Per chunk its position and block, the estimates after it, the chunk size before it, S and need."""
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    entities = F.col("entity_length") if "entity_length" in usage.columns else F.lit(0)
    usage = usage.select(
        "run_id",
        "chunk_id",
        *[number(c) for c in ("prompt_tokens", "completion_tokens", "n_images")],
        (TEMPLATE_TOKENS + F.greatest(F.lit(ENTITY_TOKENS), F.floor(F.coalesce(entities, F.lit(0)) / 3))).cast("bigint").alias("fixed"),
    )
    usage = usage.withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    rows = frame_position(usage.select("run_id", "chunk_id", "fixed", "tokens"), "pos", "chunk_id")
    rows = rows.join(_estimates(usage), ["run_id", "chunk_id"], "left")
    rows = rows.withColumn("blk", F.floor(F.col("pos") / fold_rows(usage)))

    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("pos", c)))[c].alias(c)
    earlier = Window.partitionBy("run_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c, start: F.coalesce(F.last(c, True).over(earlier), F.lit(start)).alias(f"{c}_in")
    entry = rows.groupBy(*BLOCK).agg(last("image"), last("reply"), F.sum("tokens").alias("tokens"))
    entry = entry.select(
        *BLOCK,
        carried("image", IMAGE_TOKENS),
        carried("reply", REPLY_TOKENS),
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_in"),
    )
    inside = Window.partitionBy(*BLOCK).orderBy("pos")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    known = lambda c, frame: F.coalesce(F.last(c, True).over(frame), F.col(f"{c}_in"))
    room = budget - F.col("fixed") - known("reply", before)
    size = F.floor(room / F.greatest(F.lit(1), known("image", before)))
    out = rows.join(entry, BLOCK).select(
        *BLOCK,
        "chunk_id",
        "pos",
        "tokens",
        "fixed",
        known("image", so_far).alias("image_tokens"),
        known("reply", so_far).alias("reply_tokens"),
        F.greatest(F.lit(LEAST_CHUNK), F.least(F.lit(MOST_CHUNK), size)).cast("bigint").alias("chunk_size"),
        (F.col("tokens_in") + F.sum("tokens").over(so_far)).alias("spent"),
    )
    need = F.col("fixed") + F.col("chunk_size") * F.col("image_tokens") + F.col("reply_tokens")
    return out.withColumn("need", need).drop("fixed")


def _local_ends(spent: np.ndarray, tokens: np.ndarray, need: np.ndarray, budget: int) -> np.ndarray:
    """Of each row of a block the row at which a pass begun there ends; their number where it ends later."""
    top, limit = spent + need, spent - tokens + budget
    end = np.full(len(top), len(top))
    start = 0
    for stop in [*(np.flatnonzero(need > budget) + 1), len(top)]:
        reach = np.maximum.accumulate(top[start:stop])
        end[start:stop] = start + np.searchsorted(reach, limit[start:stop], "right")
        start = stop
    return end


def _breakpoints(steps: DataFrame, budget: int) -> DataFrame:
    """run_id, blk, mark, dest: passes begun in a block where S was below ``mark`` end in block ``dest``.

    Each block that raises the running maximum files its mark under the block whose S reaches it; every
    block also learns the first one whose mark lies beyond its own S.  All windows run over blocks.
    """
    top = F.col("spent") + F.col("need")
    blocks = steps.groupBy(*BLOCK).agg(
        F.max(top).alias("top"), F.max("spent").alias("reached"), F.max((F.col("need") > budget).cast("int")).alias("wall")
    )
    along = Window.partitionBy("run_id").orderBy("blk")
    blocks = blocks.withColumn("after", F.sum("wall").over(along)).withColumn("stretch", F.col("after") - F.col("wall"))
    high = F.max("top").over(Window.partitionBy("run_id", "stretch").orderBy("blk"))
    marks = blocks.select("run_id", "stretch", (high - budget).alias("mark"), F.lit(0).alias("kind"), F.col("blk").alias("dest"))
    marks = marks.withColumn("blk", F.lit(None).cast("bigint"))
    ends = blocks.select("run_id", F.col("after").alias("stretch"), F.col("reached").alias("mark"), F.lit(1).alias("kind"), "blk")
    ends = ends.withColumn("dest", F.lit(None).cast("bigint"))
    by_mark = Window.partitionBy("run_id", "stretch").orderBy("mark", "kind", F.coalesce("blk", "dest"))
    later = by_mark.rowsBetween(1, Window.unboundedFollowing)
    both = marks.unionByName(ends).select(
        "*", F.first("blk", True).over(later).alias("home"), F.first("dest", True).over(later).alias("beyond")
    )
    filed = both.filter("kind = 0 AND home IS NOT NULL").select("run_id", F.col("home").alias("blk"), "mark", "dest")
    far = both.filter("kind = 1 AND beyond IS NOT NULL")
    return filed.unionByName(far.select("run_id", "blk", F.lit(_BEYOND).alias("mark"), F.col("beyond").alias("dest")))


def _hops(budget: int):
    """Of each row the last pass start that its chain of passes has inside the block, or the row after the block."""

    def run(pack: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        filed, parts = dict(folds.each_block(marks, BLOCK, ["mark", "dest"])), []
        for key, rows in folds.each_block(pack, BLOCK, ["pos"]):
            before = rows["spent"] - rows["tokens"]
            end = _local_ends(rows["spent"], rows["tokens"], rows["need"], budget)
            n = len(end)
            hop, ends = list(range(n + 1)), end.tolist()
            for a in range(n - 1, -1, -1):
                if ends[a] < n:
                    hop[a] = hop[ends[a] + 1]
            hop = np.array(hop[:n])
            dest = np.full(n, -1)
            if key in filed:
                at = np.searchsorted(filed[key]["mark"], before, "right")
                dest = np.where((end == n) & (at < len(filed[key]["dest"])), np.append(filed[key]["dest"], -1)[at], -1)
            parts.append(
                {c: rows[c] for c in (*BLOCK, "pos")}
                | {"hop": rows["pos"][0] + hop, "leaves": hop == n, "limit": before + budget, "dest": dest}
            )
        out = folds.put_together(parts, [*BLOCK, "pos", "hop", "leaves", "limit", "dest"])
        return out.assign(dest=out["dest"].astype("Int64").where(out["dest"] >= 0))

    return run


def _arrive(pack: pd.DataFrame, waiting: pd.DataFrame) -> pd.DataFrame:
    """Where passes that began in another block end in this one; the next begins a row later."""
    pair = ["run_id", "dest", "blk"]
    come, parts = dict(folds.each_block(waiting, pair, ["pos"])), []
    for key, rows in folds.each_block(pack, pair, ["pos"]):
        own = come[key]
        at = np.searchsorted(np.maximum.accumulate(rows["top"]), own["limit"], "right")
        parts.append({"run_id": own["run_id"], "hop": own["pos"], "to": rows["pos"][at] + 1})
    return folds.put_together(parts, ["run_id", "hop", "to"])


def _first_starts(steps: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
    """run_id, blk, start: the first pass start inside each block that has one."""
    marks = scratch.keep(_breakpoints(steps, budget), "marks")
    pack = folds.packed(steps.count(), BLOCK)
    hops = steps.select(*BLOCK, "pos", "spent", "tokens", "need").groupBy(pack).cogroup(marks.groupBy(pack))
    hops = scratch.keep(
        hops.applyInPandas(
            _hops(budget), "run_id bigint, blk bigint, pos bigint, hop bigint, leaves boolean, limit bigint, dest bigint"
        ),
        "hops",
    )
    # A block gets its waiting passes by the block they come from: both sides stay a block long, and as
    # the ends never decrease along a run, there are no more than two pairs of blocks for each block.
    waiting = hops.filter("dest IS NOT NULL").select("run_id", "pos", "limit", "dest", "blk")
    pairs = scratch.keep(waiting.select("run_id", "dest", "blk").distinct(), "pairs")
    tops = steps.select("run_id", F.col("blk").alias("dest"), "pos", (F.col("spent") + F.col("need")).alias("top"))
    tops = tops.join(pairs, ["run_id", "dest"])
    pack = folds.packed(pairs.count() * fold_rows(steps), ["run_id", "dest", "blk"])
    ends = tops.groupBy(pack).cogroup(waiting.groupBy(pack))
    ends = ends.applyInPandas(_arrive, "run_id bigint, hop bigint, to bigint")
    onward = F.when(F.col("leaves"), F.col("hop")).otherwise(F.col("to"))
    edges = hops.join(ends, ["run_id", "hop"], "left").select("run_id", "pos", onward.alias("to"))
    edges = scratch.keep(edges, "edges")
    landed = edges.select("run_id", F.col("to").alias("pos")).distinct()
    landed = landed.unionByName(edges.filter("pos = 0").select("run_id", "pos")).distinct()
    nodes = edges.join(landed, ["run_id", "pos"]).select("run_id", "pos", "to", (F.col("pos") == 0).alias("hit"))
    # Every hop leads to a later block, so 2**rounds hops cover the longest run.
    longest = steps.agg(F.max("blk")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        nodes = folds.checkpointed(nodes)
        lit_up = nodes.filter("hit AND to IS NOT NULL").select("run_id", F.col("to").alias("pos"), F.lit(True).alias("lit_up"))
        further = nodes.select("run_id", F.col("pos").alias("to"), F.col("to").alias("further"))
        nodes = nodes.join(lit_up.distinct(), ["run_id", "pos"], "left").join(further, ["run_id", "to"], "left")
        nodes = nodes.select("run_id", "pos", F.col("further").alias("to"), (F.col("hit") | F.col("lit_up").isNotNull()).alias("hit"))
    size = fold_rows(steps)
    return nodes.filter("hit").select("run_id", F.floor(F.col("pos") / size).alias("blk"), F.col("pos").alias("start"))


def _walk(budget: int):
    """Pass starts inside a block from its first one on: how many so far, and S before the last."""

    def run(pack: pd.DataFrame, firsts: pd.DataFrame) -> pd.DataFrame:
        start = {key: int(own["start"][0]) for key, own in folds.each_block(firsts, BLOCK, ["start"])}
        parts = []
        for key, rows in folds.each_block(pack, BLOCK, ["pos"]):
            before = rows["spent"] - rows["tokens"]
            begins = np.zeros(len(before), bool)
            if key in start:
                end = _local_ends(rows["spent"], rows["tokens"], rows["need"], budget)
                at = start[key] - int(rows["pos"][0])
                while at < len(before):
                    begins[at] = True
                    at = int(end[at]) + 1
            base = np.maximum.accumulate(np.where(begins, before, -1))
            parts.append({c: rows[c] for c in _WALKED} | {"starts": np.cumsum(begins), "base": base})
        out = folds.put_together(parts, [*_WALKED, "starts", "base"])
        return out.assign(base=out["base"].astype("Int64").where(out["base"] >= 0))

    return run


def token_passes(usage: DataFrame, budget: int) -> DataFrame:
    """Token bookkeeping along a run's chunks: calibrated estimates, chunk size, pass number.

    ``usage``: run_id, chunk_id, prompt_tokens, completion_tokens, n_images, and optionally
    entity_length, the characters of the entity list in the prompt; null counts as 0.  A pass ends
    when the next chunk would exceed the budget.
    """
    scratch = Scratch(usage.sparkSession, "passes")
    steps = scratch.keep(_steps(usage, budget), "steps")
    firsts = _first_starts(steps, budget, scratch)
    out = "run_id bigint, blk bigint, chunk_id bigint, pos bigint, image_tokens bigint, reply_tokens bigint, chunk_size bigint, spent bigint, starts bigint, base bigint"
    pack = folds.packed(steps.count(), BLOCK)
    walked = steps.groupBy(pack).cogroup(firsts.groupBy(pack)).applyInPandas(_walk(budget), out)
    walked = scratch.keep(walked, "walked")
    scratch.only(walked)
    earlier = Window.partitionBy("run_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = walked.groupBy(*BLOCK).agg(F.max("starts").alias("n"), F.max("base").alias("base_in")).select(
        *BLOCK, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.max("base_in").over(earlier).alias("base_in")
    )
    return walked.join(blocks, BLOCK).select(
        "run_id",
        "chunk_id",
        (F.col("before") + F.col("starts") - 1).alias("pass_id"),
        (F.col("spent") - F.coalesce("base", "base_in")).alias("cumulative"),
        "image_tokens",
        "reply_tokens",
        "chunk_size",
    )
