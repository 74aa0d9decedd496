"""Text blocks for downstream model jobs, built from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinetrace.functions.text import TRIM_MARK, token_estimate, truncate_middle
from cinetrace.functions.times import clock_text
from cinetrace.operators.detections import frame_texts
from cinetrace.operators.frames import _any_near
from cinetrace.operators.ordering import (
    first_n,
    frame_position,
    neighbour,
    position,
    running,
    text_parts,
    time_buckets,
)
from cinetrace.settings import block_rows
from cinetrace.sources.readers import Scratch

START = "this is the start"  # Fixed value: the seed of the first chunk.


def assign_chunks(frames: DataFrame, size: int = 10) -> DataFrame:
    """Consecutive slices of ``size`` frames."""
    return frame_position(frames).withColumn("chunk_id", F.floor(F.col("pos") / size))


def chunk_blocks(frames: DataFrame, detections: DataFrame, size: int = 10) -> DataFrame:
    """One block of frame lines per chunk."""
    texts = frame_texts(assign_chunks(frames, size), detections)
    line = F.concat(
        F.lit("[frame "), F.col("frame_idx").cast("string"), F.lit(" — t="),
        clock_text(F.col("timestamp_ms")), F.lit("] YOLO: "), F.col("text"),
    )
    listed = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return texts.groupBy("run_id", "chunk_id").agg(
        F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("block")
    )


def caption_log(frame_lines: DataFrame, summaries: DataFrame) -> DataFrame:
    """``caption_log_lines`` as text parts."""
    return text_parts(caption_log_lines(frame_lines, summaries), ["run_id"], F.col("line"))


def caption_log_lines(frame_lines: DataFrame, summaries: DataFrame) -> DataFrame:
    """Frame lines in order, each chunk followed by its summary, with their position.

    ``frame_lines``: run_id, chunk_id, frame_idx, line; ``summaries``: run_id, chunk_id, summary.
    """
    frames = frame_lines.filter("line <> ''").select(
        "run_id", "chunk_id", F.lit(0).alias("kind"), "frame_idx",
        F.format_string("[frame %d] %s", "frame_idx", "line").alias("line"),
    )
    ends = summaries.filter("summary <> ''").select(
        "run_id", "chunk_id", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("frame_idx"),
        F.format_string("[chunk %d summary] %s", "chunk_id", "summary").alias("line"),
    )
    return position(
        frames.union(ends), ["run_id"], [F.col(c) for c in ("chunk_id", "kind", "frame_idx")], [F.floor(F.col("chunk_id") / 1024)]
    )


def summary_groups(summaries: DataFrame, size: int = 10, single_pass: int = 30) -> DataFrame:
    """Blocks of ``size`` chunk summaries for runs with more than ``single_pass`` chunks."""
    rows = frame_position(summaries, order="chunk_id", total="total").filter(F.col("total") > single_pass)
    line = F.when(F.col("summary") != "", F.format_string("[chunk %d] %s", "chunk_id", "summary"))
    listed = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("pos", line.alias("line")))))
    return rows.groupBy("run_id", F.floor(F.col("pos") / size).alias("group_id")).agg(
        F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("block")
    )


def seeds(summaries: DataFrame) -> DataFrame:
    """The last non-empty summary before each chunk."""
    block = F.floor(F.col("chunk_id") / block_rows(summaries))
    said = F.when(F.col("summary") != "", F.struct("chunk_id", "summary"))
    rows = running(summaries, ["run_id"], block, [F.col("chunk_id")], said, "said", frame="before")
    return rows.select("run_id", "chunk_id", F.coalesce("said.summary", F.lit(START)).alias("seed"))


def registry_versions(mentions: DataFrame) -> DataFrame:
    """When each description of an entity is current: chunks ``valid_from`` to ``valid_to``.

    ``mentions``: run_id, chunk_id, id, description.  A description is seen by later chunks only.
    Storing spans keeps the registry of every chunk without repeating it per chunk.
    """
    keys = ["run_id", "id"]
    rows = neighbour(
        frame_position(mentions, order="chunk_id", keys=keys), keys, {"next_chunk": ("chunk_id", 1)}
    )
    return rows.select(
        "run_id", "id", "description",
        (F.col("chunk_id") + 1).alias("valid_from"),
        F.col("next_chunk").alias("valid_to"),
    )


def registry_log(mentions: DataFrame) -> DataFrame:
    """The changes of a run's registry in order, cut into blocks of as many changes as it has entities.

    run_id, chunk_id, id, description, pos (0-based, by chunk and id), next_pos (of the same entity's next
    change, null for none), known (entities of the run), block.
    """
    known = mentions.groupBy("run_id").agg(F.countDistinct("id").alias("known"))
    order = [F.col("chunk_id"), F.col("id"), F.col("description")]
    rows = position(mentions, ["run_id"], order, [F.floor(F.col("chunk_id") / block_rows(mentions))])
    own = ["run_id", "id"]
    rows = position(rows, own, [F.col("pos")], [F.floor(F.col("pos") / block_rows(mentions))], "nth")
    rows = neighbour(rows, own, {"next_pos": ("pos", 1)}, "nth").drop("nth")
    return rows.join(known, "run_id").withColumn("block", F.floor(F.col("pos") / F.col("known")))


def registry_snapshots(log: DataFrame) -> DataFrame:
    """run_id, block, id, description: the registry as each block of changes finds it.

    A change is in the snapshots of the blocks that begin after it and not after the entity's next one.
    As a block has as many changes as there are entities, all snapshots together are no longer than
    the log; the registry of a chunk is one snapshot and the changes since.
    """
    ends = log.groupBy("run_id").agg(F.max("block").alias("last"))
    first = F.floor(F.col("pos") / F.col("known")) + 1
    last = F.coalesce(F.floor(F.col("next_pos") / F.col("known")), F.col("last"))
    rows = log.join(ends, "run_id").withColumns({"from": first, "to": last}).filter(F.col("from") <= F.col("to"))
    return rows.select("run_id", F.explode(F.sequence("from", "to")).alias("block"), "id", "description")


def registry_lists(log: DataFrame, snapshots: DataFrame, chunks: DataFrame) -> DataFrame:
    """run_id, chunk_id, known: the entities known to each given chunk by id, each with its latest description.

    A chunk finds its block by the number of changes before it; snapshot and changes then meet it by
    run and block as one list, twice as long as the registry at most, so a task holds that of one block.  The list is
    sorted once a block, where each entry learns when the next one of its entity replaces it; a chunk only picks
    the entries that hold at its place.
    """
    asked = chunks.select("run_id", "chunk_id").distinct()
    both = log.select("run_id", "chunk_id", F.lit(1).alias("change")).unionByName(asked.withColumn("change", F.lit(0)))
    order = [F.col("chunk_id"), F.col("change")]  # a chunk comes before its own changes
    before = running(both, ["run_id"], F.floor(F.col("chunk_id") / block_rows(log)), order, F.col("change"), "upto", "sum", "before")
    sizes = log.select("run_id", "known").distinct()
    found = before.filter("change = 0 AND upto > 0").join(sizes, "run_id")
    # the block in which the last change before the chunk lies
    found = found.select("run_id", "chunk_id", "upto", F.floor((F.col("upto") - 1) / F.col("known")).alias("block"))
    # the lists grow where they lie, so small input is not put together in few tasks
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(tasks, "run_id", "block")
    entry = lambda pos: F.struct("id", pos.alias("pos"), "description")
    old = snapshots.groupBy("run_id", "block").agg(F.collect_list(entry(F.lit(-1).cast("bigint"))).alias("old"))
    new = log.groupBy("run_id", "block").agg(F.collect_list(entry(F.col("pos"))).alias("new"))
    said = new.join(old, ["run_id", "block"], "left").select(
        "run_id", "block", F.sort_array(F.concat(F.coalesce("old", F.array()), "new")).alias("said")
    )
    after = lambda i: F.try_element_at("said", (i + 2).cast("int"))
    until = lambda e, i: F.when(after(i)["id"].eqNullSafe(e["id"]), after(i)["pos"])
    spans = said.select("run_id", "block", F.transform("said", lambda e, i: e.withField("until", until(e, i))).alias("spans"))
    met = found.join(spans, ["run_id", "block"])
    holds = lambda e: (e["pos"] < F.col("upto")) & (e["until"].isNull() | (e["until"] >= F.col("upto")))
    known = F.transform(F.filter("spans", holds), lambda e: F.struct(e["id"].alias("id"), e["description"].alias("description")))
    return met.select("run_id", "chunk_id", known.alias("known"))


def registry_of(log: DataFrame, snapshots: DataFrame, chunks: DataFrame) -> DataFrame:
    """The entities known to each given chunk, a row each.

    No list is empty; ``inline`` would have Spark make every list once more, to leave out empty ones.
    """
    return registry_lists(log, snapshots, chunks).select("run_id", "chunk_id", F.inline_outer("known"))


def registry_at(versions: DataFrame, chunks: DataFrame, listed: bool = False) -> DataFrame:
    """The entities known to each given chunk, from their versions: a row each, or as one list a chunk."""
    mentions = versions.select("run_id", (F.col("valid_from") - 1).alias("chunk_id"), "id", "description")
    log = Scratch(versions.sparkSession, "registry").keep(registry_log(mentions), "log")
    return (registry_lists if listed else registry_of)(log, registry_snapshots(log), chunks)


def registry_blocks(known: DataFrame, chunks: DataFrame) -> DataFrame:
    """Prompt text of the entities known to each chunk, sorted by id; ``known`` as rows or as lists of ``registry_at``."""
    if "known" not in known.columns:
        known = known.groupBy("run_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("id", "description"))).alias("known"))
    line = lambda s: F.concat(F.lit("  "), s["id"], F.lit(": "), s["description"])
    blocks = known.select("run_id", "chunk_id", F.array_join(F.transform("known", line), "\n").alias("lines"))
    head = "Known entities so far (reuse these IDs if you see the same entity):\n"
    none = "Known entities so far: (none — this is the first segment)\n\n"
    return chunks.select("run_id", "chunk_id").join(blocks, ["run_id", "chunk_id"], "left").select(
        "run_id",
        "chunk_id",
        F.when(F.col("lines").isNull(), none).otherwise(F.concat(F.lit(head), "lines", F.lit("\n\n"))).alias("block"),
    )


def _recent(summaries: DataFrame, n: int, separator: str, name: str) -> DataFrame:
    last = first_n(summaries.filter("summary <> ''"), ["run_id"], [F.col("chunk_id").desc()], n)
    listed = F.sort_array(F.collect_list(F.struct("chunk_id", "summary")))
    return last.groupBy("run_id").agg(F.array_join(F.transform(listed, lambda s: s["summary"]), separator).alias(name))


def compact_seed(summaries: DataFrame) -> DataFrame:
    """Seed of the next pass without a model: the last three summaries, at most 300 characters."""
    return _recent(summaries, 3, "; ", "seed").withColumn("seed", F.right("seed", F.lit(300)))


def pruned_registry(mentions: DataFrame, summaries: DataFrame, keep: int = 20) -> DataFrame:
    """The ``keep`` entities that recent summaries mention most, ties by id then description, descending."""
    recent = _recent(summaries, 5, " ", "recent").withColumn("recent", F.lower("recent"))
    latest = mentions.groupBy("run_id", "id").agg(F.max_by("description", "chunk_id").alias("description"))
    said = lambda c: F.coalesce(F.col("recent").contains(c), F.lit(False)).cast("int")
    scored = latest.join(recent, "run_id", "left").withColumn(
        "score", said(F.lower("id")) + said(F.substring(F.lower("description"), 1, 20))
    )
    order = [F.col("score").desc(), F.col("id").desc(), F.col("description").desc()]
    return first_n(scored, ["run_id"], order, keep).drop("recent")


def thin_lines(lines: DataFrame, keep: int) -> DataFrame:
    """About ``keep`` evenly spaced lines per run (run_id, pos, total), first and last kept."""
    return lines.filter(_kept(F.col("pos"), F.col("total"), F.lit(keep)))


def _kept(pos: Column, total: Column, keep: Column) -> Column:
    step = total / (keep - 1)
    inner = _any_near(
        pos / step,
        keep - 1,
        lambda i: (i >= 1) & (F.least(total - 1, F.bround(i * step, 0).cast("bigint")) == pos),
    )
    return (
        F.when((keep >= total) | (keep <= 0), True)
        .when(keep == 1, pos == 0)
        .otherwise((pos == 0) | (pos == total - 1) | F.coalesce(inner, F.lit(False)))
    )


def transcript_lines(segments: DataFrame) -> DataFrame:
    """Speech lines "[from-to] text" with their position; empty texts are dropped."""
    rows = position(
        segments.filter(F.trim("text") != ""),
        ["run_id"],
        [F.col("start_ms"), F.col("segment_id")],
        time_buckets("start_ms"),
    )
    line = F.concat(
        F.lit("["), clock_text(F.col("start_ms")), F.lit("-"), clock_text(F.col("end_ms")), F.lit("] "), F.trim("text")
    )
    return rows.select("run_id", "pos", "segment_id", line.alias("line"))


def prompt_budget(n_ctx: Column, max_tokens: int = 4096, fraction: float = 0.7, slack: int = 512) -> Column:
    """Tokens a prompt may use once the reply has its room."""
    return F.greatest(F.lit(1024), F.least(F.floor(n_ctx * fraction), n_ctx - max_tokens - slack))


def fit_blocks(prompts: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    """Shrink prompt blocks (``dense``, ``transcript``, ``captions``) to a token budget.

    The dense lines are thinned by halves down to six, then the transcript loses its middle, then
    the captions do.  Each row is one prompt, so its size is bounded by what a model can read.
    """
    other = token_estimate(F.col("captions")) + token_estimate(F.col("transcript")) + overhead
    text_of = lambda a: F.array_join(a, "\n")

    def thin(acc: Column, _step: Column) -> Column:
        n = F.size(acc)
        keep = F.greatest(F.lit(6), F.floor(n / 2)).cast("int")
        over = token_estimate(text_of(acc)) + F.col("other") > budget
        return F.when(
            over & (n > 6), F.filter(acc, lambda _l, i: _kept(i.cast("bigint"), n.cast("bigint"), keep))
        ).otherwise(acc)

    halvings = F.ceil(F.log2(F.size("lines") + 1)).cast("int")
    halved = F.aggregate(F.sequence(F.lit(1), halvings), F.col("lines"), thin)
    rows = (
        prompts.withColumns({"lines": F.split("dense", "\n"), "other": other})
        .withColumn("dense", F.when(F.col("dense") == "", "").otherwise(text_of(halved)))
        .drop("lines", "other")
    )
    total = lambda: (
        token_estimate(F.col("dense")) + token_estimate(F.col("captions")) + token_estimate(F.col("transcript")) + overhead
    )
    keep_t = token_estimate(F.col("transcript")) - (total() - budget)
    rows = rows.withColumn(
        "transcript",
        F.when(
            (F.col("transcript") != "") & (total() > budget),
            truncate_middle(F.col("transcript"), F.greatest(F.lit(0), keep_t) * 3),
        ).otherwise(F.col("transcript")),
    )
    keep_c = token_estimate(F.col("captions")) - (total() - budget)
    return rows.withColumn(
        "captions",
        F.when(total() > budget, truncate_middle(F.col("captions"), F.greatest(F.lit(1), keep_c) * 3)).otherwise(
            F.col("captions")
        ),
    )


LEAST_LINES = 6  # Fixed value: a dense timeline is not thinned below this.
BLOCKS = ("dense", "transcript", "captions")


def _thinned(dense: DataFrame) -> DataFrame:
    """Dense lines with ``depth``, how many halvings they survive; run_id, pos, line, total in.

    A line follows its own position through the halvings: the list of one level is never needed.
    """

    def step(at: Column, _n: Column) -> Column:
        keep = F.greatest(F.lit(LEAST_LINES), F.floor(at["total"] / 2)).cast("bigint")
        gap = at["total"] / (keep - 1)
        guess = F.floor(at["pos"] / gap)
        hit = lambda i: (i >= 1) & (i < keep - 1) & (F.least(at["total"] - 1, F.bround(i * gap, 0).cast("bigint")) == at["pos"])
        inner = F.try_element_at(F.filter(F.sequence(guess - 1, guess + 2), hit), F.lit(1))
        moved = F.when(at["pos"] == 0, F.lit(0)).when(at["pos"] == at["total"] - 1, keep - 1).otherwise(inner).cast("bigint")
        on = at["on"] & (at["total"] > LEAST_LINES) & moved.isNotNull()
        return F.struct(
            F.when(on, moved).otherwise(at["pos"]).alias("pos"),
            F.when(on, keep).otherwise(at["total"]).alias("total"),
            (at["depth"] + on.cast("int")).alias("depth"),
            on.alias("on"),
        )

    start = F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("total").cast("bigint").alias("total"), F.lit(0).alias("depth"), F.lit(True).alias("on"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.col("total") + 1)).cast("int"))
    return dense.withColumn("depth", F.aggregate(rounds, start, step)["depth"])


def fit_run_blocks(blocks: DataFrame, budgets: DataFrame, overhead: int = 0) -> DataFrame:
    """Shrink the prompt blocks of every run to its token budget, without ever holding a block as one text.

    ``blocks``: run_id, block (of BLOCKS), pos (0-based), line; ``budgets``: run_id, budget.  Returned are the
    lines that stay, in order of run_id, block, pos, part; joined by newlines they are the block.  The dense lines
    are thinned by halves: sums of line lengths per level tell the first level that fits.  Then the
    transcript loses its middle, then the captions do: running sums of lengths tell where the cuts fall.
    """
    scratch = Scratch(blocks.sparkSession, "fit")
    size = F.length("line").cast("bigint")
    lines = blocks.select("run_id", "block", "pos", "line")
    sizes = lines.groupBy("run_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"))
    text = F.col("chars") + F.col("n") - 1
    of = lambda name: F.coalesce(F.max(F.when(F.col("block") == name, text)), F.lit(0)).alias(name)
    runs = sizes.groupBy("run_id").agg(
        of("transcript"), of("captions"), F.coalesce(F.max(F.when(F.col("block") == "dense", F.col("n"))), F.lit(0)).alias("total")
    )
    runs = scratch.keep(runs.join(budgets.select("run_id", "budget"), "run_id"), "runs")
    tokens = lambda c: F.floor(F.col(c) / 3)

    dense = lines.filter("block = 'dense'").join(runs.select("run_id", "total"), "run_id")
    dense = scratch.keep(_thinned(dense), "dense")
    levels = dense.select("run_id", "line", F.explode(F.sequence(F.lit(0), "depth")).alias("level"))
    levels = levels.groupBy("run_id", "level").agg((F.sum(size) + F.count(F.lit(1)) - 1).alias("chars"))
    room = F.col("budget") - overhead - tokens("captions") - tokens("transcript")
    chosen = levels.join(runs, "run_id").groupBy("run_id").agg(
        F.coalesce(F.min(F.when(tokens("chars") <= room, F.struct("level", "chars"))), F.max(F.struct("level", "chars"))).alias("best")
    )
    runs = runs.join(chosen, "run_id", "left").select(
        "run_id", "budget", "transcript", "captions", "best.level", F.coalesce("best.chars", F.lit(0)).alias("dense")
    )

    def limit(own: Column, over: Column, least: int) -> Column:
        """Characters that a block may keep, null for all."""
        keep = F.greatest(F.lit(least), F.floor(own / 3) - over) * 3
        return F.when((over > 0) & (own > keep), keep)

    over = overhead + tokens("dense") + tokens("captions") + tokens("transcript") - F.col("budget")
    runs = runs.withColumn("transcript_keeps", F.when(F.col("transcript") > 0, limit(F.col("transcript"), over, 0)))
    mark = len(TRIM_MARK)
    room = lambda keep: F.greatest(F.lit(0), keep - mark)
    left = F.when(F.col("transcript_keeps").isNull(), F.col("transcript")).otherwise(
        F.when(room(F.col("transcript_keeps")) > 0, F.col("transcript_keeps")).otherwise(0)
    )
    over = overhead + tokens("dense") + tokens("captions") + F.floor(left / 3) - F.col("budget")
    runs = runs.withColumn("captions_keeps", limit(F.col("captions"), over, 1))
    runs = scratch.keep(runs, "limits")

    kept = dense.join(runs.select("run_id", "level"), "run_id").filter("depth >= level")
    kept = kept.select("run_id", "block", "pos", F.lit(0).alias("part"), "line")
    rest = lines.filter("block <> 'dense'").join(runs, "run_id")
    is_speech = F.col("block") == "transcript"
    keeps = F.when(is_speech, F.col("transcript_keeps")).otherwise(F.col("captions_keeps"))
    whole = F.when(is_speech, F.col("transcript")).otherwise(F.col("captions"))
    rest = rest.select("run_id", "block", "pos", "line", keeps.alias("keeps"), whole.alias("whole"))
    rest = running(
        rest, ["run_id", "block"], F.floor(F.col("pos") / block_rows(blocks)), [F.col("pos")], size + 1, "start", "sum", "before"
    ).withColumn("start", F.coalesce("start", F.lit(0)))
    end = F.col("start") + size
    head = F.floor(room(F.col("keeps")) / 2)
    tail_from = F.col("whole") - (room(F.col("keeps")) - head)
    cut = F.col("keeps").isNotNull()
    shown = room(F.col("keeps")) > 0
    piece = lambda text, part: F.struct(F.lit(part).alias("part"), text.alias("line"))
    first = F.when(cut & shown & (F.col("start") <= head), piece(F.left("line", (head - F.col("start")).cast("int")), 0))
    trimmed = F.when(cut & shown & (F.col("start") <= head) & (end + 1 > head), piece(F.lit(TRIM_MARK.strip()), 1))
    after = F.greatest(F.lit(0), tail_from - F.col("start")).cast("int")
    last = F.when(cut & shown & (end >= tail_from), piece(F.right("line", F.length("line") - after), 2))
    pieces = F.when(~cut, F.array(piece(F.col("line"), 0))).otherwise(F.array_compact(F.array(first, trimmed, last)))
    return kept.unionByName(rest.select("run_id", "block", "pos", F.inline(pieces)))


def entity_lines(entities: DataFrame) -> DataFrame:
    """Summary-prompt lines of entities (descriptions cut at 80)."""
    return entities.select(
        "run_id", "id",
        F.format_string("%s (%s): %s", "id", "type", F.substring("description", 1, 80)).alias("line"),
    )


def event_lines(events: DataFrame, n: int = 20) -> DataFrame:
    """Summary-prompt lines of the first events (descriptions cut at 60)."""
    head = first_n(events, ["run_id"], [F.col("ev_idx")], n)
    line = F.format_string(
        "[%s–%s] %s: %s — %s", "start_time", "end_time", "type", F.array_join("entities", ", "), F.substring("description", 1, 60)
    )
    return head.select("run_id", "ev_idx", line.alias("line"))


def audio_lines(events: DataFrame, n: int = 10) -> DataFrame:
    head = first_n(events, ["run_id"], [F.col("ev_idx")], n)
    line = F.format_string("[%s–%s] %s: %s", "start_time", "end_time", "type", F.substring("text", 1, 80))
    return head.select("run_id", "ev_idx", line.alias("line"))
