"""Ordered computation that splits inside a run.

A plain ``Window.partitionBy("run_id")`` sends a whole run to one task.  The helpers
here give the same answers with windows over ``(run, block)`` plus a window over one
summary row per block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinetrace.settings import block_rows, part_rows
from cinetrace.sources.readers import Scratch


def _sum_before(spec) -> Column:
    return F.coalesce(
        F.sum("__n").over(spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    buckets: Sequence[Column],
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """0-based rank of every row inside ``keys``, in ``order``.

    ``buckets`` never decrease along ``order``.  Rows are numbered inside their bucket;
    the rows before the bucket come from one count per bucket, so the only window that
    spans a whole key runs over bucket counts.  ``total`` also emits the size of the key.
    """
    keys = list(keys)
    levels = [f"__b{i}" for i in range(len(buckets))]
    rows = df.select("*", *[b.alias(n) for b, n in zip(buckets, levels)])
    per_key = Window.partitionBy(*keys)
    offsets = (
        rows.groupBy(*keys, *levels)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *keys,
            *levels,
            _sum_before(per_key.orderBy(*levels)).alias("__before"),
            *([F.sum("__n").over(per_key).alias(total)] if total else []),
        )
    )
    rank = F.row_number().over(Window.partitionBy(*keys, *levels).orderBy(*order))
    return (
        rows.select("*", rank.alias("__rn"))
        .join(offsets, keys + levels)
        .select(
            *df.columns,
            (F.col("__before") + F.col("__rn") - 1).cast("bigint").alias(name),
            *([total] if total else []),
        )
    )


def frame_position(
    df: DataFrame,
    name: str = "pos",
    order: str = "frame_idx",
    total: str | None = None,
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """0-based position of each frame of a run (one row per frame)."""
    block = F.floor(F.col(order) / block_rows(df))
    return position(df, keys, [F.col(order)], [block], name, total)


def time_buckets(column: str | Column) -> list[Column]:
    """Order-keeping buckets of ten seconds for media milliseconds."""
    ms = F.col(column) if isinstance(column, str) else column
    return [F.floor(ms / 10_000)]


def score_buckets(score: Column, tie_block: Column) -> list[Column]:
    """Buckets for (score desc, tie asc).

    Scores on the 1/1024 grid (static footage scores 0, 2, 4, ...) form buckets of
    one value only, which are cut further along the tie-break.
    """
    scaled = score * 1024
    off_grid = scaled != F.floor(scaled)
    return [
        -(F.floor(scaled) * 2 + off_grid.cast("int")),
        F.when(off_grid, F.lit(0).cast("bigint")).otherwise(tie_block.cast("bigint")),
    ]


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    before: int = 0,
    after: int = 0,
    pos: str = "pos",
) -> DataFrame:
    """Cut a dense sequence into blocks that overlap by a few rows.

    Adds ``__blk`` and ``__home``.  Windows over ``halo_window`` then see up to
    ``before`` / ``after`` neighbours of every home row; ``drop_halo`` removes the copies.
    """
    size = max(block_rows(df), before + after + 1)
    p = F.col(pos)
    home = F.floor(p / size)
    offset = p - home * size
    copies = [home]
    if before:
        copies.append(F.when(offset >= size - before, home + 1))
    if after:
        copies.append(F.when((offset < after) & (home > 0), home - 1))
    return df.withColumn("__blk", F.explode(F.array_compact(F.array(*copies)))).withColumn(
        "__home", F.col("__blk") == home
    )


def halo_window(keys: Sequence[str], pos: str = "pos"):
    return Window.partitionBy(*keys, "__blk").orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("__home").drop("__blk", "__home")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, tuple[str, int]],
    pos: str = "pos",
) -> DataFrame:
    """lag / lead on a dense sequence: ``{new: (column, shift)}``, shift < 0 = earlier."""
    shifts = [s for _, s in columns.values()]
    halo = with_halo(df, keys, max([-s for s in shifts] + [0]), max(shifts + [0]), pos)
    spec = halo_window(keys, pos)
    return drop_halo(
        halo.withColumns(
            {new: F.lag(source, -shift).over(spec) for new, (source, shift) in columns.items()}
        )
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column],
    value: Column,
    name: str,
    how: str = "max",
    frame: str = "to_here",
) -> DataFrame:
    """Running max or sum along ``order``, over blocks that never decrease along it.

    ``frame``: ``"to_here"`` includes the row, ``"before"`` stops ahead of it and
    ``"with_peers"`` includes all rows that tie with it.
    """
    keys = list(keys)
    agg = {"max": F.max, "sum": F.sum}[how]
    merge = (
        (lambda a, b: F.greatest(a, b))
        if how == "max"
        else (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    )
    rows = df.withColumn("__blk", block).withColumn("__v", value)
    carried = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(*keys, "__blk")
        .agg(agg("__v").alias("__sum"))
        .select(*keys, "__blk", agg("__sum").over(carried).alias("__carry"))
    )
    inside = Window.partitionBy(*keys, "__blk").orderBy(*order)
    if frame == "with_peers":
        inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        inside = inside.rowsBetween(Window.unboundedPreceding, 0 if frame == "to_here" else -1)
    return (
        rows.withColumn("__in", agg("__v").over(inside))
        .join(blocks, keys + ["__blk"])
        .withColumn(name, merge(F.col("__in"), F.col("__carry")))
        .drop("__blk", "__v", "__in", "__carry")
    )


def islands(
    df: DataFrame, keys: Sequence[str], label: Sequence[str], pos: str = "pos", name: str = "island"
) -> DataFrame:
    """Mark stretches of equal consecutive labels by the position they start at."""
    previous = {f"__prev_{c}": (c, -1) for c in label}
    rows = neighbour(df, keys, previous, pos)
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__prev_{c}")) for c in label]
    )
    start = F.when((F.col(pos) == 0) | ~same, F.col(pos))
    size = block_rows(df)
    return running(
        rows, keys, F.floor(F.col(pos) / size), [F.col(pos)], start, name
    ).drop(*previous)


CELLS = 65_536  # of a histogram of one round of percentiles


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per ``keys``; nulls and NaN are left out.

    The value of each wanted rank is searched in rounds.  A round cuts the range between the least and
    the greatest candidate into CELLS cells, counts them and keeps the one that holds the rank, with its
    own least and greatest value; a rank is found once these are one.  So only the cell that matters is
    ever split, wherever outliers lie, and the only window runs over the cells of one rank.
    """
    keys = list(keys)
    scratch = Scratch(df.sparkSession, "percentiles")
    v = F.col(value).cast("double")
    data = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v")).groupBy(*keys, "__v")
    data = scratch.keep(data.agg(F.count(F.lit(1)).alias("__n")), "values")
    sides = [f(F.lit(float(p)) * (F.col("__all") - 1)) for p in wanted.values() for f in (F.floor, F.ceil)]
    searched = scratch.keep(
        data.groupBy(*keys)
        .agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"))
        .select("*", F.explode(F.array_distinct(F.array(*sides))).alias("__rank"), F.lit(0).cast("bigint").alias("__before")),
        "ranks",
    )
    here = [*keys, "__all", "__rank"]
    open_ = F.col("__lo") < F.col("__hi")
    found = []
    while True:
        found.append(searched.filter(~open_).select(*here, F.col("__lo").alias("__at")))
        left = searched.filter(open_)
        if left.isEmpty():
            break
        # halves, as the distance of two doubles may exceed the largest one
        share = (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)
        cells = (
            data.join(left, keys)
            .filter("__v BETWEEN __lo AND __hi")
            .withColumn("__cell", F.least(F.lit(CELLS - 1), F.floor(share * CELLS)))
            .groupBy(*here, "__before", "__cell")
            .agg(F.sum("__n").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        )
        before = F.col("__before") + _sum_before(Window.partitionBy(*here).orderBy("__cell"))
        cells = cells.withColumn("__before", before).filter("__before <= __rank AND __rank < __before + __n")
        searched = scratch.keep(cells.select(*here, "__lo", "__hi", "__before"), "ranks")
    values = reduce(lambda a, b: a.unionByName(b), found)
    picks, out = [], []
    for name, p in wanted.items():
        target = F.lit(float(p)) * (F.col("__all") - 1)
        for side, rank in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            picks.append(F.max(F.when(F.col("__rank") == rank, F.col("__at"))).alias(f"__{name}_{side}"))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (target - F.floor(target))).alias(name))
    return values.groupBy(*keys, "__all").agg(*picks).select(*keys, *out)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """0-based rank of every row inside ``keys``, in an ``order`` without ties; ``df`` is written once, sorted.

    Spark's range partitions cut any distribution evenly, so neither a large key nor a score that all
    rows share fills a task.  Rows are numbered within their partition; what lies before it in the
    key is summed over partitions.
    """
    keys = list(keys)
    spread = [*[F.col(k) for k in keys], *order]
    cut = df.repartitionByRange(*spread).sortWithinPartitions(*spread)
    cut = Scratch(df.sparkSession, "ranked").keep(cut.withColumn("__id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__id", 33)
    parts = cut.groupBy(*keys, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = _sum_before(Window.partitionBy(*keys).orderBy("__part")) - F.col("__first")
    offsets = parts.select(*keys, "__part", before.alias("__before"))
    return (
        cut.withColumn("__part", part)
        .join(offsets, [*keys, "__part"])
        .select(*df.columns, (F.col("__before") + F.col("__id")).cast("bigint").alias(name))
    )


def text_parts(
    df: DataFrame,
    keys: Sequence[str],
    line: Column,
    pos: str = "pos",
    name: str = "text",
    separator: str = "\n",
) -> DataFrame:
    """Join ordered lines into texts of at most ``partRows`` lines per row.

    A long run yields several numbered parts instead of one unbounded string.
    """
    part = F.floor(F.col(pos) / part_rows(df)).cast("bigint")
    listed = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("t"))))
    return (
        df.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.array_join(F.transform(listed, lambda s: s["t"]), separator).alias(name))
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Best row per key.  Spark cuts each map task to one row per key before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(spec)).filter("__rn = 1").drop("__rn")


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """Best ``n`` rows per key (small ``n``: map tasks pre-limit each key)."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).filter(F.col(rank) <= n)
