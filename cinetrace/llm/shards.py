"""Even shards from a minimax contiguous partition of atomic groups, all in column expressions.

Rows with equal texts form an atomic group; groups lie in the order of their hash.  The smallest
shard capacity for which a greedy pass needs no more than the given shards is found by binary
search, and the cuts of that pass are the shard borders.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinetrace.llm.common import Scratch

SHARDS = 40
BITS = 12  # cells per refinement: 2**BITS
ROW_BYTES = 16


def order_of(text: Column) -> Column:
    """The order key of a text, 0 to 2**63 - 1; equal texts share it."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(2**63 - 1))


@dataclass
class _Cells:
    """A sorted cover of the order keys; a cell of one group is atomic."""

    start: list[int] = field(default_factory=list)
    width: list[int] = field(default_factory=list)  # in bits
    size: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)

    def sums(self) -> list[int]:
        out = [0]
        for s in self.size:
            out.append(out[-1] + s)
        return out

    def add(self, start: int, width: int, size: int, groups: int) -> None:
        self.start.append(start)
        self.width.append(width)
        self.size.append(size)
        self.groups.append(groups)


def _greedy(sums: list[int], capacity: int, shards: int) -> tuple[bool, list[int]]:
    """Whether a greedy pass needs no more than ``shards``, and the cells that it cut before."""
    cuts: list[int] = []
    for _ in range(shards):
        at = cuts[-1] if cuts else 0
        reach = bisect_right(sums, sums[at] + capacity) - 1
        if reach == len(sums) - 1:
            return True, cuts
        cuts.append(reach)
        if reach == at:
            break
    return False, cuts


def _smallest(sums: list[int], shards: int) -> int:
    low, high = max(1, -(-sums[-1] // shards)), max(1, sums[-1])
    while low < high:
        middle = (low + high) // 2
        if _greedy(sums, middle, shards)[0]:
            high = middle
        else:
            low = middle + 1
    return low


def plan(groups: DataFrame, shards: int = SHARDS, bits: int = BITS) -> tuple[int, list[int], list[int]]:
    """(capacity, single groups, first order key of each next shard) for a table (key, size).

    Groups above an equal share fit no even cut and take a shard each; they are fewer than the
    shards.  The others are summed in cells of keys.  A pass over cells equals the pass over groups
    as long as the cell after each of its cuts is one group; where it is not, the cells about that
    cut are split and the search starts again.  So the driver holds some thousand sums, and the
    result is exact: the capacity is enough, and one byte less is not.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    single: list[int] = []
    rest = groups
    while len(single) < shards - 1:  # fewer shards and bytes are left each time, so more groups may stand out
        share = total / (shards - len(single))
        more = rest.filter(F.col("size") > share).orderBy(F.desc("size"), "key").limit(shards - 1 - len(single)).collect()
        if not more:
            break
        total -= sum(r["size"] for r in more)
        single += [r["key"] for r in more]
        rest = groups.filter(~F.col("key").isin(single))
    left = shards - len(single)
    cells = _split(rest, _Cells([0], [63], [total], [2]), {0}, bits)
    while True:
        sums = cells.sums()
        capacity = _smallest(sums, left)
        enough, cuts = _greedy(sums, capacity, left)
        doubt = {c for n in (capacity, capacity - 1) for c in _greedy(sums, n, left)[1] if cells.groups[c] > 1}
        if not doubt:
            return capacity, single, [cells.start[c] for c in cuts]
        near = {c + d for c in doubt for d in (-1, 0, 1) if 0 <= c + d < len(cells.size)}
        cells = _split(rest, cells, {c for c in near if cells.groups[c] > 1}, bits)


def _split(groups: DataFrame, cells: _Cells, doubt: set[int], bits: int) -> _Cells:
    """The cover with the cells in ``doubt`` split by their next bits, some 2**bits parts in all."""
    by_width: dict[int, list[int]] = {}
    for i in doubt:
        by_width.setdefault(cells.width[i], []).append(i)
    finer: dict[int, list[tuple[int, int, int, int]]] = {i: [] for i in doubt}
    for width, members in by_width.items():
        step = max(0, width - max(1, bits - (len(members) - 1).bit_length()))
        at = {cells.start[i] >> width: i for i in members}
        found = (
            groups.filter(F.shiftrightunsigned("key", width).isin(list(at)))
            .groupBy(F.shiftrightunsigned("key", step).alias("cell"))
            .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        )
        for r in found.collect():  # at most 2**bits sums
            finer[at[(r["cell"] << step) >> width]].append((r["cell"] << step, step, r["size"], r["n"]))
    out = _Cells()
    for i, cell in enumerate(zip(cells.start, cells.width, cells.size, cells.groups)):
        for part in sorted(finer[i]) if i in doubt else [cell]:
            out.add(*part)
    return out


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Rows with equal texts share a shard; the largest shard is as small as the order allows.  Null
    ids and repeated rows are rows like others; null and empty texts have 16 bytes.  Slots count
    from 0 within a shard without gaps: each stretch of the table numbers its own rows, and sums over
    the stretches before it are added.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(text_col, F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            order_of(F.col(text_col)).alias("key"),
            F.spark_partition_id().alias("stretch"),
        ),
        "rows",
    )
    groups = scratch.keep(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, single, cuts = plan(groups, shards)
    scratch.drop(groups)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    for n, key in enumerate(sorted(single)):
        shard = F.when(F.col("key") == key, F.lit(shards - 1 - n)).otherwise(shard)
    rows = rows.withColumn("shard", shard.cast("int"))
    counts = rows.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = W.partitionBy("shard", "stretch").orderBy("key", "id")
    return (
        rows.withColumn("own", F.row_number().over(own) - 1)
        .join(counts, ["shard", "stretch"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("own")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
