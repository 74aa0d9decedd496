"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

The distinct parts of a codebook lie in a trie, one level per dimension.  Distances to all entries
grow along a path: a node adds its dimension's share to the vector of its parent, so parts with a
common prefix share that work.  The trie is walked depth first, siblings and cousins in blocks; at
the leaves the least distance gives the entry, and counts weigh the sums of the next codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinetrace.llm.common import Scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 4096  # nodes of the trie that are visited at once
SMALL = 2**27  # components up to this keep squared distances within 64 bits
Books = list[np.ndarray]  # one per part: entries x dimensions, Python integers


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of distinct parts in lexicographic order; ties go to the lower entry."""
    n, dims = parts.shape
    small = max(abs(parts).max(initial=0), max((abs(v) for v in book.flat), default=0)) <= SMALL
    kind = np.int64 if small else object
    values = parts.astype(np.int64) if small else np.array([[int(v) for v in row] for row in parts], object).reshape(n, dims)
    entries = book.astype(kind)
    fresh = np.ones((n, dims), bool)  # whether a row begins a node of this level
    fresh[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
    starts = [np.flatnonzero(fresh[:, d]) for d in range(dims)]
    entry, distance = np.zeros(n, np.int64), np.zeros(n, kind)

    def visit(depth: int, low: int, high: int, above: np.ndarray, parent: np.ndarray) -> None:
        level = starts[depth]
        for at in range(low, high, BLOCK):
            to = min(at + BLOCK, high)
            step = values[level[at:to], depth][:, None] - entries[:, depth]
            sums = above[parent[at - low : to - low]] + step * step
            if depth == dims - 1:
                best = sums.argmin(axis=1)
                entry[at:to], distance[at:to] = best, sums[np.arange(to - at), best]
                continue
            below = starts[depth + 1]
            first = np.searchsorted(below, level[at])
            last = np.searchsorted(below, level[to]) if to < len(level) else len(below)
            visit(depth + 1, first, last, sums, np.searchsorted(level[at:to], below[first:last], "right") - 1)

    if n:
        visit(0, 0, len(starts[0]), np.zeros((1, len(entries)), kind), np.zeros(len(starts[0]), np.int64))
    return entry, distance


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    return np.floor(_matrix(column, dims) * SCALE) + 0.0  # no negative zero


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, row number of each input row, how often each occurs)."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    fresh = np.ones(len(parts), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    where = np.empty(len(parts), np.int64)
    where[order] = np.cumsum(fresh) - 1
    return ordered[fresh], where, np.bincount(where, minlength=int(fresh.sum()))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _cut(dims: int, parts: int):
    width = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _whole(batch.column(0), dims)
            for p in range(parts):
                distinct, _, n = _distinct(rows[:, p * width : (p + 1) * width])
                columns = [pa.array(np.full(len(n), p, np.int32)), _lists(distinct), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["position", "part", "n"])

    return run


def _sum_up(books: Books, width: int):
    """Weighted sums of the parts nearest to each entry, one row per entry and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(books), len(books[0]))
        count, total = np.zeros(shape, object), np.zeros((*shape, width), object)
        for batch in batches:
            position, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            rows = _matrix(batch.column(1), width)
            for p in np.unique(position):
                mine = position == p
                parts, weight = rows[mine], n[mine]
                entry, _ = nearest(parts, books[p])
                wide = abs(parts).max() * float(weight.sum()) >= 2**62
                exact = np.array([[int(v) for v in row] for row in parts], object) if wide else parts.astype(np.int64)
                kind = object if wide else np.int64
                uses, sums = np.zeros(shape[1], np.int64), np.zeros((shape[1], width), kind)
                np.add.at(uses, entry, weight)
                np.add.at(sums, entry, exact * weight.astype(kind)[:, None])
                count[p] += uses
                total[p] += sums
        at = [(p, e, d) for p, e in np.argwhere(count) for d in range(width)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(k[i]) for k in at], pa.int32()) for i in range(3)]
            + [pa.array([int(count[p, e]) for p, e, _ in at], pa.int64())]
            + [pa.array([Decimal(int(total[k])) for k in at], pa.decimal128(38, 0))],
            ["position", "entry", "dim", "n", "total"],
        )

    return run


def _encode(books: Books, dims: int):
    parts = len(books)
    width = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _whole(batch.column("embedding"), dims)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), object)
            for p in range(parts):
                distinct, where, _ = _distinct(rows[:, p * width : (p + 1) * width])
                entry, distance = nearest(distinct, books[p])
                codes[:, p], error = entry[where], error + distance[where]
            fits = [int(e) if e < 2**63 else None for e in error]
            columns = [batch.column("id"), batch.column("label")]
            columns += [pa.array([c.tobytes().hex() for c in codes]), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there, without null or non-finite components."""
    x = lambda v: v.cast("double")
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < F.lit(float("inf"))))
    return vectors.filter(F.col(column).isNotNull() & finite)


def fit(parts: DataFrame, books: Books, rounds: int = ROUNDS) -> Books:
    """Codebooks after some rounds; ``parts`` has one row per distinct part, with its count."""
    width = books[0].shape[1]
    schema = "position int, entry int, dim int, n long, total decimal(38,0)"
    for _ in range(rounds):
        sums = parts.mapInArrow(_sum_up(books, width), schema).groupBy("position", "entry", "dim")
        found = sums.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [b.copy() for b in books]
        for r in found.toLocalIterator():  # one number per entry and dimension
            books[r["position"]][r["entry"], r["dim"]] = int(r["total"]) // r["n"]
    return books


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.flat).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Per kept row: id, code, error, label_error, codebooks_sha256; other columns are not read.

    Rows without a vector, and with null or non-finite components, go.  So do vectors that cannot be
    cut (no components, or no multiple of ``parts``) or whose length is not that of the first kept one.
    The first codebook is the parts of the rows with the smallest ids, null ids last, equal ids by
    their vectors; below ``entries`` rows it is as much shorter.  Repeated rows are rows like others.
    Null labels are one label.  Errors too large for a long are null and not summed up.  An
    empty table gives no rows.

    Codebooks (``entries`` times the vector's length) travel to the tasks; at most 256 entries.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "partcodes")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    rows = usable(rows).filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    order = [F.asc_nulls_last("id"), "embedding"]
    first = rows.orderBy(*order).select("embedding").first()
    dims = len(first["embedding"]) if first else parts
    rows = rows.filter(F.size("embedding") == dims)
    start = np.array([r["embedding"] for r in rows.orderBy(*order).select("id", "embedding").limit(entries).collect()], float)
    whole = np.array([[int(v) for v in row] for row in np.floor(start.reshape(-1, dims) * SCALE)], object).reshape(-1, dims)
    books = np.split(whole, parts, axis=1)
    if first:
        cut = rows.select("embedding").mapInArrow(_cut(dims, parts), "position int, part array<double>, n long")
        distinct = cut.groupBy("position", "part").agg(F.sum("n").alias("n")).sortWithinPartitions("position", "part")
        distinct = scratch.keep(distinct, "parts")
        books = fit(distinct, books, rounds)
        scratch.drop(distinct)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = rows.mapInArrow(_encode(books, dims), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    coded = scratch.keep(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
