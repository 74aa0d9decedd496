"""Near-duplicate groups by min-max hashing over word shingles.

Every text becomes the set of its distinct five-word shingles (64-bit hashes).  Under each of
``PERMUTATIONS`` permutations both the smallest and the largest shingle are kept, so a signature of
``2 * PERMUTATIONS`` values costs half the hash evaluations.  The values are banded; texts that
agree in a band are candidates, and every candidate link is confirmed on the full sets.  In small
sets minimum and maximum depend on each other and bands miss more, so these are also filed under
their first shingles in the order of hashes, as many as one of which any linked set must share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinetrace.llm.common import SPACE, Scratch, texts_of
from cinetrace.llm.graph import components

WORDS = 5
PERCENT = 75  # of the union, for a link
PERMUTATIONS = 64  # a minimum and a maximum each: 128 values
ROWS = 4  # values per band: 32 bands; a pair of large sets at 0.75 shares none with probability 5e-6
SMALL = 32  # sets of fewer shingles are joined exactly

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_WORD_FACTORS = _odd(WORDS, 11)
_FLIPS, _FACTORS = _odd(PERMUTATIONS, 12), _odd(PERMUTATIONS, 13)
_BAND_FACTORS = _odd(ROWS, 14)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` are one shingle, no word none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    acc = h[: n - width + 1] * _WORD_FACTORS[0]
    for j in range(1, width):
        acc += h[j : n - width + 1 + j] * _WORD_FACTORS[j]
    return np.unique(_mixed(acc))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum and maximum of every non-empty set under each permutation."""
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        x = (values ^ _FLIPS[k]) * _FACTORS[k]
        out[:, 2 * k] = np.minimum.reduceat(x, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(x, starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash per band of ``ROWS`` values; the band's number is part of it."""
    parts = signature.reshape(len(signature), -1, ROWS)
    acc = (_mixed(parts) * _BAND_FACTORS).sum(axis=2, dtype=np.uint64)
    return _mixed(acc + np.arange(parts.shape[1], dtype=np.uint64) * _MIX)


def first_shingles(shingles: np.ndarray) -> np.ndarray:
    """Keys of the least shingles of a sorted set, of which every linked set has one among its own.

    A linked set shares PERCENT of this one's shingles at least, so it misses fewer than are kept here;
    and the least shared shingle of two sets lies among the first of both.
    """
    n = len(shingles)
    return _mixed(shingles[: n - -(-n * PERCENT // 100) + 1] + _MIX)


_SIGNED = "id long, text_hash long, n_shingles long, set_key binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in texts_of(batches, "text"):
        sets = [shingle_set(t) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        rows: list[list[int] | None] = [None] * len(sets)
        if full:
            found = bands(signatures([sets[i] for i in full])).view(np.int64)
            for i, row in zip(full, found):
                rows[i] = row if len(sets[i]) >= SMALL else np.concatenate([row, first_shingles(sets[i]).view(np.int64)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("text_hash"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(rows, pa.list_(pa.int64())),
            ],
            names=["id", "text_hash", "n_shingles", "set_key", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in texts_of(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [batch.column("set_key"), pa.array([shingle_set(t).view(np.int64) for t in texts], pa.list_(pa.int64()))],
            names=["set_key", "shingles"],
        )


#: Texts, or shingles in all, that one block of the exact comparison holds at most on average.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1_000_000


def _linked(common, n_a, n_b):
    return 100 * common >= PERCENT * (n_a + n_b - common)


def _matrix(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    at = [np.searchsorted(columns, s) for s in sets]
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, (s, j) in enumerate(zip(sets, at)):
        j = j[j < len(columns)]
        out[i, j[columns[j] == s[: len(j)]]] = 1
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections between two blocks of sorted sets."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float64)
    for i in range(0, len(shared), width):
        columns = shared[i : i + width]
        out += _matrix(left, columns) @ _matrix(right, columns).T
    return out


def _block_links(pdf):
    """Links across components between the two sides of one pair of blocks."""
    import pandas as pd

    own = pdf["part"] == pdf["part_a"]
    a, b = pdf[own], pdf[pdf["part"] == pdf["part_b"]]
    found: list[tuple[bytes, bytes]] = []
    if len(a) and len(b):
        common = overlaps([np.asarray(s) for s in a["shingles"]], [np.asarray(s) for s in b["shingles"]])
        n_a, n_b = a["shingles"].map(len).to_numpy()[:, None], b["shingles"].map(len).to_numpy()[None, :]
        across = a["root"].to_numpy()[:, None] != b["root"].to_numpy()[None, :]
        keys_a, keys_b, roots_b = a["set_key"].to_numpy(), b["set_key"].to_numpy(), b["root"].to_numpy()
        for i, row in enumerate(_linked(common, n_a, n_b) & across):
            # one link to each component says as much as all links to it
            found += [(keys_a[i], keys_b[j]) for j in {roots_b[j]: j for j in np.flatnonzero(row)}.values()]
    return pd.DataFrame(found, columns=["a", "b"])


def _open_buckets(members: DataFrame) -> DataFrame:
    """(bucket, n) with at least two components, one bucket for each distinct membership."""
    seen = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("set_key")).alias("x"),
        F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("y"),
        F.min("root").alias("lo"),
        F.max("root").alias("hi"),
    )
    return seen.filter("lo <> hi").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return (
        members.drop("root")
        .join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
        .withColumn("root", F.coalesce("root", "set_key"))
    )


def signed(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text hash, set size, key of the set (null if empty), band hashes."""
    own = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    return scratch.keep(own.mapInArrow(_sign, _SIGNED), "signed")


def set_roots(docs: DataFrame, rows: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root) over keys of sets that a confirmed link joins; equal sets share a key.

    Hubs first: every bucket's members are compared with its best-connected member only.  Buckets
    that still hold several components are compared in blocks of bounded size, each block pair in a
    task of its own, so that no link between candidates is lost and no pair table is built.
    """
    classes = rows.filter("set_key is not null").groupBy("set_key").agg(
        F.first("bands").alias("bands"), F.min(F.struct("id", "text_hash")).alias("at")
    )
    members = scratch.keep(classes.select("set_key", "at", F.explode("bands").alias("bucket")), "members")
    several = members.groupBy("bucket").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi")
    crowded = scratch.keep(members.join(several.select("bucket"), "bucket").withColumn("root", F.col("set_key")), "crowded")
    scratch.drop(members)
    kept_buckets = scratch.keep(_open_buckets(crowded), "buckets")
    members = scratch.keep(crowded.join(kept_buckets, "bucket"), "candidates")
    scratch.drop(crowded)

    wanted = members.select("set_key", "at.id", "at.text_hash").distinct()
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    ).filter("text is not null")
    texts = texts.join(
        wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["text_hash"] == wanted["text_hash"]), "inner"
    ).select("set_key", "text")
    sets = scratch.keep(
        texts.mapInArrow(_sets, "set_key binary, shingles array<long>").dropDuplicates(["set_key"]), "sets"
    )

    degree = members.groupBy("set_key").agg(F.sum("n").alias("degree"))
    hubs = members.join(degree, "set_key").groupBy("bucket").agg(F.max(F.struct("degree", "set_key"))["set_key"].alias("hub"))
    hubbed = scratch.keep(members.select("bucket", "set_key", "root", "n").join(hubs, "bucket"), "hubbed")
    pairs = hubbed.filter("set_key <> hub").select("hub", "set_key").distinct()
    hub_sets = sets.select(F.col("set_key").alias("hub"), F.col("shingles").alias("hub_shingles"))
    common = F.size(F.array_intersect("shingles", "hub_shingles"))
    links = (
        pairs.join(sets, "set_key")
        .join(hub_sets, "hub")
        .filter(_linked(common, F.size("shingles"), F.size("hub_shingles")))
        .select(F.col("hub").alias("a"), F.col("set_key").alias("b"))
    )
    roots = scratch.keep(components(links, scratch), "roots")

    rest = scratch.keep(_with_roots(hubbed.filter("set_key <> hub").select("bucket", "set_key", "root"), roots), "rest")
    still = _open_buckets(rest)
    left = rest.join(still, "bucket").join(sets, "set_key")
    weight = left.groupBy("bucket").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES)
        ).cast("int").alias("parts")
    )
    left = left.drop("n").join(weight, "bucket").withColumn("part", F.pmod(F.xxhash64("set_key"), "parts").cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket",
        F.least("part", "other").alias("part_a"),
        F.greatest("part", "other").alias("part_b"),
        "part",
        "set_key",
        "root",
        "shingles",
    )
    more = left.groupBy("bucket", "part_a", "part_b").applyInPandas(_block_links, "a binary, b binary")
    more = scratch.keep(more, "block-links")
    ends = _with_roots(more.select(F.col("a").alias("set_key"), "b"), roots).select(F.col("root").alias("a"), F.col("b").alias("set_key"))
    ends = _with_roots(ends, roots).select("a", F.col("root").alias("b"))
    upper = components(ends, scratch).select(F.col("node").alias("root"), F.col("root").alias("upper"))
    joined = roots.unionByName(  # ends that had no link before
        more.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
        .join(roots.select("node"), "node", "left_anti")
    )
    return joined.join(upper, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id, kept.

    component_id is the least id that links reach; ``kept`` marks the document that bears it.
    Texts without a word (null, empty, white space) have no shingle and are linked with nothing.
    Repeated rows share a set and therefore a component, and each is returned.  A null id never
    names a component unless all its ids are null; other columns of ``docs`` play no part.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = signed(docs, scratch, id_col, text_col)
    roots = scratch.keep(set_roots(docs, rows, scratch, id_col, text_col), "set-roots")
    scratch.only(rows, roots)
    least = rows.filter("set_key is not null").groupBy("set_key").agg(F.min("id").alias("least"))
    rooted = _with_roots(least, roots)
    across = _with_roots(least.join(roots.select(F.col("node").alias("set_key")), "set_key", "left_semi"), roots)
    across = across.groupBy("root").agg(F.min("least").alias("lowest"))
    named = rooted.join(across, "root", "left").select("set_key", F.coalesce("lowest", "least").alias("component_id"))
    return (
        rows.select("id", "n_shingles", "set_key")
        .join(named, "set_key", "left")
        .withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id")))
        .select(
            F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
        )
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group is kept.

    The least id of a group stays, a null id only if there is no other.  Of repeated rows of that id
    and text one stays.  Rows whose text has no word are in no group, so all of them stay.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = signed(docs, scratch, id_col, text_col)
    roots = scratch.keep(set_roots(docs, rows, scratch, id_col, text_col), "set-roots")
    scratch.only(rows, roots)
    best = rows.filter("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("best")
    )
    linked = roots.withColumnRenamed("node", "set_key")
    best = best.join(linked, "set_key", "left").groupBy(F.coalesce("root", "set_key")).agg(F.min("best").alias("best"))
    best = best.select(F.col("best.id").alias("__id"), F.col("best.text_hash").alias("__hash"), F.lit(True).alias("__best"))
    none = F.length(F.translate(F.coalesce(text_col, F.lit("")), SPACE, "")) == 0
    own = docs.filter(~none).withColumn("__text_hash", F.xxhash64(text_col))
    same = (F.col("__text_hash") == F.col("__hash")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
    again = W.partitionBy(id_col, "__text_hash").orderBy(F.lit(0))
    kept = own.join(best, same).withColumn("__n", F.row_number().over(again)).filter("__n = 1")
    return kept.select(docs.columns).unionByName(docs.filter(none))
