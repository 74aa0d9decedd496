"""WARC fixity audit: hash trees over records and ordered offset ranges, compared between replicas.

Leaves are the hashes of records.  A range of 2**RANGE_BITS bytes of a file hashes its records in
offset order, wider ranges hash 2**FAN_BITS narrower ones, a file hashes its widest range, a bucket
its files, and the root all buckets.  The audit compares the roots, and goes down only where hashes
differ, so two sound replicas cost one comparison and a damaged record costs one path.  Everything
is a grouped aggregate or a join on tree nodes, in column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinetrace.llm.common import Scratch

RANGE_BITS, FAN_BITS, BUCKETS = 16, 4, 4096
SEGMENT = 512  # pages per archive file


def archive(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(file, offset, record_id, record): pages as WARC responses, laid out in files of SEGMENT ids.

    Null columns count as empty; rows without an id share a file of their own; repeated rows are
    records like others.
    """
    html = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    record = F.concat(head, html, F.lit("\r\n\r\n")).cast("binary")
    file = F.format_string("segment-%010d", F.expr(f"{id_col} div {SEGMENT}"))
    file = F.when(F.col(id_col).isNull(), "segment-none").otherwise(file)
    rows = pages.select(file.alias("file"), F.col(id_col).alias("record_id"), record.alias("record"))
    before = W.partitionBy("file").orderBy("record_id", F.xxhash64("record")).rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.octet_length("record")).over(before), F.lit(0)).cast("long")
    return rows.select("file", offset.alias("offset"), "record_id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """(file, offset, record_id, length, hash) of records; a null record is an empty one."""
    record = F.coalesce("record", F.lit(b""))
    return records.select(
        "file", "offset", "record_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("hash")
    )


def _over(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One node per key: the hash of its children in order, with their places."""
    child = F.concat_ws(":", *[F.col(c).cast("string") for c in order], "hash")
    children = F.array_sort(F.collect_list(F.struct(*order, child.alias("child"))))
    line = F.array_join(F.transform(children, lambda x: x["child"]), "\n")
    return rows.groupBy(*keys).agg(F.sha2(line.cast("binary"), 256).alias("hash"))


@dataclass
class Tree:
    leaves: DataFrame
    ranges: list[DataFrame]  # (file, range, hash), narrow to wide
    files: DataFrame
    buckets: DataFrame
    root: str


def tree(leaf_rows: DataFrame, levels: int, scratch: Scratch) -> Tree:
    own = scratch.keep(leaf_rows, "leaves")
    nodes = own.withColumn("range", F.shiftright("offset", RANGE_BITS))
    ranges = [scratch.keep(_over(nodes, ["file", "range"], ["offset", "record_id"]), "ranges")]
    for _ in range(levels):
        wider = ranges[-1].select("file", F.shiftright("range", FAN_BITS).alias("wide"), "range", "hash")
        wider = _over(wider, ["file", "wide"], ["range"]).withColumnRenamed("wide", "range")
        ranges.append(scratch.keep(wider, "ranges"))
    files = scratch.keep(_over(ranges[-1], ["file"], ["range"]), "files")
    buckets = _over(files.withColumn("bucket", _bucket()), ["bucket"], ["file"])
    buckets = scratch.keep(buckets, "buckets")
    root = _over(buckets.withColumn("all", F.lit(0)), ["all"], ["bucket"]).first()
    return Tree(own, ranges, files, buckets, root["hash"] if root else "")


def _bucket():
    return (F.crc32(F.col("file").cast("binary")) % BUCKETS).cast("int")


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that one side lacks."""
    both = a.select(*keys, F.col("hash").alias("hash_a")).join(b.select(*keys, F.col("hash").alias("hash_b")), keys, "full")
    return both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(*keys)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, offset, record_id, kind, length, other_length) of records on which two replicas differ.

    ``left`` and ``right`` are leaf tables of the same archive.  kind is ``differs``, ``missing``
    (only left has it) or ``extra`` (only right).  Records are matched by file, offset and id; of
    records that share all three, those whose hashes occur equally often on both sides agree.  Equal
    roots, or two empty replicas, give no rows.  File and offset are not null.
    """
    spark = left.sparkSession
    scratch = Scratch(spark, "fixity")
    end = left.select("offset").unionByName(right.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels = max(0, -(-max(0, end.bit_length() - RANGE_BITS) // FAN_BITS))
    a, b = tree(left, levels, scratch), tree(right, levels, scratch)
    if a.root == b.root:
        return _verdicts(a.leaves.limit(0), b.leaves.limit(0))
    bad = _differing(a.buckets, b.buckets, ["bucket"])

    def in_bad(t: DataFrame, at: dict) -> DataFrame:
        return t.withColumns(at).join(bad, bad.columns, "left_semi")

    bad = scratch.keep(_differing(*[in_bad(t.files, {"bucket": _bucket()}) for t in (a, b)], ["file"]), "bad-files")
    below = {}
    for k in range(levels, -1, -1):
        pair = [in_bad(t.ranges[k], below).select("file", "range", "hash") for t in (a, b)]
        bad = scratch.keep(
            _differing(*pair, ["file", "range"]).select("file", F.col("range").alias("parent")), "bad-ranges"
        )
        below = {"parent": F.shiftright("range", FAN_BITS)}
    below = {"parent": F.shiftright("offset", RANGE_BITS)}
    return _verdicts(in_bad(a.leaves, below), in_bad(b.leaves, below))


def _verdicts(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = ["file", "offset", "record_id"]

    def side(df: DataFrame, name: str) -> DataFrame:
        hashes = F.array_sort(F.collect_list("hash")).alias(f"{name}_hashes")
        return df.groupBy(*keys).agg(hashes, F.max("length").alias(f"{name}_length"))

    x, y = side(a, "a").alias("x"), side(b, "b").alias("y")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    both = x.join(y, same, "full").filter(~F.col("a_hashes").eqNullSafe(F.col("b_hashes")))
    kind = F.when(F.col("b_hashes").isNull(), "missing").when(F.col("a_hashes").isNull(), "extra").otherwise("differs")
    return both.select(
        *[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys],
        kind.alias("kind"),
        F.col("a_length").alias("length"),
        F.col("b_length").alias("other_length"),
    )
