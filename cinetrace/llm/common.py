"""Shared pieces: tables, scratch files in the shared folder, byte-level text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line rules: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def crc_text(c: Column) -> Column:
    """crc32 of a value written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Intermediate tables of one job, as Parquet files in the shared folder.

    Written tables cut lineage, survive lost executors and keep column pruning.  Tables that no
    later step reads are removed with ``drop``.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.home = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"
        self._files = 0
        self._kept: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._files += 1
        path = f"{self.home}/{self._files}-{name}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        self._kept.append(kept)
        return kept

    def only(self, *kept: DataFrame) -> None:
        """Remove all tables but these; nothing unfinished may read the others."""
        self.drop(*[df for df in self._kept if all(df is not k for k in kept)])

    def drop(self, *kept: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self._kept = [k for k in self._kept if all(k is not df for df in kept)]


SLICE = 512  # rows whose derived values are held at once


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """A column in slices of bounded length."""
    for at in range(0, len(column), SLICE):
        yield column.slice(at, SLICE)


def texts_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of each batch with their texts as bytes; null is the empty text."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.slice(at, SLICE)
            yield part, text_bytes(part.column(column))


def text_bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
