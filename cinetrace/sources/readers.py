"""Readers for stores, documents and media listings."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the session's checkpoint setting.

    Only where it is unset and everything runs on one machine, as in tests, a temporary folder
    stands in; on a cluster executors would write to disks of their own, so it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cinetrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, in the one of this application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clean_up(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once no result is read any more."""
    remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is read or written meanwhile."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


class Scratch:
    """Intermediate tables of one job, as Parquet files in the shared folder.

    Written tables cut lineage, survive lost executors and keep column pruning.  What no later step
    reads is removed with ``only``; nothing unfinished may read it.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.home = scratch_dir(spark, job)
        self._kept: dict[str, DataFrame] = {}
        self._files = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._files += 1
        path = f"{self.home}/{self._files}-{name}"
        df.write.parquet(path)
        kept = self._kept[path] = self.spark.read.schema(df.schema).parquet(path)
        return kept

    def only(self, *kept: DataFrame) -> None:
        for path, df in list(self._kept.items()):
            if all(df is not k for k in kept):
                remove(self.spark, path)
                del self._kept[path]


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it; None where it is not one of plain files."""
    files, target = _at(spark, path)
    return target.toUri().getPath() if files.getUri().getScheme() == "file" else None


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    files, target = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Give a folder its name; False if that is taken."""
    files, target = _at(spark, new)
    return not files.exists(target) and files.rename(_at(spark, old)[1], target)


def print_of(df: DataFrame) -> str:
    """A print of the files that a table reads: their names, sizes and times."""
    spark, parts = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        files, target = _at(spark, name)
        status = files.getFileStatus(target)
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


# Fixed value: file name endings of recordings.
MEDIA_ENDINGS = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mpg")


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listing(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """Files under ``root``.  Each task lists many folders: by itself Spark gives every one a task, up to 10,000."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    with configured(spark, _LISTING_TASKS, str(tasks)):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return found.select("path", "length", "modificationTime")


def discover_media(spark: SparkSession, root: str, endings: tuple[str, ...] = MEDIA_ENDINGS) -> DataFrame:
    """Recordings directly under ``root``, by path.  File contents are not read."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return _listing(spark, root, False).filter(ending.isin(*endings)).orderBy("path")


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` with its size."""
    return _listing(spark, root, True).select("path", "length").orderBy("path")


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file in a run's folder: run_id, name (path below the run), length, modified_ms.

    Runs lie in folders ``run_id=<number>`` below any table's folder under ``root``.  Contents are not read.
    """
    found = _listing(spark, root, True)
    run = F.regexp_extract("path", r"/run_id=(\d+)/", 1)
    table = F.regexp_extract("path", r"/([^/]+)/run_id=\d+/", 1)
    return found.filter(run != "").select(
        run.cast("bigint").alias("run_id"),
        table.alias("table"),
        F.regexp_extract("path", r"/run_id=\d+/(.*)$", 1).alias("name"),
        "length",
        F.unix_millis("modificationTime").alias("modified_ms"),
    )


def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A stored table in its declared shape; a missing folder is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], ddl)
    return conform(spark.read.option("mergeSchema", "true").parquet(path), ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Declared columns and types; columns that older files lack are NULL."""
    fields = T.StructType.fromDDL(ddl).fields
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def transcript_segments(documents: DataFrame) -> DataFrame:
    """Speech documents of either layout to segments; empty texts are dropped."""
    item = lambda start, end, text: F.struct(
        start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"), F.trim(text).alias("text")
    )
    offsets = F.transform("transcription", lambda s: item(s["offsets"]["from"], s["offsets"]["to"], s["text"]))
    seconds = F.transform("segments", lambda s: item(s["start"] * 1000, s["end"] * 1000, s["text"]))
    return documents.select("run_id", F.posexplode(F.coalesce(offsets, seconds)).alias("at", "s")).select(
        "run_id", F.col("at").cast("bigint").alias("at"), "s.*"
    ).filter("text <> ''")


def read_json(spark: SparkSession, path: str, ddl: str, multi_line: bool = False) -> DataFrame:
    """JSON of a declared shape; unreadable records keep their text in ``_corrupt_record``."""
    reader = spark.read.schema(ddl).option("mode", "PERMISSIVE").option("multiLine", str(multi_line).lower())
    return reader.json(path)


def read_documents(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines of a declared shape, and apart from them the lines that cannot be read (``line``)."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.from_json("value", f"{ddl}, __unread string", {"columnNameOfCorruptRecord": "__unread"}).alias("d")
    )
    good = lines.filter("d.__unread IS NULL").select("d.*").drop("__unread")
    return good, lines.filter("d.__unread IS NOT NULL").select("line")


def with_fallback(preferred: DataFrame, fallback: DataFrame, column: str = "doc") -> DataFrame:
    """One document per run: the preferred place, else the fallback."""
    b = fallback.withColumnRenamed(column, "__other")
    return preferred.join(b, "run_id", "full").withColumn(column, F.coalesce(column, "__other")).drop("__other")


def chunk_documents(documents: DataFrame) -> DataFrame:
    """Chunk documents with numeric frame keys."""
    return documents.withColumn(
        "per_frame_lines", F.transform_keys("per_frame_lines", lambda k, _v: k.cast("bigint"))
    )
