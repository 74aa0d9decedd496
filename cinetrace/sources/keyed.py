"""Keyed writes as jobs: latest row per key wins, then whole runs are rewritten."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetrace.operators.ordering import first_per_key, position
from cinetrace.settings import block_rows
from cinetrace.sources.readers import exists, local_path


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-row replace: per key the new row, and of several new ones the last (``seq``).

    ``old`` holds a key once.  Only ``new`` is ranked; the stored rows are filtered against its keys.
    """
    columns = old.columns
    latest = first_per_key(new.select(*columns, "seq"), keys, [F.col("seq").desc()]).select(*columns)
    replaced = latest.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return old.join(replaced, same, "left_anti").unionByName(latest)


def append_with_ids(old: DataFrame, new: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """Append rows, numbering them on from the highest id of their run in the given order."""
    top = old.groupBy("run_id").agg(F.max(id_column).alias("__top"))
    bucket = F.floor(F.col(order[0]) / block_rows(new))
    numbered = position(new, ["run_id"], [F.col(c) for c in order], [bucket], "__pos").join(
        top, "run_id", "left"
    )
    ids = F.coalesce("__top", F.lit(0)) + F.col("__pos") + 1
    return old.unionByName(numbered.withColumn(id_column, ids).select(*old.columns))


def update_columns(rows: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Set the columns of ``updates`` on matching rows; NULL is a value; other keys do nothing."""
    changed = [c for c in updates.columns if c not in keys]
    marked = updates.select(
        *keys, *[F.col(c).alias(f"__new_{c}") for c in changed], F.lit(True).alias("__hit")
    )
    picked = [
        F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
        for c in rows.columns
    ]
    return rows.join(marked, keys, "left").select(*picked)


def replace_caption(captions: DataFrame, new: DataFrame) -> DataFrame:
    """A caption written again loses its verdict: the row is replaced as a whole."""
    full = new
    for field in captions.schema.fields:
        if field.name not in new.columns:
            full = full.withColumn(field.name, F.lit(None).cast(field.dataType))
    return upsert(captions, full, ["run_id", "frame_idx"])


def set_meta(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Set keys; a NULL value deletes the key."""
    return upsert(meta, changes, ["run_id", "key"]).filter("value IS NOT NULL")


def clear_stages(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    return ledger.join(runs.select("run_id"), "run_id", "left_anti")


def complete_runs(runs: DataFrame, ledger: DataFrame, stage: str) -> DataFrame:
    done = ledger.filter(F.col("stage_name") == stage).select("run_id")
    return runs.join(done, "run_id", "left_semi")


def replace_profiles(labels: DataFrame, new: DataFrame) -> DataFrame:
    """New labels replace all labels of their run and profile."""
    touched = new.select("run_id", "profile_name").distinct()
    return labels.join(touched, ["run_id", "profile_name"], "left_anti").unionByName(new.select(*labels.columns))


def cleared_profiles(labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """How many labels clearing each profile removes."""
    return labels.join(profiles.select("run_id", "profile_name"), ["run_id", "profile_name"]).groupBy(
        "run_id", "profile_name"
    ).agg(F.count(F.lit(1)).alias("removed"))


RUNS = 256  # runs of neighbouring numbers that share a folder
FOLDER = "__runs"  # the folder's column


def run_folder() -> Column:
    return F.floor(F.col("run_id") / RUNS).cast("bigint")


def write_runs(df: DataFrame, path: str, order: str, runs: DataFrame | None = None) -> None:
    """Rewrite the runs in ``df`` only; ``runs`` names them where ``df`` is dear to compute.

    RUNS neighbouring runs share a folder, so the files do not grow with the runs; the other runs of a
    touched folder are read and written again.  Rows are ranged by run and ``order``, so a large run is
    written by many tasks.
    """
    spark, placed = df.sparkSession, df.withColumn(FOLDER, run_folder())
    if exists(spark, path):
        runs = (df if runs is None else runs).select("run_id").distinct()
        folders = runs.select(run_folder().alias(FOLDER)).distinct()
        named = folders.limit(MOST_PARTS + 1).collect()
        stored = spark.read.option("mergeSchema", "true").parquet(path).withColumn(FOLDER, F.col(FOLDER).cast("bigint"))
        if len(named) > MOST_PARTS:
            stored = stored.join(folders, FOLDER, "left_semi")
        else:
            stored = stored.filter(F.col(FOLDER).isin([r[0] for r in named if r[0] is not None]))
        placed = placed.unionByName(stored.join(runs, "run_id", "left_anti"), allowMissingColumns=True)
    (
        placed.repartitionByRange("run_id", order)
        .sortWithinPartitions(FOLDER, "run_id", order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(FOLDER)
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What ``write_runs`` stored, in the shape of ``like`` and with the folder of each row."""
    columns = [F.lit(None).cast("bigint").alias(FOLDER)]
    return spark.read.schema(like.select("*", *columns).schema).parquet(path)


def write_run_folders(rows: DataFrame, path: str, form: str) -> None:
    """A folder ``run_id=<number>`` and a file per run, as ``parquet`` or ``text``, RUNS runs a task.

    The tasks are given by number: rows this small would all be put into one.  In a folder of plain files each task
    writes its own: Hadoop would start processes for each to set the rights of it and of its checksums, which takes
    far longer than the file itself.  Elsewhere each task moves its files to their place, as the driver would move
    those of all runs one by one.
    """
    spark = rows.sparkSession
    tasks = rows.select(F.approx_count_distinct("run_id")).first()[0] // RUNS + 1
    dealt, local = rows.repartition(tasks, "run_id"), local_path(spark, path)
    if local is None:
        writer = dealt.write.partitionBy("run_id").format(form)
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").save(path)
        return
    if exists(spark, path):
        raise ValueError(f"{path} is there already")
    run = F.coalesce(F.col("run_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    named = dealt.select(F.concat(F.lit("run_id="), run).alias(FOLDER), *[c for c in rows.columns if c != "run_id"])
    written = named.sortWithinPartitions(FOLDER).mapInArrow(partial(_files_of_runs, path=local, form=form), "files long")
    written.agg(F.sum("files")).collect()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Neighbouring rows of one folder, without its column."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        code = coded.indices.to_numpy()
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        rest = batch.select(batch.schema.names[1:])
        for start, size in zip(starts.tolist(), np.diff(starts, append=len(code)).tolist(), strict=True):
            yield coded.dictionary[int(code[start])].as_py(), rest.slice(start, size)


def _write_parquet(name: str, parts: Iterator[pa.RecordBatch]) -> None:
    first = next(parts)
    with pq.ParquetWriter(name, first.schema) as writer:
        writer.write_batch(first)
        for part in parts:
            writer.write_batch(part)


def _write_text(name: str, parts: Iterator[pa.RecordBatch]) -> None:
    with open(name, "w", encoding="utf-8", newline="") as file:
        for part in parts:
            file.writelines(f"{line or ''}\n" for line in part.column(0).to_pylist())


def _files_of_runs(batches: Iterator[pa.RecordBatch], path: str, form: str) -> Iterator[pa.RecordBatch]:
    """Write the files of a task's runs; each gets its name once it is whole, so a task may be tried again."""
    write, ending = {"parquet": (_write_parquet, "parquet"), "text": (_write_text, "txt")}[form]
    name, files = f"part-{TaskContext.get().partitionId():05d}.{ending}", 0
    for folder, pieces in groupby(_pieces(batches), key=lambda p: p[0]):
        home = f"{path}/{folder}"
        os.makedirs(home, exist_ok=True)
        unfinished = f"{home}/_{uuid.uuid4().hex}"  # readers pass over such names
        write(unfinished, (part for _, part in pieces))
        os.replace(unfinished, f"{home}/{name}")
        files += 1
    yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})


MOST_PARTS = 2000  # touched folders up to which they are named in the scan


class KeyedStore:
    """A stored table with a key, in folders by runs and, within them, by a range of keys.

    A folder holds RUNS runs and, where ``order`` names a number in the key, one block of it, so a run
    with most of the rows lies in many folders.  Writing reads and rewrites the folders that the new rows
    fall into; the scan names them, and the files of all others stay as they are.  A write that is cut
    off leaves the old folders, and can be tried again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str | None = None, rows: int | None = None):
        self.spark, self.path, self.keys, self.order, self.rows = spark, path, keys, order, rows

    def _placed(self, df: DataFrame) -> DataFrame:
        block = F.lit(0) if self.order is None else F.floor(F.col(self.order) / (self.rows or block_rows(df)))
        return df.withColumns({FOLDER: run_folder(), "__keys": block.cast("bigint")})

    def _stored(self, ddl_of: DataFrame) -> DataFrame:
        if not exists(self.spark, self.path):
            return self._placed(ddl_of.filter("false"))
        schema = self._placed(ddl_of).schema
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self, like: DataFrame) -> DataFrame:
        """All rows, in the shape of ``like``."""
        return self._stored(like).filter("run_id IS NOT NULL").select(*like.columns)

    def touched(self, changes: DataFrame, like: DataFrame) -> DataFrame:
        """Stored rows of the folders that the changes fall into."""
        parts = self._placed(changes.select("run_id", *([self.order] if self.order else []))).select("__runs", "__keys").distinct()
        named = parts.limit(MOST_PARTS + 1).collect()
        stored = self._stored(like).filter("run_id IS NOT NULL")
        if len(named) > MOST_PARTS:
            return stored.join(parts, ["__runs", "__keys"], "left_semi")
        # One list of names: a condition per run would nest as deep as there are runs.
        names = [f"{r['__runs']}/{r['__keys']}" for r in named]
        return stored.filter(F.concat_ws("/", "__runs", "__keys").isin(names))

    def upsert(self, new: DataFrame, like: DataFrame) -> None:
        """Whole-row replace: the row of the highest ``seq`` per key takes the place of the stored one."""
        old = self.touched(new, like).select(*like.columns)
        self._rewrite(upsert(old, new, self.keys))

    def set_values(self, changes: DataFrame, like: DataFrame) -> None:
        """As ``upsert`` of key and value; a key whose newest value is NULL goes."""
        old = self.touched(changes, like).select(*like.columns)
        self._rewrite(upsert(old, changes, self.keys), F.col("value").isNotNull())

    def _rewrite(self, rows: DataFrame, stays: Column | None = None) -> None:
        """Write whole folders.  Only a folder that is written is replaced, so one that loses rows gets a row without a run."""
        placed = self._placed(rows)
        if stays is not None:
            gone = placed.filter(~stays).select("__runs", "__keys").distinct()
            empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("__runs", "__keys") else F.col(f.name) for f in placed.schema.fields]
            placed = placed.filter(stays).unionByName(gone.select(*empty))
        spread = ["__runs", "__keys", *[k for k in self.keys if k in placed.columns]]
        (
            placed.repartitionByRange(*spread)
            .sortWithinPartitions(*spread)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("__runs", "__keys")
            .parquet(self.path)
        )
