"""Reports as files: one text file for each report, in a folder that names it.

On a file system that all executors share, the tasks write the files into a hidden folder of their attempt, and a
second job puts the folders of the reports in their places once all are written: a failed job leaves nothing that a reader
would take for a report.  On any other store that Spark reaches, Spark's own writer does it.  Spark's writer
on a file system would start three processes for each report, to set the modes of folder, file and checksum.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.session import shuffles_cleaned

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# How Spark names the folders of partitions, and the file in each.
_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")
_FILE = "part-00000.txt"
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_report_files(reports: DataFrame, path: str, text: str, key: str = "report_id", mode: str = "errorifexists") -> None:
    """``path/<key>=<value>/part-….txt`` with the text of each report; a report has one row (on a shared file system, more are an error), one without text has no file.

    With the mode ``overwrite`` the reports given replace their own files and leave those of others.
    """
    rows = reports.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(text).alias("value"))
    folder = _shared_folder(reports.sparkSession, path)
    if folder is None or mode not in ("error", "errorifexists", "overwrite"):
        # A report's row is in one task, so it has one file.
        rows.repartition(key).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)
    else:
        _write_folders(rows, folder, key, mode == "overwrite")


def _shared_folder(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it; None if it is on another store."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = named.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(named).toUri().getPath() if store.getUri().getScheme() == "file" else None


def folder_name(key: str, value: str | None) -> str:
    return f"{key}={_ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', value) if value else _NO_VALUE}"


def _write_folders(rows: DataFrame, folder: str, key: str, overwrite: bool) -> None:
    before = os.path.exists(folder)
    if before and not overwrite:
        raise FileExistsError(f"path {folder} already exists")
    staged = os.path.join(folder, f".staged-{uuid.uuid4().hex}")
    os.makedirs(staged)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own = TaskContext.get(), None
        for batch in batches:
            for value, content in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own is None:
                    own = os.path.join(staged, f"{task.partitionId()}-{task.taskAttemptId()}")
                    os.mkdir(own)
                report = os.path.join(own, folder_name(key, value))
                if os.path.isdir(report):
                    raise ValueError(f"report {value} has more than one row")
                os.mkdir(report)
                with open(os.path.join(report, _FILE), "wb") as f:
                    f.write(content + b"\n")
        if own is not None:
            yield pa.RecordBatch.from_pydict({"folder": [own]})

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"name": os.listdir(own)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                # Run again, it finds only what is not in its place yet.
                for name in os.listdir(own):
                    made, target = os.path.join(own, name), os.path.join(folder, name)
                    if not os.path.isdir(target):
                        os.rename(made, target)
                        continue
                    # A report that has a file gets the new one in its place at once; files of other writers go.
                    if os.path.exists(os.path.join(made, _FILE)):
                        os.replace(os.path.join(made, _FILE), os.path.join(target, _FILE))
                    for other in os.listdir(target):
                        if other != _FILE:
                            os.unlink(os.path.join(target, other))
                    os.rmdir(made)
        yield pa.RecordBatch.from_pydict({"folder": pa.array([], pa.string())})

    done = False
    try:
        with shuffles_cleaned(rows.sparkSession):
            # One name for each task.
            owns = [r.folder for r in rows.select(key, F.col("value").cast("binary")).mapInArrow(write, "folder string").collect()]
            if owns:
                folders = rows.sparkSession.createDataFrame([(o,) for o in owns], "folder string").repartition(len(owns))
                repeated = folders.mapInArrow(names, "name string").groupBy("name").count().where("count > 1").head()
                if repeated:
                    raise ValueError(f"report {repeated['name']} has more than one row")
                folders.mapInArrow(place, "folder string").collect()
        done = True
    finally:
        # Tasks of a failed job may still be at work for a moment.
        for _ in range(20):
            shutil.rmtree(staged, ignore_errors=True)
            if not os.path.exists(staged):
                break
        if not done and not before and not os.listdir(folder):
            os.rmdir(folder)


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed in a few tasks for each core; Spark's own choice is a task for each folder."""
    before = spark.conf.get(_LISTING, None)
    spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LISTING)
        else:
            spark.conf.set(_LISTING, before)


def read_report_files(spark: SparkSession, path: str, text: str, key: str = "report_id") -> DataFrame:
    """key (a string), text of every file."""
    with _few_listing_tasks(spark):
        found = spark.read.schema(f"value string, {key} string").text(path, wholetext=True)
    # The writer ends a text with a line feed of its own.
    return found.select(key, F.expr("substring(value, 1, length(value) - 1)").alias(text))
