"""Report files: what is written is read back, and a failed job leaves no file."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.report_files import read_report_files, write_report_files

ROWS = [("a/1", "# One\n\ntext\n"), ("2", ""), ("007", "ends without\nline feed — ü"), ("none", None)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "report_id string, markdown string").repartition(3)


def test_files_equal_the_table(spark, tmp_path):
    path = tmp_path / "out"
    write_report_files(frame(spark), str(path), "markdown")
    assert sorted(map(tuple, read_report_files(spark, str(path), "markdown").collect())) == sorted(r for r in ROWS if r[1] is not None)
    assert {p.name: len(list(p.glob("*.txt"))) for p in path.iterdir() if p.is_dir()} == {"report_id=a%2F1": 1, "report_id=2": 1, "report_id=007": 1}
    with pytest.raises(Exception, match="(?i)exist"):
        write_report_files(frame(spark), str(path), "markdown")
    write_report_files(frame(spark, [("2", "new"), ("9", "nine")]), str(path), "markdown", mode="overwrite")
    assert dict(map(tuple, read_report_files(spark, str(path), "markdown").collect())) == {"a/1": ROWS[0][1], "007": ROWS[2][1], "2": "new", "9": "nine"}


def test_a_failed_task_leaves_nothing_behind(spark, tmp_path):
    path = tmp_path / "out"
    some = spark.range(50).select(F.col("id").cast("string").alias("report_id"), F.lit("x").alias("markdown")).repartition(4)
    broken = some.withColumn("markdown", F.when(F.col("report_id") == "33", F.raise_error(F.lit("killed"))).otherwise(F.col("markdown")))
    write_report_files(frame(spark), str(path), "markdown")
    with pytest.raises(Exception, match="killed"):
        write_report_files(broken, str(path), "markdown", mode="overwrite")
    assert len(list(path.rglob("*.txt"))) == 3 and read_report_files(spark, str(path), "markdown").count() == 3
    write_report_files(some, str(path), "markdown", mode="overwrite")
    assert read_report_files(spark, str(path), "markdown").count() == 52


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    path = tmp_path / "out"
    write_report_files(frame(spark, [(str(i), f"report {i}") for i in range(100)]), str(path), "markdown")
    context, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    context.setJobGroup("listing", "listing")
    found = read_report_files(spark, str(path), "markdown")
    context.setJobGroup("none", "none")
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("listing") for i in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * context.defaultParallelism
    assert spark.conf.get(name, None) == before
    assert dict(map(tuple, found.collect())) == {str(i): f"report {i}" for i in range(100)}


def test_folders_are_named_as_spark_names_them(spark, tmp_path):
    odd = ["a/1", "7", "", "x=y:z", "100%", "q'\"*?\\{[]}^#", "a b.c-d_é", "tab\there", None]
    df = spark.createDataFrame([(v, f"text {i} ü\n") for i, v in enumerate(odd) if v != ""], "report_id string, markdown string")
    write_report_files(df, str(tmp_path / "own"), "markdown")
    df.selectExpr("report_id", "markdown AS value").write.partitionBy("report_id").text(str(tmp_path / "spark"))
    names = [{p.name for p in (tmp_path / w).iterdir() if p.is_dir()} for w in ("own", "spark")]
    assert names[0] == names[1] and len(names[0]) == len(odd) - 1
    assert sorted(map(str, read_report_files(spark, str(tmp_path / "own"), "markdown").collect())) == sorted(map(str, df.collect()))


def test_a_report_starts_no_process(spark, tmp_path):
    """Spark's writer starts some for each folder and file, and leaves a checksum file beside each."""
    path = tmp_path / "out"
    for mode in ("errorifexists", "overwrite"):
        write_report_files(frame(spark, [(str(i), f"report {i} {mode}") for i in range(100)]), f"file://{path}", "markdown", mode=mode)
    assert dict(map(tuple, read_report_files(spark, str(path), "markdown").collect())) == {str(i): f"report {i} overwrite" for i in range(100)}
    assert not list(path.rglob("*.crc")) and {len(list(p.iterdir())) for p in path.iterdir()} == {1} and not list(path.glob(".staged*"))


def test_a_failed_first_write_can_be_repeated(spark, tmp_path):
    path = tmp_path / "out"
    broken = frame(spark).withColumn("markdown", F.when(F.col("report_id") == "2", F.raise_error(F.lit("killed"))).otherwise(F.col("markdown")))
    with pytest.raises(Exception, match="killed"):
        write_report_files(broken, str(path), "markdown")
    assert not path.exists()
    write_report_files(frame(spark, []), str(path), "markdown")
    assert read_report_files(spark, str(path), "markdown").count() == 0


def test_files_of_another_writer_are_replaced(spark, tmp_path):
    path = tmp_path / "out"
    old = frame(spark, [(str(i), f"old {i}") for i in range(6)])
    old.selectExpr("report_id", "markdown AS value").write.partitionBy("report_id").text(str(path))
    write_report_files(frame(spark, [(str(i), f"new {i}") for i in range(3)]), str(path), "markdown", mode="overwrite")
    assert dict(map(tuple, read_report_files(spark, str(path), "markdown").collect())) == {str(i): f"{'new' if i < 3 else 'old'} {i}" for i in range(6)}


@pytest.mark.parametrize("parts", [1, 3])
def test_a_report_of_two_rows_is_an_error(spark, tmp_path, parts):
    path = tmp_path / "out"
    write_report_files(frame(spark), str(path), "markdown")
    twice = spark.createDataFrame([("2", "x"), ("8", "y"), ("2", "z")], "report_id string, markdown string").repartitionByRange(parts, "markdown")
    with pytest.raises(Exception, match="more than one row"):
        write_report_files(twice, str(path), "markdown", mode="overwrite")
    assert dict(map(tuple, read_report_files(spark, str(path), "markdown").collect())) == {r[0]: r[1] for r in ROWS if r[1] is not None}
