"""A ledger of tick files: what has been taken, exactly once under repeats and failures.

The ledger is an append-only table: a row for each file taken (path, length, time, how it went, run).
A run lists what is there without reading it, leaves out what the ledger has as it is, decodes the
rest into a folder of its own, and then appends its rows. That append ends the run: ticks of a
folder without rows in the ledger belong to a run that failed and are never read. A file whose length
or time has changed is taken again, and its ticks of an earlier run are left out.
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.sources.coverage import present_hours
from candlewright.sources.ticks import FILE_GLOB, decode_files, rejects, tick_files, to_ticks

LEDGER = ("path string, length long, modified timestamp, symbol string, hour_ts timestamp_ntz, status string, "
          "error string, ticks long, run string, run_no long")
RECORDS = ("path string, seq long, ms long, ask_raw long, bid_raw long, ask_vol double, bid_vol double, error string, "
           "symbol string, hour_ts timestamp_ntz, run string")


class Run(NamedTuple):
    """A run's number and name, and how many files it took, of these rejected, and their ticks."""

    run_no: int
    run: str
    files: int
    rejected: int
    ticks: int


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """All rows of the ledger, also of files taken again later."""
    if not _exists(spark, f"{base}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{base}/ledger")


def current(entries: DataFrame) -> DataFrame:
    """The latest row of each path."""
    latest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("run_no"), "run"))
    return entries.withColumn("_n", latest).where("_n = 1").drop("_n")


def new_files(spark: SparkSession, root: str, base: str, **some: object) -> DataFrame:
    """``binaryFile`` rows of files that the ledger doesn't have as they are now.

    ``some`` are the symbols and days of ``tick_files``. Content is read only where it is selected.
    """
    known = current(ledger(spark, base)).select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    files = tick_files(spark, root, **some)
    same = (files["path"] == known["path"]) & (files["length"] == known["_length"]) & (files["modificationTime"] == known["_modified"])
    return files.join(known, same, "left_anti")


def _only(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The listed files with their content.

    Only their day folders are looked into, and of the other files there none is opened that is older than all
    listed ones. The folders' names go through the driver, which lists files for Spark anyway.
    """
    folders = [r[0] for r in listed.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).distinct().collect()]
    oldest = listed.agg(F.min("modificationTime")).first()[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", FILE_GLOB).load(
        [re.sub(r"([\\{}\[\]*?])", r"\\\1", f) for f in folders])
    return files.where(F.col("modificationTime") >= F.lit(oldest)).join(listed.select("path"), "path", "left_semi")


def take_new(spark: SparkSession, root: str, base: str, volume_type: str = "int32", **some: object) -> Run:
    """Take the files that are new or changed; one run at a time.

    A file that changes while it is taken is listed with its old time, and so taken again by the next run.
    """
    run = uuid.uuid4().hex
    number = (ledger(spark, base).agg(F.max("run_no")).first()[0] or 0) + 1
    fresh = new_files(spark, root, base, **some)
    listed = f"{base}/listed/run={run}"
    fresh.select("path", "length", "modificationTime").write.parquet(listed)
    listed = spark.read.schema("path string, length long, modificationTime timestamp").parquet(listed)
    if listed.isEmpty():
        return Run(number, run, 0, 0, 0)
    # the listing decides: files that come or change meanwhile are the next run's
    decode_files(_only(spark, listed), volume_type).write.parquet(f"{base}/records/run={run}")
    taken = _records(spark, base).where(F.col("run") == run)
    counted = taken.groupBy("path").agg(
        F.count("ms").alias("ticks"), F.max("error").alias("error"), F.max("symbol").alias("symbol"), F.max("hour_ts").alias("hour_ts"))
    rows = listed.join(counted, "path", "left").select(
        "path", "length", F.col("modificationTime").alias("modified"), "symbol", "hour_ts",
        F.when(F.col("error").isNull(), "taken").otherwise("rejected").alias("status"), "error",
        F.when(F.col("error").isNull(), F.coalesce("ticks", F.lit(0))).otherwise(0).cast("long").alias("ticks"),
        F.lit(run).alias("run"), F.lit(number).cast("long").alias("run_no"))
    rows.coalesce(8).write.mode("append").parquet(f"{base}/ledger")       # this commits the run
    done = ledger(spark, base).where(F.col("run") == run).agg(
        F.count(F.lit(1)), F.count_if(F.col("status") == "rejected"), F.coalesce(F.sum("ticks"), F.lit(0))).first()
    return Run(number, run, *done)


def _records(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(RECORDS).parquet(f"{base}/records")


def taken_records(spark: SparkSession, base: str) -> DataFrame:
    """Decoded records of the latest taking of each file; folders of failed runs are not read."""
    if not _exists(spark, f"{base}/records"):
        return spark.createDataFrame([], RECORDS).drop("run")
    valid = current(ledger(spark, base)).select(F.col("path").alias("_path"), F.col("run").alias("_run"))
    rows = _records(spark, base)
    return rows.join(valid, (rows["run"] == valid["_run"]) & (rows["path"] == valid["_path"]), "left_semi").drop("run")


def taken_ticks(spark: SparkSession, base: str) -> DataFrame:
    return to_ticks(taken_records(spark, base))


def taken_rejects(spark: SparkSession, base: str) -> DataFrame:
    return rejects(taken_records(spark, base)).distinct()


def taken_hours(spark: SparkSession, base: str) -> DataFrame:
    """(symbol, hour_ts) with a readable file, from the ledger alone; coverage and missing hours start from it."""
    return present_hours(current(ledger(spark, base)).where("status = 'taken'").select("path", "length"))
