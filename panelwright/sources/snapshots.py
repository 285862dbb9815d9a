"""Dated parquet snapshots, committed run by run.

A run writes each of its tables to a folder of its own, ``<root>/<table>/run_date=<date>/attempt=<id>``, which nobody reads
yet. Its commit is one small file under ``<root>/_commits`` that names the folders, with rows and newest date of each table.
Readers follow commits only. So a run that is in progress or was broken off is never read, a rerun replaces all
tables of its date at one moment, and what an earlier commit names is left as it was. The latest run is the greatest run
date; of one date, the last commit counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import fixed_values as fixed

RUN = "run_date"
ATTEMPT = "attempt"
COMMITS = "_commits"
BEST_FIRST = ("panel_regimes", "panel_signals", "master")
REPORT_SCHEMA = "table_name string, latest string, n_rows bigint, file_age_days int, stale boolean"
_COMMIT_SCHEMA = (
    "run_date string, attempt string, committed_at timestamp, tables map<string, struct<folder string, n_rows bigint, latest string>>"
)


class SnapshotNotFound(FileNotFoundError):
    pass


def _files(spark: SparkSession, folder: str):
    """The folder as Hadoop path, and the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _newest(df: DataFrame) -> Column:
    for column in ("date", "year"):
        if column in df.columns:
            return F.max(column).cast("string")
    return F.max(F.lit(None).cast("string"))


@dataclass
class Run:
    """One run in the making. Tables can be read back as soon as they are written, by this run; by others after ``commit``."""

    spark: SparkSession
    root: str
    run_date: str
    attempt: str = field(default_factory=lambda: uuid.uuid4().hex)
    tables: dict[str, dict] = field(default_factory=dict)

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write a table, also one without rows, and read it back. Rows and newest date are taken on the way."""
        rows = df.drop(RUN, ATTEMPT)
        folder = f"{table}/{RUN}={self.run_date}/{ATTEMPT}={self.attempt}"
        seen = Observation()
        observed = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), _newest(rows).alias("latest"))
        observed.write.parquet(f"{self.root}/{folder}")
        self.tables[table] = {"folder": folder, "n_rows": seen.get["n_rows"], "latest": seen.get["latest"]}
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def commit(self) -> None:
        """Make all tables written so far the ones of this run date, at one moment.

        Commits are numbered. The file of a number is created exclusively, so of two runs that commit at once the later one
        takes the next number. A file that was not finished is no commit.
        """
        path, files = _files(self.spark, f"{self.root}/{COMMITS}")
        files.mkdirs(path)
        number = 1 + max([int(f.getPath().getName().split(".")[0]) for f in files.listStatus(path) if not f.getPath().getName().startswith((".", "_"))], default=0)
        while True:
            try:
                out = files.create(_files(self.spark, f"{self.root}/{COMMITS}/{number:012d}.json")[0], False)
                break
            except Py4JJavaError as problem:
                if "FileAlreadyExists" not in str(problem.java_exception.getClass().getName()) and "already exists" not in str(problem):
                    raise
                number += 1
        now = self.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\")").first()[0]
        line = json.dumps({"run_date": self.run_date, "attempt": self.attempt, "committed_at": now, "tables": self.tables})
        try:
            out.write(bytearray(line.encode()))
        finally:
            out.close()


def commits(spark: SparkSession, root: str) -> DataFrame:
    """All commits, a row each: number, run_date, attempt, committed_at, tables. No commit: no rows."""
    path, files = _files(spark, f"{root}/{COMMITS}")
    if not files.exists(path):
        return spark.createDataFrame([], f"number bigint, {_COMMIT_SCHEMA}")
    found = spark.read.schema(_COMMIT_SCHEMA).option("mode", "DROPMALFORMED").json(f"{root}/{COMMITS}")
    number = F.regexp_extract(F.col("_metadata.file_name"), "^([0-9]+)", 1).cast("bigint")
    return found.where("attempt IS NOT NULL AND tables IS NOT NULL").select(number.alias("number"), "run_date", "attempt", "committed_at", "tables")


def _committed(spark: SparkSession, root: str, table: str) -> dict[str, dict]:
    """Run date → (folder, n_rows, latest, committed_at) of a table, oldest first, as the last commit of each date has it."""
    entry = F.col("tables")[table]
    # A row per run of the table.
    rows = commits(spark, root).where(entry.isNotNull()).select("number", "run_date", "committed_at", entry.alias("entry")).collect()
    return {r["run_date"]: {**r["entry"].asDict(), "committed_at": r["committed_at"]} for r in sorted(rows, key=lambda r: (r["run_date"], r["number"]))}


def write_snapshot(df: DataFrame, root: str, table: str, run_date: date | str) -> None:
    """Write, or replace, one run of one table and commit it. Other tables and runs are left alone."""
    run = Run(df.sparkSession, root, str(run_date))
    run.write(df, table)
    run.commit()


def list_runs(spark: SparkSession, root: str, table: str) -> list[str]:
    """Committed run dates of a table, oldest first."""
    runs = list(_committed(spark, root, table))
    if not runs:
        raise SnapshotNotFound(f"no snapshot of '{table}' under {root}; run the refresh first")
    return runs


def _read(spark: SparkSession, root: str, table: str, run_date: str, entry: dict | None) -> DataFrame:
    if entry is None:
        raise SnapshotNotFound(f"no run {run_date} of '{table}' under {root}")
    try:
        return spark.read.parquet(f"{root}/{entry['folder']}")
    except AnalysisException as problem:
        raise SnapshotNotFound(f"run {run_date} of '{table}' under {root} cannot be read") from problem


def read_run(spark: SparkSession, root: str, table: str, run_date: date | str) -> DataFrame:
    """One run, with the columns that it was written with."""
    return _read(spark, root, table, str(run_date), _committed(spark, root, table).get(str(run_date)))


def read_all_runs(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of all runs with their ``run_date``; columns that only some runs have are NULL in the others."""
    found = _committed(spark, root, table)
    if not found:
        raise SnapshotNotFound(f"no snapshot of '{table}' under {root}; run the refresh first")
    folders = [f"{root}/{entry['folder']}" for entry in found.values()]
    return spark.read.option("mergeSchema", True).option("basePath", f"{root}/{table}").parquet(*folders).drop(ATTEMPT)


def read_latest(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Latest committed run; the files of other runs are not touched."""
    found = _committed(spark, root, table)
    if not found:
        raise SnapshotNotFound(f"no snapshot of '{table}' under {root}; run the refresh first")
    last = list(found)[-1]
    return _read(spark, root, table, last, found[last])


def read_previous(spark: SparkSession, root: str, table: str, before: date | str | None = None) -> DataFrame:
    """The last run before ``before`` (the latest run if not given); empty when there is none."""
    found = _committed(spark, root, table)
    if not found:
        raise SnapshotNotFound(f"no snapshot of '{table}' under {root}; run the refresh first")
    runs = list(found)
    older = [r for r in runs if r < str(before if before is not None else runs[-1])]
    if not older:
        return _read(spark, root, table, runs[0], found[runs[0]]).limit(0)
    return _read(spark, root, table, older[-1], found[older[-1]])


def read_best_panel(spark: SparkSession, root: str, tables: Sequence[str] = BEST_FIRST) -> DataFrame:
    """Latest run of the most enriched panel that exists."""
    for table in tables:
        try:
            return read_latest(spark, root, table)
        except SnapshotNotFound:
            continue
    raise SnapshotNotFound(f"none of {', '.join(tables)} under {root}; run the refresh first")


def content_freshness(df: DataFrame, table: str) -> DataFrame:
    """Latest date (or year) and number of rows of a table."""
    return df.agg(_newest(df).alias("latest"), F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(table).alias("table_name"), "latest", "n_rows"
    )


def freshness_report(
    spark: SparkSession,
    root: str,
    tables: Sequence[str],
    today: Column | None = None,
    stale_after_days: int = fixed.STALE_AFTER_DAYS,
) -> DataFrame:
    """Per table: latest data, rows, age of the latest run's commit in days, and whether that is too old.

    All of it comes from the commits; no table is opened. Tables without a snapshot are listed with NULLs.
    """
    day = F.current_date() if today is None else today
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(tables)], "place int, table_name string")
    known = commits(spark, root).select("number", "run_date", "committed_at", F.explode("tables").alias("table_name", "entry"))
    last = known.groupBy("table_name").agg(F.max_by(F.struct("committed_at", "entry"), F.struct("run_date", "number")).alias("last"))
    age = F.date_diff(day, F.col("last.committed_at").cast("date"))
    return (
        wanted.join(last, "table_name", "left")
        .orderBy("place")
        .select("table_name", "last.entry.latest", "last.entry.n_rows", age.alias("file_age_days"), (age > stale_after_days).alias("stale"))
    )


def row_counts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(run_date, n_rows) of all committed runs of a table, from the commits."""
    rows = [(run, entry["n_rows"]) for run, entry in _committed(spark, root, table).items()]
    return spark.createDataFrame(rows, "run_date string, n_rows bigint")
