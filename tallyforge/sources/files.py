"""Reading accounting tables from files, appending to them by month, and keeping keyed tables in versions.

Paths go through Spark's own file systems, so a table can be wherever Spark can read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.schemas import schema


def read_table(spark: SparkSession, path: str, table: str, kind: str = "parquet", **options: str) -> DataFrame:
    """An accounting table from Parquet, CSV, JSON or ORC, with its declared schema (never inferred)."""
    return spark.read.format(kind).schema(schema(table)).options(**options).load(path)


def append_entries(entries: DataFrame, path: str, tasks: int = 8) -> None:
    """Appends entries under the month in which they were written, so a backdated entry lands in the open month. ``tasks`` is how many write one month's rows of a batch."""
    by_month = entries.withColumn("month", F.date_format("created_at", "yyyy-MM"))
    by_month.repartition("month", F.pmod(F.xxhash64("id"), F.lit(tasks))).write.mode("append").partitionBy("month").parquet(path)


def read_entries(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Entries written by ``append_entries``, with the months outside a range of yyyy-MM pruned before any file is read."""
    found = spark.read.schema(schema("entries").add("month", "string")).parquet(path)
    if since:
        found = found.where(F.col("month") >= since)
    if until:
        found = found.where(F.col("month") <= until)
    return found.drop("month")


def compact_month(spark: SparkSession, path: str, month: str, files: int = 8) -> None:
    """Rewrites one month in ``files`` files.

    The rewritten month is finished in a folder beside the table, the old one is
    moved aside, and only then does the new one take its place; two renames, no
    copy. A job that is lost in between leaves one of them whole: ``restore_month``
    puts it back.
    """
    restore_month(spark, path, month)
    live, new, old = _month_folders(path, month)
    fs, at = _fs(spark, new)
    spark.read.parquet(live).repartition(files, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(new)
    fs.rename(_fs(spark, live)[1], _fs(spark, old)[1])
    fs.rename(at, _fs(spark, live)[1])
    fs.delete(_fs(spark, old)[1], True)


def restore_month(spark: SparkSession, path: str, month: str) -> None:
    """Ends a compaction that was lost: with its month gone the one moved aside comes back, and what it left is removed."""
    live, new, old = _month_folders(path, month)
    fs, moved = _fs(spark, old)
    if fs.exists(moved):
        if fs.exists(_fs(spark, live)[1]):
            fs.delete(moved, True)
        else:
            fs.rename(moved, _fs(spark, live)[1])
    fs.delete(_fs(spark, new)[1], True)


def _month_folders(path: str, month: str) -> tuple[str, str, str]:
    """The month, its rewritten form and its old form; the latter two are beside the table, where no reader looks."""
    side = path.rstrip("/")
    return f"{side}/month={month}", f"{side}__new_{month}", f"{side}__old_{month}"


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class VersionedTable:
    """A keyed table as a row of complete versions ``v=N``; a reader sees the newest one that was finished.

    A version is written by one job and counts once its success marker is there,
    so a job that is lost leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, table: str, keep: int = 2) -> None:
        self.spark, self.path, self.table, self.keep = spark, path.rstrip("/"), table, keep

    def versions(self) -> list[int]:
        fs, at = _fs(self.spark, self.path)
        if not fs.exists(at):
            return []
        done = []
        for status in fs.listStatus(at):
            m = re.fullmatch(r"v=(\d+)", status.getPath().getName())
            if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done.append(int(m[1]))
        return sorted(done)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version (or a given one); empty before the first."""
        done = self.versions()
        if version is None:
            version = done[-1] if done else None
        if version is None:
            return self.spark.createDataFrame([], schema(self.table))
        return self.spark.read.schema(schema(self.table)).parquet(f"{self.path}/v={version}")

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """Writes the next version (or a given one) and lets go of versions beyond ``keep``."""
        done = self.versions()
        version = (done[-1] + 1 if done else 0) if version is None else version
        rows.select(*schema(self.table).fieldNames()).write.mode("overwrite").parquet(f"{self.path}/v={version}")
        fs, _ = _fs(self.spark, self.path)
        for old in done[: -self.keep + 1 or None] if len(done) >= self.keep else []:
            if old != version:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}"), True)
        return version

    def update(self, change: Callable[[DataFrame], DataFrame], version: int | None = None) -> int:
        return self.write(change(self.read()), version)


def upsert(old: DataFrame, new: DataFrame, key: list[str], newest: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key. With ``newest``, a row is replaced only by one that is larger in that column."""
    value = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*value).alias("_old"))
    b = new.select(*key, F.struct(*value).alias("_new"))
    met = a.join(b, key, "full")
    take = F.col("_new").isNotNull()
    if newest:
        take = take & (F.col("_old").isNull() | (F.col(f"_new.{newest}") > F.col(f"_old.{newest}")))
    return met.select(*key, F.when(take, F.col("_new")).otherwise(F.col("_old")).alias("_row")).select(*key, "_row.*").select(*old.columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """``old`` and those rows of ``new`` whose key isn't there yet, the first of each key by ``order``."""
    fresh = new.join(old.select(*key).distinct(), key, "left_anti")
    rest = [c for c in new.columns if c not in key]
    by = order or rest
    first = fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_row")).select(*key, "_row.*")
    return old.unionByName(first.select(*old.columns))
