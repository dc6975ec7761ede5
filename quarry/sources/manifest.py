"""A manifest of files with digests of their contents, so that only new and changed files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, length long, modified timestamp, digest string"


def _children(spark: SparkSession, folder: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in store.listStatus(place)] if store.exists(place) else []


def versions(spark: SparkSession, manifest: str) -> list[int]:
    """Versions of a manifest that were written whole, in order."""
    return sorted(int(n) for n in _children(spark, manifest) if "_SUCCESS" in _children(spark, f"{manifest}/{n}"))


def read_version(spark: SparkSession, manifest: str, version: int | None) -> DataFrame:
    """Files of a version; none of no version."""
    return spark.createDataFrame([], ROWS) if version is None else spark.read.schema(ROWS).parquet(f"{manifest}/{version:06d}")


def refresh(spark: SparkSession, folder: str, manifest: str, pattern: str = "*.json") -> DataFrame:
    """Writes the next version for the files that the folder has now, and returns path and status of all files of this and the version before.

    Listing tells lengths and times only. Files whose length or time differ are read, and no others: their status is new, changed,
    or touched if the contents are the same after all. The others are same, or removed; empty files don't count. The paths to read are handed to Spark's
    reader by the driver, which lists the files anyway.
    """
    known = versions(spark, manifest)
    before = read_version(spark, manifest, known[-1] if known else None)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    now = reader.option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    known_rows = before.select("path", "length", "modified")
    unread = [r["path"] for r in now.join(known_rows, ["path", "length", "modified"], "left_anti").select("path").collect()]
    same = before.join(now, ["path", "length", "modified"], "left_semi")
    rows = same
    if unread:
        found = spark.read.format("binaryFile").load(unread)
        rows = same.unionByName(found.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest")))
    version = known[-1] + 1 if known else 0
    rows.write.parquet(f"{manifest}/{version:06d}")
    return changes(before, read_version(spark, manifest, version))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and status of the files of two versions."""
    old = before.select("path", F.col("modified").alias("old_modified"), F.col("length").alias("old_length"), F.col("digest").alias("old_digest"))
    both = now.join(old, "path", "full")
    status = (
        F.when(F.col("old_digest").isNull(), "new").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("old_digest"), "changed")
        .when((F.col("modified") != F.col("old_modified")) | (F.col("length") != F.col("old_length")), "touched").otherwise("same")
    )
    return both.select("path", status.alias("status"))


def to_read(found: DataFrame) -> list[str]:
    """Paths of new and changed files, for a reader."""
    return sorted(r["path"] for r in found.where(F.col("status").isin("new", "changed")).collect())
