"""A keyword index of segments: postings by ranges of tokens, tombstones for texts that changed, and merges.

An index folder holds segments and manifests, each a list of segments; readers follow the last whole one. A segment has
postings (token, key, tf) sorted by token and key, a directory of its files' token ranges (each up to the next file's first
token), the keys of its texts, and the tombstones that it brings: keys of earlier segments whose texts it replaces or deletes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.prefix import saved
from quarry.operators.retrieval import postings_of, tallies

#: Postings of a file, about.
FILE_ROWS = 2_000_000


def _children(spark: SparkSession, folder: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in store.listStatus(place)] if store.exists(place) else []


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Keywords(NamedTuple):
    """An index as a manifest tells it: its folder, key column and live segments."""

    spark: SparkSession
    path: str
    key: str
    version: int
    segments: list[int]

    def _tables(self, name: str) -> DataFrame:
        own = [self.spark.read.parquet(f"{self.path}/segments/{s:06d}/{name}").withColumn("segment", F.lit(s)) for s in self.segments]
        return reduce(lambda a, b: a.unionByName(b), own)

    def keys(self) -> DataFrame:
        """Live keys and the segments that hold them."""
        return self._tables("keys").join(self.dead(), [self.key, "segment"], "left_anti")

    def dead(self) -> DataFrame:
        """Tombstones: keys and the segments in which they no longer count."""
        return self._tables("tombstones").select(self.key, F.col("dead_in").alias("segment")).where(F.col("segment").isin(self.segments))

    def texts(self) -> DataFrame:
        """One row: the number of live texts."""
        return self.keys().agg(F.count("*").alias("texts"))

    def postings(self, tokens: Sequence[str] | None = None) -> DataFrame:
        """Live postings, of some tokens if given: then only the files whose ranges hold one of them are opened."""
        if tokens is None:
            found = self._tables("postings")
        else:
            holds = reduce(lambda a, b: a | b, ((F.col("first") <= t) & (F.col("last").isNull() | (F.col("last") >= t)) for t in tokens), F.lit(False))
            files = self._tables("directory").where(holds).select("file", "segment").collect()  # of a question's tokens
            own = [self.spark.read.parquet(*(r["file"] for r in files if r["segment"] == s)).withColumn("segment", F.lit(s)) for s in sorted({r["segment"] for r in files})]
            none = self.spark.read.parquet(f"{self.path}/segments/{self.segments[0]:06d}/postings").withColumn("segment", F.lit(0)).limit(0)
            found = (reduce(lambda a, b: a.unionByName(b), own) if own else none).where(F.col("token").isin(list(tokens)))
        return found.join(self.dead(), [self.key, "segment"], "left_anti").select(self.key, "token", "tf")


def open_keywords(spark: SparkSession, path: str, key: str) -> Keywords:
    """The index that the last whole manifest names; FileNotFoundError without any."""
    whole = [int(n) for n in _children(spark, f"{path}/manifest") if "_SUCCESS" in _children(spark, f"{path}/manifest/{n}")]
    if not whole:
        raise FileNotFoundError(path)
    version = max(whole)
    return Keywords(spark, path, key, version, sorted(r["segment"] for r in spark.read.parquet(f"{path}/manifest/{version:06d}").collect()))


def _write(spark: SparkSession, path: str, number: int, key: str, rows: DataFrame, size: int, keys: DataFrame, tombstones: DataFrame, once: bool) -> None:
    """A segment of about ``size`` postings; ``once`` if no token and key come twice, else their tf are added up."""
    base = f"{path}/segments/{number:06d}"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // FILE_ROWS)
    # rows of a token and text are equal here, so they meet where their range lies and need no shuffle of their own; a token of many texts is in several ranges
    ranges = rows.repartitionByRange(parts, "token", key)
    counted = ranges.select("token", key, "tf") if once else ranges.groupBy("token", key).agg(F.sum("tf").alias("tf"))
    counted.sortWithinPartitions("token", key).write.parquet(f"{base}/postings")
    # files are in order, too: one's range ends where the next one's begins
    stored = spark.read.parquet(f"{base}/postings").select("token", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    first = stored.where("row = 0").select("file", F.col("token").alias("first"))  # a row for each file
    first.withColumn("last", F.lead("first").over(Window.orderBy("file"))).write.parquet(f"{base}/directory")
    keys.write.parquet(f"{base}/keys")
    tombstones.write.parquet(f"{base}/tombstones")


def _put(spark: SparkSession, path: str, number: int, key: str, texts: DataFrame, text: str, tombstones: DataFrame) -> None:
    """A segment of texts, which are cut once; keys that several texts share are told by the keys alone."""
    keys, bags = texts.select(key), saved(tallies(texts, key, text), "bags", compression="zstd")
    once = keys.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    size = bags.agg(F.coalesce(F.sum(F.size("bag")), F.lit(0))).first()[0]
    _write(spark, path, number, key, postings_of(bags, key), size, keys, tombstones, once)


def _publish(spark: SparkSession, path: str, version: int, segments: Sequence[int]) -> None:
    spark.createDataFrame([(s,) for s in segments], "segment int").coalesce(1).write.parquet(f"{path}/manifest/{version:06d}")


def create(chunks: DataFrame, key: str, path: str, text: str = "text") -> None:
    """The index of texts as one segment; keys tell texts apart."""
    spark = chunks.sparkSession
    _put(spark, path, 0, key, chunks, text, chunks.select(key).limit(0).withColumn("dead_in", F.lit(0)))
    _publish(spark, path, 0, [0])


def upsert(index: Keywords, changed: DataFrame, text: str = "text", deleted: DataFrame | None = None) -> Keywords:
    """The index after some texts were put in, in place of those of their keys, and some keys deleted: one segment more.

    A key that is both stays deleted; of repeated keys among the changed texts all count, so pass one of each. Only the changed
    texts are cut into tokens; their keys are looked up among the live ones for tombstones.
    """
    spark, key = index.spark, index.key
    gone = deleted.select(key).distinct() if deleted is not None else changed.select(key).limit(0)
    rows = saved(changed.select(key, text).join(gone, key, "left_anti"), "changed")
    number = max(index.segments) + 1
    touched = rows.select(key).unionByName(gone).distinct()
    tombstones = index.keys().join(touched, key).select(key, F.col("segment").cast("int").alias("dead_in"))
    _put(spark, index.path, number, key, rows, text, tombstones)
    _publish(spark, index.path, index.version + 1, [*index.segments, number])
    return open_keywords(spark, index.path, key)


def merge(index: Keywords) -> Keywords:
    """The index with all live postings in one segment; folders that neither this manifest nor the one before names are deleted."""
    spark, key = index.spark, index.key
    number = max(index.segments) + 1
    keys = index.keys().select(key)
    # a live key is in one segment, so no token has it twice
    _write(spark, index.path, number, key, index.postings(), index._tables("postings").count(), keys, keys.limit(0).withColumn("dead_in", F.lit(0)), once=True)
    _publish(spark, index.path, index.version + 1, [number])
    used = {f"{s:06d}" for s in (*index.segments, number)}
    for name in _children(spark, f"{index.path}/segments"):
        if name not in used:
            _delete(spark, f"{index.path}/segments/{name}")
    return open_keywords(spark, index.path, key)
