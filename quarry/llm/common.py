"""Shared helpers: scratch tables, table readers and slicing of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; bounds the memory of a task whatever the batch holds.
SLICE_BYTES = 1 << 20
#: Most rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Before the names of catalog tables among the recorded folders.
TABLE = "table:"
_recorded: list[list[str]] = [[]]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that passes at most BATCH_ROWS rows or BATCH_BYTES at once between Spark and Python.

    Texts may be long, and a batch is held on both sides. Plans read these settings when they run, so they stay set for
    the session; smaller values of the caller's own are left alone.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    return df


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder of ``spark.checkpoint.dir``.

    Where that setting is absent and Spark runs in one process (tests), a temporary folder is set as checkpoint folder
    and used; on a cluster, whose machines don't share such a folder, that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quarry-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    if base.startswith("/"):
        base = "file://" + base
    elif base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]
    path = f"{base.rstrip('/')}/quarry-{what}-{uuid.uuid4().hex}"
    _recorded[-1].append(path)
    return path


@contextmanager
def recording() -> Iterator[list[str]]:
    """The scratch folders that are made within, for ``release`` once nothing reads them any more."""
    own: list[str] = []
    _recorded.append(own)
    try:
        yield own
    finally:
        _recorded.pop()


def bucketed(df: DataFrame, what: str, column: str, parts: int, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, bucketed by a column. ``release`` drops it from the catalog too."""
    spark = df.sparkSession
    path = scratch(spark, what)
    name = path.rpartition("/")[2].replace("-", "_")
    _recorded[-1].append(TABLE + name)
    df.write.format("parquet").option("path", path).options(**options).bucketBy(parts, column).saveAsTable(name)
    return spark.table(name)


def adopt(paths: list[str]) -> None:
    """Hand folders on to whoever records now."""
    _recorded[-1].extend(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders, in whatever store they are, and drop scratch tables."""
    for path in paths:
        if path.startswith(TABLE):
            spark.sql(f"DROP TABLE IF EXISTS {path.removeprefix(TABLE)}")
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def materialise(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: its partitions keep their rows and numbers, even when executors are lost."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """With doc_id this names a row: rows equal in both are repeats of one document."""
    return F.xxhash64(text_of(column))


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to at most ``most``; a larger row stands alone."""
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    at, done = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, to
        at, done = to, int(ends[to - 1])


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array, which has no nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return own, off - off[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(starts - ahead, lengths) + np.arange(total)


def strings(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A string column of a batch without nulls."""
    found = batch.column(column)
    return found.fill_null("") if found.null_count else found
