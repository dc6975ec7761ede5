"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared folder of ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves if Spark runs in one process; on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quarry-{what}-{uuid.uuid4().hex}"


#: Of each application and name the fingerprint of what was read, and the folder written from it.
_kept: dict[tuple[str, str], tuple[str, str]] = {}


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Names, sizes and times of all files below the paths."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))


def kept(spark: SparkSession, name: str, inputs: Sequence[str], write: Callable[[str], None]) -> str:
    """A folder that ``write`` makes from the inputs once, and again when their files have changed; the old one is deleted then."""
    key, mark = (spark.sparkContext.applicationId, f"{name} {' '.join(inputs)}"), fingerprint(spark, inputs)
    before = _kept.get(key)
    if before and before[0] == mark:
        return before[1]
    path = shared_folder(spark, name)
    write(path)
    _kept[key] = (mark, path)
    if before:
        place = spark._jvm.org.apache.hadoop.fs.Path(before[1])
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return path
