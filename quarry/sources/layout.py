"""A Z-order layout of payload columns: filters on any of them read few row groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a row group, bits that a column gives to the curve at most, bits of the curve, and sampled rows that choose the cuts.
GROUP_ROWS, FIELD_BITS, CURVE_BITS, SAMPLE = 20_000, 5, 62, 50_000


def cuts(df: DataFrame, fields: Sequence[str], bits: int = FIELD_BITS, sample: int = SAMPLE) -> dict[str, list]:
    """For each column up to 2 ** bits - 1 values that cut its rows into shares of about equal size.

    From about ``sample`` rows; as with Spark's own range partitioning, a sample that is off makes groups uneven, not results wrong.
    """
    n = df.count()
    some = df.select(*fields)
    rows = (some.sample(False, min(1.0, sample / n), seed=5) if n > sample else some).toArrow()
    out = {}
    for name in fields:
        values = sorted(v for v in rows[name].to_pylist() if v is not None)
        places = [values[len(values) * i // 2**bits] for i in range(1, 2**bits)] if values else []
        out[name] = sorted({v for v in places if v != values[0]})
    return out


def curve(found: Mapping[str, list]) -> Column:
    """Place on the Z-order curve: the columns' shares' numbers, highest bits first, one bit of each column in turn; null counts as least."""
    lists = []
    for name, limits in found.items():
        share = sum((F.coalesce(F.col(name) >= F.lit(v), F.lit(False)).cast("long") for v in limits), F.lit(0).cast("long"))
        width = len(limits).bit_length()
        lists.append([F.shiftright(share, b).bitwiseAND(F.lit(1).cast("long")) for b in range(width - 1, -1, -1)])
    turns = [bits[i] for i in range(FIELD_BITS) for bits in lists if i < len(bits)][:CURVE_BITS]
    place = F.lit(0).cast("long")
    for bit in turns:
        place = F.shiftleft(place, 1).bitwiseOR(bit)
    return place


def write_layout(df: DataFrame, path: str, fields: Sequence[str], keys: Sequence[str] = (), group_rows: int = GROUP_ROWS, narrow: Sequence[str] = (), make: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Rows as Parquet along the curve of ``fields``, in row groups of ``group_rows`` with statistics, and bloom filters of ``keys``.

    Rows of one place on the curve are dealt on by their hash, so many equal rows lie in several files. Rows that are made from few
    columns are dealt as these: ``narrow`` names them and ``make`` gives the rows of them again, one for one. A filter is sized by
    the rows of a group.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = list(narrow) if make else df.columns
    placed = df.withColumn("_place", curve(cuts(df, fields))).withColumn("_hash", F.pmod(F.xxhash64(*fields, F.monotonically_increasing_id()), F.lit(1 << 16))).select(*own, "_place", "_hash")
    dealt = placed.repartitionByRange(parts, "_place", "_hash").sortWithinPartitions("_place", *([] if make else fields))
    writer = (make(dealt) if make else dealt.drop("_place", "_hash")).write.option("parquet.block.row.count.limit", str(group_rows)).option("compression", "zstd")
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(group_rows))
    writer.parquet(path)


def group_stats(spark: SparkSession, path: str, fields: Sequence[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row for each row group (file, group, rows) with min_ and max_ of the columns, as Parquet keeps them."""
    rows = spark.read.parquet(path).select(*fields, F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / group_rows).alias("group"))
    return rows.groupBy("file", "group").agg(F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in fields for n, f in (("min", F.min), ("max", F.max))))


def may_hold(wanted: Mapping[str, tuple]) -> Column:
    """Can a row group hold rows whose columns are in these closed ranges (least, most), by its statistics?"""
    out = F.lit(True)
    for name, (least, most) in wanted.items():
        out = out & (F.col(f"max_{name}") >= F.lit(least)) & (F.col(f"min_{name}") <= F.lit(most))
    return F.coalesce(out, F.lit(False))
