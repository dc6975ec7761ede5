"""Running totals of groups in order, where a group of any size is split over partitions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.scratch import shared_folder

#: Column of segmented rows: the range partition in which a row lies.
SEGMENT = "_segment"


def saved(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again."""
    path = shared_folder(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segmented(rows: DataFrame, by: Sequence[str], order: Sequence[str], save: Callable[[DataFrame, str], DataFrame] = saved) -> DataFrame:
    """Rows dealt to segments by ranges of their group and order, as a table: a large group is in several segments.

    Rows that are equal in group and order are in one segment; nulls come first.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return save(rows.repartitionByRange(parts, *by, *order).withColumn(SEGMENT, F.spark_partition_id()), "segments")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, xors: Mapping[str, Column] | None = None) -> DataFrame:
    """``rows`` (segmented by the same columns) with running totals of their groups, this row included, and ``<name>_all``.

    Each segment's rows are summed by a window of their own; then the totals of the segments before are added. Only a
    segment's first and last group can go on in another, so what is added is at most two rows a segment, and broadcast.
    Rows that are equal in order get their totals in any order among them.
    """
    values = {**(sums or {}), **(xors or {})}
    total = {name: F.bit_xor if xors and name in xors else F.sum for name in values}
    rows = rows.withColumns({f"_v_{name}": column for name, column in values.items()})
    keys = F.struct(*by)
    ends = rows.groupBy(SEGMENT).agg(F.array(F.min(keys), F.max(keys)).alias("ends")).select(SEGMENT, F.explode(F.array_distinct("ends")).alias("k"))
    own = [f"_k_{i}" for i in range(len(by))]
    split = ends.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(f"k.{b}").alias(o) for b, o in zip(by, own, strict=True)))
    parts = rows.join(F.broadcast(split), _same(by, own), "left_semi").groupBy(SEGMENT, *by).agg(*(total[name](f"_v_{name}").alias(name) for name in values))
    every = Window.partitionBy(*by)
    before = every.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(
        F.col(SEGMENT).alias("_s"), *(F.col(b).alias(o) for b, o in zip(by, own, strict=True)),
        *(total[name](name).over(before).alias(f"_b_{name}") for name in values), *(total[name](name).over(every).alias(f"_a_{name}") for name in values),
    )
    here = Window.partitionBy(SEGMENT, *by)
    upto = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({name: total[name](f"_v_{name}").over(upto) for name in values} | {f"{name}_all": total[name](f"_v_{name}").over(here) for name in values})
    joined = local.join(F.broadcast(ahead), (F.col(SEGMENT) == F.col("_s")) & _same(by, own), "left")

    def whole(name: str) -> Column:
        first = F.coalesce(F.col(f"_b_{name}"), F.lit(0))
        return F.col(name).bitwiseXOR(first) if xors and name in xors else F.col(name) + first

    out = {name: whole(name) for name in values} | {f"{name}_all": F.coalesce(F.col(f"_a_{name}"), F.col(f"{name}_all")) for name in values}
    return joined.withColumns(out).drop("_s", *own, *(f"_{x}_{name}" for x in "vba" for name in values))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, take: Sequence[str]) -> DataFrame:
    """``left`` with the columns ``take`` of the last row of ``right`` in its group at or before it, null without any.

    Both have the columns ``by`` and ``at``; of right rows at one place the one of largest ``take`` counts, so there left rows
    see it too. Rows of both are counted together in segments, and a left row joins the right one by its number: the join has
    one row of the right for each key, and no group is in one task.
    """
    rank = F.struct(*take)
    best = right.groupBy(*by, at).agg(F.max(rank).alias("_take"))
    own = left.select(*by, at, F.struct("*").alias("_row"))
    kind = best.schema["_take"].dataType
    both = own.withColumns({"_take": F.lit(None).cast(kind), "_left": F.lit(1)}).unionByName(best.withColumns({"_row": F.lit(None).cast(own.schema["_row"].dataType), "_left": F.lit(0)}))
    counted = running(segmented(both, by, [at, "_left"]), by, [at, "_left"], sums={"_n": (1 - F.col("_left")).cast("long")})
    keys = [f"_r_{i}" for i in range(len(by))]
    found = counted.where("_left = 0").select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col("_n").alias("_m"), F.col("_take").alias("_found"))
    joined = counted.where("_left = 1").drop("_take").join(found, _same(by, keys) & (F.col("_n") == F.col("_m")), "left")
    return joined.select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in take))
