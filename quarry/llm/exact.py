"""Exact duplicates by sorting contents, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarry.llm.common import materialise, text_of

#: A text with more copies than this share of a partition's rows is split over partitions.
HOT_SHARE = 4


def _salted(docs: DataFrame, parts: int) -> DataFrame:
    """Rows with the columns text, begin, key, hot and salt beside a struct ``row`` of all their own."""
    rows = docs.select(F.struct("*").alias("row"), text_of().alias("text"))
    counted = rows.groupBy(F.xxhash64("text").alias("hot_key")).agg(F.count("*").alias("copies"))
    share = max(docs.count() // (HOT_SHARE * parts), 50)
    # At most HOT_SHARE * parts keys have more than total / (HOT_SHARE * parts) rows: safe to broadcast.
    hot = F.broadcast(counted.where(F.col("copies") > share))
    salt = F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("copies") / share)))
    joined = rows.join(hot, F.xxhash64("text") == F.col("hot_key"), "left")
    return joined.select("row", "text", F.substring("text", 1, 32).alias("begin"), F.xxhash64("text").alias("key"), F.col("copies").isNotNull().alias("hot"), salt.cast("int").alias("salt"))


def _partitions(docs: DataFrame) -> int:
    spark = docs.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _order(keep: str) -> Column:
    return F.desc_nulls_last("doc_id") if keep == "largest" else F.asc_nulls_last("doc_id")


def _equal() -> WindowSpec:
    """Equal texts. The splitters that Spark samples are beginnings and hashes, not whole texts; texts are compared in full."""
    return Window.partitionBy("begin", "key", "salt", "text")


def groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per document with the document of its group of equal texts that stays.

    Rows are range-partitioned by their text's beginning and hash (Spark samples the splitters) and sorted, so equal texts stand side by
    side and are compared in full. Texts with very many copies, found by a count of text hashes, are dealt to several
    partitions by a salt, and their parts' results are combined by SHA-256.

    Null texts count as empty. Null ids never stay while another is there; a group of null ids only has a null keep_id.
    Repeated rows count each in group_size, and one of equal ids is kept. Other columns are left out.
    """
    parts = _partitions(docs)
    equal = _equal().orderBy(_order(keep), "hot")
    every = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    salted = _salted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts).withColumn("doc_id", F.col("row.doc_id")).drop("row")
    local = materialise(
        salted.repartitionByRange(parts, "begin", "key", "salt").select(
            "doc_id", "hot", "salt", F.row_number().over(equal).alias("place"), F.first("doc_id").over(every).alias("part_keep"),
            F.count("*").over(every).alias("part_size"), F.sha2("text", 256).alias("text_sha256"),
        ),
        "exact",
    )
    known = F.col("part_keep").isNotNull()
    first = F.max(F.struct(known, "part_keep", (-F.col("salt")).alias("part"))) if keep == "largest" else F.min(F.struct(~known, "part_keep", F.col("salt").alias("part")))
    # One row per hot text: bounded like the hot keys.
    whole = local.where(F.col("hot") & (F.col("place") == 1)).groupBy(F.col("text_sha256").alias("hot_sha256")).agg(
        first.alias("first"), F.sum("part_size").alias("hot_size")
    ).select("hot_sha256", "hot_size", F.col("first.part_keep").alias("hot_keep"), F.abs("first.part").alias("hot_salt"))
    joined = local.join(F.broadcast(whole), F.col("hot") & (F.col("text_sha256") == F.col("hot_sha256")), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("hot"), F.col("hot_keep")).otherwise(F.col("part_keep")).alias("keep_id"),
        F.coalesce("hot_size", "part_size").alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | (F.col("salt") == F.col("hot_salt")))).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs``, all columns and one of each group of equal texts: that of the largest or smallest doc_id.

    Sorted and split like ``groups``; the winners of a hot text's parts, a few rows, are compared once more. Nulls and
    repeated rows as there.
    """
    parts = _partitions(docs)
    salted = _salted(docs, parts).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    placed = salted.repartitionByRange(parts, "begin", "key", "salt").withColumn("place", F.row_number().over(_equal().orderBy(_order(keep), "hot")))
    winners = materialise(placed.where("place = 1").drop("place", "begin", "salt"), "exact")
    last = Window.partitionBy("key", "text").orderBy(_order(keep))
    hot = winners.where("hot").withColumn("place", F.row_number().over(last)).where("place = 1")
    return winners.where("not hot").select("row.*").unionByName(hot.select("row.*"))
