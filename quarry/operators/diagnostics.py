"""Quality checks of a corpus of report chunks, and the scores that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Chapters in which a finding is hardly ever right.
BAD_CHAPTERS = ["executive summary", "preface", "recommendations", "introduction", "annexures", "annexure", "glossary", "abbreviations", "contents", "table of contents", "foreword", "acknowledgement"]
#: Texts shorter or longer than this fit badly for search.
SHORT, LONG = 50, 3000


def percent(part: Column, whole: Column) -> Column:
    """Per cent of a whole, which counts as one if it is none."""
    return part * 100 / F.greatest(whole, F.lit(1))


def lengths(chunks: DataFrame, by: str) -> DataFrame:
    """Sizes of texts by report: how many are short or long, and percentiles by index: the value at n // 10 and so on.

    Texts are counted by size and the counts summed in order, so no report's texts are sorted or gathered in one task.
    """
    sizes = chunks.groupBy(by, F.length(F.coalesce("text", F.lit(""))).alias("size")).agg(F.count("*").alias("n"))
    summed = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy("size"))).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    at = lambda e, name: F.min(F.when(F.col("upto") > F.floor(e), F.col("size"))).alias(name)
    m, some = F.col("all"), lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return summed.groupBy(by).agg(
        F.sum("n").alias("total"), some(F.col("size") < SHORT).alias("too_short"), some(F.col("size") > LONG).alias("too_long"),
        at(m / 10, "p10"), at(m / 4, "p25"), at(m / 2, "p50"), at(3 * m / 4, "p75"), at(9 * m / 10, "p90"), F.min("size").alias("least"), F.max("size").alias("most"),
    )


def duplicates(chunks: DataFrame, by: str, least: int = 50, compared: int = 200) -> DataFrame:
    """Repeats by report among texts of at least 50 characters, by the hash of their first 200; groups and eligible texts."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = chunks.select(by, body.alias("body")).where(F.length("body") >= least)
    counted = rows.groupBy(by, F.md5(F.left("body", F.lit(compared))).alias("hash")).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(F.col("n") > 1).alias("groups"), F.sum("n").alias("eligible"))


def findings(rows: DataFrame) -> DataFrame:
    """By report: findings, those with money, those of low confidence, mean confidence in hundredths, and the share of the largest chapter."""
    chapter = rows.groupBy("report_id", "chapter").agg(F.count("*").alias("c"))
    top = chapter.groupBy("report_id").agg(F.max("c").alias("top"), F.max_by("chapter", F.struct("c", "chapter")).alias("top_chapter"))
    own = rows.groupBy("report_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("amount_paise", F.lit(0)) > 0).alias("with_money"), F.count_if((F.col("confidence") > 0) & (F.col("confidence") < 0.5)).alias("unsure"))
    bad = F.lower("top_chapter").isin(BAD_CHAPTERS) & (F.col("n") > 10)
    return own.join(top, "report_id").select("report_id", "n", "with_money", "unsure", "top", "top_chapter", bad.alias("bad_chapter"))


def gaps(rows: DataFrame, by: str, number: str) -> DataFrame:
    """Numbers between a report's least and largest that are missing."""
    seen = rows.where(F.col(number).isNotNull()).groupBy(by).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.collect_set(number).alias("seen"))
    missing = F.array_sort(F.array_except(F.sequence("lo", "hi"), "seen"))
    return seen.select(by, F.size(missing).alias("missing"), F.array_join(missing.cast("array<string>"), ",").alias("numbers"))


def deducted(value: Column, *limits: tuple[float, int]) -> Column:
    """Points taken off by the first limit that the value exceeds."""
    out = F.lit(0)
    for limit, points in reversed(limits):
        out = F.when(value > limit, F.lit(points)).otherwise(out)
    return out


def content_score(df: DataFrame) -> Column:
    """Of 20: by shares of empty texts, inverted pages, duplicates and texts of bad length, and by mean confidence."""
    c = F.col
    lost = deducted(c("empty_pct"), (10, 8), (5, 3)) + deducted(c("inversion_pct"), (5, 8), (2, 3)) + deducted(c("duplicate_pct"), (15, 6), (5, 3)) + deducted(c("bad_length_pct"), (25, 5), (10, 2))
    return F.greatest(F.lit(0), F.lit(20) - lost - F.when((c("confidence") > 0) & (c("confidence") < 0.8), 3).otherwise(0))


def hierarchy_score(df: DataFrame) -> Column:
    """Of 25: by mismatches, concentration in one section, number of sections, depths and orphans."""
    c = F.col
    few = F.when(c("hierarchies") < 5, 10).when(c("hierarchies") < 10, 3).otherwise(0)
    lost = F.least(F.lit(10), c("mismatches")) + deducted(c("concentration"), (40, 15), (20, 8), (10, 3)) + few + F.when(c("depths") == 1, 3).otherwise(0) + F.least(F.lit(5), c("orphans"))
    return F.greatest(F.lit(0), F.lit(25) - lost)


def issue_score(critical: Column, warnings: Column, infos: Column) -> Column:
    """Of 100: 15 off for a critical issue, 5 for a warning, 1 for a note."""
    return F.greatest(F.lit(0), F.lit(100) - critical * 15 - warnings * 5 - infos)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")
