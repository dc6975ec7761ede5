"""Evaluation of answers and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import amounts as A


def issue_kind(issue: Column) -> Column:
    low = F.lower(issue)
    return F.when(low.contains("amount"), "amount").when(low.contains("entity") | low.contains("coverage"), "coverage").when(low.contains("hallucination"), "hallucination").when(low.contains("forbidden"), "forbidden").otherwise("other")


def amount_accuracy(expected: DataFrame) -> DataFrame:
    """test_id and its score, 70 % for required amounts and 30 % for others, of rows (test_id, kind, required); a kind of amounts that isn't asked for counts as met."""
    hit = F.col("kind").isin("exact", "close").cast("int")
    return expected.groupBy("test_id").agg(
        (F.coalesce(F.avg(F.when(F.col("required"), hit)), F.lit(1.0)) * 0.7 + F.coalesce(F.avg(F.when(~F.col("required"), hit)), F.lit(1.0)) * 0.3).alias("amount_accuracy")
    )


def scored(cases: DataFrame) -> DataFrame:
    """Cases with overall score and whether they passed."""
    score = A.overall_score(*(F.col(c) for c in ("factual", "complete", "relevant", "cited", "amount_accuracy", "entity_coverage", "hallucinated")))
    return cases.withColumn("score", score).withColumn("passed", A.passed(F.col("score"), F.col("factual"), F.col("hallucinated")))


def chosen(cases: DataFrame, kind: str | None = None, difficulty: str | None = None) -> DataFrame:
    """Cases of a type and a difficulty; an empty wish is none."""
    for name, want in (("type", kind), ("difficulty", difficulty)):
        if want:
            cases = cases.where(F.col(name) == want)
    return cases


def report(results: DataFrame) -> DataFrame:
    """Cases and passes in all, by difficulty and by type, in one pass."""
    sets = [[], [F.col("difficulty")], [F.col("type")]]
    return results.groupingSets(sets, "difficulty", "type").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases of both runs that newly pass, newly fail or fail in both."""
    both = before.select("test_id", F.col("passed").alias("was")).join(after.select("test_id", F.col("passed").alias("now")), "test_id")
    kind = F.when(~F.col("was") & F.col("now"), "newly_passing").when(F.col("was") & ~F.col("now"), "newly_failing").when(~F.col("was") & ~F.col("now"), "consistent_failure")
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("test_id", "kind")


def failure_patterns(results: DataFrame, issues: DataFrame) -> DataFrame:
    """Kinds of cases that hold more than half (types: 40 %) of the failures, and issues of three cases and more."""
    failed = results.where(~F.col("passed"))
    total = F.broadcast(failed.agg(F.count("*").alias("all")))
    by = lambda name, share: failed.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n")).crossJoin(total).where(F.col("n") > F.col("all") * share).select(F.lit(name).alias("pattern"), "value", "n")
    recurring = failed.select("test_id").join(issues, "test_id").groupBy(F.col("issue").alias("value")).agg(F.count("*").alias("n")).where("n >= 3").select(F.lit("issue").alias("pattern"), "value", "n")
    return by("difficulty", 0.5).unionByName(by("type", 0.4)).unionByName(recurring)
