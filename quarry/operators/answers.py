"""From a question to the context and the citations of its answer, which a model then writes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.operators.prefix import saved
from quarry.operators.providers import Enhancer, Reranker, merged_filters, per_query_limit
from quarry.operators.vectors import ranked


def ask(question: str, search: Callable[[str, int], DataFrame], chunks: DataFrame, sections: DataFrame, reports: DataFrame, enhancer: Enhancer, reranker: Reranker, filters: dict | None = None) -> dict[str, DataFrame]:
    """hits, context (one row), citations and sufficient (one row) for a question.

    The question is planned, each of its queries searched by keywords, their lists fused, and the best
    candidates that pass the filters reranked with the paths of their sections. Hits are grouped by section, sections
    placed so that the best stand first and last, and the context cut to the plan's size.
    search: the chunk_id and rank of so many chunks that keywords of a question find.
    chunks: chunk_id, report_id, parent_id, page and text, what filters ask for, and if they are there previous_text,
    next_text and tags.
    """
    plan = enhancer.plan(question)
    queries = plan["queries"]
    most = plan["candidates"] if len(queries) == 1 else per_query_limit(plan["candidates"], len(queries))
    lists = [search(q, most).select("chunk_id", "rank") for q in queries]
    fused = ranked(retrieval.fuse(reduce(DataFrame.unionByName, lists), "chunk_id"), F.round("score", 12), "chunk_id", plan["candidates"]).select("chunk_id")
    kept = chunks.where(retrieval.payload_filter(chunks, merged_filters(filters, plan["filters"])))
    paths = sections.select(F.col("section_id").alias("parent_id"), "toc_entry", "hierarchy_path", "page_start", "page_end")
    found = kept.join(F.broadcast(fused), "chunk_id").join(paths, "parent_id", "left")  # the plan's candidates
    hits = saved(retrieval.rerank(found, question, reranker, "chunk_id", plan["top_k"]), "hits")  # a few, read several times
    grouped = retrieval.group_by_parent(hits.withColumn("answer", F.lit(0)), ["answer"])
    places = grouped.select("parent_id", retrieval.attention_place(F.col("parent_rank") - 1, F.col("parents")).cast("int").alias("place"))
    lacking = [F.lit(None).cast("string").alias(c) for c in ("previous_text", "next_text", "tags") if c not in hits.columns]
    context = retrieval.context(hits.select("*", *lacking).withColumn("report_id", F.lit("all")).na.fill({"toc_entry": "Unknown", "hierarchy_path": "Unknown", "page_start": 0, "page_end": 0}))
    cited = retrieval.citations(hits.select("report_id", "chunk_id", "parent_id", "page", "score").withColumn("answer", F.lit(0)), sections, reports, ["answer"])
    return {
        "hits": hits.join(places, "parent_id", "left"),
        "context": context.select(retrieval.truncated(F.col("context"), F.lit(plan["max_context_chars"])).alias("context")),
        "citations": cited,
        "sufficient": hits.agg((F.coalesce(F.max("score"), F.lit(0.0)) >= retrieval.SUFFICIENT).alias("sufficient")),
    }


# What stands before a report's part of a comparison.
RULE, YEAR_LINE, REPORT_LINE, YEAR_NOTE = "=" * 60, "📅 YEAR: ", "📄 Report: ", ("⚠️ All findings below are from ", ". Cite as: [", " - Section X, p.XX]")


def comparison_citations(hits: DataFrame, by: str) -> DataFrame:
    """``hits`` with id, the citation's number in its series: reports in their place, then sections by their best hit, then hits by score.

    Hits have the series, report_id, place (of the report in its series), parent_id, chunk_id and score. A report's hits are
    numbered on their own; what stands before them is summed over one row a report.
    """
    own = Window.partitionBy(by, "report_id")
    best = F.max("score").over(Window.partitionBy(by, "report_id", "parent_id"))
    numbered = hits.withColumn("_best", best).withColumn("_nth", F.row_number().over(own.orderBy(F.desc("_best"), "parent_id", F.desc("score"), "chunk_id")))
    counts = hits.groupBy(by, "report_id", "place").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(by).orderBy("place", "report_id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(by, "report_id", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_ahead"))
    return numbered.join(ahead, [by, "report_id"]).withColumn("id", F.col("_ahead") + F.col("_nth")).drop("_ahead", "_nth", "_best")


def comparison_context(hits: DataFrame, by: str) -> DataFrame:
    """Each series' context (its reports' contexts under headers of year and title), the years it covers, and its number of hits.

    Hits have the series, place, year and title of their report beside what ``retrieval.context`` asks for. A report without a
    year goes by its id.
    """
    year = F.coalesce(F.nullif("year_label", F.lit("")), "report_id")
    heads = hits.groupBy(by, "report_id", "place").agg(F.first(year).alias("year"), F.first(F.coalesce("title", "report_id")).alias("title"), F.count("*").alias("n"))
    head = F.concat(F.lit(f"\n{RULE}\n{YEAR_LINE}"), "year", F.lit(f"\n{REPORT_LINE}"), "title", F.lit(f"\n{RULE}\n\n{YEAR_NOTE[0]}"), "year", F.lit(YEAR_NOTE[1]), "year", F.lit(f"{YEAR_NOTE[2]}\n\n"))
    parts = heads.join(retrieval.context(hits), "report_id").withColumn("part", F.concat(head, "context"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "report_id", "part"))), lambda x: x["part"])
    return parts.groupBy(by).agg(F.array_join(ordered, "\n\n").alias("context"), F.array_join(F.array_sort(F.collect_list("year")), ", ").alias("years"), F.sum("n").alias("hits"))
