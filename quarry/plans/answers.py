"""Queries that put search and context together, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry.functions import reports as R
from quarry.operators import answers, catalog, providers, retrieval
from quarry.operators.vectors import ranked
from quarry.plans import listing, search
from quarry.plans.frames import CHUNK_ID, CHUNKS, FINDINGS, PASSAGES, REPORTS, SECTIONS, duck, frame, over
from quarry.plans.listing import more

CLASSES = f"SELECT {CHUNK_ID} AS chunk_id, concat(lpad(CAST(l_orderkey AS STRING), 12, '0'), lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0'), CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)) AS ord, CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'finding' WHEN 1 THEN 'recommendation' WHEN 2 THEN 'background' ELSE 'annexure' END AS section_type FROM {{lineitem}} WHERE l_discount > 0.02"
ENRICHED = "SELECT finding_id, CASE WHEN page % 3 = 0 THEN '' ELSE finding_type END AS finding_type, CASE WHEN page % 2 = 0 THEN NULL ELSE severity END AS severity, amount_paise, is_recommendation FROM ({}) AS f"


def _hits(spark, sf_dir):
    return frame(spark, sf_dir, search.HITS)


def ask(spark, sf_dir):
    """Citations of a question's answer, the place of each hit's section in the context, and whether the hits suffice."""
    chunks = frame(spark, sf_dir, PASSAGES, wide=True).withColumnRenamed("passage_id", "chunk_id")
    keys = frame(spark, sf_dir, PASSAGES).withColumnRenamed("passage_id", "chunk_id")
    by_words = lambda question, most: retrieval.sparse_topk_of_texts(chunks, "chunk_id", question, most, keys=keys)
    found = answers.ask(search.QUESTION, by_words, chunks, frame(spark, sf_dir, SECTIONS), frame(spark, sf_dir, REPORTS), providers.RuleEnhancer(), providers.WordOverlap())
    rows = found["citations"].join(found["hits"].select("chunk_id", "place", "rank"), "chunk_id")
    return rows.crossJoin(F.broadcast(found["sufficient"])).select("id", "chunk_id", "report_id", "section", "page", "place", "rank", "sufficient")


def rerank_breadcrumb(spark, sf_dir):
    """The best hits by the words of a question that their texts and section paths have."""
    s = frame(spark, sf_dir, SECTIONS).select(F.col("section_id").alias("parent_id"), "hierarchy_path")
    p = frame(spark, sf_dir, PASSAGES, wide=True).where("year = 2015").join(s, "parent_id", "left")
    return retrieval.rerank(p, BREADCRUMB, providers.WordOverlap(), "passage_id", 15).select("passage_id", "rank")


BREADCRUMB = "Part 2 dues of Section 3 under rule 12B"


def series_query(spark, sf_dir):
    """Hits of a question among all reports of each series, ten for each report."""
    r = catalog.with_series(frame(spark, sf_dir, REPORTS)).where("series_id is not null").select("series_id", "report_id")
    limits = r.groupBy("series_id").agg((F.count("*") * 10).alias("most"))
    hits = _hits(spark, sf_dir).join(r, "report_id").join(limits, "series_id")
    return retrieval.best_of(hits, "series_id", F.col("most"), "chunk_id").select("series_id", "report_id", "chunk_id", F.col("place").cast("long").alias("place"))


def legacy_params(spark, sf_dir):
    """Sizes and styles of questions without a plan."""
    q = listing.question_type(spark, sf_dir).select("kind").distinct()
    return q.select("kind", R.legacy_top_k(F.col("kind"), F.lit(10)).alias("top_k"), R.legacy_chars(F.col("kind"), F.lit(15000)).alias("chars"), R.legacy_style(F.col("kind")).alias("style"))


def section_type(spark, sf_dir):
    return catalog.with_section_type(frame(spark, sf_dir, CHUNKS).select("chunk_id"), frame(spark, sf_dir, CLASSES))


def semantic_data(spark, sf_dir):
    """Enriched chunks and others."""
    f = frame(spark, sf_dir, ENRICHED.format(FINDINGS))
    has = retrieval.has_semantic_data(F.col("finding_type"), F.col("severity"), F.col("amount_paise"), F.col("is_recommendation"))
    return f.groupBy(has.alias("has_data")).agg(F.count("*").alias("n"))


#: Five reports are a series; each takes part with so many hits.
COMPARED = 5
NUMBER = "CAST(substr(report_id, 2) AS BIGINT)"
YEARS = f"SELECT report_id, CAST(floor({NUMBER} / 5) AS BIGINT) AS series, {NUMBER} AS place, CASE WHEN {NUMBER} % 6 = 0 THEN '' ELSE concat(CAST(2010 + {NUMBER} % 13 AS STRING), '-', CAST(11 + {NUMBER} % 13 AS STRING)) END AS year_label, title FROM ({REPORTS}) AS r"


def _compared(spark, sf_dir):
    """The best hits of each report with its series, year and title."""
    best = ranked(search._hits(spark, sf_dir).where("parent_id is not null"), F.col("score"), "chunk_id", COMPARED, ["report_id"]).drop("rank")
    return search._context_rows(spark, sf_dir, best).join(frame(spark, sf_dir, YEARS), "report_id")


def comparative_citations(spark, sf_dir):
    """Citations of comparisons, numbered through all reports of a series."""
    found = answers.comparison_citations(_compared(spark, sf_dir), "series")
    return found.select("series", "id", "report_id", F.coalesce(F.nullif("year_label", F.lit("")), "report_id").alias("year"), F.col("toc_entry").alias("section"), (F.col("page") + 1).alias("page"), "chunk_id")


def comparative_context(spark, sf_dir):
    """Contexts of comparisons with a header of year and title for each report."""
    return answers.comparison_context(_compared(spark, sf_dir), "series").select("series", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("size"), "years", "hits")


QUERIES = {f.__name__: f for f in (ask, rerank_breadcrumb, series_query, legacy_params, section_type, semantic_data, comparative_citations, comparative_context)}
TOP_SQL = f"t5 AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, chunk_id) AS nth FROM a WHERE parent_id IS NOT NULL) WHERE nth <= {COMPARED})"


def _overlap(question: str, text: str) -> str:
    words = sorted(set(re.findall(r"[a-z0-9]{2,}", question.lower())))
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{w}') AS INT)" for w in words) + f") / {len(words)}::DOUBLE"


SHOWN = "coalesce('[' || nullif(hierarchy_path, '') || '] ', '') || text"
ORACLE_SQL = {
    "comparative_citations": more(f""", {TOP_SQL}, k AS (SELECT t5.*, s.toc_entry, max(score) OVER (PARTITION BY t5.report_id, t5.parent_id) AS best FROM t5 JOIN s ON t5.parent_id = s.section_id)
SELECT series, row_number() OVER (PARTITION BY series ORDER BY place, k.report_id, best DESC, parent_id, score DESC, chunk_id) AS id, k.report_id, coalesce(nullif(year_label, ''), k.report_id) AS year, toc_entry AS section, page + 1 AS page, chunk_id FROM k JOIN y USING (report_id)""", a=search.HITS, s=SECTIONS, y=YEARS),
    "comparative_context": more(f""", {TOP_SQL}, h AS (SELECT t5.* FROM t5){search.CONTEXT_SQL},
e AS (SELECT *, coalesce(nullif(year_label, ''), report_id) AS year FROM o JOIN y USING (report_id)), f AS (SELECT report_id, count(*) AS n FROM k GROUP BY 1),
j AS (SELECT e.*, n, chr(10) || repeat('=', 60) || chr(10) || '{answers.YEAR_LINE}' || year || chr(10) || '{answers.REPORT_LINE}' || coalesce(title, report_id) || chr(10) || repeat('=', 60) || chr(10) || chr(10) || '{answers.YEAR_NOTE[0]}' || year || '{answers.YEAR_NOTE[1]}' || year || '{answers.YEAR_NOTE[2]}' || chr(10) || chr(10) || context AS part FROM e JOIN f USING (report_id)),
w AS (SELECT series, string_agg(part, chr(10) || chr(10) ORDER BY place, report_id) AS c, string_agg(year, ', ' ORDER BY year) AS years, CAST(sum(n) AS BIGINT) AS hits FROM j GROUP BY 1)
SELECT series, md5(c) AS context_md5, length(c) AS size, years, hits FROM w""", a=search.HITS, c=CHUNKS, s=SECTIONS, y=YEARS),
    "ask": search.passages_with(f"""sections AS ({duck(SECTIONS)}), {search.TF_SQL}, {search.ASKED}, m AS (SELECT * FROM tf JOIN asked USING (token)), d AS (SELECT token, count(*) AS df FROM m GROUP BY 1), n AS (SELECT count(*) AS n FROM passages),
w AS (SELECT passage_id, round(sum(tf / (tf + 1.2::DOUBLE) * {search.BOOST} * asked * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)), 9) AS score FROM m JOIN d USING (token), n GROUP BY 1),
c AS (SELECT passage_id FROM w QUALIFY row_number() OVER (ORDER BY score DESC, passage_id) <= 30),
h AS (SELECT p.passage_id AS chunk_id, p.report_id, p.parent_id, p.page, coalesce(toc_entry, 'Unknown') AS section, {_overlap(search.QUESTION, SHOWN)} AS score FROM c JOIN passages p USING (passage_id) LEFT JOIN sections s ON p.parent_id = s.section_id),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM h QUALIFY rank <= 8),
g AS (SELECT parent_id, max(score) AS best, row_number() OVER (ORDER BY max(score) DESC, parent_id) - 1 AS r, count(*) OVER () AS n FROM b GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY best DESC, parent_id, score DESC, chunk_id) AS INT) AS id, chunk_id, report_id, section, page + 1 AS page, CAST(CASE WHEN n <= 2 THEN r WHEN 2 * r < n THEN 2 * r ELSE 2 * (n - 1 - r) + 1 END AS INT) AS place, CAST(rank AS INT) AS rank, max(score) OVER () >= 0.25 AS sufficient FROM b JOIN g USING (parent_id)"""),
    "rerank_breadcrumb": over(f"SELECT passage_id, CAST(row_number() OVER (ORDER BY {_overlap(BREADCRUMB, SHOWN)} DESC, passage_id) AS INT) AS rank FROM p LEFT JOIN s ON p.parent_id = s.section_id WHERE year = 2015 QUALIFY rank <= 15", p=PASSAGES, s=SECTIONS),
    "series_query": more(f", {listing.WITH_SERIES}, k AS (SELECT series_id, count(*) * 10 AS most FROM s WHERE series_id IS NOT NULL GROUP BY 1) SELECT series_id, report_id, chunk_id, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, chunk_id) AS place FROM h JOIN s USING (report_id) JOIN k USING (series_id) QUALIFY place <= most", r=REPORTS, h=search.HITS),
    "legacy_params": "SELECT * FROM (VALUES ('list', 15, 22500, 'adaptive'), ('aggregation', 15, 22500, 'adaptive'), ('comparison', 15, 22500, 'comparative'), ('explanation', 10, 15000, 'explanatory'), ('factual', 10, 15000, 'adaptive')) t(kind, top_k, chars, style)",
    "section_type": over("SELECT DISTINCT chunk_id, first(section_type) OVER (PARTITION BY chunk_id ORDER BY ord) AS section_type FROM (SELECT c.chunk_id, k.ord, k.section_type FROM c LEFT JOIN k USING (chunk_id))", c=CHUNKS, k=CLASSES),
    "semantic_data": over("SELECT finding_type <> '' OR severity IS NOT NULL OR coalesce(amount_paise, 0) <> 0 OR is_recommendation AS has_data, count(*) AS n FROM f GROUP BY 1", f=ENRICHED.format(FINDINGS)),
}
