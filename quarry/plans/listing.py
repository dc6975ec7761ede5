"""Report, series and finding queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import reports as R
from quarry.operators import catalog, retrieval
from quarry.plans.frames import CHUNKS, FINDINGS, PASSAGES, REPORTS, SECTIONS, frame, over
from quarry.plans.search import QUESTION  # noqa: F401


def _reports(spark, sf_dir):
    return frame(spark, sf_dir, REPORTS)


def _findings(spark, sf_dir):
    return frame(spark, sf_dir, FINDINGS)


def audit_year(spark, sf_dir):
    return _reports(spark, sf_dir).select("report_id", R.audit_year(F.col("title")).alias("audit_year"))


def audit_year_filename(spark, sf_dir):
    return _reports(spark, sf_dir).select("report_id", R.audit_year_of_filename(F.col("filename")).alias("audit_year"))


def report_year(spark, sf_dir):
    return _reports(spark, sf_dir).select("report_id", R.report_year(F.col("report_no")).alias("year"))


def series_match(spark, sf_dir):
    return _reports(spark, sf_dir).select("report_id", R.series_of(F.col("title")).alias("series_id"))


def series_build(spark, sf_dir):
    return catalog.build_series(catalog.with_series(_reports(spark, sf_dir)))


def series_members(spark, sf_dir):
    """Members of series that are known; the registry lacks a third of the reports."""
    r = catalog.with_series(_reports(spark, sf_dir))
    return catalog.series_members(catalog.build_series(r), r.where("ord % 3 > 0").select("report_id", "audit_year")).select("series_id", "report_id", "audit_year")


def series_latest(spark, sf_dir):
    return catalog.latest_of_series(catalog.with_series(_reports(spark, sf_dir)))


def registry_stats(spark, sf_dir):
    return catalog.registry_stats(catalog.with_series(_reports(spark, sf_dir)))


def sanitize_title(spark, sf_dir):
    return _reports(spark, sf_dir).select("report_id", R.sanitize_title(F.col("title")).alias("title"))


def report_status(spark, sf_dir):
    return catalog.statuses(_findings(spark, sf_dir), _reports(spark, sf_dir))


def report_detail(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("text", F.when(F.col("page") % 3 == 0, "").otherwise(F.concat(F.col("finding_type"), F.lit(" in "), F.col("chapter"))))
    return catalog.report_details(f, first=3, chars=20)


def reports_by_sector(spark, sf_dir):
    return catalog.reports_by(_reports(spark, sf_dir), "1-urgent", 2015).select("report_id", "sector", "year")


def reports_by_year(spark, sf_dir):
    return catalog.reports_by(_reports(spark, sf_dir), None, 2015).select("report_id", "sector", "year")


def report_regex(spark, sf_dir):
    return _reports(spark, sf_dir).where(F.col("title").rlike("(?i)toll.*audit|frbm") | F.col("report_id").rlike("(?i)^r12")).select("report_id")


def dashboard_filter(spark, sf_dir):
    return catalog.dashboard_filter(_reports(spark, sf_dir), "taxes", year=2016, audit_types=["O", "P"]).select("report_id", "ministry")


def dropdown_values(spark, sf_dir):
    r = _reports(spark, sf_dir)
    m = r.select(F.lit("ministry").alias("kind"), F.col("ministry").alias("value")).distinct()
    y = r.select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("value")).distinct()
    return m.unionByName(y)


def dashboard_stats(spark, sf_dir):
    r = _reports(spark, sf_dir).withColumn("impact", catalog.money_of_text(catalog.money_text(F.col("amount"))))
    return catalog.dashboard_stats(r, _findings(spark, sf_dir))


def total_impact(spark, sf_dir):
    """Sum of the amounts in the reports' texts, in thousands with a plus from 1000 on."""
    total = _reports(spark, sf_dir).agg(F.sum(catalog.money_of_text(catalog.money_text(F.col("amount")))).alias("t"))
    return total.select(F.when(F.col("t") >= 1000, F.concat(F.round(F.col("t") / 1000).cast("long").cast("string"), F.lit("K+"))).otherwise(F.round("t").cast("long").cast("string")).alias("impact"))


def findings_filter(spark, sf_dir):
    return catalog.filter_findings(_findings(spark, sf_dir), "HIGH", "Non_Compliance", 5, 50, "chapter").select("finding_id")


def findings_page(spark, sf_dir):
    f = catalog.filter_findings(_findings(spark, sf_dir), severity="low")
    return catalog.page_of(f, [F.desc_nulls_last("amount_paise"), "finding_id"], 100, 50).select("finding_id", "amount_paise", "total", "has_more")


def findings_summary(spark, sf_dir):
    return catalog.findings_summary(_findings(spark, sf_dir))


def severity_band(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy(R.severity_band(F.col("amount_paise") / F.lit(1_000_000_0)).alias("band")).agg(F.count("*").alias("n"))


def recommendations_by_chapter(spark, sf_dir):
    f = _findings(spark, sf_dir).where("is_recommendation").where(F.instr(F.lower("chapter"), "chapter 3") > 0)
    return f.groupBy("target").agg(F.count("*").alias("n"))


def glossary_search(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet")
    return n.where(F.contains(F.lower("p_name"), F.lit("ring")) | F.coalesce(F.contains(F.lower("p_brand"), F.lit("#17")), F.lit(False))).select("p_partkey", "p_name", "p_brand")


def toc_projection(spark, sf_dir):
    s = frame(spark, sf_dir, SECTIONS)
    return s.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_start", "toc_entry"))), lambda x: x["toc_entry"]), ",").alias("toc"), F.count("*").alias("entries"))


def payload_filter_eq(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.where(retrieval.payload_filter(f, {"severity": "high", "target": "NODE3", "finding_type": None})).select("finding_id")


def payload_filter_in(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.where(retrieval.payload_filter(f, {"target": ["NODE1", "NODE2"]})).groupBy("target").agg(F.count("*").alias("n"))


def payload_filter_range(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.where(retrieval.payload_filter(f, {"amount_paise": {"gte": 10_000_000_000, "lt": 20_000_000_000}, "page": {"gt": 10, "lte": 20}})).groupBy("page").agg(F.count("*").alias("n"))


def payload_filter_compound(spark, sf_dir):
    f = _findings(spark, sf_dir).withColumn("entities", F.array("target", "finding_type"))
    return f.where(retrieval.payload_filter(f, {"entities": ["NODE5", "loss_of_revenue"], "severity": "low", "page": {"gte": 5}})).select("finding_id")


def collection_stats(spark, sf_dir):
    c, s = frame(spark, sf_dir, CHUNKS), frame(spark, sf_dir, SECTIONS)
    return c.agg(F.count("*").alias("chunks")).crossJoin(s.agg(F.count("*").alias("sections")))


def index_stats(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.agg(F.count_distinct("report_id").alias("files"), F.count("*").alias("children"), F.count_if(F.col("target").isNotNull()).alias("enriched"), F.count_if(F.col("amount_paise").isNull()).alias("errors"))


def upsert_latest(spark, sf_dir):
    f = _findings(spark, sf_dir).select("source_chunk_id", "finding_type", F.concat(F.lpad(F.col("ord").cast("string"), 9, "0"), F.lit("-"), F.col("finding_id")).alias("seq"))
    return catalog.upsert(f.where("finding_type <> 'non_compliance'"), f.where("finding_type = 'non_compliance'"), "source_chunk_id")


def point_id(spark, sf_dir):
    return frame(spark, sf_dir, CHUNKS).select("chunk_id", catalog.point_id(F.col("chunk_id")).cast("string").alias("point_id"))


def question_type(spark, sf_dir):
    text = F.concat(F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("ord") % len(QUESTIONS) + 1).cast("int")), F.lit(" "), F.col("ministry"))
    kind = R.question_type(text)
    return _reports(spark, sf_dir).select("report_id", kind.alias("kind"), R.retrieval_param(kind, 0).alias("top_k"), R.retrieval_param(kind, 2).alias("chars"))


QUESTIONS = ["What are the key findings on", "How much in total was lost by", "Compare spending of", "Why did delays occur in", "When was the levy of duty set by", "Explain the trend in", "Sum of dues of"]


def citation_extract(spark, sf_dir):
    rows = frame(spark, sf_dir, PASSAGES).select("passage_id", F.explode(R.citations_in(F.col("text"))).alias("citation"))
    return rows.select("passage_id", "citation", R.citation_key(F.col("citation")).alias("key"), R.citation_section(F.col("citation")).alias("section"), R.citation_page(F.col("citation")).alias("page"))


def _cited(spark, sf_dir):
    """Citations of an answer on each report: some entries know their physical page, some a logical one in other words."""
    s = frame(spark, sf_dir, SECTIONS)
    physical, logical = F.when(F.col("toc_level") == 0, F.col("page_end") - 1), F.when(F.col("toc_level") == 1, F.col("page_end").cast("string")).when(F.col("toc_level") == 2, F.concat(F.lit("page "), F.col("page_end").cast("string")))
    end = F.col("page_end").cast("string")
    usual = F.concat(F.lit("Section "), F.col("page_start").cast("string"), F.lit("."), (F.col("page_end") % 5).cast("string"), F.lit(", p."), end)
    entry = F.when(F.col("toc_level") == 2, F.concat(F.lit("Section 2.1, p."), end, F.lit("4"))).when(F.col("toc_level") == 3, F.lit("Annexure, p.0")).otherwise(usual)
    return s.select("report_id", F.col("page_start").alias("ord"), entry.alias("entry"), F.col("toc_entry").alias("section"), physical.alias("page_physical"), logical.alias("page_logical"))


def citation_lookup(spark, sf_dir):
    """Citations in each report's passages, and the same without the word, against the citations of that report's answer."""
    cited = F.flatten(F.transform(R.citations_in(F.col("text")), lambda x: F.array(x, F.regexp_replace(x, "^Section ", ""))))
    asked = frame(spark, sf_dir, PASSAGES, wide=True).select("report_id", F.explode_outer(cited).alias("citation")).where("citation is not null")
    return retrieval.lookup_citations(asked, retrieval.citation_entries(_cited(spark, sf_dir), "report_id"), "report_id")


def citation_lookup_all(spark, sf_dir):
    """How many citations each way finds."""
    return citation_lookup(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"))


def context_scope(spark, sf_dir):
    text = F.concat(F.when(F.col("ord") % 3 == 0, F.lit("## 1. Context & Scope\n\n")).when(F.col("ord") % 3 == 1, F.lit("Intro\n**Context and Scope**\n")).otherwise(F.lit("No such part\n")), F.lit("The **audit** covered *"), F.col("ministry"), F.lit("*.\n\n\n\nIt ran long.\n## Findings\nMany."))
    return _reports(spark, sf_dir).select("report_id", R.context_and_scope(text).alias("scope"))


def series_list(spark, sf_dir):
    r = catalog.with_series(_reports(spark, sf_dir)).where("series_id is not null and coalesce(audit_year, '') <> ''")
    return r.groupBy("series_id").agg(F.count("*").alias("reports"), F.min("audit_year").alias("first"), F.max("audit_year").alias("last"), F.max_by("report_id", F.struct("audit_year", "ord")).alias("latest"))


def overview_merge(spark, sf_dir):
    r = _reports(spark, sf_dir)
    rules = r.select("report_id", F.col("sector").alias("topic"), F.col("ministry").alias("scope"), "year")
    model = r.where("ord % 2 = 0").select("report_id", F.when(F.col("ord") % 3 == 0, F.lit("Ports")).alias("topic"), F.lit("All").alias("scope"))
    return catalog.merge_overview(rules, model, "report_id")


AUDIT_YEAR = """CASE WHEN regexp_matches(title, '\\d{4}-\\d{2,4}') THEN regexp_extract(title, '(\\d{4})-(\\d{2,4})', 1) || '-' || right(regexp_extract(title, '(\\d{4})-(\\d{2,4})', 2), 2)
 WHEN regexp_matches(title, '(?i)(?:year|period)\\s+ended\\s+March\\s+\\d{4}') THEN (CAST(regexp_extract(title, '(?i)(?:year|period)\\s+ended\\s+March\\s+(\\d{4})', 1) AS INT) - 1) || '-' || right(regexp_extract(title, '(?i)(?:year|period)\\s+ended\\s+March\\s+(\\d{4})', 1), 2)
 WHEN regexp_matches(lower(title), 'year\\s+\\d{4}') THEN regexp_extract(lower(title), 'year\\s+(\\d{4})', 1)
 WHEN regexp_matches(lower(title), 'period\\s+\\d{4}') THEN regexp_extract(lower(title), 'period\\s+(\\d{4})', 1) ELSE '' END"""
FILE_YEAR = """CASE WHEN CAST(regexp_extract(filename, '(\\d{4})(\\d{2})(?:_|\\.pdf|$)', 2) AS INT) = CAST(right(regexp_extract(filename, '(\\d{4})(\\d{2})(?:_|\\.pdf|$)', 1), 2) AS INT) + 1
 THEN regexp_extract(filename, '(\\d{4})(\\d{2})(?:_|\\.pdf|$)', 1) || '-' || regexp_extract(filename, '(\\d{4})(\\d{2})(?:_|\\.pdf|$)', 2) ELSE '' END"""
SERIES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(title, '(?i){p}')" + (f" AND NOT regexp_matches(title, '(?i){x}')" if x else "") + f" THEN '{n}'" for n, _, p, x in R.SERIES) + " END"
WITH_SERIES = f"s AS (SELECT *, coalesce(nullif({AUDIT_YEAR}, ''), {FILE_YEAR}) AS audit_year, {SERIES_SQL} AS series_id FROM r)"


def _title_sql() -> str:
    out = "title"
    for pattern, by in R.TITLE_STEPS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return f"SELECT report_id, coalesce(nullif(upper(left(t, 1)) || substr(t, 2), ''), title) AS title FROM (SELECT report_id, title, {out} AS t FROM r)"


def _kinds_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(q, '{'|'.join(w)}') THEN '{n}'" for n, w in R.QUESTION_WORDS) + " ELSE 'factual' END"


def _param_sql(which: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{n}' THEN {v[which]}" for n, v in R.RETRIEVAL_PARAMS.items()) + " END"


KEY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(citation), '^\\[|\\]$', '', 'g'), '\\s+', ' ', 'g'), '\\s*,\\s*', ',', 'g'), '\\b(page|pg)\\s*', 'p', 'g'), 'p\\.\\s*', 'p', 'g'))"
CITES_SQL = f"cites AS (SELECT passage_id, citation, {KEY_SQL} AS key, nullif(regexp_extract(citation, '(\\d+(?:\\.\\d+)*)', 1), '') AS section, CAST(nullif(regexp_extract(citation, '(?i)(?:p\\.?|page)\\s*(\\d+)', 1), '') AS INT) AS page FROM (SELECT passage_id, trim(unnest(regexp_extract_all(text, '(?i)\\[([^\\]]*(?:p\\.?\\s*\\d+|page\\s*\\d+)[^\\]]*)\\]', 1))) AS citation FROM p))"

LOOKUP_SQL = f"""b AS (SELECT DISTINCT report_id, unnest([citation, regexp_replace(citation, '^Section ', '')]) AS citation FROM cites JOIN p USING (passage_id)),
a AS (SELECT DISTINCT report_id, citation, {KEY_SQL} AS key, nullif(regexp_extract(citation, '(\\d+(?:\\.\\d+)*)', 1), '') AS section, CAST(nullif(regexp_extract(citation, '(?i)(?:p\\.?|page)\\s*(\\d+)', 1), '') AS INT) AS page, regexp_extract(citation, '(?i)p\\.?\\s*(\\d+)', 1) AS target FROM b),
d AS (SELECT report_id, page_start AS ord, CASE toc_level WHEN 2 THEN 'Section 2.1, p.' || page_end || '4' WHEN 3 THEN 'Annexure, p.0' ELSE 'Section ' || page_start || '.' || (page_end % 5) || ', p.' || page_end END AS citation, toc_entry AS section, CASE WHEN toc_level = 0 THEN page_end - 1 END AS physical, CASE toc_level WHEN 1 THEN CAST(page_end AS STRING) WHEN 2 THEN 'page ' || page_end END AS logical FROM s),
e AS (SELECT *, nullif(regexp_extract(citation, '(\\d+(?:\\.\\d+)*)', 1), '') AS number, nullif(CAST(nullif(regexp_extract(citation, '(?i)(?:p\\.?|page)\\s*(\\d+)', 1), '') AS INT), 0) AS page FROM d),
k AS (SELECT *, unnest([{KEY_SQL}, regexp_replace(lower(citation), '[\\s,]+', '', 'g'), number || 'p' || page, 'section' || number || 'p' || page, nullif(regexp_replace(section, '[^0-9.]', '', 'g'), '') || 'p' || nullif(regexp_replace(logical, '[^0-9]', '', 'g'), '')]) AS known, unnest([0, 1, 2, 3, 4]) AS nth FROM e),
m AS (SELECT report_id, known, min(row(ord, nth)) AS place, max_by(row(citation, physical, logical), row(ord, nth)) AS v FROM k WHERE known IS NOT NULL GROUP BY 1, 2),
j AS (SELECT a.*, m.place, m.v[1] AS entry, CASE WHEN known = key THEN 1 WHEN page <> 0 AND known = a.section || 'p' || page THEN 2 WHEN page <> 0 AND (v[2] = page - 1 OR v[3] = CAST(page AS STRING)) THEN 3
  WHEN contains(key, 'p') AND contains(known, string_split(key, 'p')[1]) AND contains(known, 'p' || string_split(key, 'p')[-1]) THEN 4 END AS way, regexp_extract(known, 'p(\\d+)', 1) = target AND target <> '' AS paged FROM a JOIN m USING (report_id)),
looked AS (SELECT report_id, citation, CASE WHEN min(way) IS NOT NULL THEN min_by(entry, row(way, place)) FILTER (WHERE way IS NOT NULL) ELSE max(entry) FILTER (WHERE paged) END AS entry, coalesce(min(way), 5) AS strategy FROM j GROUP BY 1, 2 HAVING min(way) IS NOT NULL OR count(*) FILTER (WHERE paged) = 1)"""

QUERIES = {f.__name__: f for f in (audit_year, audit_year_filename, report_year, series_match, series_build, series_members, series_latest, registry_stats, sanitize_title, report_status, report_detail, reports_by_sector, reports_by_year, report_regex, dashboard_filter, dropdown_values, dashboard_stats, total_impact, findings_filter, findings_page, findings_summary, severity_band, recommendations_by_chapter, glossary_search, toc_projection, payload_filter_eq, payload_filter_in, payload_filter_range, payload_filter_compound, collection_stats, index_stats, upsert_latest, point_id, question_type, citation_extract, citation_lookup, citation_lookup_all, context_scope, series_list, overview_merge)}


def more(body: str, **frames: str) -> str:
    """SQL whose body goes on with the list of named tables."""
    return over(body, **frames).replace(")\n,", "),")


ORACLE_SQL = {
    "audit_year": over(f"SELECT report_id, {AUDIT_YEAR} AS audit_year FROM r", r=REPORTS),
    "audit_year_filename": over(f"SELECT report_id, {FILE_YEAR} AS audit_year FROM r", r=REPORTS),
    "report_year": over("SELECT report_id, coalesce(CAST(nullif(regexp_extract(report_no, '(20\\d{2})', 1), '') AS INT), 2024) AS year FROM r", r=REPORTS),
    "series_match": over(f"SELECT report_id, {SERIES_SQL} AS series_id FROM r", r=REPORTS),
    "series_build": more(f", {WITH_SERIES} SELECT series_id, report_id, row_number() OVER (PARTITION BY series_id ORDER BY coalesce(nullif(audit_year, ''), '9999'), ord, report_id) AS place FROM s WHERE series_id IS NOT NULL", r=REPORTS),
    "series_members": more(f", {WITH_SERIES} SELECT series_id, report_id, audit_year FROM s WHERE series_id IS NOT NULL AND ord % 3 > 0", r=REPORTS),
    "series_latest": more(f", {WITH_SERIES} SELECT series_id, coalesce(audit_year, '') AS audit_year, report_id FROM s WHERE series_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY coalesce(audit_year, '') DESC, ord) = 1", r=REPORTS),
    "registry_stats": more(f", {WITH_SERIES} SELECT series_id, count(*) AS reports, coalesce(string_agg(DISTINCT nullif(audit_year, ''), ',' ORDER BY nullif(audit_year, '')), '') AS years FROM s GROUP BY 1", r=REPORTS),
    "sanitize_title": over(_title_sql(), r=REPORTS),
    "report_status": more(", k AS (SELECT r.report_id, count(finding_id) AS findings, count(*) FILTER (WHERE severity = 'high') AS high FROM r LEFT JOIN f USING (report_id) GROUP BY 1) SELECT *, CASE WHEN findings = 0 THEN 'Compliant' WHEN high > 5 THEN 'Action Pending' WHEN high > 0 THEN 'Under Review' ELSE 'Partial Compliance' END AS status FROM k", r=REPORTS, f=FINDINGS),
    "report_detail": more(", k AS (SELECT *, CASE WHEN page % 3 = 0 THEN '' ELSE left(finding_type || ' in ' || chapter, 20) END AS t, row_number() OVER (PARTITION BY report_id ORDER BY ord, finding_id) AS rn FROM f) SELECT report_id, coalesce(string_agg(t, '|' ORDER BY rn) FILTER (WHERE t <> ''), '') AS texts FROM k WHERE rn <= 3 GROUP BY 1", f=FINDINGS),
    "reports_by_sector": over("SELECT report_id, sector, year FROM r WHERE lower(sector) = '1-urgent'", r=REPORTS),
    "reports_by_year": over("SELECT report_id, sector, year FROM r WHERE year = 2015", r=REPORTS),
    "report_regex": over("SELECT report_id FROM r WHERE regexp_matches(title, '(?i)toll.*audit|frbm') OR regexp_matches(report_id, '(?i)^r12')", r=REPORTS),
    "dashboard_filter": over("SELECT report_id, ministry FROM r WHERE (contains(lower(title), 'taxes') OR contains(lower(ministry), 'taxes')) AND year = 2016 AND audit_type IN ('O', 'P')", r=REPORTS),
    "dropdown_values": over("SELECT DISTINCT 'ministry' AS kind, ministry AS value FROM r UNION ALL SELECT DISTINCT 'year', CAST(year AS STRING) FROM r", r=REPORTS),
    "dashboard_stats": over("SELECT (SELECT count(*) FROM r) AS reports, (SELECT CAST(sum(amount) AS DECIMAL(20,2)) FROM r WHERE amount > 0) AS impact, (SELECT count(DISTINCT ministry) FROM r) AS ministries, (SELECT count(DISTINCT sector) FROM r) AS sectors, (SELECT min(year) FROM r) AS first_year, (SELECT max(year) FROM r) AS last_year, (SELECT count(*) FROM f) AS findings", r=REPORTS, f=FINDINGS),
    "total_impact": over("SELECT CASE WHEN sum(amount) >= 1000 THEN CAST(CAST(round(sum(amount) / 1000) AS BIGINT) AS STRING) || 'K+' ELSE CAST(CAST(round(sum(amount)) AS BIGINT) AS STRING) END AS impact FROM r", r=REPORTS),
    "findings_filter": over("SELECT finding_id FROM f WHERE severity = 'high' AND finding_type = 'non_compliance' AND coalesce(amount_paise, 0)::DOUBLE / 1000000000 BETWEEN 5 AND 50 AND contains(lower(chapter), 'chapter')", f=FINDINGS),
    "findings_page": more(", k AS (SELECT finding_id, amount_paise FROM f WHERE severity = 'low'), t AS (SELECT count(*) AS total FROM k) SELECT finding_id, amount_paise, total, 150 < total AS has_more FROM k, t ORDER BY amount_paise DESC NULLS LAST, finding_id LIMIT 50 OFFSET 100", f=FINDINGS),
    "findings_summary": over("SELECT severity, finding_type, count(*) AS n, CAST(sum(coalesce(amount_paise, 0)) AS BIGINT) AS paise FROM f GROUP BY GROUPING SETS ((), (severity), (finding_type))", f=FINDINGS),
    "severity_band": over("SELECT CASE WHEN amount_paise::DOUBLE / 10000000 > 100 THEN 'critical' WHEN amount_paise::DOUBLE / 10000000 >= 10 THEN 'high' WHEN amount_paise::DOUBLE / 10000000 >= 1 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM f GROUP BY 1", f=FINDINGS),
    "recommendations_by_chapter": over("SELECT target, count(*) AS n FROM f WHERE is_recommendation AND contains(lower(chapter), 'chapter 3') GROUP BY 1", f=FINDINGS),
    "glossary_search": "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') OR coalesce(contains(lower(p_brand), '#17'), false)",
    "toc_projection": over("SELECT report_id, string_agg(toc_entry, ',' ORDER BY page_start, toc_entry) AS toc, count(*) AS entries FROM s GROUP BY 1", s=SECTIONS),
    "payload_filter_eq": over("SELECT finding_id FROM f WHERE severity = 'high' AND target = 'NODE3'", f=FINDINGS),
    "payload_filter_in": over("SELECT target, count(*) AS n FROM f WHERE target IN ('NODE1', 'NODE2') GROUP BY 1", f=FINDINGS),
    "payload_filter_range": over("SELECT page, count(*) AS n FROM f WHERE amount_paise >= 10000000000 AND amount_paise < 20000000000 AND page > 10 AND page <= 20 GROUP BY 1", f=FINDINGS),
    "payload_filter_compound": over("SELECT finding_id FROM f WHERE (target = 'NODE5' OR finding_type = 'loss_of_revenue') AND severity = 'low' AND page >= 5", f=FINDINGS),
    "collection_stats": over("SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM s) AS sections", c=CHUNKS, s=SECTIONS),
    "index_stats": over("SELECT count(DISTINCT report_id) AS files, count(*) AS children, count(target) AS enriched, count(*) - count(amount_paise) AS errors FROM f", f=FINDINGS),
    "upsert_latest": over("SELECT source_chunk_id, finding_type, lpad(CAST(ord AS STRING), 9, '0') || '-' || finding_id AS seq FROM f QUALIFY row_number() OVER (PARTITION BY source_chunk_id ORDER BY CASE WHEN finding_type = 'non_compliance' THEN 1 ELSE 0 END DESC, lpad(CAST(ord AS STRING), 9, '0') || '-' || finding_id DESC) = 1", f=FINDINGS),
    "point_id": over("SELECT chunk_id, CAST(CAST('0x' || left(md5(chunk_id), 16) AS UBIGINT) AS STRING) AS point_id FROM c", c=CHUNKS),
    "question_type": more(f", q AS (SELECT report_id, lower(['" + "', '".join(QUESTIONS) + f"'][CAST(ord % {len(QUESTIONS)} AS INT) + 1] || ' ' || ministry) AS q FROM r), k AS (SELECT report_id, {_kinds_sql()} AS kind FROM q) SELECT report_id, kind, {_param_sql(0)} AS top_k, {_param_sql(2)} AS chars FROM k", r=REPORTS),
    "citation_extract": more(f", {CITES_SQL} SELECT * FROM cites", p=PASSAGES),
    "citation_lookup": more(f", {CITES_SQL}, {LOOKUP_SQL} SELECT report_id, citation, entry, CAST(strategy AS INT) AS strategy FROM looked", p=PASSAGES, s=SECTIONS),
    "citation_lookup_all": more(f", {CITES_SQL}, {LOOKUP_SQL} SELECT CAST(strategy AS INT) AS strategy, count(*) AS n FROM looked GROUP BY 1", p=PASSAGES, s=SECTIONS),
    "context_scope": over("SELECT report_id, CASE WHEN ord % 3 < 2 THEN 'The audit covered ' || ministry || '.' || chr(10) || chr(10) || 'It ran long.' END AS scope FROM r", r=REPORTS),
    "series_list": more(f", {WITH_SERIES} SELECT series_id, count(*) AS reports, min(audit_year) AS first, max(audit_year) AS last, max_by(report_id, row(audit_year, ord)) AS latest FROM s WHERE series_id IS NOT NULL AND coalesce(audit_year, '') <> '' GROUP BY 1", r=REPORTS),
    "overview_merge": over("SELECT report_id, CASE WHEN ord % 6 = 0 THEN 'Ports' ELSE sector END AS topic, CASE WHEN ord % 2 = 0 THEN 'All' ELSE ministry END AS scope, year FROM r", r=REPORTS),
}
