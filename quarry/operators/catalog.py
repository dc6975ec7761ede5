"""Report listings, series, findings and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import reports as R

CRORE = 1_000_000_000  # paise
#: A reference in a text to a numbered part of its report, and how a footnote begins.
REFERENCE, FOOTNOTE = r"(?i)\b(para|table|section)\s+(\d+(?:\.\d+)*)", r"(?s)^\s*\[?(\d{1,4})[\].):]?\s+(.+)$"


def with_series(reports: DataFrame) -> DataFrame:
    """Reports with their audit year (of the title, else of the file name) and series."""
    year = F.coalesce(R.year_of_title(F.col("title")), R.audit_year_of_filename(F.col("filename")))
    return reports.withColumn("audit_year", year).withColumn("series_id", R.series_of(F.col("title")))


def build_series(reports: DataFrame) -> DataFrame:
    """series_id, report_id and its place from 1 by audit year (none last), ties in the reports' order; a row for each report of a series."""
    year = F.coalesce(F.nullif("audit_year", F.lit("")), F.lit("9999"))
    place = F.row_number().over(Window.partitionBy("series_id", "year").orderBy("ord", "report_id"))
    rows = reports.where(F.col("series_id").isNotNull()).select("series_id", "report_id", "ord", year.alias("year")).withColumn("own", place)
    # years are few, so their counts are summed in order instead of sorting a whole series in one task
    sizes = rows.groupBy("series_id", "year").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("series_id").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.withColumn("before", before), ["series_id", "year"]).select("series_id", "report_id", (F.col("before") + F.col("own")).alias("place"))


def series_members(members: DataFrame, reports: DataFrame) -> DataFrame:
    """Members of series with what is known of them; ids without a report are left out."""
    return members.join(reports, "report_id")


def latest_of_series(reports: DataFrame) -> DataFrame:
    """series_id and its report of the latest audit year, of several the first."""
    year = F.coalesce("audit_year", F.lit(""))
    return reports.where(F.col("series_id").isNotNull()).groupBy("series_id").agg(F.max(year).alias("audit_year"), F.max_by("report_id", F.struct(year, -F.col("ord"))).alias("report_id"))


def with_section_type(chunks: DataFrame, classes: DataFrame) -> DataFrame:
    """Chunks with the section type that the first of their classifications (chunk_id, ord, section_type) names, null without one."""
    first = classes.groupBy("chunk_id").agg(F.min_by("section_type", "ord").alias("section_type"))
    return chunks.join(first, "chunk_id", "left")


def resolve_references(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """References in chunks (report_id, chunk_id, text) to numbered paragraphs, tables and sections of their report, and the chunk that each means.

    targets: report_id, kind, number and chunk_id; of several the least chunk_id. A reference to nothing known has a null.
    """
    found = F.regexp_extract_all("text", F.lit(REFERENCE), 0)
    rows = chunks.select("report_id", "chunk_id", F.explode(F.array_distinct(F.transform(found, lambda x: F.lower(x)))).alias("reference"))
    named = rows.withColumn("kind", F.regexp_extract("reference", REFERENCE, 1)).withColumn("number", F.regexp_extract("reference", REFERENCE, 2))
    known = targets.groupBy("report_id", "kind", "number").agg(F.min("chunk_id").alias("target_id"))
    return named.join(known, ["report_id", "kind", "number"], "left").select("report_id", "chunk_id", "kind", "number", "target_id")


def footnotes(texts: DataFrame) -> DataFrame:
    """report_id, number, text and chunk_id of footnotes (report_id, chunk_id, ord, text), which begin with their number; the first of each number."""
    parsed = texts.select("report_id", "chunk_id", "ord", F.regexp_extract("text", FOOTNOTE, 1).alias("number"), F.regexp_extract("text", FOOTNOTE, 2).alias("note")).where("number <> ''")
    first = F.min_by(F.struct("chunk_id", "note"), F.struct("ord", "chunk_id")).alias("f")
    return parsed.groupBy("report_id", F.col("number").cast("int").alias("number")).agg(first).select("report_id", "number", "f.chunk_id", F.col("f.note").alias("text"))


def job_status(updates: DataFrame) -> DataFrame:
    """Jobs by the latest update (job, batch, seq, status) of each batch: batches, those that ended, and the job's status."""
    latest = updates.groupBy("job", "batch").agg(F.max_by("status", "seq").alias("status"))
    jobs = latest.groupBy("job").agg(F.count("*").alias("batches"), F.count_if(F.col("status") == "ended").alias("ended"))
    return jobs.withColumn("status", F.when(F.col("ended") == F.col("batches"), "ready_for_processing").otherwise("in_progress"))


def costs(tables: DataFrame, by: str, nano_usd: int = 150) -> DataFrame:
    """Summarised tables by report, their tokens, and what these cost at a price in 1e-9 dollars a token."""
    return tables.groupBy(by).agg(F.count("*").alias("tables"), F.sum("tokens").alias("tokens"), (F.sum("tokens") * nano_usd).alias("nano_usd"))


def registry_stats(reports: DataFrame) -> DataFrame:
    """Per series its reports and years; reports without series under null."""
    years = F.array_join(F.array_sort(F.collect_set(F.nullif("audit_year", F.lit("")))), ",")
    return reports.groupBy("series_id").agg(F.count("*").alias("reports"), years.alias("years"))


def statuses(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """Findings, findings of high severity and status of every report, those without findings too."""
    counts = findings.groupBy("report_id").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "high").alias("high"))
    rows = reports.select("report_id").join(counts, "report_id", "left").select("report_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("high", F.lit(0)).alias("high"))
    return rows.withColumn("status", R.status(F.col("findings"), F.col("high")))


def report_details(findings: DataFrame, first: int = 10, chars: int = 500) -> DataFrame:
    """A report's first findings' texts, each cut and empty ones dropped after the cut to ``first``."""
    rank = F.row_number().over(Window.partitionBy("report_id").orderBy("ord", "finding_id"))
    rows = findings.withColumn("rank", rank).where(F.col("rank") <= first)
    texts = F.array_sort(F.collect_list(F.struct("rank", F.left("text", F.lit(chars)).alias("t"))))
    return rows.groupBy("report_id").agg(F.array_join(F.filter(F.transform(texts, lambda x: x["t"]), lambda t: F.coalesce(t, F.lit("")) != ""), "|").alias("texts"))


def filter_findings(findings: DataFrame, severity: str | None = None, finding_type: str | None = None, least: float | None = None, most: float | None = None, chapter: str | None = None) -> DataFrame:
    """Findings by severity and type (whatever the case), amount in crore (null counts as 0) and part of the chapter."""
    crore = F.coalesce(F.col("amount_paise"), F.lit(0)) / F.lit(CRORE)
    for want, keep in (
        (severity, lambda v: F.lower("severity") == v.lower()), (finding_type, lambda v: F.lower("finding_type") == v.lower()), (least, lambda v: crore >= v), (most, lambda v: crore <= v),
        (chapter, lambda v: F.instr(F.lower("chapter"), v.lower()) > 0),
    ):
        if want is not None:
            findings = findings.where(keep(want))
    return findings


def page_of(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of a filtered result, with the total before paging and whether more follows. The total is one small aggregate."""
    total = df.agg(F.count("*").alias("total"))
    page = df.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Count and paise in all, by severity and by type, in one pass."""
    return findings.groupingSets([[], [F.col("severity")], [F.col("finding_type")]], "severity", "finding_type").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("amount_paise", F.lit(0))).cast("long").alias("paise")
    )


def dashboard_filter(reports: DataFrame, search: str = "", sector: str | None = None, ministry: str | None = None, year: int | None = None, audit_types: list[str] | None = None) -> DataFrame:
    """Reports whose title or ministry holds the search text, of exactly the sector, ministry and year, and of the audit types (null is none of them)."""
    low = search.lower()
    keep = F.lower("title").contains(low) | F.lower("ministry").contains(low)
    for name, want in (("sector", sector), ("ministry", ministry), ("year", year)):
        if want is not None:
            keep = keep & (F.col(name) == want)
    if audit_types:
        keep = keep & F.coalesce(F.col("audit_type").isin(audit_types), F.lit(False))
    return reports.where(keep)


def reports_by(reports: DataFrame, sector: str | None = None, year: int | None = None) -> DataFrame:
    """Reports of a sector, whatever the case; only without one, of a year."""
    if sector:
        return reports.where(F.lower("sector") == sector.lower())
    return reports.where(F.col("year") == year) if year is not None else reports


def money_text(crore: Column) -> Column:
    """₹ and the amount with thousands separators and two decimals."""
    return F.concat(F.lit("₹"), F.format_number(crore, 2), F.lit(" crore"))


def money_of_text(text: Column) -> Column:
    """Amount of such a text, null if there is none."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, r"([\d,]+\.?\d*)", 1), F.lit("")), ",", "").try_cast("decimal(20,2)")


def dashboard_stats(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: reports, findings, amount of positive amounts, ministries, sectors and span of years."""
    f = findings.agg(F.count("*").alias("findings"))
    r = reports.agg(F.count("*").alias("reports"), F.sum(F.when(F.col("impact") > 0, F.col("impact"))).cast("decimal(20,2)").alias("impact"), F.count_distinct("ministry").alias("ministries"), F.count_distinct("sector").alias("sectors"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return r.crossJoin(f)


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, of the new ones where both have it; within one side the row of highest ``seq`` wins."""
    both = current.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("side"), F.desc("seq")))
    return both.withColumn("place", last).where("place = 1").drop("place", "side")


def point_id(chunk_id: Column) -> Column:
    """First eight bytes of the id's MD5 as an unsigned number."""
    return F.conv(F.substring(F.md5(chunk_id), 1, 16), 16, 10).cast("decimal(20,0)")


def merge_overview(rules: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Fields that a model gave, else those that rules gave."""
    names = [c for c in rules.columns if c != key]
    other = model.select(key, *(F.col(c).alias(f"m_{c}") for c in names if c in model.columns))
    return rules.join(other, key, "left").select(key, *(F.coalesce(F.col(f"m_{c}"), F.col(c)).alias(c) if c in model.columns else F.col(c) for c in names))
