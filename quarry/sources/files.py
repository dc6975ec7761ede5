"""Report files, batch results, evaluation cases and summaries as tables, and the sinks of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = "array<struct<level:string,title:string>>"
REPORT = """
report_metadata struct<report_id:string, report_title:string, report_no:string, report_year:int, ministry:string, sector:string, department:string, report_type:string, source_filename:string, page_count:int, executive_summary:string>,
parent_chunks array<struct<chunk_id:string, report_id:string, hierarchy:map<string,string>, page_range_physical:array<int>, page_range_logical:array<string>, toc_entry:string, toc_level:int>>,
child_chunks array<struct<chunk_id:string, parent_chunk_id:string, content_type:string, content:string, source_page_physical:int, hierarchy:map<string,string>, report_id:string, structured_data:string, extraction_confidence:double, metadata:struct<source:string>>>,
semantic_enrichment struct<findings:array<struct<source_chunk_id:string, finding_type:string, severity:string, total_amount_inr:bigint, entities_mentioned:array<string>, chapter:string, page:int, confidence:double, description:string, text:string>>,
  recommendations:array<struct<source_chunk_id:string, target_entity:string, action_required:string, extraction_strategy:string, rec_number:string, text:string>>,
  section_classifications:array<struct<chunk_id:string, section_type:string, confidence:double>>, entities:map<string,array<string>>>,
_corrupt_record string"""
# Variants of a summary in the order in which they are listed.
VARIANTS = ["executive", "journalist", "deep_dive", "simple", "policy"]
BATCH_LINE = "custom_id string, result struct<type:string, message:struct<content:array<struct<type:string,text:string,thinking:string>>>, error:struct<message:string>>, _corrupt_record string"
EVENT_LINE = "type string, data string"


def read_reports(spark: SparkSession, folder: str, pattern: str = "*_chunks.json", recursive: bool = True) -> DataFrame:
    """One row per report file, with its path; files that can't be parsed have their text in _corrupt_record.

    The schema is given, never inferred, and missing fields are null.
    """
    reader = spark.read.schema(REPORT).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.json(folder).select("*", F.col("_metadata.file_path").alias("path"))


def read_reports_or(spark: SparkSession, folder: str, first: str = "*_enriched.json", other: str = "*_chunks.json") -> DataFrame:
    """Reports of the first file pattern that the folder has, like an index run takes them."""
    found = read_reports(spark, folder, first, recursive=False)
    return found if not found.isEmpty() else read_reports(spark, folder, other, recursive=False)


def failed_files(files: DataFrame) -> DataFrame:
    """Files that could not be parsed, or not to their end; no other function takes anything from them."""
    # Spark doesn't read the corrupt record alone, so another column is looked at
    return files.where(F.col("_corrupt_record").isNotNull() & (F.coalesce("report_metadata.report_id", F.lit("")) != F.lit("\0"))).select("path", F.left("_corrupt_record", F.lit(200)).alias("begin"))


def levels(hierarchy: Column) -> Column:
    """Levels of a section as an ordered list: level_1 before level_2 and so on."""
    return F.array_sort(F.transform(F.map_entries(hierarchy), lambda e: F.struct(e["key"].alias("level"), e["value"].alias("title"))))


def reports(files: DataFrame) -> DataFrame:
    """Report metadata; without any, the source named by the first chunk stands in for the file name and id."""
    m, source = F.col("report_metadata"), F.get("child_chunks", 0)["metadata"]["source"]
    name = F.coalesce(m["source_filename"], source, F.regexp_extract("path", r"([^/]+?)(?:_chunks|_enriched)?\.json$", 1))
    ident = F.coalesce(m["report_id"], F.regexp_replace(name, r"\.pdf$", ""))
    return files.where(F.col("_corrupt_record").isNull()).select(
        ident.alias("report_id"), F.coalesce(m["report_title"], ident).alias("title"), m["report_no"].alias("report_no"), m["report_year"].alias("year"), m["ministry"].alias("ministry"), m["sector"].alias("sector"),
        F.when(name.endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf"))).alias("filename"), m["page_count"].alias("pages"), m["executive_summary"].alias("executive_summary"),
    )


def chunks(files: DataFrame) -> DataFrame:
    """Child chunks with their place in the file and the path of their section."""
    rows = files.where(F.col("_corrupt_record").isNull()).select(F.col("report_metadata.report_id").alias("file_report"), F.posexplode("child_chunks").alias("ord", "c"))
    return rows.select(
        F.coalesce("c.report_id", "file_report").alias("report_id"), "ord", "c.chunk_id", F.col("c.parent_chunk_id").alias("parent_id"), F.col("c.content_type").alias("kind"), F.col("c.content").alias("text"),
        F.col("c.source_page_physical").alias("page"), F.array_join(F.transform(levels(F.col("c.hierarchy")), lambda x: x["title"]), " > ").alias("hierarchy_path"), F.col("c.extraction_confidence").alias("confidence"),
    )


def sections(files: DataFrame) -> DataFrame:
    """Parent chunks: entry of the contents list, path, and first and last page."""
    rows = files.where(F.col("_corrupt_record").isNull()).select(F.explode("parent_chunks").alias("p"))
    return rows.select(F.col("p.report_id").alias("report_id"), F.col("p.chunk_id").alias("section_id"), "p.toc_entry", F.array_join(F.transform(levels(F.col("p.hierarchy")), lambda x: x["title"]), " > ").alias("hierarchy_path"), F.get("p.page_range_physical", 0).alias("page_start"), F.get("p.page_range_physical", 1).alias("page_end"), "p.toc_level")


def findings(files: DataFrame) -> DataFrame:
    """Findings in the files' order."""
    rows = files.where(F.col("_corrupt_record").isNull()).select(F.col("report_metadata.report_id").alias("report_id"), F.posexplode("semantic_enrichment.findings").alias("ord", "f"))
    return rows.select("report_id", "ord", "f.source_chunk_id", "f.finding_type", "f.severity", F.col("f.total_amount_inr").alias("amount_paise"), "f.chapter", "f.page", "f.confidence", F.coalesce("f.description", "f.text").alias("text"))


def section_classes(files: DataFrame) -> DataFrame:
    """Section types of chunks in the files' order."""
    rows = files.where(F.col("_corrupt_record").isNull()).select(F.posexplode("semantic_enrichment.section_classifications").alias("ord", "s"))
    return rows.select("s.chunk_id", "ord", "s.section_type", "s.confidence")


def batch_results(spark: SparkSession, path: str, jobs: DataFrame | None = None) -> DataFrame:
    """Summaries of a JSONL file of batch results: report_id, variant, content, word_count, thinking_used, error.

    ``jobs`` (custom_id, report_id, variant) names them; an id that it lacks stands for the report itself.
    """
    lines = spark.read.schema(BATCH_LINE).json(path).where(F.col("custom_id").isNotNull())
    text = lambda kind, field: F.array_join(F.transform(F.filter("result.message.content", lambda c: c["type"] == kind), lambda c: F.coalesce(c[field], F.lit(""))), "")
    rows = lines.select("custom_id", F.when(F.col("result.type") == "succeeded", text("text", "text")).alias("content"), F.coalesce(F.exists("result.message.content", lambda c: c["type"] == "thinking"), F.lit(False)).alias("thinking_used"), F.when(F.col("result.type") != "succeeded", F.coalesce("result.error.message", "result.type")).alias("error"))
    words = F.when(F.trim("content") == "", 0).otherwise(F.size(F.split(F.trim("content"), r"\s+")))
    named = rows.join(jobs, "custom_id", "left") if jobs is not None else rows.select("*", F.lit(None).cast("string").alias("report_id"), F.lit(None).cast("string").alias("variant"))
    return named.select(F.coalesce("report_id", "custom_id").alias("report_id"), "variant", "content", words.alias("word_count"), "thinking_used", "error")


def custom_id(code: str, identifier: Column, most: int = 64) -> Column:
    """Batch id of a report's variant: a hash and as much of the report's id as fits."""
    head = 3 + len(code) + 1 + 8 + 1
    return F.concat(F.lit(f"sm_{code}_"), F.substring(F.md5(identifier), 1, 8), F.lit("_"), F.left(identifier, F.lit(most - head)))


def summary_list(summaries: DataFrame) -> DataFrame:
    """Every report's variants in their fixed order, those that it lacks too."""
    spark = summaries.sparkSession
    dimension = F.broadcast(spark.createDataFrame([(i, v) for i, v in enumerate(VARIANTS)], "place int, variant string"))
    wanted = summaries.select("report_id").distinct().crossJoin(dimension)
    have = summaries.where(F.col("content").isNotNull()).select("report_id", "variant", "word_count")
    return wanted.join(have, ["report_id", "variant"], "left").select("report_id", "place", "variant", F.col("word_count").isNotNull().alias("available"), F.coalesce("word_count", F.lit(0)).alias("word_count"))


def read_manual_tests(spark: SparkSession, path: str) -> DataFrame:
    """Hand-filled evaluation sheet: yes and no as booleans, issues split at ';'."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn("passed", F.lower(F.trim("passed")) == "yes").withColumn("issues", F.filter(F.transform(F.split(F.coalesce("issues", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))


def write_manual_tests(cases: DataFrame, path: str) -> None:
    """Evaluation cases as a sheet, amounts and entities flattened."""
    flat = cases.select("test_id", "question", F.array_join(F.transform("amounts", lambda a: F.concat(a["value"].cast("string"), F.lit(" "), a["unit"])), "; ").alias("amounts"), F.array_join("entities", "; ").alias("entities"))
    flat.write.option("header", True).mode("overwrite").csv(path)


def write_latest(rows: DataFrame, path: str, key: str, order: str, by: str | None = None) -> None:
    """Rows as Parquet, of equal keys the last in order; partitioned by ``by`` and sorted by key for row-group statistics."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    last = rows.withColumn("_place", place).where("_place = 1").drop("_place")
    writer = last.repartition(by).sortWithinPartitions(by, key) if by else last.sortWithinPartitions(key)
    out = writer.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true")
    (out.partitionBy(by) if by else out).parquet(path)


def by_id(rows: DataFrame, report_id: str) -> DataFrame:
    """Rows of the report of this id; if there are none, of the first report whose id holds it."""
    rank = F.when(F.col("report_id") == report_id, 0).when(F.contains("report_id", F.lit(report_id)), 1)
    best = F.broadcast(rows.where(rank.isNotNull()).agg(F.min(F.struct(rank.alias("rank"), "report_id")).alias("b")).select(F.col("b.report_id").alias("best")))
    return rows.join(best, F.col("report_id") == F.col("best")).drop("best")
