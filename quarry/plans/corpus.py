"""Queries on the way of texts and files into the engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.rounding import half_even
from quarry.operators import embedding
from quarry.operators.prefix import saved
from quarry.plans.frames import PASSAGES, duck, frame
from quarry.plans.search import TF_SQL, passages_with
from quarry.sources import files, manifest
from quarry.sources.scratch import shared_folder

#: Halves that doubles hold, halves that they only print, and prices.
HALVES = "SELECT l_linenumber AS line, CAST(l_partkey % 1000 AS DOUBLE) / 8 AS exact, CAST(l_partkey * 2 + 1 AS DOUBLE) / 200 AS printed, l_extendedprice * (1 - l_discount) AS price FROM {lineitem}"


def half_even_rounding(spark, sf_dir):
    """Sums of values rounded to two digits, in hundredths."""
    rows = frame(spark, sf_dir, HALVES)
    cents = lambda c: F.sum(F.round(half_even(F.col(c), 2) * 100).cast("long")).alias(c)
    return rows.groupBy("line").agg(*(cents(c) for c in ("exact", "printed", "price")))


#: Columns of lines from which passages' keys and texts are made.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax"]


def _counted(spark, sf_dir, *left_out):
    """Passages' tokens' places and rarity; texts are cut once, and what they have is a table."""
    passages = frame(spark, sf_dir, PASSAGES, wide=True).select("passage_id", "text")
    counted = embedding.counted(passages, "passage_id", keys=frame(spark, sf_dir, PASSAGES))
    found = saved(counted.drop(*left_out), "counted", compression="zstd")
    return found, saved(embedding.rarity_of(found), "rarity")


def tfidf_vectors(spark, sf_dir):
    """Hashed vectors of all passages: their places, size and largest value."""
    found = embedding.weighed(*_counted(spark, sf_dir, "content"), whole=False)
    return found.select("passage_id", F.col("places").cast("long").alias("places"), F.round(F.col("size") * 1000).cast("long").alias("size3"), F.round(F.col("most") * 1000).cast("long").alias("most3"))


def tfidf_refresh(spark, sf_dir):
    """Vectors after one text in seven has changed: the changed ones alone are made, the others come from the places that are kept."""
    found, weights = _counted(spark, sf_dir)
    stored = embedding.weighed(found, weights, whole=False).select("passage_id", "content", "places")
    changed = F.pmod(F.length("passage_id"), F.lit(7)) == 0
    passages = lambda lines: spark.sql(PASSAGES.replace("\nFROM", ", *\nFROM"), lineitem=lines)
    now = lambda lines: passages(lines).withColumn("text", F.when(changed, F.concat("text", F.lit(" zebra quartz"))).otherwise(F.col("text")))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINE)
    return embedding.refresh(stored, lines, weights, "passage_id", make=now).groupBy("made").agg(F.count("*").alias("n"), F.sum("places").alias("places"))


def _one_file(spark, folder, name):
    """The one part file of a folder moved to a name that stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for group in store.listStatus(path(folder)):
        if group.isDirectory():
            for part in store.listStatus(group.getPath()):
                if part.getPath().getName().startswith("part-"):
                    to = path(f"{name}/{group.getPath().getName().split('=')[1]}.json")
                    store.mkdirs(path(name))
                    store.delete(to, False)
                    store.rename(part.getPath(), to)


def manifest_ingest(spark, sf_dir):
    """Files of customers by nation, loaded twice: some changed, some written again as they were, some new; the second load's files by status, and rows read."""
    base = shared_folder(spark, "manifest")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")

    def put(df, step):
        df.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("nation"), "c_custkey", "mark").repartition("nation").sortWithinPartitions("c_custkey").write.partitionBy("nation").json(f"{base}/{step}")
        _one_file(spark, f"{base}/{step}", f"{base}/files")

    put(rows.where("c_nationkey % 4 <> 3").withColumn("mark", F.lit("first")), "one")
    manifest.refresh(spark, f"{base}/files", f"{base}/versions")
    put(rows.where("c_nationkey % 4 = 3 or c_nationkey % 4 = 1").withColumn("mark", F.lit("second")), "two")
    put(rows.where("c_nationkey % 4 = 2").withColumn("mark", F.lit("first")), "three")
    found = saved(manifest.refresh(spark, f"{base}/files", f"{base}/versions"), "changes")
    name = lambda c: F.regexp_extract(c, r"/(N\d+)\.json$", 1)
    read = spark.read.schema("c_custkey long, mark string").json(manifest.to_read(found)).groupBy(name(F.col("_metadata.file_path")).alias("nation")).agg(F.count("*").alias("rows"), F.max("mark").alias("mark"))
    return found.select(name(F.col("path")).alias("nation"), "status").join(read, "nation", "left")


#: Customers as a nation's chunks: their section, text and page.
MEMBERS = "SELECT c_nationkey AS n, c_custkey AS k, concat('N', CAST(c_nationkey AS STRING), '_s', CAST(c_custkey % 4 AS STRING)) AS section_id, concat('Member ', CAST(c_custkey AS STRING), ' of ', n_name) AS text, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"


def _report_files(spark, sf_dir):
    """Files of nations as reports: some without metadata, some cut off in the middle."""
    m = frame(spark, sf_dir, MEMBERS)
    name = F.concat(F.lit("N"), F.col("n").cast("string"))
    levels = F.create_map(F.lit("level_2"), F.concat(F.lit("Section "), (F.col("k") % 4).cast("string")), F.lit("level_1"), F.col("n_name"))
    chunk = F.struct(
        F.concat(name, F.lit("_c"), F.col("k").cast("string")).alias("chunk_id"), F.col("section_id").alias("parent_chunk_id"), F.lit("paragraph").alias("content_type"), F.col("text").alias("content"), (F.col("k") % 50).cast("int").alias("source_page_physical"),
        levels.alias("hierarchy"), F.struct(F.concat(name, F.lit(".pdf")).alias("source")).alias("metadata"),
    )
    finding = F.struct(F.concat(name, F.lit("_c"), F.col("k").cast("string")).alias("source_chunk_id"), F.lit("non_compliance").alias("finding_type"), (F.col("k") * 100).alias("total_amount_inr"), F.col("text").alias("description"))
    parts = m.groupBy("n", "n_name").agg(F.collect_list(chunk).alias("chunks"), F.collect_list(F.when(F.col("k") % 3 == 0, finding)).alias("found"), F.collect_set("section_id").alias("sections"))
    metadata = F.struct(name.alias("report_id"), F.col("n_name").alias("report_title"), (F.col("n") % 13 + 2010).cast("int").alias("report_year"), F.concat(name, F.lit(".pdf")).alias("source_filename"), F.size("chunks").alias("page_count"))
    section = lambda s: F.struct(s.alias("chunk_id"), name.alias("report_id"), F.array(F.lit(0), F.lit(49)).alias("page_range_physical"), F.concat(F.lit("Entry of "), s).alias("toc_entry"), F.lit(2).alias("toc_level"))
    report = F.to_json(F.struct(
        F.when(F.col("n") % 7 != 3, metadata).alias("report_metadata"), F.transform("sections", section).alias("parent_chunks"), F.col("chunks").alias("child_chunks"), F.struct(F.col("found").alias("findings")).alias("semantic_enrichment"),
    ))
    text = F.when(F.col("n") % 11 == 5, F.left(report, F.lit(300))).otherwise(report)
    folder = shared_folder(spark, "reports")
    parts.select("n", text.alias("value")).repartition("n").write.partitionBy("n").text(folder)
    return files.read_reports(spark, folder, "*.txt")


def report_files(spark, sf_dir):
    """Metadata of report files, with what stands in where there is none."""
    return files.reports(_report_files(spark, sf_dir)).select("report_id", "title", F.col("year").cast("long").alias("year"), "filename", F.col("pages").cast("long").alias("pages"))


def report_file_parts(spark, sf_dir):
    """Chunks, sections and findings of report files, and the files that can't be read."""
    rows = _report_files(spark, sf_dir)
    chunks = files.chunks(rows).agg(F.lit("chunks").alias("part"), F.count("*").alias("n"), F.max("hierarchy_path").alias("last"), F.sum("page").alias("sum"))
    sections = files.sections(rows).agg(F.lit("sections").alias("part"), F.count("*").alias("n"), F.max("toc_entry").alias("last"), F.sum("page_end").alias("sum"))
    findings = files.findings(rows).agg(F.lit("findings").alias("part"), F.count("*").alias("n"), F.max("text").alias("last"), F.sum("amount_paise").alias("sum"))
    failed = files.failed_files(rows).agg(F.lit("failed").alias("part"), F.count("*").alias("n"), F.max(F.left("begin", F.lit(10))).alias("last"), F.sum(F.length("begin")).alias("sum"))
    return chunks.unionByName(sections).unionByName(findings).unionByName(failed)


QUERIES = {f.__name__: f for f in (report_files, report_file_parts, half_even_rounding, tfidf_vectors, tfidf_refresh, manifest_ingest)}

#: The same by whole numbers of 128 bits.
ROUND = lambda x: f"(SELECT CASE WHEN r * 2 > p OR (r * 2 = p AND q % 2 = 1) THEN q + 1 ELSE q END FROM (SELECT (m * 100) // p AS q, (m * 100) % p AS r, p FROM (SELECT CAST({x} * pow(2, k) AS HUGEINT) AS m, CAST(1 AS HUGEINT) << k AS p FROM (SELECT CAST(54 - floor(log2(CASE WHEN {x} > 0 THEN {x} ELSE 1 END)) AS INT) AS k))))"
BITS = "(('0x' || left(md5(token), 7))::BIGINT % 1048576)"
PLACES = f"{TF_SQL}, t AS (SELECT passage_id, {BITS} AS place, sum(tf) AS tf FROM tf GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM passages), w AS (SELECT place, ln((n + 1) / (count(*) + 1)::DOUBLE) AS idf FROM t, n GROUP BY place, n), v AS (SELECT passage_id, (1 + ln(tf)) * idf AS value FROM t JOIN w USING (place))"
READABLE = f"m AS ({duck(MEMBERS)}), w AS (SELECT * FROM m WHERE n % 11 <> 5)"
ORACLE_SQL = {
    "report_files": f"WITH {READABLE} SELECT 'N' || n AS report_id, CASE WHEN n % 7 = 3 THEN 'N' || n ELSE n_name END AS title, CASE WHEN n % 7 <> 3 THEN 2010 + n % 13 END AS year, 'N' || n || '.pdf' AS filename, CASE WHEN n % 7 <> 3 THEN count(*) END AS pages FROM w GROUP BY n, n_name",
    "report_file_parts": f"""WITH {READABLE} SELECT 'chunks' AS part, count(*) AS n, max(n_name || ' > Section ' || k % 4) AS last, CAST(sum(k % 50) AS BIGINT) AS sum FROM w
UNION ALL SELECT 'sections', count(DISTINCT section_id), max('Entry of ' || section_id), 49 * count(DISTINCT section_id) FROM w
UNION ALL SELECT 'findings', count(*), max(text), CAST(sum(k * 100) AS BIGINT) FROM w WHERE k % 3 = 0
UNION ALL SELECT 'failed', count(DISTINCT n), CASE WHEN count(*) > 0 THEN max('{{"report_m') END, CASE WHEN count(*) > 0 THEN 200 * count(DISTINCT n) END FROM m WHERE n % 11 = 5""",
    "half_even_rounding": f"WITH h AS ({HALVES.replace('{lineitem}', 'lineitem')}) SELECT line, " + ", ".join(f"CAST(sum({ROUND(c)}) AS BIGINT) AS {c}" for c in ("exact", "printed", "price")) + " FROM h GROUP BY 1",
    "tfidf_vectors": passages_with(f"{PLACES} SELECT passage_id, count(*) AS places, CAST(round(sqrt(sum(value * value)) * 1000) AS BIGINT) AS size3, CAST(round(max(value) / sqrt(sum(value * value)) * 1000) AS BIGINT) AS most3 FROM v WHERE value <> 0 GROUP BY 1"),
    "manifest_ingest": "SELECT 'N' || c_nationkey AS nation, CASE c_nationkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'changed' WHEN 2 THEN 'touched' ELSE 'new' END AS status, CASE WHEN c_nationkey % 2 = 1 THEN count(*) END AS rows, CASE WHEN c_nationkey % 2 = 1 THEN 'second' END AS mark FROM customer GROUP BY c_nationkey",
}
ORACLE_SQL["tfidf_refresh"] = passages_with(
    f"{PLACES}, s AS (SELECT passage_id, count(*) AS n FROM v WHERE value <> 0 GROUP BY 1), a AS (SELECT DISTINCT passage_id, place FROM t), extra AS (SELECT DISTINCT {BITS} AS place FROM (SELECT unnest(['zebra', 'quartz']) AS token)), "
    "g AS (SELECT passage_id, length(passage_id) % 7 = 0 AS made, n FROM s), x AS (SELECT g.passage_id, count(*) AS more FROM g, extra WHERE made AND NOT EXISTS (SELECT 1 FROM a WHERE a.passage_id = g.passage_id AND a.place = extra.place) GROUP BY 1) "
    "SELECT made, count(*) AS n, CAST(sum(n + coalesce(more, 0)) AS BIGINT) AS places FROM g LEFT JOIN x USING (passage_id) GROUP BY 1"
)
