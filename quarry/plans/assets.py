"""Chart and table queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import assets as A
from quarry.operators import assets
from quarry.plans.frames import frame, over
from quarry.plans.listing import more

ELEMENTS_SQL = """
SELECT concat('R', CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS STRING)) AS report_id, concat('k', CAST(p_partkey AS STRING)) AS chunk_id, p_partkey AS ord, CAST(p_size % 9 AS INT) AS page,
       CASE WHEN p_partkey % 9 IN (2, 3, 4) THEN 'image_caption' ELSE 'paragraph' END AS kind,
       CASE CAST(p_partkey % 9 AS INT)
         WHEN 0 THEN concat('Figure ', CAST(p_size % 3 AS STRING), '.1: Trend of ', p_name) WHEN 1 THEN concat('chart 4 - Share of ', p_name, ' by type')
         WHEN 2 THEN concat('a bar chart depicting the average charges of ', p_name, ', in 2020') WHEN 3 THEN 'a photo of a building with people'
         WHEN 4 THEN concat('it shows the trend line of ', p_name) WHEN 5 THEN concat('Box ', CAST(p_size AS STRING), ': Note on ', p_brand) WHEN 6 THEN concat('Map 3.1: ', p_name, ' sites')
         WHEN 7 THEN concat('Exhibit 9: ', p_name, ' versus ', p_type) ELSE concat('As Figure 2 shows, ', p_name) END AS text
FROM {part}"""
TABLES_SQL = """
SELECT concat('R', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS report_id, concat('t', CAST(p_partkey AS STRING)) AS chunk_id, p_partkey AS ord, CAST(p_size % 5 AS INT) AS page, 'table_markdown' AS kind,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat('Data Table: ', CAST(p_size % 4 AS STRING), '.1 ', p_name) WHEN 1 THEN '' WHEN 2 THEN ' Data Table: Summary ' ELSE 'Receipts' END AS title,
       CASE WHEN p_partkey % 6 = 1 THEN concat('Totals of ', p_brand) END AS struct_title,
       concat('| ', p_brand, ' | Budget | Actual |', chr(10), '|---|:-:|---|', chr(10), repeat(concat('| ', p_name, ' | ', CAST(p_size AS STRING), ' |  |', chr(10)), CAST(p_size % 4 AS INT))) AS text
FROM {part}"""
CELLS_SQL = """
SELECT CAST(floor(l_orderkey / 40) AS INT) AS table_id, CAST(l_partkey AS INT) AS row_no, CAST(l_linenumber - 1 AS INT) AS col_no,
       CASE WHEN min(l_suppkey) % 7 = 0 THEN 'total' WHEN min(l_suppkey) % 7 = 1 THEN 'header' ELSE 'data' END AS row_type,
       concat('cell no. ', CAST(min(l_suppkey) AS STRING), ' of ', CAST(count(*) AS STRING)) AS text,
       CAST(CASE WHEN min(l_suppkey) % 3 = 0 THEN 0 WHEN min(l_suppkey) % 3 = 1 THEN NULL ELSE min(CAST(l_extendedprice AS DECIMAL(14,2))) END AS DECIMAL(14,2)) AS normalized,
       CAST(CASE WHEN min(l_suppkey) % 5 = 0 THEN NULL ELSE min(CAST(l_quantity AS DECIMAL(14,2))) END AS DECIMAL(14,2)) AS parsed
FROM {lineitem} GROUP BY CAST(floor(l_orderkey / 40) AS INT), l_partkey, l_linenumber"""
POINTS_SQL = """
SELECT CAST(floor(l_orderkey / 40) AS INT) AS chart_id, CAST(l_suppkey % 5 AS INT) AS series_id, concat(CASE WHEN l_partkey % 2 = 0 THEN 'FY ' ELSE 'fy ' END, CAST(year(l_shipdate) AS STRING)) AS category,
       concat(lpad(CAST(l_orderkey AS STRING), 9, '0'), '-', lpad(CAST(l_partkey AS STRING), 9, '0'), '-', CAST(l_linenumber AS STRING), '-', lpad(CAST(l_suppkey AS STRING), 6, '0'), '-', CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING)) AS ord,
       CAST(l_extendedprice AS DECIMAL(14,2)) AS value
FROM {lineitem}"""


def visual_titles(spark, sf_dir):
    e = frame(spark, sf_dir, ELEMENTS_SQL).where(A.is_visual_title(F.col("text")))
    return e.select("chunk_id", *(A.visual_part(F.col("text"), p).alias(p) for p in ("number", "kind", "title")))


def chart_type(spark, sf_dir):
    e = frame(spark, sf_dir, ELEMENTS_SQL)
    return e.select("chunk_id", A.chart_type(F.col("text"), F.when(F.col("page") == 1, "map").when(F.col("page") == 2, "box").otherwise("chart")).alias("type"))


def caption_title(spark, sf_dir):
    e = frame(spark, sf_dir, ELEMENTS_SQL).where("kind = 'image_caption'")
    return e.select("chunk_id", A.title_of_caption(F.col("text"), F.col("page") + 1).alias("title"), A.describes_chart(F.col("text")).alias("chart"))


def extract_charts(spark, sf_dir):
    return assets.extract_charts(frame(spark, sf_dir, ELEMENTS_SQL))


def assets_summary(spark, sf_dir):
    c = assets.extract_charts(frame(spark, sf_dir, ELEMENTS_SQL))
    return c.groupBy("report_id", "type").agg(F.count("*").alias("n"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def charts_filter(spark, sf_dir):
    return assets.extract_charts(frame(spark, sf_dir, ELEMENTS_SQL)).where("page = 2 and type = 'line'").orderBy("report_id", "title", "chunk_id").offset(2).limit(20).select("report_id", "chunk_id", "title")


def md_table_dims(spark, sf_dir):
    t = frame(spark, sf_dir, TABLES_SQL).withColumn("lines", A.table_lines(F.col("text")))
    return t.select("chunk_id", F.size("lines").alias("rows"), F.size(F.get("lines", 0)).alias("columns"), F.array_join(F.get("lines", 0), ",").alias("headers"))


def extract_tables(spark, sf_dir):
    return assets.extract_tables(frame(spark, sf_dir, TABLES_SQL)).select("report_id", "chunk_id", "rows", "columns", "headers", "table_no")


def tables_filter(spark, sf_dir):
    """Tables of at least three rows and columns on a page, after they are named."""
    t = assets.extract_tables(frame(spark, sf_dir, TABLES_SQL))
    return assets.disambiguate(t).join(t.select("chunk_id", "page", "rows", "columns"), "chunk_id").where("page = 1 and rows >= 3 and columns >= 3").select("report_id", "chunk_id", "display")


def disambiguate_titles(spark, sf_dir):
    return assets.disambiguate(assets.extract_tables(frame(spark, sf_dir, TABLES_SQL)))


def clean_caption(spark, sf_dir):
    return frame(spark, sf_dir, TABLES_SQL).select("chunk_id", A.clean_caption(F.col("title")).alias("caption"))


def table_fallback_summary(spark, sf_dir):
    return frame(spark, sf_dir, TABLES_SQL).select("chunk_id", A.rule_summary(F.col("text")).alias("summary"))


def table_quality_gate(spark, sf_dir):
    """Tables with three filled cells and more."""
    t = frame(spark, sf_dir, TABLES_SQL).select("chunk_id", F.size(F.flatten(A.table_lines(F.col("text")))).alias("cells"))
    return t.where("cells >= 6")


def table_structure_check(spark, sf_dir):
    """Rows of the markdown against rows that were told: more than half apart is severe."""
    t = frame(spark, sf_dir, TABLES_SQL).select("chunk_id", F.size(A.table_lines(F.col("text"))).alias("md_rows"), F.lit(3).alias("rows"))
    return t.select("chunk_id", "md_rows", ((F.abs(F.col("rows") - F.col("md_rows")) / F.greatest("md_rows", F.lit(1))) > 0.5).alias("severe"))


def table_preview(spark, sf_dir):
    return assets.preview(frame(spark, sf_dir, CELLS_SQL).where("row_type <> 'header'"))


def table_sum_column(spark, sf_dir):
    return assets.sum_columns(frame(spark, sf_dir, CELLS_SQL))


def table_get_cell(spark, sf_dir):
    return frame(spark, sf_dir, CELLS_SQL).where("row_no = 77 and col_no = 2").select("table_id", "text")


def table_find_column(spark, sf_dir):
    """First column of a table with a header that holds the text, whatever the case."""
    c = frame(spark, sf_dir, CELLS_SQL).where("row_type = 'header'").where(F.contains(F.lower("text"), F.lit("no. 5")))
    return c.groupBy("table_id").agg(F.min("col_no").alias("col_no"))


def table_entity_row(spark, sf_dir):
    """First row whose first column holds the entity."""
    c = frame(spark, sf_dir, CELLS_SQL).where("col_no = 0").where(F.contains(F.lower("text"), F.lit("no. 9")))
    return c.groupBy("table_id").agg(F.min("row_no").alias("row_no"))


def chart_series_agg(spark, sf_dir):
    return assets.series_aggregates(frame(spark, sf_dir, POINTS_SQL))


def chart_total_across_series(spark, sf_dir):
    return assets.totals_across_series(frame(spark, sf_dir, POINTS_SQL))


def chart_categories(spark, sf_dir):
    return frame(spark, sf_dir, POINTS_SQL).groupBy("chart_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count("*").alias("points"))


def chart_validate(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    w = A.chart_warnings(F.col("p_size") / 20, F.col("p_partkey") % 2 == 0, F.col("p_size") % 3, F.when(F.col("p_size") % 4 == 0, " ").otherwise("Year"), F.when(F.col("p_size") % 5 > 0, "Amount"), F.concat(F.lit("Budget of "), F.col("p_name")), F.when(F.col("p_size") % 2 == 0, "crore"))
    return p.select("p_partkey", F.array_join(w, ",").alias("warnings"))


def chart_analysis(spark, sf_dir):
    e = frame(spark, sf_dir, ELEMENTS_SQL).where(A.is_visual_title(F.col("text")))
    path = F.concat(F.lit("Part "), F.col("page").cast("string"), F.lit(" > Dues"))
    return e.select("chunk_id", A.chart_analysis(F.col("text"), A.visual_part(F.col("text"), "kind"), path).alias("analysis"))


def table_analysis(spark, sf_dir):
    t = frame(spark, sf_dir, TABLES_SQL)
    return t.select("chunk_id", A.table_analysis(F.concat("text", F.when(F.col("page") == 1, "lakh").otherwise("")), F.col("title"), F.size(A.table_lines(F.col("text"))), F.lit(3)).alias("analysis"))


def embed_text(spark, sf_dir):
    t = frame(spark, sf_dir, TABLES_SQL)
    return t.select("chunk_id", A.embedding_text(F.col("title"), A.rule_summary(F.col("text")), F.col("text"), 120).alias("embedded"))


LINES = "list_filter(list_transform(list_filter(list_transform(string_split(trim(text), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^[\\s|:-]+$')), lambda x: list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c <> '')), lambda c: len(c) > 0)"
TYPE_SQL = lambda text, kind: f"CASE WHEN {kind} = 'box' THEN 'table_chart' " + " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{name}'" for name, words in A.TYPE_WORDS) + f" WHEN {kind} = 'map' THEN 'area' ELSE 'bar' END"
VIS = A.VISUAL
VISUAL_SQL = f"v AS (SELECT *, trim(regexp_extract(text, '{VIS}', 1)) AS number, lower(regexp_extract(text, '{VIS}', 2)) AS el, trim(regexp_extract(text, '{VIS}', 3)) AS vt FROM e WHERE regexp_matches(text, '{VIS}') AND length(text) <= 250)"
DESCRIBES = "((" + " OR ".join(f"contains(lower(text), '{w}')" for w in A.CHART_WORDS) + ") AND NOT (" + " OR ".join(f"contains(lower(text), '{w}')" for w in A.NO_CHART_WORDS) + "))"
SUBJECT = lambda i: f"regexp_replace(regexp_replace(trim(regexp_extract(lower(text), '{A.SUBJECTS[i]}', 1)), '\\s+', ' ', 'g'), '[.,;:]+$', '')"
INITCAP = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
CAPTION = f"CASE WHEN length({SUBJECT(0)}) > 10 THEN {INITCAP(SUBJECT(0))} WHEN length({SUBJECT(1)}) > 10 THEN {INITCAP(SUBJECT(1))} ELSE 'Visual Element on Page ' || (page + 1) END"
CHARTS = f"""{VISUAL_SQL}, formal AS (SELECT report_id, chunk_id, page, number || ': ' || vt AS title, {TYPE_SQL('vt', 'el')} AS type FROM v WHERE kind IN ('paragraph', 'header') QUALIFY row_number() OVER (PARTITION BY report_id, page, number ORDER BY ord, chunk_id) = 1),
charts AS (SELECT * FROM formal UNION ALL SELECT report_id, chunk_id, page, {CAPTION}, {TYPE_SQL('text', "'caption'")} FROM e WHERE kind = 'image_caption' AND {DESCRIBES} AND (SELECT count(*) FROM formal f WHERE f.report_id = e.report_id) < 3 AND NOT EXISTS (SELECT 1 FROM formal f WHERE f.report_id = e.report_id AND f.page = e.page) QUALIFY row_number() OVER (PARTITION BY report_id, page ORDER BY ord, chunk_id) = 1)"""
TABLES = f"tabs AS (SELECT report_id, chunk_id, page, ord, title, struct_title, CAST(len(l) AS INT) AS rows, CAST(len(l[1]) AS INT) AS columns, array_to_string(l[1], ',') AS headers, CAST(row_number() OVER (PARTITION BY report_id ORDER BY ord, chunk_id) AS INT) AS table_no FROM (SELECT *, {LINES} AS l FROM t WHERE length(text) >= 30) WHERE len(l) >= 2)"
CLEAN_OF = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN 'Untitled Table' WHEN lower(trim({c})) LIKE 'data table:%' AND regexp_matches(trim(substr(trim({c}), 12)), '^\\d+\\.') THEN trim(substr(trim({c}), 12)) ELSE trim({c}) END"
CLEAN = CLEAN_OF("title")
NAMED = f"""n1 AS (SELECT *, {CLEAN} AS caption FROM tabs), n2 AS (SELECT *, count(*) OVER (PARTITION BY report_id, caption) AS same, coalesce(struct_title, '') <> '' AND struct_title <> caption AND count(*) OVER (PARTITION BY report_id, caption, coalesce(struct_title, '')) = 1 AS told FROM n1),
n3 AS (SELECT *, same > 1 AND NOT told AND coalesce(page, 0) <> 0 AND row_number() OVER (PARTITION BY report_id, caption, told, page ORDER BY ord, chunk_id) = 1 AS paged FROM n2),
n4 AS (SELECT *, same > 1 AND NOT told AND NOT paged AND rows > 0 AND columns > 0 AND row_number() OVER (PARTITION BY report_id, caption, told, paged, rows, columns ORDER BY ord, chunk_id) = 1 AS sized FROM n3),
named AS (SELECT report_id, chunk_id, page, rows, columns, CASE WHEN same = 1 THEN caption WHEN told THEN {CLEAN_OF('struct_title')} WHEN paged THEN caption || ' (Page ' || page || ')' WHEN sized THEN caption || ' (' || rows || '×' || columns || ')'
  ELSE caption || ' (' || row_number() OVER (PARTITION BY report_id, caption, told, paged, sized ORDER BY ord, chunk_id) || ')' END AS display FROM n4)"""
FIRST_POINT = "pt AS (SELECT chart_id, series_id, lower(category) AS category, min_by(value, ord) AS value FROM p GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (visual_titles, chart_type, caption_title, extract_charts, assets_summary, charts_filter, md_table_dims, extract_tables, tables_filter, disambiguate_titles, clean_caption, table_fallback_summary, table_quality_gate, table_structure_check, table_preview, table_sum_column, table_get_cell, table_find_column, table_entity_row, chart_series_agg, chart_total_across_series, chart_categories, chart_validate, chart_analysis, table_analysis, embed_text)}

SUMMARY = "CASE WHEN len(l) < 3 THEN '' ELSE 'Table with ' || len(list_filter(l[3:], lambda x: contains(x, '|'))) || ' rows showing: ' || array_to_string(list_filter(list_transform(string_split(l[1], '|'), lambda c: trim(c)), lambda c: c <> '')[1:4], ', ') || '.' END"
KIND_SQL = "CASE el " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in A.KIND_NAMES.items()) + " END"
ACTION_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{n}'" for n, words in A.ACTIONS) + " ELSE 'presents' END"
THEME_SQL = "concat_ws(', ', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{n}' END" for n, words in A.THEMES) + ")"

ORACLE_SQL = {
    "chart_analysis": more(f", {VISUAL_SQL} SELECT chunk_id, 'This ' || {KIND_SQL} || ' ' || {ACTION_SQL} || ' ' || CASE WHEN contains(text, ':') THEN trim(regexp_replace(text, '^[^:]*:', '')) ELSE text END || ', as discussed in Dues.' AS analysis FROM v", e=ELEMENTS_SQL),
    "table_analysis": over(f"SELECT chunk_id, 'Contains ' || coalesce(nullif({THEME_SQL}, ''), 'tabular data') || ' related to ' || coalesce(string_split(nullif(title, ''), ' > ')[-1], 'this section') || '. Dimensions: ' || n || ' rows × 3 columns.' AS analysis FROM (SELECT *, lower(text || CASE WHEN page = 1 THEN 'lakh' ELSE '' END) AS low, len({LINES}) AS n FROM t)", t=TABLES_SQL),
    "embed_text": over(f"SELECT chunk_id, left(concat_ws(chr(10) || chr(10), CASE WHEN coalesce(title, '') <> '' THEN '[' || title || ']' END, CASE WHEN s <> '' THEN '[Table Summary: ' || s || ']' END, text), 120) AS embedded FROM (SELECT *, {SUMMARY} AS s FROM (SELECT *, string_split(trim(text, chr(10) || ' '), chr(10)) AS l FROM t))", t=TABLES_SQL),
    "visual_titles": more(f", {VISUAL_SQL} SELECT chunk_id, number, el AS kind, vt AS title FROM v", e=ELEMENTS_SQL),
    "chart_type": over(f"SELECT chunk_id, {TYPE_SQL('text', 'k')} AS type FROM (SELECT *, CASE page WHEN 1 THEN 'map' WHEN 2 THEN 'box' ELSE 'chart' END AS k FROM e)", e=ELEMENTS_SQL),
    "caption_title": over(f"SELECT chunk_id, {CAPTION} AS title, {DESCRIBES} AS chart FROM e WHERE kind = 'image_caption'", e=ELEMENTS_SQL),
    "extract_charts": more(f", {CHARTS} SELECT * FROM charts", e=ELEMENTS_SQL),
    "assets_summary": more(f", {CHARTS} SELECT report_id, type, count(*) AS n, min(page) AS first_page, max(page) AS last_page FROM charts GROUP BY ALL", e=ELEMENTS_SQL),
    "charts_filter": more(f", {CHARTS} SELECT report_id, chunk_id, title FROM charts WHERE page = 2 AND type = 'line' ORDER BY report_id, title, chunk_id LIMIT 20 OFFSET 2", e=ELEMENTS_SQL),
    "md_table_dims": over(f"SELECT chunk_id, CAST(len(l) AS INT) AS rows, CAST(len(l[1]) AS INT) AS columns, array_to_string(l[1], ',') AS headers FROM (SELECT chunk_id, {LINES} AS l FROM t)", t=TABLES_SQL),
    "extract_tables": more(f", {TABLES} SELECT report_id, chunk_id, rows, columns, headers, table_no FROM tabs", t=TABLES_SQL),
    "disambiguate_titles": more(f", {TABLES}, {NAMED} SELECT report_id, chunk_id, display FROM named", t=TABLES_SQL),
    "tables_filter": more(f", {TABLES}, {NAMED} SELECT report_id, chunk_id, display FROM named WHERE page = 1 AND rows >= 3 AND columns >= 3", t=TABLES_SQL),
    "clean_caption": over(f"SELECT chunk_id, {CLEAN} AS caption FROM t", t=TABLES_SQL),
    "table_fallback_summary": over("SELECT chunk_id, CASE WHEN len(l) < 3 THEN '' ELSE 'Table with ' || len(list_filter(l[3:], lambda x: contains(x, '|'))) || ' rows showing: ' || array_to_string(list_filter(list_transform(string_split(l[1], '|'), lambda c: trim(c)), lambda c: c <> '')[1:4], ', ') || '.' END AS summary FROM (SELECT chunk_id, string_split(trim(text, chr(10) || ' '), chr(10)) AS l FROM t)", t=TABLES_SQL),
    "table_quality_gate": over(f"SELECT * FROM (SELECT chunk_id, CAST(len(flatten({LINES})) AS INT) AS cells FROM t) WHERE cells >= 6", t=TABLES_SQL),
    "table_structure_check": over(f"SELECT chunk_id, n AS md_rows, abs(3 - n)::DOUBLE / greatest(n, 1) > 0.5 AS severe FROM (SELECT chunk_id, CAST(len({LINES}) AS INT) AS n FROM t)", t=TABLES_SQL),
    "table_preview": more(", d AS (SELECT * FROM c WHERE row_type <> 'header'), r AS (SELECT table_id, row_no, string_agg(CASE WHEN length(text) > 12 THEN left(text, 11) || '…' ELSE text END, '|' ORDER BY col_no) AS line FROM d WHERE col_no < 4 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_no) AS place FROM r), z AS (SELECT table_id, count(DISTINCT row_no) > 4 AS more_rows, max(col_no) >= 4 AS more_cols FROM d GROUP BY 1) SELECT table_id, string_agg(line, ';' ORDER BY place) AS preview, any_value(more_rows) AS more_rows, any_value(more_cols) AS more_cols FROM k JOIN z USING (table_id) WHERE place <= 3 GROUP BY 1", c=CELLS_SQL),
    "table_sum_column": over("SELECT table_id, col_no, CAST(coalesce(sum(coalesce(nullif(normalized, 0), parsed)), 0) AS DECIMAL(20,2)) AS total FROM c WHERE row_type = 'data' GROUP BY ALL", c=CELLS_SQL),
    "table_get_cell": over("SELECT table_id, text FROM c WHERE row_no = 77 AND col_no = 2", c=CELLS_SQL),
    "table_find_column": over("SELECT table_id, min(col_no) AS col_no FROM c WHERE row_type = 'header' AND contains(lower(text), 'no. 5') GROUP BY 1", c=CELLS_SQL),
    "table_entity_row": over("SELECT table_id, min(row_no) AS row_no FROM c WHERE col_no = 0 AND contains(lower(text), 'no. 9') GROUP BY 1", c=CELLS_SQL),
    "chart_series_agg": more(f", {FIRST_POINT} SELECT chart_id, series_id, count(*) AS n, CAST(sum(value) AS DECIMAL(20,2)) AS total, min(value) AS least, max(value) AS most FROM pt GROUP BY ALL", p=POINTS_SQL),
    "chart_total_across_series": more(f", {FIRST_POINT} SELECT chart_id, category, CAST(sum(value) AS DECIMAL(20,2)) AS total, count(*) AS series FROM pt GROUP BY ALL", p=POINTS_SQL),
    "chart_categories": over("SELECT chart_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS points FROM p GROUP BY 1", p=POINTS_SQL),
    "chart_validate": "SELECT p_partkey, concat_ws(',', CASE WHEN p_size / 20::DOUBLE < 0.5 THEN 'low confidence' END, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 = 0 THEN 'no series' END, CASE WHEN p_size % 4 = 0 THEN 'no x label' END, CASE WHEN p_size % 5 = 0 THEN 'no y label' END, CASE WHEN p_size % 2 = 1 THEN 'no unit' END) AS warnings FROM part",
}
