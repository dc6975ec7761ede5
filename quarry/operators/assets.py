"""Charts and tables of reports: extraction, titles, look-ups and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import assets as A


def extract_charts(chunks: DataFrame) -> DataFrame:
    """Charts of report chunks (report_id, chunk_id, ord, kind, page, text): numbered titles, each once on its page.

    A report with fewer than three gets those of its image captions that describe charts, the first of each page without one.
    """
    titles = chunks.where(F.col("kind").isin("paragraph", "header") & A.is_visual_title(F.col("text")))
    parts = titles.select("*", *(A.visual_part(F.col("text"), p).alias(f"v_{p}") for p in ("number", "kind", "title")))
    once = F.row_number().over(Window.partitionBy("report_id", "page", "v_number").orderBy("ord", "chunk_id"))
    formal = parts.withColumn("once", once).where("once = 1").select("report_id", "chunk_id", "page", F.concat("v_number", F.lit(": "), "v_title").alias("title"), A.chart_type(F.col("v_title"), F.col("v_kind")).alias("type"))
    pages = formal.groupBy("report_id").agg(F.count("*").alias("n"), F.collect_set("page").alias("pages"))
    captions = chunks.where((F.col("kind") == "image_caption") & A.describes_chart(F.col("text"))).join(pages, "report_id", "left")
    missing = captions.where((F.coalesce("n", F.lit(0)) < 3) & ~F.coalesce(F.array_contains("pages", F.col("page")), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("report_id", "page").orderBy("ord", "chunk_id"))
    fallback = missing.withColumn("first", first).where("first = 1").select("report_id", "chunk_id", "page", A.title_of_caption(F.col("text"), F.col("page") + 1).alias("title"), A.chart_type(F.col("text"), F.lit("caption")).alias("type"))
    return formal.unionByName(fallback)


def extract_tables(chunks: DataFrame) -> DataFrame:
    """Tables of markdown chunks with at least 30 characters, two rows (the header counts) and a column; numbered in order."""
    lines = chunks.where((F.col("kind") == "table_markdown") & (F.length("text") >= 30)).withColumn("lines", A.table_lines(F.col("text")))
    sized = lines.withColumn("rows", F.size("lines")).where(F.col("rows") >= 2).withColumn("columns", F.size(F.get("lines", 0)))
    nth = F.row_number().over(Window.partitionBy("report_id").orderBy("ord", "chunk_id"))
    headers = F.array_join(F.slice(F.transform(F.get("lines", 0), lambda h: F.left(h, F.lit(50))), 1, 10), ",")
    return sized.withColumn("headers", headers).withColumn("table_no", nth).drop("lines")


def disambiguate(tables: DataFrame) -> DataFrame:
    """report_id, chunk_id and display: a title that tells a table from others of its report with the same caption.

    That is the caption if it is the only one; else the structured title if it says something else than the caption and
    no other has it; else, for the first of a page, the page; else, for the first left of a size, rows and columns; else
    a number among those that are left. Tables come in the order of ``ord``; a page, row or column number that is null or
    0 tells nothing.
    """
    order = ["ord", "chunk_id"]
    among = lambda *more: Window.partitionBy("report_id", "caption", *more)
    first = lambda *more: F.row_number().over(among(*more).orderBy(*order)) == 1
    known = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    named = tables.select("report_id", "chunk_id", "ord", "page", "rows", "columns", F.coalesce("struct_title", F.lit("")).alias("own"), A.clean_caption(F.col("title")).alias("caption"))
    counted = named.withColumn("same", F.count("*").over(among())).withColumn("same_own", F.count("*").over(among("own")))
    ways = counted.withColumn("way", F.when(F.col("same") == 1, 0).when((F.col("own") != "") & (F.col("own") != F.col("caption")) & (F.col("same_own") == 1), 1))
    for number, columns in ((2, ["page"]), (3, ["rows", "columns"])):
        fits = F.col("way").isNull() & first("way", *columns)
        for c in columns:
            fits = fits & known(c)
        ways = ways.withColumn("fits", fits).withColumn("way", F.when(F.col("fits"), number).otherwise(F.col("way")))
    nth = F.row_number().over(among("way").orderBy(*order))
    told = (
        F.when(F.col("way") == 2, F.concat(F.lit("Page "), F.col("page").cast("string"))).when(F.col("way") == 3, F.concat(F.col("rows").cast("string"), F.lit("×"), F.col("columns").cast("string"))).otherwise(nth.cast("string"))
    )
    display = F.when(F.col("way") == 0, F.col("caption")).when(F.col("way") == 1, A.clean_caption(F.col("own"))).otherwise(F.concat("caption", F.lit(" ("), F.col("told"), F.lit(")")))
    return ways.withColumn("told", told).select("report_id", "chunk_id", display.alias("display"))


def stitch(parts: DataFrame, least: float = 0.8) -> DataFrame:
    """Tables that go on over pages: report_id, table_no, its first chunk, pages and rows, of parts (report_id, ord, chunk_id, page, caption, headers, rows).

    A part goes on the one before it if it stands on the next page and has more than ``least`` of both one's headers, or
    says that it is continued.
    """
    order = Window.partitionBy("report_id").orderBy("ord", "chunk_id")
    before = parts.withColumn("b", F.lag(F.struct("page", "headers")).over(order))
    alike = F.size(F.array_intersect("headers", "b.headers")) / F.greatest(F.size(F.array_union("headers", "b.headers")), F.lit(1)) > least
    goes_on = (F.col("page") == F.col("b.page") + 1) & (alike | F.lower("caption").rlike(r"\bcont(d|inued)\b"))
    numbered = before.withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("table_no", F.sum("starts").over(order))
    return numbered.groupBy("report_id", "table_no").agg(
        F.min_by("chunk_id", F.struct("ord", "chunk_id")).alias("chunk_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "page"))), lambda x: x["page"].cast("string")), ",").alias("pages"), F.sum("rows").alias("rows")
    )


def preview(cells: DataFrame, max_rows: int = 3, max_cols: int = 4) -> DataFrame:
    """First data rows and columns of each table (table_id, row_no, col_no, text), cells cut, ';' between rows and '|' between cells."""
    rows = cells.where(F.col("col_no") < max_cols).groupBy("table_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", A.cut(F.col("text")).alias("t")))), lambda x: x["t"]), "|").alias("line"))
    place = F.row_number().over(Window.partitionBy("table_id").orderBy("row_no"))
    first = rows.withColumn("place", place).where(F.col("place") <= max_rows)
    shown = first.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), ";").alias("preview"))
    size = cells.groupBy("table_id").agg((F.count_distinct("row_no") > max_rows + 1).alias("more_rows"), (F.max("col_no") >= max_cols).alias("more_cols"))
    return shown.join(size, "table_id")


def sum_columns(cells: DataFrame) -> DataFrame:
    """Sum of each column's data cells: the normalised value, or the parsed one where that is missing or 0."""
    value = F.coalesce(F.nullif("normalized", F.lit(0).cast("decimal(14,2)")), F.col("parsed"))
    return cells.where(F.col("row_type") == "data").groupBy("table_id", "col_no").agg(F.coalesce(F.sum(value), F.lit(0)).cast("decimal(20,2)").alias("total"))


def series_aggregates(points: DataFrame) -> DataFrame:
    """Count, sum, mean in hundredths and range of each series' first point per category, whatever the category's case."""
    first = points.groupBy("chart_id", "series_id", F.lower("category").alias("category")).agg(F.min_by("value", "ord").alias("value"))
    return first.groupBy("chart_id", "series_id").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(20,2)").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def totals_across_series(points: DataFrame) -> DataFrame:
    """Sum over a chart's series for each category, and their number."""
    first = points.groupBy("chart_id", "series_id", F.lower("category").alias("category")).agg(F.min_by("value", "ord").alias("value"))
    return first.groupBy("chart_id", "category").agg(F.sum("value").cast("decimal(20,2)").alias("total"), F.count("*").alias("series"))
