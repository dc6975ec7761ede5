"""Report-shaped tables over the driver's tables: SQL that Spark and DuckDB read alike.

The driver's tables have no report texts, so titles, chunks, findings and answers are put together from their keys and
amounts. Doubles become decimals before they become text, since engines print doubles differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Name of a line: its keys and price, as two lines of an order may share all keys.
LINE_ID = "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING))"
#: Forty orders are a report of some 160 chunks, so reports grow in number with the data, not in size.
REPORT_NO = "CAST(floor(l_orderkey / 40) AS BIGINT)"
CHUNK_ID = f"concat('R', CAST({REPORT_NO} AS STRING), '_child_p', lpad(CAST(l_linenumber AS STRING), 3, '0'), '_', CASE WHEN l_suppkey % 3 = 0 THEN 'table_markdown' ELSE 'paragraph' END, '_', lpad(CAST(l_partkey % 60 AS STRING), 4, '0'))"

REPORTS = """
SELECT concat('R', CAST(o_orderkey AS STRING)) AS report_id, o_orderkey AS ord,
       CASE CAST(o_orderkey % 8 AS INT)
         WHEN 0 THEN concat('Report No. ', CAST(o_orderkey % 40 + 1 AS STRING), ' of ', CAST(2014 + o_orderkey % 10 AS STRING), ' - Union Government Compliance Audit on Direct Taxes for period ', CAST(2010 + o_orderkey % 13 AS STRING), '-', CAST(11 + o_orderkey % 13 AS STRING))
         WHEN 1 THEN concat('Accounts of the Union Government Financial Audit for the year ended March ', CAST(2010 + o_orderkey % 13 AS STRING))
         WHEN 2 THEN concat('Fiscal Responsibility and Budget Management Act period ', CAST(2010 + o_orderkey % 13 AS STRING))
         WHEN 3 THEN concat('Performance Audit on Direct Taxes year ', CAST(2010 + o_orderkey % 13 AS STRING))
         WHEN 4 THEN concat('FRBM Compliance for the year ', CAST(2010 + o_orderkey % 13 AS STRING), '-', CAST(2011 + o_orderkey % 13 AS STRING))
         WHEN 5 THEN 'Performance Audit of Toll Operations (Performance Audit-Commercial)'
         WHEN 6 THEN concat('Report of the Comptroller and Auditor General of India on Railways Union Government (Railways) No. ', CAST(o_orderkey % 30 AS STRING), ' of 2022')
         ELSE concat('Audit Report No. ', CAST(o_orderkey % 30 AS STRING), ' of 2021, CAG''s review of ports') END AS title,
       concat(CAST(2014 + o_orderkey % 10 AS STRING), '_', CAST(o_orderkey % 40 AS STRING), '_Audit_', CAST(2010 + o_orderkey % 13 AS STRING), CAST(11 + o_orderkey % 13 + CAST(o_orderkey % 3 AS INT) % 2 AS STRING), '_final.pdf') AS filename,
       CASE WHEN o_orderkey % 5 = 0 THEN 'undated' ELSE concat('No. ', CAST(o_orderkey % 40 AS STRING), ' of ', CAST(2014 + o_orderkey % 10 AS STRING)) END AS report_no,
       o_orderpriority AS sector, n_name AS ministry, CAST(2014 + o_orderkey % 10 AS INT) AS year,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS audit_type,
       CAST(o_totalprice AS DECIMAL(14,2)) AS amount
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

FINDINGS = f"""
SELECT concat('R', CAST(l_orderkey AS STRING)) AS report_id,
       {LINE_ID} AS finding_id,
       concat('R', CAST(l_orderkey AS STRING), '_c', CAST(l_linenumber AS STRING)) AS source_chunk_id,
       l_partkey * 100 + l_suppkey AS ord,
       CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN 'loss_of_revenue' WHEN 1 THEN 'fraud_misappropriation' WHEN 2 THEN 'non_compliance' WHEN 3 THEN 'wasteful_expenditure' ELSE 'system_deficiency' END AS finding_type,
       CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 13 = 0 THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * 10000 END AS amount_paise,
       CASE WHEN l_linenumber = 7 THEN 'Executive Summary' ELSE concat('Chapter ', CAST(l_linenumber AS STRING), ' Receipts') END AS chapter,
       CAST(l_suppkey % 50 AS INT) AS page, CAST(l_discount AS DECIMAL(6,2)) * 10 AS confidence,
       l_returnflag = 'R' AS is_recommendation,
       CASE WHEN l_linestatus = 'O' THEN concat('NODE', CAST(l_suppkey % 17 AS STRING)) END AS target
FROM {{lineitem}}"""

CHUNKS = f"""
SELECT concat('R', CAST({REPORT_NO} AS STRING)) AS report_id, {CHUNK_ID} AS chunk_id,
       concat('R', CAST({REPORT_NO} AS STRING), '_s', CASE WHEN min(l_suppkey) % 9 = 0 THEN '9' ELSE CAST(l_linenumber % 4 AS STRING) END) AS parent_id,
       CAST(l_linenumber AS INT) AS page
FROM {{lineitem}} GROUP BY 1, 2, l_linenumber, {REPORT_NO}"""

SECTIONS = f"""
SELECT DISTINCT concat('R', CAST({REPORT_NO} AS STRING)) AS report_id,
       concat('R', CAST({REPORT_NO} AS STRING), '_s', CAST(l_linenumber % 4 AS STRING)) AS section_id,
       concat('Section ', CAST(l_linenumber % 4 AS STRING)) AS toc_entry,
       concat('Part ', CAST({REPORT_NO} % 3 AS STRING), ' > Section ', CAST(l_linenumber % 4 AS STRING)) AS hierarchy_path,
       CAST(l_linenumber % 4 AS INT) AS page_start, CAST(l_linenumber % 4 + 4 - 5 * CAST({REPORT_NO} % 5 = 0 AS INT) AS INT) AS page_end, CAST(l_linenumber % 4 AS INT) AS toc_level
FROM {{lineitem}}"""

PASSAGES = f"""
SELECT {LINE_ID} AS passage_id, concat('R', CAST({REPORT_NO} AS STRING)) AS report_id, CAST(2010 + l_orderkey % 13 AS INT) AS year,
       concat('R', CAST({REPORT_NO} AS STRING), '_s', CAST(l_linenumber % 4 AS STRING)) AS parent_id, CAST(l_linenumber AS INT) AS page,
       concat('Under Section ', CAST(l_linenumber + 140 AS STRING), CASE WHEN l_suppkey % 2 = 0 THEN concat('(', CAST(l_suppkey % 9 AS STRING), ')') ELSE '' END,
              ' and Rule ', CAST(l_partkey % 90 AS STRING), 'B of the Act, Form ', CAST(l_partkey % 30 AS STRING), 'AS was not filed; Article ', CAST(l_suppkey AS STRING),
              ' applies. The GST department noticed a short levy of Rs. ', CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN ' crore' ELSE ' lakh' END,
              ' in ', CAST(CAST(l_quantity AS INT) AS STRING), ' cases during 20', CAST(10 + l_orderkey % 13 AS STRING), '-', CAST(11 + l_orderkey % 13 AS STRING), ', or ', CAST(CAST(l_tax AS DECIMAL(6,2)) * 100 AS STRING), ' per cent of the total, against ',
              CAST(l_partkey % 70 AS STRING), '% before [Section ', CAST(l_linenumber AS STRING), '.', CAST(l_suppkey % 5 AS STRING), ', p.', CAST(l_suppkey % 60 AS STRING), ']') AS text
FROM {{lineitem}}"""


def tables_of(sql: str) -> list[str]:
    """Driver tables that SQL with {placeholders} names."""
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt to all of them: a scan can't split a file's row groups.

    For queries whose expressions take long; tables of many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def frame(spark: SparkSession, sf_dir: str, sql: str, wide: bool = False) -> DataFrame:
    """SQL with {table} placeholders over the data folder, its tables ``spread`` if ``wide``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)}
    return spark.sql(sql, **{t: spread(df) if wide else df for t, df in tables.items()})


def duck(sql: str) -> str:
    """The same SQL over tables registered by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def over(body: str, **frames: str) -> str:
    """DuckDB SQL of a query's body over named frames."""
    return "WITH " + ", ".join(f"{name} AS ({duck(sql)})" for name, sql in frames.items()) + "\n" + body
