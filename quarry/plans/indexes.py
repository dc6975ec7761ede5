"""Queries over indexes of vectors and of payload columns, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.operators import ann, retrieval, segments
from quarry.operators.retrieval import payload_filter
from quarry.plans.frames import LINE_ID, REPORT_NO, duck, frame, spread
from quarry.sources import layout
from quarry.sources.scratch import kept, shared_folder

#: Filter of the vector searches.
LABELS = (1, 3, 5)
#: The eleven payload columns.
FIELDS = ["report_id", "report_year", "parent_chunk_id", "content_type", "page_physical", "finding_type", "severity", "section_type", "amount_paise", "is_recommendation", "recommendation_target"]
PAYLOAD = f"""
SELECT {LINE_ID} AS chunk_id, concat('R', CAST({REPORT_NO} AS STRING)) AS report_id, CAST(2010 + {REPORT_NO} % 13 AS INT) AS report_year,
       concat('R', CAST({REPORT_NO} AS STRING), '_s', CAST(l_linenumber AS STRING)) AS parent_chunk_id,
       CASE WHEN l_suppkey % 3 = 0 THEN 'table_markdown' WHEN l_suppkey % 3 = 1 THEN 'paragraph' ELSE 'list' END AS content_type, CAST(l_partkey % 200 AS INT) AS page_physical,
       CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN 'loss_of_revenue' WHEN 1 THEN 'fraud_misappropriation' WHEN 2 THEN 'non_compliance' WHEN 3 THEN 'wasteful_expenditure' END AS finding_type,
       CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, concat('part ', CAST(l_linenumber AS STRING)) AS section_type,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_paise, l_returnflag = 'R' AS is_recommendation, CASE WHEN l_linestatus = 'O' THEN concat('NODE', CAST(l_suppkey % 17 AS STRING)) END AS recommendation_target
FROM {{lineitem}}"""
#: Columns of lines from which payloads are made.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"]
#: Filters on two columns each, and the same in SQL.
FILTERS = {
    "year_severity": ({"report_year": 2015, "severity": "critical"}, "report_year = 2015 AND severity = 'critical'"),
    "finding_amount": ({"finding_type": "non_compliance", "amount_paise": {"gte": 5_000_000}}, "finding_type = 'non_compliance' AND amount_paise >= 5000000"),
    "kind_page": ({"content_type": "table_markdown", "page_physical": {"gte": 20, "lt": 30}}, "content_type = 'table_markdown' AND page_physical >= 20 AND page_physical < 30"),
    "section_target": ({"section_type": ["part 1", "part 6"], "recommendation_target": "NODE3"}, "section_type IN ('part 1', 'part 6') AND recommendation_target = 'NODE3'"),
    "report_severity": ({"report_id": ["R3", "R5", "R8"], "severity": "low"}, "report_id IN ('R3', 'R5', 'R8') AND severity = 'low'"),
    "parent_flag": ({"parent_chunk_id": "R4_s2", "is_recommendation": True}, "parent_chunk_id = 'R4_s2' AND is_recommendation"),
}


def _vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _index(spark, sf_dir):
    path = kept(spark, "vectors", [f"{sf_dir}/embeddings.parquet"], lambda to: ann.write_index(_vectors(spark, sf_dir), to, ["label"]))
    return ann.read_index(spark, path)


def _asked(spark, sf_dir):
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0")


def _filter():
    return F.col("label").isin(*LABELS)


def ann_filtered_topk(spark, sf_dir):
    """About the ten vectors of some labels most similar to each query, through the index."""
    return ann.topk_of_set(_index(spark, sf_dir), _asked(spark, sf_dir), 10, _filter()).select("query_id", "vec_id", "rank")


def ann_exact_filtered(spark, sf_dir):
    """The same exactly, from the index's rows."""
    return ann.exact_of_set(_index(spark, sf_dir), _asked(spark, sf_dir), 10, _filter()).select("query_id", "vec_id", "rank")


def ann_recall(spark, sf_dir):
    """Queries of the set, their exact neighbours with and without the filter, and whether the index finds nine in ten of them."""
    index, asked = _index(spark, sf_dir), _asked(spark, sf_dir)
    parts = [ann.recall(ann.topk_of_set(index, asked, 10, w), ann.exact_of_set(index, asked, 10, w)).select(F.lit(name).alias("filter"), "*") for name, w in (("none", None), ("labels", _filter()))]
    return parts[0].unionByName(parts[1]).groupBy("filter").agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("reached"))


def ann_rows(spark, sf_dir):
    """Rows of the index by label: all of the table's."""
    return _index(spark, sf_dir).rows.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


def payload_layout(spark, sf_dir):
    """Rows along a curve of the eleven payload columns."""
    made = lambda lines: spark.sql(PAYLOAD, lineitem=lines)
    rows = frame(spark, sf_dir, PAYLOAD.replace("\nFROM", f", {', '.join(LINE)}\nFROM"))
    write = lambda to: layout.write_layout(rows, to, FIELDS, keys=["report_id", "parent_chunk_id"], group_rows=2000, narrow=LINE, make=made)
    return kept(spark, "payload", [f"{sf_dir}/lineitem.parquet"], write)


def layout_filters(spark, sf_dir):
    """Filters on two payload columns each, read from the layout: their rows' number, first and last id and sum."""
    rows = spark.read.parquet(payload_layout(spark, sf_dir))
    found = [rows.where(payload_filter(rows, c)).agg(F.lit(name).alias("filter"), F.count("*").alias("n"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"), F.sum("amount_paise").cast("long").alias("paise")) for name, (c, _) in FILTERS.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


def _changed(spark, sf_dir):
    """A keyword index of most documents, then with the others and changed ones put in and some deleted, in two more segments."""
    base = shared_folder(spark, "keywords")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    segments.create(spread(docs.where("doc_id % 5 <> 4")), "doc_id", base)
    index = segments.open_keywords(spark, base, "doc_id")
    index = segments.upsert(index, docs.where("doc_id % 5 = 4 or doc_id % 7 = 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" union added"))).otherwise(F.col("text"))))
    return segments.upsert(index, docs.where("doc_id % 35 = 0").withColumn("text", F.lit("added twice")), deleted=docs.where("doc_id % 11 = 0"))


CHANGED_WORDS = "the union added twice"


def keyword_incremental(spark, sf_dir):
    """A keyword search after two changes of the index, in three segments."""
    index = _changed(spark, sf_dir)
    return retrieval.sparse_topk(index.postings, index.texts(), "doc_id", CHANGED_WORDS, 50).select("doc_id", "rank")


def keyword_merged(spark, sf_dir):
    """How many texts have each token after the same changes and a merge of the segments."""
    index = segments.merge(_changed(spark, sf_dir))
    return index.postings(["union", "added", "twice", "nosuchtoken"]).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf")).crossJoin(F.broadcast(index.texts()))


QUERIES = {f.__name__: f for f in (ann_filtered_topk, ann_exact_filtered, ann_recall, ann_rows, layout_filters, keyword_incremental, keyword_merged)}

SIM = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12)"
RANKED = f"SELECT q.vec_id AS query_id, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, e.vec_id) AS INT) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"
LIVE = """live AS (SELECT doc_id, CASE WHEN doc_id % 35 = 0 THEN 'added twice' WHEN doc_id % 7 = 0 THEN coalesce(text, '') || ' union added' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0),
m AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS token FROM live) WHERE token IN ('union', 'added', 'twice') GROUP BY ALL), n AS (SELECT count(*) AS n FROM live), d AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM m GROUP BY 1)"""
ORACLE_SQL = {
    "keyword_incremental": f"""WITH {LIVE}, s AS (SELECT doc_id, round(sum(m.tf / (m.tf + 1.2::DOUBLE) * (1::DOUBLE / 2.2::DOUBLE) * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)), 9) AS score FROM m JOIN d USING (token), n GROUP BY 1)
SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 50""",
    "keyword_merged": f"WITH {LIVE} SELECT token, df, tf, n AS texts FROM d, n",
    "ann_exact_filtered": f"{RANKED} WHERE e.label IN {LABELS} QUALIFY rank <= 10",
    "ann_recall": f"WITH a AS ({RANKED} QUALIFY rank <= 10), b AS ({RANKED} WHERE e.label IN {LABELS} QUALIFY rank <= 10) SELECT 'none' AS filter, count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS reached FROM a UNION ALL SELECT 'labels', count(DISTINCT query_id), count(*), true FROM b",
    "ann_rows": "SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1",
    "layout_filters": f"WITH p AS MATERIALIZED ({duck(PAYLOAD)}) " + " UNION ALL ".join(f"SELECT '{name}' AS filter, count(*) AS n, min(chunk_id) AS first_id, max(chunk_id) AS last_id, CAST(sum(amount_paise) AS BIGINT) AS paise FROM p WHERE {sql}" for name, (_, sql) in FILTERS.items()),
}
