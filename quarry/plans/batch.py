"""Queries on sources, streams and documented steps, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import reports as R
from quarry.operators import assets, catalog
from quarry.plans.frames import FINDINGS, PASSAGES, REPORTS, frame, over
from quarry.plans import listing
from quarry.plans.assets import TABLES_SQL
from quarry.plans.listing import _title_sql, more
from quarry.sources import files
from quarry.sources.scratch import shared_folder
from quarry.streaming import ingest

SUMMARIES = "SELECT concat('R', CAST(CAST(floor(o_orderkey / 12) AS BIGINT) AS STRING)) AS report_id, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'executive' WHEN 1 THEN 'simple' ELSE 'policy' END AS variant, max(CASE WHEN o_custkey % 7 > 4 THEN o_orderpriority END) AS content, CAST(max(o_custkey % 900) AS INT) AS word_count FROM {orders} GROUP BY 1, 2"
REQUESTS = "SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN concat(' 10.0.0.', CAST(user_id AS STRING), ', 10.1.1.1') ELSE '' END AS forwarded, concat('192.168.0.', CAST(user_id AS STRING)) AS peer FROM {events}"


def rate_limit_window(spark, sf_dir):
    return ingest.requests_per_hour(spark.read.parquet(f"{sf_dir}/events.parquet"), limit=2).select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "requests", F.col("refused").cast("long").alias("refused"))


def client_ip(spark, sf_dir):
    return frame(spark, sf_dir, REQUESTS).select("event_id", ingest.client_of(F.col("forwarded"), F.col("peer")).alias("client"))


def _frames(spark, sf_dir):
    t = F.col("turn")
    token = F.concat(F.lit('en", "data": "t'), t.cast("string"), F.lit('"}\n\n'))
    text = F.when(t == 0, F.lit('data: {"type": "citation_map", "data": "m"}\n\ndata: {"type": "tok')).when(t == 1, token).otherwise(F.concat(F.lit('data: {"type": "tok'), token))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.alias("text"))


def sse_parse(spark, sf_dir):
    return ingest.parse_events(_frames(spark, sf_dir), "conv_id", "turn")


def token_fold(spark, sf_dir):
    return ingest.fold_tokens(ingest.parse_events(_frames(spark, sf_dir), "conv_id", "turn"), "conv_id")


def summaries_list(spark, sf_dir):
    return files.summary_list(frame(spark, sf_dir, SUMMARIES))


def custom_id(spark, sf_dir):
    return frame(spark, sf_dir, REPORTS).select("report_id", files.custom_id("exec", F.concat("report_id", F.lit("_"), "ministry", F.lit("_audit_of_the_year"))).alias("custom_id"))


def triage(spark, sf_dir):
    """Native texts: one of the first three pages (here lines) has 50 characters or more."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.slice(F.split("text", "\n"), 1, 3).alias("l"))
    return lines.select("doc_id", F.exists("l", lambda x: F.length(x) >= 50).alias("native"))


def money_normalize(spark, sf_dir):
    """Amounts of any unit in paise."""
    f = frame(spark, sf_dir, FINDINGS)
    unit = F.when(F.col("page") % 3 == 0, "lakh").when(F.col("page") % 3 == 1, "crore").otherwise("rupee")
    factor = F.when(unit == "lakh", 10_000_000).when(unit == "crore", 1_000_000_000).otherwise(100).cast("decimal(10,0)")
    # decimals: longs do not hold the sum over a large table
    paise = F.floor(F.coalesce("amount_paise", F.lit(0)) / 1_000_000).cast("decimal(19,0)") * factor
    return f.groupBy(unit.alias("unit")).agg(F.sum(paise).cast("string").alias("paise"))


def temporal_refs(spark, sf_dir):
    """First and last year that titles name."""
    r = frame(spark, sf_dir, REPORTS).select("report_id", F.regexp_extract_all("title", F.lit(r"\b(20\d{2})"), 1).alias("y"))
    return r.where(F.size("y") > 0).select("report_id", F.array_min("y").alias("first"), F.array_max("y").alias("last"), F.size("y").alias("n"))


def toc_tiers(spark, sf_dir):
    """How well a title of the contents list fits the text's: by edit distance, in three tiers."""
    r = frame(spark, sf_dir, REPORTS).select("report_id", "title", R.sanitize_title(F.col("title")).alias("clean"))
    fit = F.floor(100 - F.levenshtein("title", "clean") * 100 / F.greatest(F.length("title"), F.length("clean")))
    return r.select("report_id", F.when(fit >= 70, "accept").when(fit >= 40, "review").otherwise("reject").alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


def retrieval_params(spark, sf_dir):
    """Kinds of the questions on reports, how many there are, and how each is searched and answered."""
    rows = [(k, *v, R.STYLES[k]) for k, v in R.RETRIEVAL_PARAMS.items()]
    kinds = F.broadcast(spark.createDataFrame(rows, "kind string, top_k int, candidates int, chars int, style string"))  # six rows
    return listing.question_type(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("questions")).join(kinds, "kind")


def stream_ingest(spark, sf_dir):
    """Events put into a table by user through a file stream of several batches; the last event of each user stays."""
    base, schema = shared_folder(spark, "stream"), "user_id long, event_type string, seq long"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.col("event_id").alias("seq"))
    events.repartition(3).write.parquet(f"{base}/in")
    ingest.index_stream(spark, f"{base}/in", schema, f"{base}/table", f"{base}/progress", "user_id", buckets=8, files_a_batch=1)
    return ingest.read_indexed(spark, f"{base}/table", schema)


def batch_results(spark, sf_dir):
    """Results of a batch, written as JSON lines and read again: texts, thinking and errors."""
    path = f"{shared_folder(spark, 'batch')}/results"
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), (text if kind == "text" else F.lit(None).cast("string")).alias("text"), (text if kind == "thinking" else F.lit(None).cast("string")).alias("thinking"))
    r = _outcomes(spark, sf_dir)
    said = F.when(F.col("ord") % 3 == 0, F.array(part("thinking", F.lit("hm")), part("text", F.col("title")))).otherwise(F.array(part("text", F.col("title"))))
    result = F.when(F.col("failed"), F.struct(F.lit("errored").alias("type"), F.lit(None).cast(MESSAGE).alias("message"), F.struct(F.lit("too long").alias("message")).alias("error"))).otherwise(
        F.struct(F.lit("succeeded").alias("type"), F.struct(said.alias("content")).alias("message"), F.lit(None).cast("struct<message:string>").alias("error")))
    r.select(F.to_json(F.struct(F.col("report_id").alias("custom_id"), result.alias("result"))).alias("value")).write.text(path)
    jobs = r.where("ord % 2 = 0").select(F.col("report_id").alias("custom_id"), F.concat(F.lit("A"), F.col("ord").cast("string")).alias("report_id"), F.lit("simple").alias("variant"))
    return files.batch_results(spark, path, jobs)


MESSAGE = "struct<content:array<struct<type:string,text:string,thinking:string>>>"


def _outcomes(spark, sf_dir):
    return frame(spark, sf_dir, REPORTS).select("report_id", "ord", "title", (F.col("ord") % 10 == 3).alias("failed"))


def job_status(spark, sf_dir):
    """Users' jobs: a batch for each type of event, which its latest event ends or not."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_id") % 5 > 0, "ended").otherwise("in_progress")
    return catalog.job_status(e.select(F.col("user_id").alias("job"), F.col("event_type").alias("batch"), F.col("event_id").alias("seq"), status.alias("status")))


def cost_estimates(spark, sf_dir):
    """Tokens, at four characters each, and costs of summarising the tables of each report."""
    t = frame(spark, sf_dir, TABLES_SQL)
    return catalog.costs(t.select("report_id", F.floor(F.length("text") / 4).alias("tokens")), "report_id")


def xref_resolve(spark, sf_dir):
    """Where the sections that passages name are: the least chunk of each numbered section of a report."""
    p = frame(spark, sf_dir, PASSAGES, wide=True)
    number = F.regexp_extract("text", r"\[Section (\d+\.\d)", 1)
    targets = p.where("page < 4").select("report_id", F.lit("section").alias("kind"), number.alias("number"), F.col("passage_id").alias("chunk_id"))
    found = catalog.resolve_references(p.withColumnRenamed("passage_id", "chunk_id"), targets)
    return found.groupBy("report_id", "kind", "number").agg(F.count("*").alias("refs"), F.min("target_id").alias("target_id"))


def footnote_index(spark, sf_dir):
    return catalog.footnotes(frame(spark, sf_dir, NOTES_SQL))


NOTES_SQL = "SELECT concat('R', CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING)) AS report_id, concat('n', CAST(p_partkey AS STRING)) AS chunk_id, p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN concat(CAST(p_size % 12 AS STRING), '. ', p_name) ELSE concat(' [', CAST(p_size % 12 AS STRING), '] See ', p_brand) END AS text FROM {part}"
PARTS_SQL = "SELECT concat('R', CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING)) AS report_id, p_partkey AS ord, concat('t', CAST(p_partkey AS STRING)) AS chunk_id, CAST(p_partkey % 20 + CASE WHEN p_size % 9 = 0 THEN 1 ELSE 0 END AS INT) AS page, CASE WHEN p_size % 4 = 0 THEN 'Dues (contd.)' ELSE 'Dues' END AS caption, concat('Year,Budget,Total,', CASE WHEN p_size % 3 = 0 THEN 'Spent' ELSE 'Actual' END) AS heads, CAST(p_size AS INT) AS rows FROM {part}"


def stitch_tables(spark, sf_dir):
    parts = frame(spark, sf_dir, PARTS_SQL).withColumn("headers", F.split("heads", ","))
    return assets.stitch(parts).select("report_id", "chunk_id", "pages", F.col("table_no").cast("long").alias("table_no"), "rows")


QUERIES = {f.__name__: f for f in (rate_limit_window, client_ip, sse_parse, token_fold, summaries_list, custom_id, triage, money_normalize, temporal_refs, toc_tiers, retrieval_params, stream_ingest, batch_results, job_status, cost_estimates, xref_resolve, footnote_index, stitch_tables)}
PARAM_ROWS = ", ".join(f"('{k}', {a}, {b}, {c}, '{R.STYLES[k]}')" for k, (a, b, c) in R.RETRIEVAL_PARAMS.items())
VARIANT_ROWS = ", ".join(f"({i}, '{v}')" for i, v in enumerate(files.VARIANTS))
ORACLE_SQL = {
    "rate_limit_window": "SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS requests, greatest(0, count(*) - 2) AS refused FROM events GROUP BY 1, 2",
    "client_ip": over("SELECT event_id, coalesce(nullif(trim(string_split(forwarded, ',')[1]), ''), peer) AS client FROM r", r=REQUESTS),
    "sse_parse": "WITH e AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, CAST(turn AS INT) AS place, CASE WHEN turn = 0 THEN 'citation_map' ELSE 'token' END AS type, CASE WHEN turn = 0 THEN 'm' ELSE 't' || turn END AS data FROM e",
    "token_fold": "SELECT conv_id, string_agg('t' || turn, '' ORDER BY turn) AS message FROM conversations WHERE turn > 0 GROUP BY 1",
    "summaries_list": more(f", w AS (SELECT DISTINCT report_id, place, variant FROM s, (VALUES {VARIANT_ROWS}) v(place, variant)) SELECT report_id, place, variant, word_count IS NOT NULL AS available, coalesce(word_count, 0) AS word_count FROM (SELECT report_id, place, w.variant, h.word_count FROM (SELECT r.report_id, v.place, v.variant FROM (SELECT DISTINCT report_id FROM s) r, (VALUES {VARIANT_ROWS}) v(place, variant)) w LEFT JOIN (SELECT * FROM s WHERE content IS NOT NULL) h USING (report_id, variant))", s=SUMMARIES),
    "custom_id": over("SELECT report_id, 'sm_exec_' || left(md5(report_id || '_' || ministry || '_audit_of_the_year'), 8) || '_' || left(report_id || '_' || ministry || '_audit_of_the_year', 47) AS custom_id FROM r", r=REPORTS),
    "triage": "SELECT doc_id, len(list_filter(string_split(text, chr(10))[1:3], lambda x: length(x) >= 50)) > 0 AS native FROM documents",
    "money_normalize": over("SELECT CASE page % 3 WHEN 0 THEN 'lakh' WHEN 1 THEN 'crore' ELSE 'rupee' END AS unit, CAST(sum(coalesce(amount_paise, 0) // 1000000 * CASE page % 3 WHEN 0 THEN 10000000 WHEN 1 THEN 1000000000 ELSE 100 END) AS STRING) AS paise FROM f GROUP BY 1", f=FINDINGS),
    "temporal_refs": over("SELECT report_id, list_min(y) AS first, list_max(y) AS last, CAST(len(y) AS INT) AS n FROM (SELECT report_id, regexp_extract_all(title, '\\b(20\\d{2})', 1) AS y FROM r) WHERE len(y) > 0", r=REPORTS),
    "toc_tiers": more(f", k AS ({_title_sql()}), j AS (SELECT floor(100 - levenshtein(r.title, k.title) * 100 / greatest(length(r.title), length(k.title))::DOUBLE) AS fit FROM r JOIN k USING (report_id)) SELECT CASE WHEN fit >= 70 THEN 'accept' WHEN fit >= 40 THEN 'review' ELSE 'reject' END AS tier, count(*) AS n FROM j GROUP BY 1", r=REPORTS),
    "retrieval_params": f"SELECT kind, questions, top_k, candidates, chars, style FROM (SELECT kind, count(*) AS questions FROM ({listing.ORACLE_SQL['question_type']}) GROUP BY 1) JOIN (VALUES {PARAM_ROWS}) t(kind, top_k, candidates, chars, style) USING (kind)",
    "batch_results": over("SELECT CASE WHEN ord % 2 = 0 THEN 'A' || ord ELSE report_id END AS report_id, CASE WHEN ord % 2 = 0 THEN 'simple' END AS variant, CASE WHEN ord % 10 <> 3 THEN title END AS content, CASE WHEN ord % 10 <> 3 THEN CAST(len(regexp_split_to_array(trim(title), '\\s+')) AS INT) END AS word_count, ord % 10 <> 3 AND ord % 3 = 0 AS thinking_used, CASE WHEN ord % 10 = 3 THEN 'too long' END AS error FROM r", r=REPORTS),
    "job_status": "WITH l AS (SELECT user_id AS job, event_type, max_by(event_id % 5 > 0, event_id) AS ended FROM events GROUP BY 1, 2) SELECT job, count(*) AS batches, count(*) FILTER (WHERE ended) AS ended, CASE WHEN bool_and(ended) THEN 'ready_for_processing' ELSE 'in_progress' END AS status FROM l GROUP BY 1",
    "cost_estimates": over("SELECT report_id, count(*) AS tables, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, CAST(sum(length(text) // 4) * 150 AS BIGINT) AS nano_usd FROM t GROUP BY 1", t=TABLES_SQL),
    "xref_resolve": more(", x AS (SELECT report_id, passage_id, page, regexp_extract(text, '\\[Section (\\d+\\.\\d)', 1) AS own, list_distinct(regexp_extract_all(lower(text), '\\b(?:para|table|section)\\s+\\d+(?:\\.\\d+)*')) AS refs FROM p), u AS (SELECT report_id, passage_id, unnest(refs) AS ref FROM x), n AS (SELECT report_id, regexp_extract(ref, '^\\w+') AS kind, regexp_extract(ref, '[0-9.]+$') AS number FROM u), g AS (SELECT report_id, own AS number, min(passage_id) AS target_id FROM x WHERE page < 4 GROUP BY 1, 2) SELECT n.report_id, n.kind, n.number, count(*) AS refs, any_value(target_id) AS target_id FROM n LEFT JOIN g ON n.kind = 'section' AND n.report_id = g.report_id AND n.number = g.number GROUP BY 1, 2, 3", p=PASSAGES),
    "footnote_index": more(", k AS (SELECT report_id, chunk_id, ord, CAST(nullif(regexp_extract(text, '^\\s*\\[?(\\d{1,4})[\\].):]?\\s+', 1), '') AS INT) AS number, regexp_replace(text, '^\\s*\\[?\\d{1,4}[\\].):]?\\s+', '') AS note FROM n) SELECT report_id, number, chunk_id, note AS text FROM k WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id, number ORDER BY ord, chunk_id) = 1", n=NOTES_SQL),
    "stitch_tables": more(", k AS (SELECT *, lag(page) OVER w AS p0, lag(heads) OVER w AS h0 FROM t WINDOW w AS (PARTITION BY report_id ORDER BY ord)), l AS (SELECT *, CASE WHEN page = p0 + 1 AND (heads = h0 OR contains(caption, 'contd')) THEN 0 ELSE 1 END AS starts FROM k), m AS (SELECT *, sum(starts) OVER (PARTITION BY report_id ORDER BY ord) AS table_no FROM l) SELECT report_id, CAST(table_no AS BIGINT) AS table_no, arg_min(chunk_id, ord) AS chunk_id, string_agg(page, ',' ORDER BY ord) AS pages, CAST(sum(rows) AS BIGINT) AS rows FROM m GROUP BY 1, 2", t=PARTS_SQL),
    "stream_ingest": "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY 1",
}
