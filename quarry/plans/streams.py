"""Queries on streams of several batches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.frames import duck, frame
from quarry.sources.scratch import shared_folder
from quarry.streaming import answers, ingest

#: Things that happen to answers, a minute for each turn; every fourth answer's second and third are heard in turned order.
ARRIVALS = """
SELECT conv_id AS answer_id, seq, kind, data, score, batch, timestamp_seconds(1700000000 + 60 * batch + conv_id % 50) AS ts FROM (
  SELECT conv_id, turn AS seq, CASE WHEN turn = 0 THEN 'hits' ELSE 'token' END AS kind, CASE WHEN turn > 0 THEN concat('t', CAST(turn AS STRING)) WHEN conv_id % 5 > 0 THEN concat('m', CAST(conv_id AS STRING)) END AS data,
    CASE WHEN turn = 0 THEN CAST(conv_id % 10 AS DOUBLE) / 10 END AS score, CASE WHEN conv_id % 4 = 1 AND turn = 1 THEN 2 WHEN conv_id % 4 = 1 AND turn = 2 THEN 1 ELSE turn END AS batch FROM {conversations}
  UNION ALL SELECT conv_id, max(turn) + 1, CASE WHEN conv_id % 3 = 0 THEN 'end' ELSE 'fail' END, CASE WHEN conv_id % 3 = 1 THEN 'model' END, NULL, max(turn) + 1 FROM {conversations} WHERE conv_id % 3 < 2 GROUP BY conv_id) AS e"""
#: Requests with the batch in which they arrive: every fiftieth twelve days late.
REQUESTS_AT = "SELECT event_id, user_id, ts, CAST(floor((unix_timestamp(ts) - 1704067200) / 86400) AS INT) + CASE WHEN event_id % 50 = 0 THEN 12 ELSE 0 END AS day FROM {events}"


def _batches(spark, rows, folder, by):
    """A file for each batch, written in their order: a few dozen at most."""
    rows = rows.cache()
    for b in sorted(r[by] for r in rows.select(by).distinct().collect()):
        rows.where(F.col(by) == b).drop(by).coalesce(1).write.mode("append").parquet(folder)
    rows.unpersist()


def answer_stream(spark, sf_dir):
    """Events of answers whose things arrive minute by minute, some out of order, some never ended.

    A file has a minute, and from the eighth on twice as many minutes as the one before: files and batches grow with the logarithm
    of the longest answer. Files lie in the order of their minutes, so no thing is late in them.
    """
    base, minute = shared_folder(spark, "answers"), F.col("batch")
    arrivals = frame(spark, sf_dir, ARRIVALS).withColumn("batch", F.when(minute < 8, minute).otherwise(F.length(F.bin(minute)) + 4))
    _batches(spark, arrivals, f"{base}/in", "batch")
    answers.stream_answers(spark, f"{base}/in", f"{base}/out", f"{base}/progress")
    return spark.read.schema(answers.EVENTS).parquet(f"{base}/out")


def _sliding(spark, sf_dir):
    base = shared_folder(spark, "sliding")
    day = F.expr("int(day / 4)")
    _batches(spark, frame(spark, sf_dir, REQUESTS_AT).withColumn("batch", day).drop("day"), f"{base}/in", "batch")
    ingest.stream_sliding(spark, f"{base}/in", "event_id long, user_id long, ts timestamp", f"{base}/out", f"{base}/progress", limit=2)
    return spark.read.parquet(f"{base}/out"), spark.read.parquet(f"{base}/in")


def sliding_rate_limit(spark, sf_dir):
    """Requests of users in closed windows of an hour every quarter, from batches of four days with late requests."""
    found = _sliding(spark, sf_dir)[0]
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "requests", F.col("refused").cast("long").alias("refused"))


def late_requests(spark, sf_dir):
    """Users' requests that came too late for closed windows."""
    return ingest.late_requests(*_sliding(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("windows"), F.sum("late").alias("late"))


QUERIES = {f.__name__: f for f in (answer_stream, sliding_rate_limit, late_requests)}

WINDOWS = """e AS (SELECT event_id, user_id, ts, event_id % 50 = 0 AS late FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM e),
p AS (SELECT user_id, late, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start FROM e, (SELECT unnest(range(0, 4)) AS k)),
c AS (SELECT user_id, start, count(*) AS requests FROM p, m WHERE NOT late AND start + INTERVAL 1 HOUR <= w GROUP BY 1, 2)"""
ORACLE_SQL = {
    "answer_stream": f"""
WITH a AS ({duck(ARRIVALS).replace("timestamp_seconds(", "to_timestamp(")}), n AS (SELECT conv_id AS c, max(turn) + 1 AS n FROM conversations GROUP BY 1), o AS (SELECT c, n, CASE WHEN c % 10 < 3 THEN 1 ELSE 0 END AS low FROM n WHERE c % 5 > 0),
t AS (SELECT answer_id AS c, max(epoch(ts)) + 240 < (SELECT max(epoch(ts)) FROM a) AS timed FROM a GROUP BY 1)
SELECT c AS answer_id, 0 AS place, 'token' AS type, '{answers.NOTHING.replace("'", "''")}' AS data FROM n WHERE c % 5 = 0 UNION ALL SELECT c, 1, 'done', NULL FROM n WHERE c % 5 = 0
UNION ALL SELECT c, 0, 'caveat', '{answers.LOW}' FROM o WHERE low = 1 UNION ALL SELECT c, low, 'citation_map', 'm' || c FROM o
UNION ALL SELECT c, low + turn, 'token', 't' || turn FROM o JOIN conversations ON conv_id = c WHERE turn > 0
UNION ALL SELECT c, low + n, CASE WHEN c % 3 = 0 THEN 'done' ELSE 'error' END, CASE c % 3 WHEN 1 THEN 'model' WHEN 2 THEN 'timeout' END FROM o JOIN t USING (c) WHERE c % 3 < 2 OR timed""",
    "sliding_rate_limit": f"WITH {WINDOWS} SELECT user_id, strftime(start, '%Y-%m-%d %H:%M') AS start, requests, greatest(0, requests - 2) AS refused FROM c",
    "late_requests": f"WITH {WINDOWS}, z AS (SELECT max(start) AS last FROM c), l AS (SELECT user_id, start, count(*) AS late FROM p, z WHERE late AND start <= last GROUP BY 1, 2) SELECT user_id, count(*) AS windows, CAST(sum(late) AS BIGINT) AS late FROM l GROUP BY 1",
}
