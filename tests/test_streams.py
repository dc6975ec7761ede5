"""Streams over several batches: order, repeats, failures, timeouts and late rows."""

import datetime as dt

import compare
import duckdb
from pyspark.sql import functions as F

from quarry.plans import streams
from quarry.streaming import answers, ingest

BEGIN = dt.datetime(2024, 1, 1)


def things(spark, folder, batches):
    for rows in batches:
        made = [(a, s, k, d, v, BEGIN + dt.timedelta(seconds=t)) for a, s, k, d, v, t in rows]
        spark.createDataFrame(made, answers.INPUT).coalesce(1).write.mode("append").parquet(folder)


def told(spark, base):
    answers.stream_answers(spark, f"{base}/in", f"{base}/out", f"{base}/progress")
    out = {}
    for r in spark.read.schema(answers.EVENTS).parquet(f"{base}/out").orderBy("answer_id", "place").collect():
        out.setdefault(r["answer_id"], []).append((r["place"], r["type"], r["data"]))
    return out


def test_answers(spark, tmp_path):
    base = f"file://{tmp_path}"
    things(spark, f"{base}/in", [
        [(1, 2, "token", "b", None, 1), (1, 2, "token", "again", None, 1), (2, 0, "hits", None, None, 1), (3, 0, "hits", "{}", 0.1, 1), (None, 0, "token", "x", None, 1), (4, 1, "token", "only", None, 1)],
        [(1, 0, "hits", '{"k": 1}', 0.9, 30), (2, 1, "token", "after the end", None, 30), (3, 1, "fail", "model", None, 31)],
        [(1, 3, "end", None, None, 40), (1, 1, "token", "a", None, 41), (3, 2, "token", "no more", None, 42), (5, 0, "hits", "{}", None, 43)],
    ])
    got = told(spark, base)
    assert got[1] == [(0, "citation_map", '{"k": 1}'), (1, "token", "a"), (2, "token", "b"), (3, "done", None)]
    assert got[2] == [(0, "token", answers.NOTHING), (1, "done", None)]
    assert got[3] == [(0, "caveat", answers.LOW), (1, "citation_map", "{}"), (2, "error", "model")]
    assert got[5] == [(0, "caveat", answers.LOW), (1, "citation_map", "{}")] and 4 not in got
    # the same stream goes on: what heard nothing for three minutes is over
    things(spark, f"{base}/in", [[(6, 0, "hits", "{}", 0.9, 600)]])
    got = told(spark, base)
    assert got[4] == [(0, "error", "timeout")] and got[5][-1] == (2, "error", "timeout") and got[6] == [(0, "citation_map", "{}")] and len(got[1]) == 4


def test_many_answers_share_a_state(spark, tmp_path):
    """Answers of a group end, wait and time out each by itself, and states are no more than groups."""
    base, n = f"file://{tmp_path}", 3 * answers.GROUPS
    things(spark, f"{base}/in", [
        [(a, 0, "hits", "{}", 0.9, 1) for a in range(n)] + [(a, 2, "token", "c", None, 1) for a in range(0, n, 2)],
        [(a, 1, "token", "b", None, 400) for a in range(0, n, 2)] + [(1, 1, "end", None, None, 400)],
        [(0, 3, "end", None, None, 401), (n, 0, "hits", None, None, 401)],
    ])
    got = told(spark, base)
    assert len(got) == n + 1 and got[n][-1] == (1, "done", None) and got[1] == [(0, "citation_map", "{}"), (1, "done", None)]
    assert got[0] == [(0, "citation_map", "{}"), (1, "token", "b"), (2, "token", "c"), (3, "done", None)]
    assert all(got[a] == got[0][:3] for a in range(2, n, 2)) and all(got[a] == [(0, "citation_map", "{}"), (1, "error", "timeout")] for a in range(3, n, 2))
    assert 0 < spark.read.format("statestore").load(f"{base}/progress").count() <= answers.GROUPS


def test_long_answers_make_few_batches(spark, tmp_path, monkeypatch):
    """One answer of 300 minutes beside short ones: the same as by the SQL, in a dozen batches."""
    turns = [(c, t, "user", "x") for c in range(1, 24) for t in range(300 if c == 3 else 70 if c == 13 else c % 6 + 1)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"file://{tmp_path}/sf/conversations.parquet")
    monkeypatch.setattr(streams, "shared_folder", lambda spark, what: f"file://{tmp_path}/{what}")
    got = streams.answer_stream(spark, f"file://{tmp_path}/sf").toPandas()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/sf/conversations.parquet/*.parquet')")
    assert compare.rows(got) == compare.rows(con.sql(streams.ORACLE_SQL["answer_stream"]).df())
    assert len(list((tmp_path / "answers/in").glob("*.parquet"))) <= 14 and len(list((tmp_path / "answers/progress/commits").glob("[0-9]*"))) <= 16


def test_frames_read_back(spark):
    rows = spark.createDataFrame([(1, 0, "token", 'a "quoted"\nline'), (1, 1, "done", None)], "a long, n int, type string, data string")
    framed = rows.select("a", "n", answers.frame_of(F.col("type"), F.col("data")).alias("text"))
    assert framed.where("n = 1").first()["text"] == 'data: {"type":"done","data":null}\n\n'
    back = ingest.parse_events(framed, "a", "n").orderBy("place").collect()
    assert [(r["type"], r["data"]) for r in back] == [("token", 'a "quoted"\nline'), ("done", None)]


def test_late_requests(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "user_id long, ts timestamp"
    for rows in ([(1, 0), (1, 5), (1, 50), (2, 3)], [(1, 600)], [(1, 650)], [(1, 700), (1, 2), (3, 1)], [(1, 5000)]):
        spark.createDataFrame([(u, BEGIN + dt.timedelta(minutes=m)) for u, m in rows], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    ingest.stream_sliding(spark, f"{base}/in", schema, f"{base}/out", f"{base}/progress", limit=1)
    windows = spark.read.parquet(f"{base}/out")
    own = windows.where(F.col("start") == F.lit(BEGIN)).orderBy("user_id").select("user_id", "requests", "refused").collect()
    assert list(map(tuple, own)) == [(1, 3, 2), (2, 1, 0)]
    late = ingest.late_requests(windows, spark.read.parquet(f"{base}/in")).groupBy("user_id").agg(F.sum("late").alias("late")).collect()
    assert {r["user_id"]: r["late"] for r in late} == {1: 4, 3: 4}
