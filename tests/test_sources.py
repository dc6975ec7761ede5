"""Readers, sinks and streams on invented files."""

import json

from pyspark.sql import functions as F

from quarry.operators import catalog
from quarry.plans import batch
from quarry.sources import files
from quarry.streaming import ingest

REPORT = {
    "report_metadata": {"report_id": "r1", "report_title": "Ports 2020-21", "report_year": 2021, "source_filename": "r1"},
    "parent_chunks": [{"chunk_id": "r1_s1", "report_id": "r1", "hierarchy": {"level_2": "Dues", "level_1": "Ports"}, "page_range_physical": [0, 3], "toc_entry": "Dues", "toc_level": 2}],
    "child_chunks": [{"chunk_id": "r1_child_p000_paragraph_0000", "parent_chunk_id": "r1_s1", "content_type": "paragraph", "content": "Dues rose.", "source_page_physical": 0, "report_id": "r1"}],
    "semantic_enrichment": {"findings": [{"source_chunk_id": "r1_child_p000_paragraph_0000", "severity": "high", "total_amount_inr": 5}, {"source_chunk_id": "r1_child_p000_paragraph_0000", "severity": "low"}]},
}


def test_report_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "r1_chunks.json").write_text(json.dumps(REPORT, indent=1))
    (tmp_path / "sub" / "r2_chunks.json").write_text(json.dumps({"child_chunks": [{"chunk_id": "c", "metadata": {"source": "r2.pdf"}}]}))
    (tmp_path / "bad_chunks.json").write_text("{ not json")
    read = files.read_reports(spark, str(tmp_path))
    assert read.count() == 3 and files.failed_files(read).count() == 1
    got = {r["report_id"]: r for r in files.reports(read).collect()}
    assert got["r1"]["filename"] == "r1.pdf" and got["r2"]["filename"] == "r2.pdf"
    assert files.sections(read).first()["hierarchy_path"] == "Ports > Dues"
    assert [r["ord"] for r in files.findings(read).orderBy("ord").collect()] == [0, 1]
    assert files.chunks(read).where("report_id = 'r1'").count() == 1
    assert files.read_reports(spark, str(tmp_path), recursive=False).count() == 2
    assert files.by_id(files.reports(read), "2").first()["report_id"] == "r2"
    assert files.read_reports_or(spark, str(tmp_path)).count() == 2


def test_batch_results(spark, tmp_path):
    lines = [
        {"custom_id": "a", "result": {"type": "succeeded", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "two words"}]}}},
        {"custom_id": "b", "result": {"type": "errored", "error": {"message": "too long"}}},
    ]
    path = tmp_path / "out.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\n\n")
    jobs = spark.createDataFrame([("a", "r1", "simple")], "custom_id string, report_id string, variant string")
    got = {r["report_id"]: r for r in files.batch_results(spark, str(path), jobs).collect()}
    assert got["r1"]["word_count"] == 2 and got["r1"]["thinking_used"] and got["r1"]["variant"] == "simple"
    assert got["b"]["error"] == "too long" and got["b"]["content"] is None
    listed = files.summary_list(files.batch_results(spark, str(path), jobs)).where("report_id = 'r1'").orderBy("place").collect()
    assert [r["variant"] for r in listed] == files.VARIANTS and [r["available"] for r in listed] == [False, False, False, True, False]


def test_sheets_and_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("test_id,passed,issues\n1,Yes,late; wrong\n2,no,\n")
    got = files.read_manual_tests(spark, str(tmp_path / "m.csv")).orderBy("test_id").collect()
    assert got[0]["passed"] and got[0]["issues"] == ["late", "wrong"] and not got[1]["passed"] and got[1]["issues"] == []
    cases = spark.createDataFrame([("1", "q", [(1.5, "crore")], ["NHAI"])], "test_id string, question string, amounts array<struct<value:double,unit:string>>, entities array<string>")
    files.write_manual_tests(cases, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["amounts"] == "1.5 crore"
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "key string, seq int, v string")
    files.write_latest(rows, str(tmp_path / "t"), "key", "seq")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["b", "c"]


def test_streams(spark, data, tmp_path):
    got = batch.stream_ingest(spark, data)
    assert got.count() == got.select("user_id").distinct().count()
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    query = ingest.stream_requests(spark, str(tmp_path / "events"), schema).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hours").agg(F.sum("requests")).first()[0] == events.count()


def test_rows_that_come_late(spark, tmp_path):
    """Batches rewrite the buckets they touch, and an older row that comes later changes nothing."""
    schema, source, table = "k string, v int, seq long", str(tmp_path / "in"), str(tmp_path / "table")
    go = lambda rows: (spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source), ingest.index_stream(spark, source, schema, table, str(tmp_path / "c"), "k", buckets=4))
    assert ingest.read_indexed(spark, table, schema).count() == 0
    go([("a", 1, 5), ("b", 1, 1), ("c", 1, 1)])
    go([("a", 2, 3), ("b", 2, 2), ("d", 1, 1), (None, 7, 1)])
    got = {r["k"]: r["v"] for r in ingest.read_indexed(spark, table, schema).collect()}
    assert got == {"a": 1, "b": 2, "c": 1, "d": 1, None: 7}
    go([("d", 9, 9)])
    assert {r["k"]: r["v"] for r in ingest.read_indexed(spark, table, schema).collect()} == got | {"d": 9}


def test_section_types(spark, tmp_path):
    own = REPORT | {"semantic_enrichment": {"section_classifications": [{"chunk_id": "x", "section_type": "finding", "confidence": 0.9}, {"chunk_id": "x", "section_type": "other"}]}}
    (tmp_path / "r_chunks.json").write_text(json.dumps(own))
    classes = files.section_classes(files.read_reports(spark, str(tmp_path)))
    chunks = spark.createDataFrame([("x",), ("y",)], "chunk_id string")
    assert {r["chunk_id"]: r["section_type"] for r in catalog.with_section_type(chunks, classes).collect()} == {"x": "finding", "y": None}


def test_partial_events(spark):
    rows = spark.createDataFrame([(1, 0, 'data: {"type": "token", "da'), (1, 1, 'ta": "a"}\n\ndata: {"type": "done"'), (2, 0, "noise\n\n")], "s int, turn int, text string")
    got = ingest.parse_events(rows, "s", "turn").collect()
    assert [(r["s"], r["type"], r["data"]) for r in got] == [(1, "token", "a")]
