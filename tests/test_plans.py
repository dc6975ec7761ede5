"""What the optimizer makes of headline queries: pruned columns, pushed filters, no pairwise joins."""

import contextlib
import io

import duckdb
import pytest
from compare import rows

from quarry.plans import batch
from quarry.plans import registry


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_reach_the_scan(spark, data):
    text = plan(registry.QUERIES["dense_topk_filtered"](spark, data))
    assert "PushedFilters" in text and "In(label" in text and "TakeOrderedAndProject" in text


def test_columns_are_pruned(spark, data):
    text = plan(registry.QUERIES["payload_filter_in"](spark, data))
    assert "l_extendedprice" not in text and "l_shipdate" not in text


@pytest.mark.parametrize("name", ["neighbor_expand", "orphan_chunks", "dup_detect", "findings_summary", "upsert_latest", "citation_extract", "assign_parent", "series_build", "extract_charts", "eval_compare"])
def test_no_pairwise_joins(spark, data, name):
    text = plan(registry.QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_search_reads_postings(spark, data):
    """A search reads the files and row groups of its tokens, and no text of the corpus."""
    text = plan(registry.QUERIES["sparse_topk"](spark, data))
    assert "In(token" in text and "lineitem" not in text


def test_one_pass_over_groupings(spark, data):
    assert plan(registry.QUERIES["findings_summary"](spark, data)).count("Scan parquet") <= 2


def test_money_beyond_longs(spark, tmp_path):
    line = "1L as l_orderkey, 1L as l_partkey, 1L as l_suppkey, 1 as l_linenumber, 1.0D as l_quantity, 9.0e9D as l_extendedprice, 0.0D as l_discount, 'R' as l_returnflag, 'O' as l_linestatus"
    spark.range(2000).selectExpr(*line.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert batch.money_normalize(spark, str(tmp_path)).collect() == [("crore", str(2000 * 9_000_000_000 * 1_000_000_000))]


def test_pages_and_not_chunks_meet_sections(spark, data):
    assert "Keys [1]: [chunk_id" not in plan(registry.QUERIES["assign_parent"](spark, data))


@pytest.mark.parametrize("name", ["suggest_amounts", "match_amount", "extract_amounts", "amount_accuracy"])
def test_amounts_are_not_tried_text_by_text(spark, data, name):
    text = plan(registry.QUERIES[name](spark, data))
    assert "regexp_extract_all" not in text and "ArrowEvalPython" in text


def test_cases_are_counted_where_they_are(spark, data, tmp_path):
    """Cases that share their name count once by unit, and only they are shuffled."""
    lines = spark.read.parquet(f"{data}/lineitem.parquet").limit(200)
    lines.unionByName(lines.limit(50)).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.QUERIES["extract_amounts"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
        assert rows(got.toPandas()) == rows(con.sql(registry.ORACLE_SQL["extract_amounts"]).df())
    assert "count(distinct" in plan(got) and "LeftSemi" in plan(got)


def test_hits_of_a_question_are_found_once(spark, data):
    """What is made of the hits reads them, and passages no more."""
    assert "text" not in " ".join(x for x in plan(registry.QUERIES["ask"](spark, data)).splitlines() if "concat(Under Section" in x)


def test_entities_are_found_once(spark, data):
    assert "size(array_distinct" not in plan(registry.QUERIES["suggest_entities"](spark, data))
