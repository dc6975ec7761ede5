"""The vector index and the payload layout: recall, pruning, odd rows."""

import shutil
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ann, retrieval, segments
from quarry.plans import indexes
from quarry.plans.frames import frame
from quarry.sources import layout, scratch


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * 3 + r.normal(size=16)).tolist(), i % 4) for i in range(3000)] + [(3000 + i, centres[0].tolist(), 1) for i in range(900)]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 8, 2), (9004, centres[1].tolist(), None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    path = f"file://{tmp_path_factory.mktemp('ann')}/index"
    ann.write_index(vectors, path, ["label"])
    return vectors, ann.read_index(spark, path)


def test_every_row_is_indexed(clustered):
    vectors, index = clustered
    assert index.rows.count() == vectors.count()
    assert sorted(r["vec_id"] for r in index.rows.where(F.col("cell") == ann.ASIDE).collect()) == [9000, 9001, 9002, 9003]


@pytest.mark.parametrize("filtered", [False, True])
def test_recall(clustered, filtered):
    vectors, index = clustered
    where = F.col("label") == 2 if filtered else None
    asked = vectors.where("vec_id % 100 = 0 and vec_id < 3000")
    hits = ann.recall(ann.topk_of_set(index, asked, 10, where), ann.exact_of_set(index, asked, 10, where)).agg(F.sum("wanted"), F.sum("hits")).first()
    assert hits[0] == 300 and hits[1] >= 0.9 * hits[0]
    some = ann.unit(asked.select("embedding").toArrow()["embedding"].combine_chunks(), 16)[1]
    assert index.probed(some, 10, where) < len(index.centroids)


def test_all_cells_are_exact(clustered):
    vectors, index = clustered
    asked = vectors.where("vec_id in (5, 3001, 9000, 9002, 9003)")
    got = ann.topk_of_set(index, asked, 7, n=len(index.centroids)).select("query_id", "rank", "score")
    want = ann.exact_of_set(index, vectors.where("vec_id in (5, 3001)"), 7).select("query_id", "rank", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_folders_are_pruned(clustered):
    vectors, index = clustered
    query = vectors.where("vec_id = 7").first()["embedding"]
    found = ann.topk(index, query, 5, F.col("label") == 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "EqualTo(label,3)" in plan
    assert found.first()["vec_id"] == 7
    assert ann.topk(index, [0.0] * 16, 5).count() == ann.topk(index, [1.0], 5).count() == 0


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    ann.write_index(none, f"file://{tmp_path}/index", ["label"])
    index = ann.read_index(spark, f"file://{tmp_path}/index")
    assert ann.topk_of_set(index, none, 3).count() == 0 and ann.topk(index, [1.0, 2.0], 3).count() == 0


def test_two_columns_read_few_groups(spark, tmp_path):
    path = f"file://{tmp_path}/layout"
    layout.write_layout(frame(spark, "/root/testdata/sf0.01", indexes.PAYLOAD), path, indexes.FIELDS, group_rows=100)
    stats = layout.group_stats(spark, path, indexes.FIELDS, 100).cache()
    assert stats.agg(F.sum("rows")).first()[0] == 60_000 and stats.agg(F.max("rows")).first()[0] <= 100
    total, shares = stats.count(), {}
    rows = spark.read.parquet(path)
    one = {c: rows.where(F.col(c).isNotNull()).orderBy(F.xxhash64(c)).first()[c] for c in ("report_year", "content_type", "page_physical", "finding_type", "severity", "section_type", "amount_paise")}
    for a, b in combinations(one, 2):
        shares[a, b] = stats.where(layout.may_hold({c: (one[c], one[c]) for c in (a, b)})).count() / total
    assert np.mean(list(shares.values())) < 0.4, shares


def test_layout_of_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else "a", i % 2 == 0) for i in range(50)] + [(None, None, None)] * 40, "i int, s string, b boolean")
    layout.write_layout(rows, f"file://{tmp_path}/l", ["i", "s", "b"], ["s"], group_rows=10)
    back = spark.read.parquet(f"file://{tmp_path}/l")
    assert back.columns == rows.columns and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    layout.write_layout(rows.limit(0), f"file://{tmp_path}/none", ["i", "s", "b"])
    assert spark.read.schema(rows.schema).parquet(f"file://{tmp_path}/none").count() == 0


def test_kept_folders_follow_their_inputs(spark, tmp_path):
    source, made = f"{tmp_path}/in", []
    write = lambda to: (made.append(to), spark.read.parquet(source).write.parquet(to))
    spark.range(3).write.parquet(source)
    first = scratch.kept(spark, "copy", [source], write)
    assert scratch.kept(spark, "copy", [source], write) == first and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    second = scratch.kept(spark, "copy", [source], write)
    assert second != first and spark.read.parquet(second).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(first).count()


def test_changed_index_equals_a_new_one(spark, tmp_path):
    texts = {i: f"toll dues {'abcdefg'[i % 7] * 3} of port" for i in range(60)}
    docs = lambda d: spark.createDataFrame(sorted(d.items()), "id long, text string")
    segments.create(docs(texts), "id", f"file://{tmp_path}/a")
    index = segments.open_keywords(spark, f"file://{tmp_path}/a", "id")
    for changed, gone in (({3: "new words", 70: "toll"}, [5, 6, 999]), ({3: "toll twice", 5: "back", 8: None}, [70]), ({}, [3])):
        index = segments.upsert(index, docs(changed), deleted=spark.createDataFrame([(g,) for g in gone], "id long"))
        texts = {k: v for k, v in (texts | changed).items() if k not in gone}
    segments.create(docs(texts), "id", f"file://{tmp_path}/b")
    new = segments.open_keywords(spark, f"file://{tmp_path}/b", "id")
    every = lambda x: sorted(map(tuple, x.postings().collect()))
    assert len(index.segments) == 4 and every(index) == every(new) and index.texts().first() == new.texts().first()
    merged = segments.merge(index)
    assert len(merged.segments) == 1 and every(merged) == every(new) and merged.texts().first() == new.texts().first()
    assert sorted(r["id"] for r in merged.postings(["twice", "back", "bbb"]).collect()) == sorted([5, *(i for i, t in texts.items() if t and "bbb" in t)])
    assert set(merged.postings(["back"]).inputFiles()) < set(merged.postings().inputFiles()) or len(merged.postings().inputFiles()) == 1


def test_search_without_its_index(spark, tmp_path):
    dense = spark.createDataFrame([(1, 0.5, 1), (2, 0.25, 2)], "id long, score double, rank int")
    segments.create(spark.createDataFrame([(2, "toll")], "id long, text string"), "id", f"file://{tmp_path}/k")
    index = segments.open_keywords(spark, f"file://{tmp_path}/k", "id")
    search = lambda: retrieval.sparse_topk(index.postings, index.texts(), "id", "toll", 5)
    assert retrieval.hybrid_or_dense(dense, search, "id", 5).where("id = 2").first()["lists"] == 2
    planned = search()
    planned._jdf.queryExecution().executedPlan()
    shutil.rmtree(tmp_path / "k")
    for lost in (lambda: planned, search, lambda: segments.open_keywords(spark, f"file://{tmp_path}/k", "id")):
        assert [r["id"] for r in retrieval.hybrid_or_dense(dense, lost, "id", 5).orderBy("rank").collect()] == [1, 2]


def test_layout_deals_narrow_rows(spark, tmp_path):
    """Rows made from one column are shuffled as it, and are the same in the end."""
    make = lambda df: df.selectExpr("id", "id % 7 as a", "repeat('x', 500) as b")
    rows = make(spark.range(3000))
    layout.write_layout(rows, f"file://{tmp_path}/n", ["a", "b"], ["b"], group_rows=100, narrow=["id"], make=make)
    got = spark.read.parquet(f"file://{tmp_path}/n")
    assert got.columns == rows.columns and got.exceptAll(rows).count() == rows.exceptAll(got).count() == 0


def test_tokens_are_counted_where_texts_are(spark, tmp_path):
    """A segment's rows are counted before they are shuffled, keys that texts share too, and every token is found by its file's range."""
    texts = [(1, "toll dues toll 5% of 3 crore"), (1, "toll Section 14(2)"), (2, None), (3, ""), (4, "Rule 7b form 2a article 9 " + "w" + "dues port " * 20_000), (5, "rs 7 lac in 2019-20 NGT 8 percent"), (6, "lakhs of thousand")]
    docs = spark.createDataFrame(texts, "id long, text string")
    bags = retrieval.tallies(docs, "id")
    assert "Exchange" not in bags._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in bags.collect()) == [1, 1, 2, 3, 4, 5, 6]
    want = sorted(map(tuple, retrieval.term_frequencies(docs, "id").select("id", "token", "tf").collect()))
    segments.create(docs, "id", f"file://{tmp_path}/t")
    index = segments.open_keywords(spark, f"file://{tmp_path}/t", "id")
    assert sorted(map(tuple, index.postings().collect())) == want and index.texts().first()["texts"] == 7
    for token in {t for _, t, _ in want}:
        assert sorted(map(tuple, index.postings([token]).collect())) == [w for w in want if w[1] == token], token
    assert {"section_14_2", "rule_7b", "form_2a", "article_9", "money_crore", "money_lakh", "has_percentage", "year_2019-20", "acronym_NGT"} <= {t for _, t, _ in want}
    assert index.postings(["nosuchtoken"]).count() == index.postings(["0"]).count() == 0
