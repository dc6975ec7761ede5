"""Expressions on small literal cases, worked out by hand."""

import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import amounts, assets, reports, tokens
from quarry.operators import assets as table_ops
from quarry.operators import catalog, diagnostics, providers, retrieval, segments, vectors


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for n, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title,year",
    [("Audit for 2023-24", "2023-24"), ("Audit 2022-2023 report", "2022-23"), ("Accounts, year ended March 2022", "2021-22"), ("for the period ended MARCH 2000", "1999-00"), ("year 2019", "2019"), ("Period 2018 review", "2018"), ("none", ""), (None, "")],
)
def test_audit_year(spark, title, year):
    assert one(spark, reports.audit_year(F.col("t")), t=title) == year


@pytest.mark.parametrize("name,year", [("x_202021_y.pdf", "2020-21"), ("x_199900.pdf", "1999-00"), ("x_202022_.pdf", ""), ("202122", "2021-22")])
def test_audit_year_of_filename(spark, name, year):
    assert one(spark, reports.audit_year_of_filename(F.col("t")), t=name) == year


@pytest.mark.parametrize("n,order", [(1, [0]), (2, [0, 1]), (3, [0, 2, 1]), (4, [0, 2, 3, 1]), (5, [0, 2, 4, 3, 1]), (6, [0, 2, 4, 5, 3, 1])])
def test_attention_places(spark, n, order):
    got = spark.range(n).select("id", retrieval.attention_place(F.col("id"), F.lit(n)).alias("p")).orderBy("id").collect()
    assert [r["p"] for r in got] == order


def test_special_tokens(spark):
    text = "Section 143 (3) and rule 86B; Form 26AS under Article 311. ₹847.71 crore, 5 lac, 2023-24, 12.5% by GST"
    got = one(spark, tokens.special_tokens(F.col("t")), t=text)
    assert got == ["section_143_3", "rule_86b", "form_26as", "article_311", "money_crore", "money_lakh", "year_2023-24", "has_percentage", "acronym_GST"]


def test_query_tokens_differ(spark):
    got = one(spark, tokens.query_tokens(F.col("t")), t="Was ₹5 lakh lost, 10% more?")
    assert "money_crore" in got and "has_percentage" not in got and "more" in got


def test_chunk_ids(spark):
    rows = spark.createDataFrame([("R_1_child_p003_paragraph_0001",), ("R_1_child_p003_paragraph_0002",), ("R_1_child_p003_paragraph_0004",), ("R_1_child_p003_list_0000",), ("odd",), (None,)], "chunk_id string")
    got = {r["chunk_id"]: (r["previous_id"], r["next_id"]) for r in retrieval.neighbours(rows).collect()}
    assert got["R_1_child_p003_paragraph_0002"] == ("R_1_child_p003_paragraph_0001", None)
    assert got["R_1_child_p003_list_0000"] == (None, None) and got["odd"] == (None, None) and got[None] == (None, None)


@pytest.mark.parametrize("value,unit,kind", [(1250.5, "lakhs", "exact"), (1200.0, "lakh", "close"), (7.0, "crore", "missing"), (500.0, "lakh", "wrong"), (3.0, "lakh", "close")])
def test_amount_match(spark, value, unit, kind):
    text = "₹1,250.5 lakh went to 3 godowns"
    assert one(spark, amounts.match_kind(amounts.amounts_in(F.lit(text)), F.lit(value), F.lit(unit))) == kind


def test_entities_and_facts(spark):
    assert one(spark, amounts.contains_entity(F.lit("the National Highways Authority"), F.lit("NHAI")))
    assert one(spark, amounts.contains_entity(F.lit("fci stocks"), F.lit("Food Corporation")))
    assert not one(spark, amounts.contains_entity(F.lit("nothing"), F.lit("SEBI")))
    assert one(spark, amounts.fact_holds(F.lit("5 of 12"), F.lit("anything")))
    assert not one(spark, amounts.fact_holds(F.lit("tolls collected: 500"), F.lit("tolls collected: 100")))


def test_titles(spark):
    assert one(spark, reports.sanitize_title(F.lit("Report No. 5 of 2023 - Union Government – Ministry of Ports – Performance Audit on Dredging"))) == "Dredging"
    assert one(spark, reports.sanitize_title(F.lit("Report No. 5 of 2023"))) == "Report No. 5 of 2023"
    assert one(spark, assets.clean_caption(F.lit("Data Table: 2.3 Dues"))) == "2.3 Dues"
    assert one(spark, assets.clean_caption(F.lit(""))) == "Untitled Table"


def test_citation_keys(spark):
    assert one(spark, reports.citation_key(F.lit("[Section 2.3 ,  Page 54]"))) == "section 2.3,p54"
    assert one(spark, reports.citations_in(F.lit("So [Sec 2, p.5] and [x] and [ 3, page 7 ]."))) == ["Sec 2, p.5", "3, page 7"]


def test_point_id_is_unsigned(spark):
    import hashlib

    for i in range(20):
        assert int(one(spark, catalog.point_id(F.lit(f"c{i}")))) == int.from_bytes(hashlib.md5(f"c{i}".encode()).digest()[:8], "big")


def test_payload_filter_nulls(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, None), (3, "b", ["y", "z"])], "n int, s string, e array<string>")
    ids = lambda c: sorted(r["n"] for r in df.where(retrieval.payload_filter(df, c)).collect())
    assert ids({}) == [1, 2, 3] and ids({"s": None}) == [1, 2, 3] and ids({"s": ["a", "b"]}) == [1, 3] and ids({"e": ["z", "x"]}) == [1, 3] and ids({"n": {"gt": 1, "lte": 3}, "s": "b"}) == [3]


def test_plans():
    plan = providers.plan_of_reply("q", 'text {"question_type": "list", "expanded_queries": ["q", "a", "b", "c"]} more')
    assert plan["queries"] == ["q", "a", "b"] and plan["question_type"] == "list"
    assert providers.plan_of_reply("q", "no json")["top_k"] == 10
    assert providers.RuleEnhancer().plan("Compare dues")["question_type"] == "comparison"
    assert providers.merged_filters({"a": 1}, {"a": 2, "b": 3}) == {"a": 1, "b": 3} and providers.per_query_limit(50, 3) == 20


def test_default_models(spark):
    docs = spark.createDataFrame([(1, "toll dues of ports"), (2, "rail wagons"), (3, None)], "id int, text string")
    vectors = {r["id"]: r["embedding"] for r in providers.HashedWords(32).embed(docs, "text").collect()}
    assert set(vectors) == {1, 2} and abs(sum(x * x for x in vectors[1]) - 1) < 1e-9
    got = docs.select("id", providers.WordOverlap().score("toll dues", F.col("text")).alias("s")).orderBy(F.desc("s")).first()
    assert got["id"] == 1 and got["s"] == 1.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 5)), min_size=1, max_size=12))
def test_fusion_ignores_order(spark, pairs):
    frame = lambda p: {r["id"]: round(r["score"], 12) for r in retrieval.fuse(spark.createDataFrame(p, "id int, rank int"), "id").collect()}
    assert frame(pairs) == frame(pairs[::-1])


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, seq int")
    once = catalog.upsert(old, new, "k")
    twice = catalog.upsert(once, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1, 1), ("b", 3, 2), ("c", 4, 1)]


def test_gaps(spark):
    df = spark.createDataFrame([("r", 2), ("r", 5), ("r", 3), ("s", 1), ("t", None)], "r string, n int")
    assert {r["r"]: r["numbers"] for r in diagnostics.gaps(df, "r", "n").collect()} == {"r": "4", "s": ""}


def test_display_titles(spark):
    """Null pages tell nothing, structured titles are compared as they stand, and each way is used up in order."""
    rows = [
        ("r", "a", 1, None, 5, 3, "Dues", None), ("r", "b", 2, 4, 5, 3, "Dues", None), ("r", "c", 3, 4, 5, 3, "Dues", ""), ("r", "d", 4, None, 5, 3, "Dues", None), ("r", "e", 5, 0, 0, 3, "Dues", None),
        ("r", "f", 6, 9, 2, 2, "Dues", "Data Table: 1.2 Ports"), ("r", "g", 7, 9, 2, 2, "Dues", "1.2 Ports"), ("r", "h", 8, 9, 2, 2, "Dues", "Dues"), ("r", "i", 9, 1, 1, 1, "Alone", None), ("s", "j", 1, None, 1, 1, "Dues", "x"), ("s", "k", 1, None, 1, 1, "Dues", "x"), ("s", "l", 2, None, 1, 1, "", None),
    ]
    df = spark.createDataFrame(rows, "report_id string, chunk_id string, ord int, page int, rows int, columns int, title string, struct_title string")
    got = {r["chunk_id"]: r["display"] for r in table_ops.disambiguate(df).collect()}
    assert got == {
        "a": "Dues (5×3)", "b": "Dues (Page 4)", "c": "Dues (1)", "d": "Dues (2)", "e": "Dues (3)", "f": "1.2 Ports", "g": "1.2 Ports", "h": "Dues (Page 9)", "i": "Alone", "j": "Dues (1×1)", "k": "Dues (1)", "l": "Untitled Table",
    }


def test_one_caption_of_a_page(spark):
    rows = [("r", "a", 1, 3, "image_caption", "a bar chart depicting the dues of ports"), ("r", "b", 2, 3, "image_caption", "a pie chart showing the dues of rails"), ("r", "c", 3, 4, "image_caption", "a photo of people"), ("r", "d", 4, 4, "image_caption", "it shows the trend line of dues paid")]
    got = table_ops.extract_charts(spark.createDataFrame(rows, "report_id string, chunk_id string, ord int, page int, kind string, text string")).collect()
    assert sorted(r["chunk_id"] for r in got) == ["a", "d"]


def test_tables_over_pages(spark):
    rows = [("r", 1, "a", 1, "Dues", "A,B,C,D,E,F", 3), ("r", 2, "b", 2, "Dues", "A,B,C,D,E,F", 4), ("r", 3, "c", 4, "Dues", "A,B,C,D,E,F", 1), ("r", 4, "d", 5, "Dues (contd.)", "X", 2), ("r", 5, "e", 6, "Dues", "X,Y", 2), ("s", 6, "f", 7, "Dues", None, 2)]
    df = spark.createDataFrame(rows, "report_id string, ord int, chunk_id string, page int, caption string, heads string, rows int").withColumn("headers", F.split("heads", ","))
    assert sorted((r["chunk_id"], r["pages"], r["rows"]) for r in table_ops.stitch(df).collect()) == [("a", "1,2", 7), ("c", "4,5", 3), ("e", "6", 2), ("f", "7", 2)]


def test_citation_lookup(spark):
    """Each way of finding a citation, worked out by hand."""
    entries = spark.createDataFrame([("r", 0, "Section 2.3, p.54", "2.3 Dues", None, None), ("r", 1, "Executive Summary, p.11", "Executive Summary", 10, "11"), ("r", 2, "Annexure, p.0", "Annexure", None, None), ("r", 3, "Section 2.3, p.54", "2.3 Dues", 99, None)], "by string, ord int, entry string, section string, page_physical int, page_logical string")
    known = retrieval.citation_entries(entries, "by")
    assert known.where("known = 'section 2.3,p54'").first()["page_physical"] == 99
    asked = spark.createDataFrame([("r", c) for c in ("[section 2.3 ,  Page 54]", "2.3, p.54", "Part 9, page 11", "section 2.3, p.5", "x, p.0", "y, p.77", "no page")], "by string, citation string")
    got = {r["citation"]: (r["entry"], r["strategy"]) for r in retrieval.lookup_citations(asked, known, "by").collect()}
    assert got == {"[section 2.3 ,  Page 54]": ("Section 2.3, p.54", 1), "2.3, p.54": ("Section 2.3, p.54", 2), "Part 9, page 11": ("Executive Summary, p.11", 3), "section 2.3, p.5": ("Section 2.3, p.54", 4), "x, p.0": ("Annexure, p.0", 5)}


def test_similar_vectors(spark):
    """Blocks give what pairs give; null, zero and odd vectors are similar to nothing; equal vectors go by number."""
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, []), (8, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.topk_of_queries(v, v.where("vec_id in (2, 4, 5, 8)"), 3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(2, 1, 1), (2, 2, 2), (2, 3, 8), (8, 1, 8), (8, 2, 1), (8, 3, 2)]
    assert [r["vec_id"] for r in vectors.dense_topk(v.where("vec_id <> 6"), [5.0, 0.0], 9).orderBy("rank").collect()] == [1, 2, 8, 3]


def test_best_of_groups(spark):
    rows = [(g, f"k{i}", ((i * 37) % 10) / 10 + (i % 3) / 1e6) for g in ("a", "b") for i in range(25)]
    limits = F.when(F.col("g") == "a", 7).otherwise(30)
    got = retrieval.best_of(spark.createDataFrame(rows, "g string, k string, score double"), "g", limits, "k").collect()
    for g, n in (("a", 7), ("b", 25)):
        want = [k for _, k, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))][:n]
        assert [r["k"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])] == want


def test_rerank_shows_the_path(spark):
    df = spark.createDataFrame([("a", "Ports > Dues", "nothing"), ("b", None, "dues of rails"), ("c", "", None)], "chunk_id string, hierarchy_path string, text string")
    got = retrieval.rerank(df, "ports dues", providers.WordOverlap(), "chunk_id", 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("a", 1.0), ("b", 0.5)]


def test_keyword_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "toll dues toll"), (2, "dues"), (3, None), (4, "Section 5 dues")], "id long, text string")
    segments.create(docs, "id", str(tmp_path / "k"))
    index = segments.open_keywords(spark, str(tmp_path / "k"), "id")
    postings, texts = index.postings, index.texts()
    assert texts.first()["texts"] == 4 and postings().where("token = 'toll'").first()["tf"] == 2
    assert [r["id"] for r in retrieval.sparse_topk(postings, texts, "id", "toll under Section 5", 5).orderBy("rank").collect()] == [4, 1]
    assert retrieval.sparse_topk(postings, texts, "id", "the of", 5).count() == 0


def test_legacy_sizes(spark):
    for kind, want in (("list", (15, 15000)), ("factual", (10, 10000))):
        assert (one(spark, reports.legacy_top_k(F.lit(kind), F.lit(10))), one(spark, reports.legacy_chars(F.lit(kind), F.lit(10000)))) == want


def test_jobs_and_footnotes(spark):
    updates = spark.createDataFrame([("j", "a", 1, "in_progress"), ("j", "a", 2, "ended"), ("j", "b", 1, "ended"), ("k", "a", 3, "in_progress")], "job string, batch string, seq int, status string")
    assert sorted((r["job"], r["status"]) for r in catalog.job_status(updates).collect()) == [("j", "ready_for_processing"), ("k", "in_progress")]
    notes = spark.createDataFrame([("r", "c1", 1, "1. First"), ("r", "c2", 2, "[1] Again"), ("r", "c3", 3, "none"), ("r", "c4", 4, None)], "report_id string, chunk_id string, ord int, text string")
    assert [(r["number"], r["chunk_id"], r["text"]) for r in catalog.footnotes(notes).collect()] == [(1, "c1", "First")]


def test_semantic_data(spark):
    yes = lambda *v: one(spark, retrieval.has_semantic_data(*(F.lit(x).cast(t) for x, t in zip(v, ("string", "string", "double", "boolean"), strict=True))))
    assert not yes(None, "", 0.0, None) and yes("fraud", None, None, None) and yes(None, "low", None, None) and yes(None, None, 0.1, None) and yes(None, None, None, True)


def test_bags_are_term_frequencies(spark):
    texts = [("a", "Section 14 and section 14, Rule 5B"), ("b", "levy levy"), ("a", "section 14 levy"), ("c", None), (None, "rail"), (None, "rail port"), ("d", "₹ 1,250.5 crore, 12.5.5 % of 7,1 lac and 3percent, 1.2.3cr")]
    rows = spark.createDataFrame(texts, "k string, text string")
    want = sorted(map(str, retrieval.term_frequencies(rows, "k").collect()))
    assert sorted(map(str, retrieval.postings_of(retrieval.bags(rows, "k"), "k").collect())) == want
    some = sorted(map(str, retrieval.postings_of(retrieval.bags(rows, "k", only=["levy", "section_14"]), "k").collect()))
    assert some == [w for w in want if "'levy'" in w or "'section_14'" in w]


def test_one_question_shuffles_no_postings(spark):
    rows = spark.range(4000).selectExpr("concat('key', id) as k", "concat('levy of dues ', repeat('and rail port ship toll ', 20), id % 7, ' crore') as text")
    found = retrieval.sparse_topk_of_texts(rows, "k", "levy in crore", 3)
    assert [r["k"] for r in found.orderBy("rank").collect()] == ["key0", "key1", "key10"]
    plan = retrieval.postings_of(retrieval.bags(rows, "k"), "k").groupBy("token").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" not in plan.replace("hashpartitioning(k#", "hashpartitioning(k").split("Union")[0]


def test_numbers_are_tried_once(spark):
    """Patterns of money and percentages find what they found while they could begin and end within a number."""
    import random
    import re

    r = random.Random(3)
    parts = ["1", "23", ",", ".", " ", "₹", "%", "percent", "crore", "cr", "lakh", "lac", "x", "-", "45.6", "thousand"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 16))) for _ in range(4000)]
    for old, new in ((r"₹?\s*[\d,]+(?:\.\d+)?\s*(crore|lakh|thousand|cr|lac)", tokens.MONEY), (r"(\d+(?:\.\d+)?\s*(?:%|percent))", tokens.PERCENT)):
        assert [re.findall(old, t) for t in texts] == [re.findall(new, t) for t in texts]


def test_amounts_are_tried_once():
    """Patterns of amounts find what they found, and a long number without a unit takes no time of its square."""
    import random
    import re
    import time

    r = random.Random(5)
    parts = ["1", "23", ",", ".", " ", "₹", "Rs", "%", "-", " per cent", "crore", "cr", "lakh", "lac", " lakh crore", "m", "sq. km", "Lakh Metric Tonnes", "cases", "days", "MT", "x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 16))) for _ in range(3000)]
    every = [p for p, *_ in amounts.AMOUNT_PATTERNS] + [p for p, _ in amounts.SUGGESTED_AMOUNTS]
    for old in every:
        new = re.compile("(?i)" + amounts.once_a_number(old))
        assert [[m.group(0, 1) for m in re.finditer("(?i)" + old, t)] for t in texts] == [[m.group(0, 1) for m in new.finditer(t)] for t in texts], old
    began = time.process_time()
    assert not re.findall("(?i)" + amounts.once_a_number(every[2]), "7" * 5000)
    assert time.process_time() - began < 1


def test_chunks_without_a_parent_have_no_section(spark):
    chunks = spark.createDataFrame([("s1", None), ("c2", "s1"), ("c3", "s9")], "chunk_id string, parent_id string")
    got = retrieval.with_sections(chunks, spark.createDataFrame([("s1", "One")], "section_id string, toc_entry string"))
    assert "coalesce(parent_id" in got._jdf.queryExecution().optimizedPlan().toString()  # their key is not null
    assert {r["chunk_id"]: r["toc_entry"] for r in got.collect()} == {"s1": None, "c2": "One", "c3": None}


def test_citations_are_looked_up_in_lists(spark):
    entries = spark.createDataFrame([(1, 0, "Section 2.1, p.14", "2.1", None, None)], "by long, ord int, entry string, section string, page_physical int, page_logical string")
    asked = spark.createDataFrame([(1, "Section 2.1, p.14"), (1, "Section 2.1, p.14"), (2, "p.1")], "by long, citation string")
    found = retrieval.lookup_citations(asked, retrieval.citation_entries(entries, "by"), "by")
    assert "min_by" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "Section 2.1, p.14", "Section 2.1, p.14", 1)]


def test_neighbours_keep_columns(spark):
    rows = spark.createDataFrame([("R_child_p001_paragraph_0001", 5), ("R_child_p001_paragraph_0002", 6), ("odd", 7)], "chunk_id string, score int")
    assert {(r["chunk_id"][-4:], r["score"], (r["next_id"] or "")[-4:]) for r in retrieval.neighbours(rows, "score").collect()} == {("0001", 5, "0002"), ("0002", 6, ""), ("odd", 7, "")}


def test_bags_of_questions(spark):
    rows = spark.createDataFrame([(1, "dues dues crore 5%"), (2, "rail"), (2, "rail GST"), (3, None)], "id long, text string")
    got = retrieval.postings_of(retrieval.bags(rows, "id", of_query=True), "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.term_frequencies(rows, "id", of_query=True).select("id", "token", "tf").collect()))


def test_blocks_of_many_questions(spark):
    v = spark.range(700).selectExpr("id as vec_id", "array(float(sin(id)), float(cos(id)), float(id % 7)) as embedding")
    got = vectors.topk_of_queries(v, v, 1)
    assert {(r["query_id"], r["rank"], r["score"]) for r in got.select("query_id", "rank", "score").collect()} == {(i, 1, 1.0) for i in range(700)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= vectors.PAIRS * 2 * vectors.BLOCK * 64 * 8


def test_amounts_are_found_once_a_shape(spark):
    """Texts that differ in digits alone are searched once, and each gives what the patterns find in it."""
    texts = [f"Rs. {i}.50 crore or {i % 3},5 crore in 2 cases, {i % 2}% and ₹{i},000 lakh, 1.2.3%" for i in range(100, 400)] + ["12 croreé, 5.5 cases", "-0% and 0 %", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    number = lambda x: None if re.fullmatch(r"[\d.,-]*\..*\.[\d.,-]*|[,.-]*", x) else float(x.replace(",", ""))
    got = [r[0] for r in rows.select(amounts.amounts_in(F.col("text"))).collect()]
    for text, found in zip(texts, got, strict=True):
        want = {}
        for pattern, unit, _ in amounts.AMOUNT_PATTERNS:
            for m in re.finditer(pattern.replace(r"\b", r"(?u:\b)"), text or "", re.IGNORECASE | re.ASCII):
                name = unit or m[2].lower()
                if number(m[1]) is not None:
                    want[number(m[1]), next((n for n, forms in amounts.UNITS.items() if name in forms), name)] = None
        assert [tuple(a) for a in found] == list(want)
    amounts._amounts_of.cache_clear()
    amounts._amounts(pa.array(texts))
    assert amounts._amounts_of.cache_info().misses < 10


def test_match_without_unit_or_value(spark):
    found = amounts.amounts_in(F.lit("5 crore"))
    assert one(spark, amounts.match_kind(found, F.lit(5.0), F.lit(None).cast("string"))) == "missing"
    assert one(spark, amounts.match_kind(found, F.lit(None).cast("double"), F.lit("cr"))) == "wrong"


def test_suggested_amounts_are_found_once(spark):
    text = "₹5 crore, then 15 crore, 5 Crore and ₹ 5 crore; 2.5 per cent, 2.5%"
    got = one(spark, amounts.suggested_amounts(F.lit(text)))
    assert [(a["value"], a["unit"], a["place"]) for a in got] == [(5.0, "crore", 1), (15.0, "crore", 16), (2.5, "percent", text.index("2.5 per") + 1)]
    assert got[0]["context"] == text and one(spark, amounts.suggested_amounts(F.lit(None).cast("string"))) is None
    amounts._suggested_in.cache_clear()
    amounts._suggested(pa.array([f"Rs. {i} crore" for i in range(100, 900)]))
    assert amounts._suggested_in.cache_info().misses == 1


def test_tokens_are_cut_once_a_shape(spark):
    """Bags and counts of texts are those of the index's tokens, and texts that differ in digits alone are cut once."""
    odd = ["Section 5 (a 1), section 5(a1), SECTION 15( ) and section 5 (a 1)", "2015-16, 1999-20 2015-167 x2015", "GSTé मेंSection 4 theİ section 4", "1,2 lac 3cr 5% 6 percent", "", None, "levy " * 300 + "form 26AS"]
    texts = [f"Under Section {i} and Rule {i % 90}B of {1900 + i}-{i % 100}, GST of {i}.5 crore" for i in range(100, 400)] + odd
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(2)
    got = rows.select(tokens.index_tokens(F.col("text")).alias("every"), tokens.index_bag(F.col("text")).alias("bag"), tokens.index_bag(F.col("text"), ["gst", "section_5"]).alias("some")).collect()
    for r in got:
        assert {b["token"]: b["tf"] for b in r["bag"]} == Counter(r["every"]) and len(r["bag"]) == len(set(r["every"]))
        assert {b["token"]: b["tf"] for b in r["some"]} == {t: n for t, n in Counter(r["every"]).items() if t in ("gst", "section_5")}
    want = Counter((t, n) for r in got for t, n in Counter(r["every"]).items())
    tally = retrieval.tally(rows, "id")
    assert {(r["token"], r["tf"]): r["n"] for r in tally.collect()} == want
    twice = rows.where("id < 102").selectExpr("id % 100 as id", "text")  # keys that two texts share
    found = Counter((r["token"], r["tf"]) for r in retrieval.term_frequencies(twice, "id").collect())
    assert {(r["token"], r["tf"]): r["n"] for r in retrieval.tally(twice, "id").collect()} == found
    tokens._tokens_of_shape.cache_clear()
    list(tokens.tallied(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert tokens._tokens_of_shape.cache_info().misses < 12
