"""Diagnostics and evaluation queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import amounts as A
from quarry.functions import reports as R
from quarry.operators import diagnostics, evaluation, retrieval
from quarry.plans.assets import CELLS_SQL
from quarry.plans.frames import CHUNKS, FINDINGS, LINE_ID, SECTIONS, frame, over
from quarry.plans.listing import more

CASES = f"""
SELECT {LINE_ID} AS test_id,
       concat('NHAI collected Rs. ', CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), ' crore in ', CAST(CAST(l_quantity AS INT) AS STRING), ' cases, or ', CAST(CAST(l_tax AS DECIMAL(6,2)) * 100 AS STRING), ' per cent of dues. ',
         CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN 'No data on tolls; 12.5 tonnes were not found.' WHEN 1 THEN concat('Stock of the Food Corporation fell ', CAST(l_suppkey % 40 AS STRING), '%.') WHEN 2 THEN 'Goods and services tax of 3 states rose in 2 years.' ELSE '₹1,250.5 lakh went to 7 godowns.' END) AS answer,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) * (1 + CAST(l_linenumber % 4 AS DOUBLE) * 2 / 100) AS expected_value,
       CASE WHEN l_suppkey % 5 = 0 THEN 'lakh' ELSE 'Crores' END AS expected_unit, l_suppkey % 3 = 0 AS required,
       CASE CAST(l_suppkey % 6 AS INT) WHEN 0 THEN 'NHAI' WHEN 1 THEN 'fci' WHEN 2 THEN 'GST' WHEN 3 THEN 'National Highways Authority' WHEN 4 THEN 'SEBI' ELSE 'collected' END AS entity,
       concat('Collected dues in ', CAST(CAST(l_quantity AS INT) + l_linenumber % 3 AS STRING), ' cases of tolls stock') AS fact,
       CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
       CASE WHEN l_linenumber < 4 THEN 'factual' WHEN l_linenumber < 6 THEN 'list' ELSE 'aggregation' END AS type,
       CAST(1 + l_partkey % 5 AS INT) AS factual, CAST(1 + l_suppkey % 5 AS INT) AS complete, CAST(1 + l_orderkey % 5 AS INT) AS relevant, CAST(1 + (l_partkey + l_suppkey) % 5 AS INT) AS cited,
       CAST(l_partkey % 11 AS DOUBLE) / 10 AS amount_accuracy, CAST(l_suppkey % 5 AS DOUBLE) / 4 AS entity_coverage, l_returnflag = 'R' AS hallucinated
FROM {{lineitem}}"""
ISSUES = f"""
SELECT {LINE_ID} AS test_id,
       CASE CAST(l_suppkey % 6 AS INT) WHEN 0 THEN 'Missing required amount: 5 crore' WHEN 1 THEN 'Low entity coverage: 40%' WHEN 2 THEN 'Hallucination detected: no source' WHEN 3 THEN 'Contains forbidden content' WHEN 4 THEN 'Low key fact coverage: 20%' ELSE 'Slow' END AS issue
FROM {{lineitem}}"""
DOCS = "SELECT doc_id, lang AS report_id, text FROM {documents}"


def _cases(spark, sf_dir, wide=False):
    return frame(spark, sf_dir, CASES, wide)


def extract_amounts(spark, sf_dir):
    """Amounts by unit and the cases that have them; only cases that share their name are shuffled by it, others are counted where they are."""
    once, again = retrieval.parted(_cases(spark, sf_dir, wide=True).select("test_id", "answer"), "test_id", _cases(spark, sf_dir))
    found = lambda rows: rows.select("test_id", A.amounts_in(F.col("answer")).alias("found"))
    # outer explodes: for inner ones Spark would extract the amounts once more, to filter by their number
    first = F.transform("found", lambda a, i: F.struct(a["value"].alias("value"), a["unit"].alias("unit"), (F.array_position(F.col("found.unit"), a["unit"]) == i + 1).cast("long").alias("first")))
    own = found(once).select(F.explode_outer(first).alias("a")).where("a is not null")
    shared = found(again).select("test_id", F.explode_outer("found").alias("a")).where("a is not null")
    hundredths = F.sum(F.round(F.col("a.value") * 100).cast("long")).alias("hundredths")
    parts = own.groupBy("a.unit").agg(F.count("*").alias("n"), F.sum("a.first").alias("tests"), hundredths).unionByName(shared.groupBy("a.unit").agg(F.count("*").alias("n"), F.count_distinct("test_id").alias("tests"), hundredths))
    return parts.groupBy("unit").agg(*(F.sum(c).alias(c) for c in ("n", "tests", "hundredths")))


def _matches(spark, sf_dir):
    return _cases(spark, sf_dir, wide=True).select("test_id", "required", A.match_kind(A.amounts_in(F.col("answer")), F.col("expected_value"), F.col("expected_unit")).alias("kind"))


def match_amount(spark, sf_dir):
    return _matches(spark, sf_dir)


def amount_accuracy(spark, sf_dir):
    return evaluation.amount_accuracy(_matches(spark, sf_dir)).select("test_id", F.round(F.col("amount_accuracy") * 1000).cast("long").alias("accuracy"))


def entity_coverage(spark, sf_dir):
    return _cases(spark, sf_dir, wide=True).select("test_id", A.contains_entity(F.col("answer"), F.col("entity")).alias("found"))


def fact_coverage(spark, sf_dir):
    return _cases(spark, sf_dir, wide=True).select("test_id", A.fact_holds(F.col("fact"), F.col("answer")).alias("holds"))


def overall_score(spark, sf_dir):
    return evaluation.scored(_cases(spark, sf_dir)).select("test_id", F.round(F.col("score") * 100).cast("long").alias("score"), "passed")


def eval_report(spark, sf_dir):
    return evaluation.report(evaluation.scored(_cases(spark, sf_dir)))


def eval_compare(spark, sf_dir):
    now = evaluation.scored(_cases(spark, sf_dir)).select("test_id", "passed", "hallucinated")
    return evaluation.compare(now.select("test_id", (F.length("test_id") % 3 == 0).alias("passed")), now).groupBy("kind").agg(F.count("*").alias("n"))


def eval_filtered(spark, sf_dir):
    """Results of hard questions of fact."""
    c = evaluation.chosen(evaluation.scored(_cases(spark, sf_dir)), kind="factual", difficulty="hard")
    return c.groupBy("hallucinated").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def eval_failures(spark, sf_dir):
    """Failure patterns of all results."""
    return evaluation.failure_patterns(evaluation.scored(_cases(spark, sf_dir)), frame(spark, sf_dir, ISSUES).distinct())


def issue_categorise(spark, sf_dir):
    return frame(spark, sf_dir, ISSUES).groupBy(evaluation.issue_kind(F.col("issue")).alias("kind")).agg(F.count("*").alias("n"))


def issue_summary(spark, sf_dir):
    """Issues with their number, and the first and last case of each; issue_tests has all cases."""
    return frame(spark, sf_dir, ISSUES).groupBy("issue").agg(F.count("*").alias("n"), F.min("test_id").alias("first_test"), F.max("test_id").alias("last_test"))


def issue_counts(spark, sf_dir):
    """Issues of all results."""
    return frame(spark, sf_dir, ISSUES).groupBy("issue").agg(F.count("*").alias("n"))


def issue_tests(spark, sf_dir):
    """Which results have which issue, a row each."""
    return frame(spark, sf_dir, ISSUES).select("issue", "test_id")


def wilson_interval(spark, sf_dir):
    r = evaluation.scored(_cases(spark, sf_dir)).groupBy("difficulty").agg(F.count_if("passed").alias("p"), F.count("*").alias("n"))
    low, high = A.wilson(F.col("p"), F.col("n"))
    return r.select("difficulty", F.round(low * 1_000_000).cast("long").alias("low"), F.round(high * 1_000_000).cast("long").alias("high"))


def ack_no_data(spark, sf_dir):
    return _cases(spark, sf_dir).groupBy(A.admits_no_data(F.col("answer")).alias("admits")).agg(F.count("*").alias("n"))


def forbidden_content(spark, sf_dir):
    return _cases(spark, sf_dir).where(A.has_forbidden(F.col("answer"), F.array(F.lit("TOLLS"), F.lit("lakh WENT")))).select("test_id")


def testcase_validate(spark, sf_dir):
    c = _cases(spark, sf_dir).select("test_id", F.when(F.col("required"), F.col("entity")).alias("entity"), F.when(F.col("type") != "list", F.col("fact")).alias("fact"))
    missing = F.concat_ws(",", *(F.when(F.col(n).isNull(), F.lit(n)) for n in ("entity", "fact")))
    return c.groupBy(missing.alias("missing")).agg(F.count("*").alias("n"))


def dup_detect(spark, sf_dir):
    return diagnostics.duplicates(frame(spark, sf_dir, DOCS), "report_id")


def length_distribution(spark, sf_dir):
    return diagnostics.lengths(frame(spark, sf_dir, DOCS), "report_id")


def diag_content(spark, sf_dir):
    """Empty texts of documents, inverted pages of sections."""
    d = frame(spark, sf_dir, DOCS).groupBy("report_id").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("text")) < 10).alias("empty"))
    s = frame(spark, sf_dir, SECTIONS).agg(F.count_if(F.col("page_start") > F.col("page_end")).alias("inverted"))
    return d.crossJoin(F.broadcast(s))


def diag_findings(spark, sf_dir):
    return diagnostics.findings(frame(spark, sf_dir, FINDINGS).withColumn("report_id", F.concat(F.lit("S"), F.col("page").cast("string"))))


def diag_hierarchy(spark, sf_dir):
    """Chunks by section: sections, depth and the share of the largest."""
    c = frame(spark, sf_dir, CHUNKS).join(frame(spark, sf_dir, SECTIONS).select(F.col("section_id").alias("parent_id"), "hierarchy_path"), "parent_id", "left")
    by = c.groupBy("report_id", "hierarchy_path").agg(F.count("*").alias("c"))
    return by.groupBy("report_id").agg(F.count("hierarchy_path").alias("hierarchies"), F.sum("c").alias("chunks"), F.max("c").alias("largest"), F.max(F.size(F.split(F.coalesce("hierarchy_path", F.lit("")), " > "))).alias("depth"))


def diag_rec_gaps(spark, sf_dir):
    f = frame(spark, sf_dir, FINDINGS).where("is_recommendation and severity = 'high'").select(F.concat(F.lit("S"), (F.col("ord") % 40).cast("string")).alias("report_id"), F.col("page").alias("number"))
    return diagnostics.gaps(f, "report_id", "number")


def diag_entities(spark, sf_dir):
    names = frame(spark, sf_dir, ENTITIES)
    return names.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(A.noisy_entity(F.col("name"))).alias("noisy"))


ENTITIES = "SELECT CASE WHEN p_size % 2 = 0 THEN 'organizations' ELSE 'schemes' END AS kind, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN p_brand WHEN 1 THEN p_name WHEN 2 THEN concat('The ', p_type) WHEN 3 THEN concat('Board noticed ', p_type) WHEN 4 THEN 'Ab' ELSE concat('Ministry of ', p_type) END AS name FROM {part}"
RECS = "SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat('As per the Act ', p_name) WHEN 1 THEN concat('Ministry may review ', p_name, ' as per rules') WHEN 2 THEN concat('Section 12 on ', p_name) ELSE concat('Review of ', p_name) END AS text FROM {part}"


def entity_noise(spark, sf_dir):
    return frame(spark, sf_dir, ENTITIES).select("name", A.noisy_entity(F.col("name")).alias("noisy")).distinct()


def verb_rec_fp(spark, sf_dir):
    return frame(spark, sf_dir, RECS).select("p_partkey", A.false_recommendation(F.col("text")).alias("false_positive"))


def diag_xrefs(spark, sf_dir):
    f = frame(spark, sf_dir, FINDINGS)
    return f.groupBy("chapter").agg(F.count("*").alias("refs"), F.count_if(F.col("target").isNotNull()).alias("resolved"), F.round(diagnostics.percent(F.count_if(F.col("target").isNotNull()), F.count("*")) * 10).cast("long").alias("permille"))


MEASURES = "SELECT p_partkey, CAST(p_size % 14 AS DOUBLE) AS empty_pct, CAST(p_partkey % 9 AS DOUBLE) AS inversion_pct, CAST(p_partkey % 23 AS DOUBLE) AS duplicate_pct, CAST(p_size AS DOUBLE) AS bad_length_pct, CAST(p_partkey % 11 AS DOUBLE) / 10 AS confidence, CAST(p_partkey % 13 AS INT) AS mismatches, CAST(p_size AS DOUBLE) AS concentration, CAST(p_partkey % 17 AS INT) AS hierarchies, CAST(p_partkey % 3 AS INT) AS depths, CAST(p_size % 7 AS INT) AS orphans FROM {part}"


def diag_score(spark, sf_dir):
    m = frame(spark, sf_dir, MEASURES)
    return m.select("p_partkey", diagnostics.content_score(m).cast("int").alias("content"), diagnostics.hierarchy_score(m).cast("int").alias("hierarchy"))


def diag_score_v3(spark, sf_dir):
    m = frame(spark, sf_dir, MEASURES)
    score = diagnostics.issue_score(F.col("depths"), F.col("mismatches"), F.col("orphans")).cast("int")
    return m.select("p_partkey", score.alias("score"), diagnostics.grade(score).alias("grade"))


def corpus_summary(spark, sf_dir):
    f = diagnostics.findings(frame(spark, sf_dir, FINDINGS))
    return f.agg(F.count("*").alias("reports"), F.sum("n").alias("findings"), F.sum("with_money").alias("with_money"), F.sum("unsure").alias("unsure"), F.count_if("bad_chapter").alias("bad_chapters"), F.max("top").alias("most"))


def chunk_confidence(spark, sf_dir):
    """0.4 of layout, 0.3 of contents list and 0.3 of content."""
    m = frame(spark, sf_dir, MEASURES)
    c = F.col("confidence").cast("decimal(4,2)") * F.lit(0.4).cast("decimal(3,2)") + (F.col("depths") * 0.15).cast("decimal(4,2)") + (F.col("orphans") * 0.05).cast("decimal(4,2)")
    return m.select("p_partkey", F.round(c * 100).cast("long").alias("confidence"))


def suggest_amounts(spark, sf_dir):
    """Distinct amounts that answers suggest, by unit, and how often they come first."""
    rows = _cases(spark, sf_dir, wide=True).select("test_id", F.posexplode(A.suggested_amounts(F.col("answer"))).alias("k", "a"))
    return rows.groupBy("a.unit", "k").agg(F.count("*").alias("n"), F.sum(F.col("a.place")).alias("places"), F.sum(F.round(F.col("a.value") * 100).cast("long")).alias("hundredths"))


def suggest_entities(spark, sf_dir):
    # an outer explode, as in extract_amounts
    rows = _cases(spark, sf_dir, wide=True).select(F.explode_outer(A.suggested_entities(F.concat("answer", F.lit(" Under the Toll Act, 2003 on NH 44 in Tamil Nadu."), "entity"))).alias("entity")).where("entity is not null")
    return rows.groupBy("entity").agg(F.count("*").alias("n"))


def diag_tables(spark, sf_dir):
    """Cells by kind and row type of tables, empty ones, and tables that have totals."""
    c = frame(spark, sf_dir, CELLS_SQL)
    filled = F.coalesce("normalized", "parsed").isNotNull()
    t = c.groupBy("table_id").agg(F.count("*").alias("cells"), F.count_if(~filled).alias("empty"), F.count_if(F.col("row_type") == "header").alias("headers"), F.max((F.col("row_type") == "total").cast("int")).alias("has_total"))
    return t.select("table_id", "cells", "empty", "headers", "has_total", (F.col("empty") * 100 > F.greatest("cells", F.lit(1)) * 30).alias("warn"))


def sample_size(spark, sf_dir):
    """Cases that a precision needs at a pass rate."""
    r = frame(spark, sf_dir, MEASURES).where("confidence > 0 and confidence < 1").select("confidence").distinct()
    return r.select(F.round(F.col("confidence") * 10).cast("int").alias("tenths"), F.ceil(F.lit(1.96 * 1.96) * F.col("confidence") * (1 - F.col("confidence")) / F.lit(0.0025)).cast("long").alias("n"))


UNIT_SQL = lambda u: "CASE " + " ".join(f"WHEN lower(trim({u})) IN ({', '.join(repr(x) for x in forms)}) THEN '{n}'" for n, forms in A.UNITS.items()) + f" ELSE lower(trim({u})) END"


def _amounts_sql(text: str) -> str:
    parts = []
    for pattern, unit, _ in A.AMOUNT_PATTERNS:
        if unit is None:
            parts.append(f"list_transform(list_zip(regexp_extract_all({text}, '(?i){pattern}', 1), regexp_extract_all({text}, '(?i){pattern}', 2)), lambda t: {{'value': TRY_CAST(replace(t[1], ',', '') AS DOUBLE), 'unit': {UNIT_SQL('t[2]')}}})")
        else:
            name = next((n for n, forms in A.UNITS.items() if unit in forms), unit)
            parts.append(f"list_transform(regexp_extract_all({text}, '(?i){pattern}', 1), lambda v: {{'value': TRY_CAST(replace(v, ',', '') AS DOUBLE), 'unit': '{name}'}})")
    return "list_distinct(list_filter(list_concat(" + ", ".join(parts) + "), lambda a: a.value IS NOT NULL))"


AM = f"am AS (SELECT *, {_amounts_sql('answer')} AS found FROM c)"
KIND = f"CASE WHEN len(list_filter(found, lambda a: a.unit = eu)) = 0 THEN 'missing' WHEN len(list_filter(found, lambda a: a.unit = eu AND abs(a.value - expected_value) < 0.01)) > 0 THEN 'exact' WHEN len(list_filter(found, lambda a: a.unit = eu AND expected_value <> 0 AND abs(a.value - expected_value) / abs(expected_value) < 0.05)) > 0 OR len(list_filter(found, lambda a: abs(a.value - expected_value) < 0.01)) > 0 THEN 'close' ELSE 'wrong' END"
MATCH = f"{AM}, mt AS (SELECT test_id, required, {KIND} AS kind FROM (SELECT *, {UNIT_SQL('expected_unit')} AS eu FROM am))"
ENTITY = "(contains(low, name) OR " + " OR ".join(f"(name = '{s}' AND ({' OR '.join(f'contains(low, {n!r})' for n in names)})) OR (name IN ({', '.join(repr(n) for n in names)}) AND contains(low, '{s}'))" for s, names in A.ALIASES.items()) + ")"
SCORED = "sc AS (SELECT *, score >= 70 AND factual >= 3 AND NOT hallucinated AS passed FROM (SELECT *, (factual * 6 + complete * 4 + relevant * 3 + cited * 3 + amount_accuracy * 10 + entity_coverage * 10) * CASE WHEN hallucinated THEN 0.5::DOUBLE ELSE 1 END AS score FROM c))"
BODY = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
NOISY = "length(name) < 3 OR length(name) > 80 OR " + " OR ".join(f"regexp_matches(name, '{p}')" for p in A.NOISE)
ISSUE_KIND = "CASE WHEN contains(lower(issue), 'amount') THEN 'amount' WHEN contains(lower(issue), 'entity') OR contains(lower(issue), 'coverage') THEN 'coverage' WHEN contains(lower(issue), 'hallucination') THEN 'hallucination' WHEN contains(lower(issue), 'forbidden') THEN 'forbidden' ELSE 'other' END"
TOP = "ch AS (SELECT report_id, chapter, count(*) AS c FROM f GROUP BY ALL), tp AS (SELECT report_id, c AS top, chapter AS top_chapter FROM ch QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY c DESC, chapter DESC) = 1), fd AS (SELECT report_id, count(*) AS n, count(*) FILTER (WHERE amount_paise > 0) AS with_money, count(*) FILTER (WHERE confidence > 0 AND confidence < 0.5) AS unsure FROM f GROUP BY 1), ff AS (SELECT *, lower(top_chapter) = 'executive summary' AND n > 10 AS bad_chapter FROM fd JOIN tp USING (report_id))"

def _suggested_sql() -> str:
    parts = []
    for pattern, unit in A.SUGGESTED_AMOUNTS:
        units = f"regexp_extract_all(answer, '(?i){pattern}', 2)" if unit is None else f"list_transform(regexp_extract_all(answer, '(?i){pattern}', 1), lambda x: '{unit}')"
        parts.append(f"list_transform(list_zip(regexp_extract_all(answer, '(?i){pattern}', 1), {units}, regexp_extract_all(answer, '(?i){pattern}', 0)), lambda z: {{'value': TRY_CAST(replace(z[1], ',', '') AS DOUBLE), 'unit': lower(z[2]), 'found': z[3]}})")
    return f"e AS (SELECT test_id, answer, list_filter(list_concat({', '.join(parts)}), lambda a: a.value IS NOT NULL) AS every FROM c), x AS (SELECT test_id, answer, unnest(every) AS a, generate_subscripts(every, 1) AS i FROM e), y AS (SELECT test_id, answer, a.value AS value, a.unit AS unit, arg_min(a.found, i) AS found, min(i) AS i FROM x GROUP BY ALL), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY test_id ORDER BY i) - 1 AS INT) AS k FROM y)"


QUERIES = {f.__name__: f for f in (extract_amounts, match_amount, amount_accuracy, entity_coverage, fact_coverage, overall_score, eval_report, eval_compare, eval_failures, eval_filtered, issue_categorise, issue_summary, issue_counts, issue_tests, wilson_interval, ack_no_data, forbidden_content, testcase_validate, dup_detect, length_distribution, diag_content, diag_findings, diag_hierarchy, diag_rec_gaps, diag_entities, entity_noise, verb_rec_fp, diag_xrefs, diag_score, diag_score_v3, corpus_summary, chunk_confidence, suggest_amounts, suggest_entities, diag_tables, sample_size)}
QUERIES["eval_failures_all"] = eval_failures

ORACLE_SQL = {
    "extract_amounts": more(f", {AM}, a AS (SELECT test_id, unnest(found) AS a FROM am) SELECT a.unit AS unit, count(*) AS n, count(DISTINCT test_id) AS tests, CAST(sum(CAST(round(a.value * 100) AS BIGINT)) AS BIGINT) AS hundredths FROM a GROUP BY 1", c=CASES),
    "match_amount": more(f", {MATCH} SELECT * FROM mt", c=CASES),
    "amount_accuracy": more(f", {MATCH} SELECT test_id, CAST(round((coalesce(avg(CASE WHEN required THEN CAST(kind IN ('exact', 'close') AS INT) END), 1) * 0.7::DOUBLE + coalesce(avg(CASE WHEN NOT required THEN CAST(kind IN ('exact', 'close') AS INT) END), 1) * 0.3::DOUBLE) * 1000) AS BIGINT) AS accuracy FROM mt GROUP BY 1", c=CASES),
    "entity_coverage": over(f"SELECT test_id, {ENTITY} AS found FROM (SELECT test_id, lower(answer) AS low, lower(trim(entity)) AS name FROM c)", c=CASES),
    "fact_coverage": more(", k AS (SELECT test_id, lower(answer) AS low, list_transform(regexp_extract_all(fact, '\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE)) AS nums, list_transform(regexp_extract_all(lower(answer), '\\d+\\.?\\d*'), lambda x: TRY_CAST(x AS DOUBLE)) AS own, list_filter(regexp_extract_all(lower(fact), '\\b([a-z]{4,})\\b', 1), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in A.COMMON_WORDS) + ")) AS words FROM c) SELECT test_id, CASE WHEN len(words) = 0 THEN true ELSE len(list_filter(words, lambda w: contains(low, w)))::DOUBLE / len(words) >= 0.4 AND len(list_filter(nums, lambda n: n > 1 AND len(list_filter(own, lambda m: abs(m - n) < 0.1 OR abs(m - n) / n < 0.05)) = 0)) = 0 END AS holds FROM k", c=CASES),
    "overall_score": more(f", {SCORED} SELECT test_id, CAST(round(score * 100) AS BIGINT) AS score, passed FROM sc", c=CASES),
    "eval_report": more(f", {SCORED} SELECT difficulty, type, count(*) AS n, count(*) FILTER (WHERE passed) AS passed FROM sc GROUP BY GROUPING SETS ((), (difficulty), (type))", c=CASES),
    "eval_compare": more(f", {SCORED}, d AS (SELECT test_id, passed FROM sc) SELECT CASE WHEN length(test_id) % 3 <> 0 AND passed THEN 'newly_passing' WHEN length(test_id) % 3 = 0 AND NOT passed THEN 'newly_failing' ELSE 'consistent_failure' END AS kind, count(*) AS n FROM d WHERE NOT (length(test_id) % 3 = 0 AND passed) GROUP BY 1", c=CASES),
    "eval_failures": more(f", {SCORED}, fl AS (SELECT * FROM sc WHERE NOT passed), n AS (SELECT count(*) AS total FROM fl), di AS (SELECT DISTINCT * FROM i) SELECT 'difficulty' AS pattern, difficulty AS value, count(*) AS n FROM fl GROUP BY 2 HAVING count(*) > (SELECT total * 0.5 FROM n) UNION ALL SELECT 'type', type, count(*) FROM fl GROUP BY 2 HAVING count(*) > (SELECT total * 0.4 FROM n) UNION ALL SELECT 'issue', issue, count(*) FROM fl JOIN di USING (test_id) GROUP BY 2 HAVING count(*) >= 3", c=CASES, i=ISSUES),
    "issue_categorise": over(f"SELECT {ISSUE_KIND} AS kind, count(*) AS n FROM i GROUP BY 1", i=ISSUES),
    "issue_summary": over("SELECT issue, count(*) AS n, min(test_id) AS first_test, max(test_id) AS last_test FROM i GROUP BY 1", i=ISSUES),
    "eval_filtered": more(f", {SCORED} SELECT hallucinated, count(*) AS n, count(*) FILTER (WHERE passed) AS passed FROM sc WHERE type = 'factual' AND difficulty = 'hard' GROUP BY 1", c=CASES),
    "wilson_interval": more(f", {SCORED}, r AS (SELECT difficulty, (count(*) FILTER (WHERE passed))::DOUBLE / count(*) AS p, count(*)::DOUBLE AS n, 1.96::DOUBLE * 1.96::DOUBLE AS z2 FROM sc GROUP BY 1) SELECT difficulty, CAST(round(greatest(0, (p + z2 / (2 * n)) / (1 + z2 / n) - 1.96::DOUBLE * sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)) * 1000000) AS BIGINT) AS low, CAST(round(least(1, (p + z2 / (2 * n)) / (1 + z2 / n) + 1.96::DOUBLE * sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)) * 1000000) AS BIGINT) AS high FROM r", c=CASES),
    "ack_no_data": over("SELECT regexp_matches(lower(answer), '" + "|".join(A.NO_DATA).replace("'", "''") + "') AS admits, count(*) AS n FROM c GROUP BY 1", c=CASES),
    "forbidden_content": over("SELECT test_id FROM c WHERE contains(lower(answer), 'tolls') OR contains(lower(answer), 'lakh went')", c=CASES),
    "testcase_validate": over("SELECT concat_ws(',', CASE WHEN NOT required THEN 'entity' END, CASE WHEN type = 'list' THEN 'fact' END) AS missing, count(*) AS n FROM c GROUP BY 1", c=CASES),
    "dup_detect": more(f", b AS (SELECT report_id, {BODY} AS body FROM d), h AS (SELECT report_id, md5(left(body, 200)) AS h, count(*) AS n FROM b WHERE length(body) >= 50 GROUP BY ALL) SELECT report_id, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n) AS BIGINT) AS eligible FROM h GROUP BY 1", d=DOCS),
    "length_distribution": more(", s AS (SELECT report_id, list_sort(list(length(coalesce(text, '')))) AS l FROM d GROUP BY 1) SELECT report_id, len(l) AS total, len(list_filter(l, lambda x: x < 50)) AS too_short, len(list_filter(l, lambda x: x > 3000)) AS too_long, CAST(l[len(l) // 10 + 1] AS INT) AS p10, CAST(l[len(l) // 4 + 1] AS INT) AS p25, CAST(l[len(l) // 2 + 1] AS INT) AS p50, CAST(l[3 * len(l) // 4 + 1] AS INT) AS p75, CAST(l[9 * len(l) // 10 + 1] AS INT) AS p90, CAST(l[1] AS INT) AS least, CAST(l[-1] AS INT) AS most FROM s", d=DOCS),
    "diag_content": over("SELECT report_id, count(*) AS n, count(*) FILTER (WHERE length(trim(text)) < 10) AS empty, (SELECT count(*) FROM s WHERE page_start > page_end) AS inverted FROM d GROUP BY 1", d=DOCS, s=SECTIONS),
    "diag_findings": more(f", f AS (SELECT * REPLACE ('S' || page AS report_id) FROM g), {TOP} SELECT report_id, n, with_money, unsure, top, top_chapter, bad_chapter FROM ff", g=FINDINGS),
    "diag_hierarchy": more(", b AS (SELECT c.report_id, hierarchy_path, count(*) AS k FROM c LEFT JOIN s ON c.parent_id = s.section_id GROUP BY ALL) SELECT report_id, count(hierarchy_path) AS hierarchies, CAST(sum(k) AS BIGINT) AS chunks, max(k) AS largest, CAST(max(len(string_split(coalesce(hierarchy_path, ''), ' > '))) AS INT) AS depth FROM b GROUP BY 1", c=CHUNKS, s=SECTIONS),
    "diag_rec_gaps": more(", r AS (SELECT 'S' || (ord % 40) AS report_id, page AS number FROM f WHERE is_recommendation AND severity = 'high'), s AS (SELECT report_id, list(DISTINCT number) AS seen, min(number) AS lo, max(number) AS hi FROM r GROUP BY 1), m AS (SELECT report_id, list_filter(generate_series(lo, hi), lambda x: NOT list_contains(seen, CAST(x AS INT))) AS miss FROM s) SELECT report_id, CAST(len(miss) AS INT) AS missing, array_to_string(miss, ',') AS numbers FROM m", f=FINDINGS),
    "diag_entities": over(f"SELECT kind, count(*) AS n, count(*) FILTER (WHERE {NOISY}) AS noisy FROM e GROUP BY 1", e=ENTITIES),
    "entity_noise": over(f"SELECT DISTINCT name, {NOISY} AS noisy FROM e", e=ENTITIES),
    "verb_rec_fp": over("SELECT p_partkey, regexp_matches(left(text, 150), '" + "|".join(f"(?:{p})" for p in A.NO_RECOMMENDATION) + "') AND NOT regexp_matches(left(text, 200), '" + "|".join(f"(?:{p})" for p in A.A_RECOMMENDATION) + "') AS false_positive FROM r", r=RECS),
    "diag_xrefs": over("SELECT chapter, count(*) AS refs, count(target) AS resolved, CAST(round(count(target) * 100::DOUBLE / greatest(count(*), 1) * 10) AS BIGINT) AS permille FROM f GROUP BY 1", f=FINDINGS),
    "diag_score": over("SELECT p_partkey, CAST(greatest(0, 20 - CASE WHEN empty_pct > 10 THEN 8 WHEN empty_pct > 5 THEN 3 ELSE 0 END - CASE WHEN inversion_pct > 5 THEN 8 WHEN inversion_pct > 2 THEN 3 ELSE 0 END - CASE WHEN duplicate_pct > 15 THEN 6 WHEN duplicate_pct > 5 THEN 3 ELSE 0 END - CASE WHEN bad_length_pct > 25 THEN 5 WHEN bad_length_pct > 10 THEN 2 ELSE 0 END - CASE WHEN confidence > 0 AND confidence < 0.8 THEN 3 ELSE 0 END) AS INT) AS content, CAST(greatest(0, 25 - least(10, mismatches) - CASE WHEN concentration > 40 THEN 15 WHEN concentration > 20 THEN 8 WHEN concentration > 10 THEN 3 ELSE 0 END - CASE WHEN hierarchies < 5 THEN 10 WHEN hierarchies < 10 THEN 3 ELSE 0 END - CASE WHEN depths = 1 THEN 3 ELSE 0 END - least(5, orphans)) AS INT) AS hierarchy FROM m", m=MEASURES),
    "diag_score_v3": over("SELECT p_partkey, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM (SELECT p_partkey, CAST(greatest(0, 100 - depths * 15 - mismatches * 5 - orphans) AS INT) AS score FROM m)", m=MEASURES),
    "corpus_summary": more(f", {TOP} SELECT count(*) AS reports, CAST(sum(n) AS BIGINT) AS findings, CAST(sum(with_money) AS BIGINT) AS with_money, CAST(sum(unsure) AS BIGINT) AS unsure, count(*) FILTER (WHERE bad_chapter) AS bad_chapters, max(top) AS most FROM ff", f=FINDINGS),
    "suggest_amounts": more(f", {_suggested_sql()} SELECT unit, k, count(*) AS n, CAST(sum(instr(answer, found)) AS BIGINT) AS places, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hundredths FROM z GROUP BY ALL", c=CASES),
    "suggest_entities": over("SELECT entity, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(t, '(?i){p}', 1)" for p in A.SUGGESTED_ENTITIES) + "), lambda x: trim(x)))) AS entity FROM (SELECT answer || ' Under the Toll Act, 2003 on NH 44 in Tamil Nadu.' || entity AS t FROM c)) GROUP BY 1", c=CASES),
    "diag_tables": over("SELECT table_id, count(*) AS cells, count(*) FILTER (WHERE coalesce(normalized, parsed) IS NULL) AS empty, count(*) FILTER (WHERE row_type = 'header') AS headers, max(CAST(row_type = 'total' AS INT)) AS has_total, count(*) FILTER (WHERE coalesce(normalized, parsed) IS NULL) * 100 > greatest(count(*), 1) * 30 AS warn FROM c GROUP BY 1", c=CELLS_SQL),
    "sample_size": over("SELECT DISTINCT CAST(round(confidence * 10) AS INT) AS tenths, CAST(ceil(1.96::DOUBLE * 1.96::DOUBLE * confidence * (1 - confidence) / 0.0025::DOUBLE) AS BIGINT) AS n FROM m WHERE confidence > 0 AND confidence < 1", m=MEASURES),
    "chunk_confidence": over("SELECT p_partkey, CAST(round((CAST(confidence AS DECIMAL(4,2)) * CAST(0.4 AS DECIMAL(3,2)) + CAST(depths * 0.15 AS DECIMAL(4,2)) + CAST(orphans * 0.05 AS DECIMAL(4,2))) * 100) AS BIGINT) AS confidence FROM m", m=MEASURES),
}
ORACLE_SQL |= {
    "eval_failures_all": ORACLE_SQL["eval_failures"],
    "issue_counts": over("SELECT issue, count(*) AS n FROM i GROUP BY 1", i=ISSUES),
    "issue_tests": over("SELECT issue, test_id FROM i", i=ISSUES),
}
