"""Keyword search, fusion, and what is made of the found chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import reports, tokens
from quarry.operators.prefix import saved
from quarry.operators.providers import Reranker
from quarry.operators.vectors import ranked

#: Constant of reciprocal rank fusion; ranks there begin at 0.
RRF_K = 60
#: Score of the best chunk from which a context counts as sufficient.
SUFFICIENT = 0.25


def payload_filter(df: DataFrame, conditions: dict) -> Column:
    """AND of conditions by column: None is skipped, a dict is a range (gte, lte, gt, lt), a list any of its values.

    On an array column a value or list matches if the array holds one of them. A null never matches.
    """
    kinds = dict(df.dtypes)
    parts = []
    for name, want in conditions.items():
        column = F.col(name)
        if want is None:
            continue
        if isinstance(want, dict):
            compare = {"gte": column.__ge__, "lte": column.__le__, "gt": column.__gt__, "lt": column.__lt__}
            parts += [compare[op](value) for op, value in want.items() if value is not None]
        elif kinds[name].startswith("array"):
            parts.append(F.arrays_overlap(column, F.array(*(F.lit(v) for v in (want if isinstance(want, list) else [want])))))
        elif isinstance(want, list):
            parts.append(column.isin(want))
        else:
            parts.append(column == F.lit(want))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def term_frequencies(chunks: DataFrame, key: str, text: str = "text", of_query: bool = False) -> DataFrame:
    """key, token and tf of every chunk."""
    return _tokens(chunks, key, text, of_query).groupBy(key, "token").agg(F.count("*").alias("tf"))


def _tokens(chunks: DataFrame, key: str, text: str, of_query: bool = False) -> DataFrame:
    """key and token, a row for each time that a text has it.

    The explode is an outer one: for an inner one Spark would cut texts a second time, to filter by their number of tokens.
    """
    make = tokens.query_tokens if of_query else tokens.index_tokens
    return chunks.select(key, F.explode_outer(make(F.col(text))).alias("token")).where("token is not null")


def sparse_vectors(chunks: DataFrame, key: str, text: str = "text", of_query: bool = False) -> DataFrame:
    """key, token and weight: keyword vectors by token string."""
    tf = term_frequencies(chunks, key, text, of_query)
    return tf.select(key, "token", tokens.weight(F.col("tf"), F.col("token"), of_query).alias("weight"))


def idf(tf: DataFrame, texts: DataFrame) -> DataFrame:
    """token, df and idf of (key, token) rows; ``texts`` is one row with the number of texts."""
    return idf_of(tf.groupBy("token").agg(F.count("*").alias("df")), texts)


def idf_of(df: DataFrame, texts: DataFrame) -> DataFrame:
    """The same of tokens and the number of texts that have them."""
    return df.crossJoin(F.broadcast(texts)).withColumn("idf", F.log((F.col("texts") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).drop("texts")


def _runs(every: Column) -> Column:
    """(token, tf) of a list of tokens in order."""
    begins = F.filter(F.transform(every, lambda t, i: F.when(~t.eqNullSafe(F.get(every, i - 1)), i)), lambda i: i.isNotNull())
    run = lambda at: F.transform(at, lambda i, n: F.struct(F.get(every, i).alias("token"), (F.coalesce(F.get(at, n + 1), F.size(every)) - i).cast("long").alias("tf")))
    return F.get(F.transform(F.array(begins), run), 0)


def tallies(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and bag, the (token, tf) of the index in order, of every row; rows that share a key are not put together.

    Tokens are put in order and counted where the text is, in time linear in them but for the sort: texts of any length may come.
    """
    every = F.sort_array(tokens.index_tokens(F.col(text)))
    return chunks.select(key, F.get(F.transform(F.array(every), _runs), 0).alias("bag"))


def parted(rows: DataFrame, key: str, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key no other row has, and those that may share it: told by hashes of keys (of ``keys`` if given), which alone are shuffled."""
    hashed = rows.withColumn("_hash", F.xxhash64(key))
    told = hashed if keys is None else keys.select(F.xxhash64(key).alias("_hash"))
    repeated = saved(told.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"), "repeated")
    return hashed.join(repeated, "_hash", "left_anti").drop("_hash"), hashed.join(repeated, "_hash", "left_semi").drop("_hash")


def bags(chunks: DataFrame, key: str, text: str = "text", only: list[str] | None = None, of_query: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """key and bag, a list of (token, tf), of each different key: of some tokens if given.

    Tokens are counted where the text is. ``keys`` are as in ``parted``. Only texts that share their key with others are shuffled; their keys are left out where they
    have no token.
    """
    once, again = parted(chunks.select(key, F.col(text).alias("text")), key, keys)
    if of_query:
        wanted = (lambda c: c) if only is None else (lambda c: F.filter(c, lambda t: t.isin(only)))
        count = lambda t, every: (F.size(every) - F.size(F.array_remove(every, t))).cast("long")
        counted = lambda every: F.transform(F.array_distinct(every), lambda t: F.struct(t.alias("token"), count(t, every).alias("tf")))
        # the tokens are named by a lambda: Spark would put their expression in each place and cut the text again for every token
        bag = F.get(F.transform(F.array(wanted(tokens.query_tokens(F.col("text")))), counted), 0)
    else:
        bag = tokens.index_bag(F.col("text"), only)
    own = once.select(key, bag.alias("bag"))
    shared = term_frequencies(again, key, of_query=of_query)
    shared = shared if only is None else shared.where(F.col("token").isin(only))
    return own.unionByName(shared.groupBy(key).agg(F.collect_list(F.struct("token", "tf")).alias("bag")))


def tally(chunks: DataFrame, key: str, text: str = "text", keys: DataFrame | None = None) -> DataFrame:
    """token, tf and n, the number of different keys that have the token so often.

    Tokens are counted where the texts are, for many texts at once; only texts that share their key are shuffled. ``keys`` are as in ``parted``.
    """
    once, again = parted(chunks.select(key, F.col(text).alias("text")), key, keys)
    own = once.select("text").mapInArrow(tokens.tallied, "token string, tf long, n long")
    shared = term_frequencies(again, key).groupBy("token", "tf").agg(F.count("*").alias("n"))
    return own.unionByName(shared.select("token", "tf", "n")).groupBy("token", "tf").agg(F.sum("n").alias("n"))


def postings_of(found: DataFrame, key: str) -> DataFrame:
    """key, token and tf of bags; the explode is an outer one, for the same reason as in ``_tokens``."""
    return found.select(key, F.explode_outer("bag").alias("b")).where("b is not null").select(key, "b.token", "b.tf")


def sparse_topk_of_texts(chunks: DataFrame, key: str, question: str, k: int, text: str = "text", keys: DataFrame | None = None) -> DataFrame:
    """The same as ``sparse_topk`` for texts without an index, which one question is not worth: they are cut once and scored where they are.

    ``keys`` are as in ``parted``.
    """
    spark = chunks.sparkSession
    asked = sparse_vectors(spark.createDataFrame([(0, question)], "q int, text string"), "q", of_query=True).select("token", F.col("weight").alias("asked"))
    found = saved(bags(chunks, key, text, sorted(r["token"] for r in asked.collect()), keys=keys), "asked")  # of one question
    rare = idf(postings_of(found, key), (chunks if keys is None else keys).agg(F.count("*").alias("texts"))).join(F.broadcast(asked), "token")
    by = rare.select("token", (F.col("asked") * F.col("idf")).alias("factor"), tokens.boost(F.col("token")).alias("boost")).collect()  # a row for each token of the question
    named = lambda c: F.create_map(*(F.lit(x) for r in sorted(by) for x in (r["token"], r[c]))) if by else F.create_map().cast("map<string,double>")
    factor, boost = named("factor"), named("boost")  # of each token, not told anew in each text
    score = F.aggregate("bag", F.lit(0.0), lambda s, b: s + b["tf"] / (b["tf"] + F.lit(tokens.K1)) * boost[b["token"]] * factor[b["token"]])
    return ranked(found.where(F.size("bag") > 0).select(key, F.round(score, 9).alias("score")), F.col("score"), key, k)


def sparse_topk(postings: Callable[[list[str]], DataFrame], texts: DataFrame, key: str, question: str, k: int) -> DataFrame:
    """key, score and rank of the k texts whose keyword vectors match the question best, tokens weighted by rarity.

    ``postings`` gives those of some tokens: only those of the question's tokens, of which there are a few, are read.
    ``texts`` is one row with the number of texts.
    """
    spark = texts.sparkSession
    asked = sparse_vectors(spark.createDataFrame([(0, question)], "q int, text string"), "q", of_query=True).select("token", F.col("weight").alias("asked"))
    found = postings(sorted(r["token"] for r in asked.collect()))  # of one question
    rare = idf(found, texts).join(F.broadcast(asked), "token")  # a row for each token of the question
    scored = found.join(F.broadcast(rare), "token").groupBy(key).agg(F.sum(tokens.weight(F.col("tf"), F.col("token")) * F.col("asked") * F.col("idf")).alias("score"))
    return ranked(scored, F.round("score", 9), key, k)


#: Errors of files that can't be found or read, when a query is planned or while it runs.
UNREADABLE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "FILE_NOT_EXIST", "UNABLE_TO_INFER_SCHEMA", "FileNotFoundException")


def hybrid_or_dense(dense: DataFrame, sparse: Callable[[], DataFrame], key: str, k: int) -> DataFrame:
    """Fusion of a dense and a keyword list; where the keyword index can't be read, the dense list alone.

    The keyword list, a few rows, is fetched here, so that files that vanish while it is read count too.
    """
    try:
        found = sparse()
        listed = dense.sparkSession.createDataFrame(found.collect(), found.schema)
    except FileNotFoundError:
        listed = None
    except (PySparkException, Py4JJavaError) as error:
        if not any(name in str(error) for name in UNREADABLE):
            raise
        listed = None
    if listed is None:
        return dense.where(F.col("rank") <= k).select(key, F.lit(1).cast("long").alias("lists"), "score", "rank")
    return hybrid_topk(dense, listed, key, k)


def rerank(hits: DataFrame, question: str, reranker: Reranker, key: str, k: int, path: str = "hierarchy_path", text: str = "text") -> DataFrame:
    """The k hits that a model finds best; it is shown a hit's text after the path of its section in brackets."""
    shown = F.concat(F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("["), F.col(path), F.lit("] "))).otherwise(F.lit("")), F.coalesce(text, F.lit("")))
    return ranked(hits.drop("score", "rank"), reranker.score(question, shown), key, k)


def best_of(df: DataFrame, by: str, limit: Column, key: str, digits: int = 4) -> DataFrame:
    """Rows of each group up to its own limit, by score and then key, with their place from 1.

    Scores are counted by their first digits and the counts summed in order, so only rows of nearly equal scores are
    sorted together, however large a group is.
    """
    binned = df.withColumn("_bin", F.floor(F.col("score") * 10**digits))
    counts = binned.groupBy(by, "_bin").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(by, "_bin").orderBy(F.desc("score"), key))
    rows = binned.join(counts.withColumn("_ahead", ahead).drop("_n"), [by, "_bin"])
    return rows.withColumn("place", F.col("_ahead") + own).where(F.col("place") <= limit).drop("_bin", "_ahead")


def fuse(lists: DataFrame, key: str, by: list[str] | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (rank from 1): key and the sum of 1 / (constant + rank - 1)."""
    share = F.lit(1.0) / (F.lit(constant) + F.col("rank") - 1)
    return lists.groupBy(*(by or []), key).agg(F.sum(share).alias("score"), F.count("*").alias("lists"))


def hybrid_topk(dense: DataFrame, sparse: DataFrame, key: str, k: int) -> DataFrame:
    """Fusion of a dense and a keyword list, cut to k."""
    both = dense.select(key, "rank").unionByName(sparse.select(key, "rank"))
    return ranked(fuse(both, key), F.round("score", 12), key, k)


def parse_chunk_id(chunk_id: Column) -> list[Column]:
    """report, page, kind and index of ids of the form <report>_child_p<page>_<kind>_<index>; null for others."""
    pattern = r"^(.+)_child_p(\d+)_(\w+)_(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(chunk_id, pattern, i), F.lit(""))
    return [part(1).alias("report"), part(2).cast("int").alias("page_no"), part(3).alias("kind"), part(4).cast("int").alias("index")]


def neighbours(chunks: DataFrame, *also: str) -> DataFrame:
    """chunk_id (and other columns) with the ids of the chunks right before and after it on its page: same report and kind, index off by one.

    The chunks of a kind on a page are looked at in order; gaps in the indices give no neighbour, and neither do ids of
    another form.
    """
    rest = ["_also.*"] if also else []
    parsed = chunks.select("chunk_id", *([F.struct(*also).alias("_also")] if also else []), *parse_chunk_id(F.col("chunk_id")))
    order = Window.partitionBy("report", "page_no", "kind").orderBy("index")
    beside = lambda move, step: F.when(move("index").over(order) == F.col("index") + step, move("chunk_id").over(order))
    usual = parsed.where(F.col("report").isNotNull()).select("chunk_id", *rest, beside(F.lag, -1).alias("previous_id"), beside(F.lead, 1).alias("next_id"))
    none = F.lit(None).cast("string")
    return usual.unionByName(parsed.where(F.col("report").isNull()).select("chunk_id", *rest, none.alias("previous_id"), none.alias("next_id")))


def group_by_parent(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Chunks by section: children from the best score down, sections by their best child; ties by id.

    Sections are ranked and counted (``parents``) within each value of ``by``; without it all meet in one task.
    """
    by = by or []
    grouped = hits.groupBy(*by, F.coalesce("parent_id", F.lit("unknown")).alias("parent_id")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "chunk_id"))).alias("sorted"), F.max("score").alias("best"), F.count("*").alias("children")
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("best"), "parent_id"))
    return grouped.select(*by, "parent_id", F.array_join(F.transform("sorted", lambda x: x["chunk_id"]), ",").alias("chunk_ids"), "best", "children", place.alias("parent_rank"), F.count("*").over(Window.partitionBy(*by)).alias("parents"))


def attention_place(rank: Column, n: Column) -> Column:
    """Place from 0 of the rank from 0 among n when best and worst are taken in turn; up to two stay in order."""
    return F.when(n <= 2, rank).when(2 * rank < n, 2 * rank).otherwise(2 * (n - 1 - rank) + 1)


def citations(hits: DataFrame, sections: DataFrame, reports: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Numbered citations of the hits, by section rank and score: report, section, page from 1, title ('' if unknown).

    Numbers begin anew with each value of ``by``; without it all hits meet in one task.
    """
    by = by or []
    best = Window.partitionBy(*by, "parent_id")
    order = Window.partitionBy(*by).orderBy(F.desc("best"), "parent_id", F.desc("score"), "chunk_id")
    # numbered while rows are narrow; titles and sections come after
    numbered = hits.select(*dict.fromkeys([*by, "report_id", "parent_id", "chunk_id", "page", "score"])).withColumn("best", F.max("score").over(best)).withColumn("id", F.row_number().over(order)).drop("best", "score")
    titled = numbered.join(reports.select("report_id", "title"), "report_id", "left")
    named = with_sections(titled, sections.select("section_id", "toc_entry", "hierarchy_path"))
    return named.select(
        "id", "report_id", F.coalesce("toc_entry", F.lit("Unknown")).alias("section"), F.coalesce("hierarchy_path", "toc_entry", F.lit("Unknown")).alias("hierarchy"),
        (F.col("page") + 1).alias("page"), F.coalesce("title", F.lit("")).alias("title"), "chunk_id",
    )


def with_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with the columns of their section (section_id, which is left out), null without one.

    Chunks without a parent are dealt by their own id: all of them would meet in one task by a null.
    """
    own = F.coalesce("parent_id", "chunk_id")
    return chunks.join(sections, (own == F.col("section_id")) & F.col("parent_id").isNotNull(), "left").drop("section_id")


def citation_map(cited: DataFrame, by: list[str] | None = None) -> DataFrame:
    """'section, p.page' and the last citation of it: keys that collide keep the later one."""
    return cited.groupBy(*(by or []), F.concat("section", F.lit(", p."), F.col("page").cast("string")).alias("key")).agg(F.max_by("chunk_id", "id").alias("chunk_id"), F.max("id").alias("id"))


def citation_entries(cited: DataFrame, by: str) -> DataFrame:
    """Keys under which an answer's citations are found: (by, known, place, entry) of citations (by, ord, entry, section, page_physical, page_logical).

    A citation has its normal form, its form without spaces and commas, and forms of its section and page numbers. Of
    citations with one key the last counts, at the place of the first.
    """
    section, page = reports.citation_section(F.col("entry")), reports.citation_page(F.col("entry"))
    short = F.when(page != 0, F.concat(section, F.lit("p"), page.cast("string")))
    digits, number = F.regexp_replace("page_logical", r"\D", ""), F.regexp_replace("section", r"[^\d.]", "")
    keys = F.array(reports.citation_key(F.col("entry")), F.regexp_replace(F.lower("entry"), r"[\s,]+", ""), short, F.concat(F.lit("section"), short), F.when((digits != "") & (number != ""), F.concat(number, F.lit("p"), digits)))
    rows = cited.select(by, "ord", F.struct("entry", "page_physical", "page_logical").alias("value"), F.posexplode(keys).alias("nth", "known")).where("known is not null")
    place = F.struct("ord", "nth")
    return rows.groupBy(by, "known").agg(F.max_by("value", place).alias("value"), F.min(place).alias("place")).select(by, "known", "place", "value.*")


def lookup_citations(asked: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """by, citation, entry and strategy of the different citations (by, citation) that are found among their answer's entries.

    Tried are 1 the normal form, 2 section and page, 3 the page, 4 parts of the normal form, the first entry each, and 5
    the page in a key if only one key has it. An answer's entries are few, so they are one list, in which each citation is looked up
    where it is: pairs of both are never rows.
    """
    text = F.col("citation")
    whole = F.get(F.regexp_extract_all("known", F.lit(r"p(\d+)"), 1), 0)
    lists = entries.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "known", "entry", "page_physical", "page_logical", whole.alias("on")))).alias("entries"))
    parsed = asked.select(by, "citation").repartition(by).distinct().select(by, "citation", reports.citation_key(text).alias("key"), reports.citation_section(text).alias("c_section"), reports.citation_page(text).alias("c_page"), F.get(F.regexp_extract_all(text, F.lit(r"(?i)p\.?\s*(\d+)"), 1), 0).alias("target"))
    terms = F.split("key", "p")
    # made before the lists are gone through, once a citation
    both = parsed.select("*", F.concat("c_section", F.lit("p"), F.col("c_page").cast("string")).alias("short"), F.col("c_page").cast("string").alias("page"), F.size(terms).alias("terms"), F.get(terms, 0).alias("part"), F.concat(F.lit("p"), F.element_at(terms, -1)).alias("last")).join(lists, by)
    numbered = F.col("c_page") != 0
    ways = (
        (F.lit(True), lambda e: e["known"] == F.col("key")),
        (numbered, lambda e: e["known"] == F.col("short")),
        (numbered, lambda e: (e["page_physical"] == F.col("c_page") - 1) | (e["page_logical"] == F.col("page"))),
        (F.col("terms") >= 2, lambda e: F.contains(e["known"], F.col("part")) & F.contains(e["known"], F.col("last"))),
    )
    named = lambda some, n: F.transform(some, lambda e: F.struct(e["entry"].alias("entry"), F.lit(n).alias("strategy")))
    first = [F.when(may, F.get(named(F.filter("entries", is_it), n), 0)) for n, (may, is_it) in enumerate(ways, 1)]
    on_page = F.filter("entries", lambda e: e["on"] == F.col("target"))
    alone = F.get(F.filter(named(on_page, 5), lambda x: (F.size(on_page) == 1) & x["entry"].isNotNull()), 0)
    return both.select(by, "citation", F.coalesce(*first, alone).alias("found")).where("found is not null").select(by, "citation", "found.entry", "found.strategy")


def has_semantic_data(finding_type: Column, severity: Column, crore: Column, recommends: Column) -> Column:
    """Is a chunk enriched at all? Empty texts and zero are nothing."""
    return (F.coalesce(finding_type, F.lit("")) != "") | (F.coalesce(severity, F.lit("")) != "") | (F.coalesce(crore, F.lit(0)) != 0) | F.coalesce(recommends, F.lit(False))


def semantic_tags(finding_type: Column, severity: Column, crore: Column, recommends: Column, target: Column) -> Column:
    """Display tags of a chunk's finding, ' | ' between them."""
    tags = F.array(
        F.when(F.coalesce(finding_type, F.lit("")) != "", F.concat(F.lit("Finding: "), F.initcap(F.replace(finding_type, F.lit("_"), F.lit(" "))))),
        F.when(F.coalesce(severity, F.lit("")) != "", F.concat(F.lit("Severity: "), F.upper(severity))),
        F.when(crore > 0, F.concat(F.lit("Amount: ₹"), F.round(crore, 2).cast("decimal(20,2)").cast("string"), F.lit(" crore"))),
        F.when(recommends, F.lit("Recommendation")),
        F.when(recommends & (F.coalesce(target, F.lit("")) != ""), F.concat(F.lit("To: "), target)),
    )
    return F.array_join(F.filter(tags, lambda x: x.isNotNull()), " | ")


def stars(score: Column) -> Column:
    return F.when(score > 0.85, "★★★").when(score > 0.7, "★★").otherwise("★")


def context(hits: DataFrame) -> DataFrame:
    """One context string per report of hits with toc_entry, hierarchy_path, pages, previous_text, text, next_text, tags and score.

    Sections follow their best child, children their score; neighbours lend their nearest 200 characters.
    """
    nth = F.row_number().over(Window.partitionBy("report_id", "parent_id").orderBy(F.desc("score"), "chunk_id"))
    best = F.max("score").over(Window.partitionBy("report_id", "parent_id"))
    lines = F.concat_ws(
        "\n",
        F.when(F.col("previous_text").isNotNull(), F.concat(F.lit("[...preceding]: "), F.right("previous_text", F.lit(200)))),
        F.concat(F.lit("[Source: "), F.col("toc_entry"), F.lit(", p."), (F.col("page") + 1).cast("string"), F.lit("]")),
        F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("]"), stars(F.col("score")), F.lit(" "), F.col("text")),
        F.when(F.coalesce("tags", F.lit("")) != "", F.concat(F.lit("  📋 "), F.col("tags"))),
        F.when(F.col("next_text").isNotNull(), F.concat(F.lit("[following...]: "), F.left("next_text", F.lit(200)))),
    )
    rows = hits.withColumn("nth", nth).withColumn("best", best).withColumn("lines", lines)
    sections = rows.groupBy("report_id", "parent_id").agg(
        F.first("best").alias("best"),
        F.concat(F.lit("## "), F.first("hierarchy_path"), F.lit(" (Pages "), (F.first("page_start") + 1).cast("string"), F.lit("-"), (F.first("page_end") + 1).cast("string"), F.lit(")\n\n")).alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "lines"))), lambda x: x["lines"]), "\n\n").alias("body"),
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("minus"), "parent_id", F.concat("head", "body").alias("section"))))
    return sections.groupBy("report_id").agg(F.array_join(F.transform(ordered, lambda x: x["section"]), "\n\n---\n\n").alias("context"))


def truncated(context_text: Column, most: Column) -> Column:
    """A context cut to the most characters, and a note where it was cut."""
    return F.when(F.length(context_text) > most, F.concat(F.left(context_text, most), F.lit("\n\n[Context truncated...]"))).otherwise(context_text)
