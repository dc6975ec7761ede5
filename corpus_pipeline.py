"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next.

Stages take documents with any further columns and give DOCUMENTS alone, the last one pieces. Null texts count as empty
and null ids stay null in all of them; an empty table gives an empty table of the same columns. A stage's scratch tables
live until the next stage of the same session begins, so pipelines that run side by side need sessions of their own
(``spark.newSession()``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from weakref import WeakKeyDictionary

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact, jaccard, packing, quality, suffix
from quarry.llm.common import materialise, read, recording, release, text_key

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Scratch tables of each session's last stage.
_tables: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()


def _stage(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that first deletes the scratch tables of the one before, whose result has been written by then."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _tables.setdefault(spark, []))
        with recording() as made:
            out = work(spark, docs, sf_dir)
        _tables[spark].extend(made)
        return out

    return run_stage


def _rows(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Rows of docs that are, or are not, among the chosen (doc_id, text_key)."""
    keys = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("text_key").alias("chosen_key"))
    same = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (text_key() == F.col("chosen_key"))
    return docs.select(*DOCUMENTS).join(keys, same, how)


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: those above their language's perplexity threshold go.

    Texts that are null, empty or without bytes to score have no perplexity and stay. Rows of equal doc_id and text are
    rated alike, so all of them go or stay. A language without trusted documents, null among
    them, takes the largest threshold of the others; without any trusted document nothing is rejected.
    """
    rated = quality.classify(docs, read(spark, sf_dir, "labels"))
    return _rows(docs, rated.where(~F.col("accepted")), "left_anti")


@_stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id; of rows equal in both, one.

    All null and empty texts are one text. A null doc_id is less than any other.
    """
    return exact.deduplicate(docs.select(*DOCUMENTS), keep="largest")


@_stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of least doc_id, of equal ones that of least text_key.

    Similarity is that of sets of word 5-grams, 0.8 or more. Texts without words are one class. Null ids come after all
    others. Rows equal in doc_id and text both stay; the stage before leaves none.
    """
    classes = jaccard.near_duplicates(docs, n=5, threshold=0.8)
    return _rows(docs, classes.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))), "left_semi")


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without what repeated strings of suffix.PASSAGE bytes cover.

    A passage of 50 words is the shortest that should go, and most have fewer than 400 bytes. A text may become empty
    but its document stays; n_chars is counted anew. Repeats within a text count; all copies of a passage go. Characters
    that a cut splits go whole.
    """
    kept = suffix.remove_repeats(docs.select(*DOCUMENTS), length=suffix.PASSAGE)
    return kept.select("row.doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 1024, a row for each piece of a document.

    An empty text is a piece of its end identifier alone; repeated rows are packed each; long texts are cut into pieces.
    """
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]

#: The model's perplexities, similarity classes and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with recording() as written:
            docs = materialise(out, name.replace(" ", "-"))
        release(spark, before)
        before = written
    release(spark, _tables.get(spark, []))
    return docs
