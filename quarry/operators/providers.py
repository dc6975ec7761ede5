"""Plug-ins for models, each with a deterministic default that needs no network."""

from __future__ import annotations

import json
import re
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import reports as R


class Embedder(Protocol):
    """Adds a vector column to texts."""

    def embed(self, df: DataFrame, text: str) -> DataFrame: ...


class Reranker(Protocol):
    """Score of a text for a question, as an expression."""

    def score(self, question: str, text: Column) -> Column: ...


class Enhancer(Protocol):
    """Plan for a question: kind, queries, filters and sizes."""

    def plan(self, question: str) -> dict: ...


class HashedWords:
    """Vectors of word counts by hash, of unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+").transform(df.where(F.col(text).isNotNull()))
        counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=self.size).transform(words)
        return Normalizer(inputCol="_tf", outputCol="_unit").transform(counted).withColumn("embedding", vector_to_array("_unit")).drop("_words", "_tf", "_unit")


class WordOverlap:
    """Share of a question's words that a text holds."""

    def score(self, question: str, text: Column) -> Column:
        words = sorted(set(re.findall(r"[a-z0-9]{2,}", question.lower())))
        hits = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))
        return hits / F.lit(max(len(words), 1))


class RuleEnhancer:
    """Kind of a question by its words, and the sizes for that kind."""

    def plan(self, question: str) -> dict:
        low = question.lower()
        kind = next((n for n, words in R.QUESTION_WORDS if any(w in low for w in words)), "factual")
        top_k, candidates, chars = R.RETRIEVAL_PARAMS[kind]
        return {"question_type": kind, "queries": [question], "filters": {}, "top_k": top_k, "candidates": candidates, "max_context_chars": chars, "style": R.STYLES[kind]}


def plan_of_reply(question: str, reply: str, most: int = 3) -> dict:
    """Plan from a model's JSON reply: at most ``most`` queries, the question first and not repeated; the rules' plan if it can't be read."""
    found = re.search(r"\{.*\}", reply or "", re.S)
    try:
        given = json.loads(found[0]) if found else {}
    except ValueError:
        given = {}
    if not given:
        return {"question_type": "factual", "queries": [question], "filters": {}, "top_k": 10, "candidates": 50, "max_context_chars": 15000, "style": None}
    sizes = given.get("retrieval_params", {})
    queries = [question, *(q for q in given.get("expanded_queries", []) if q != question)][:most]
    return {"question_type": given.get("question_type", "factual"), "queries": queries, "filters": given.get("suggested_filters", {}), "top_k": sizes.get("top_k", 10), "candidates": sizes.get("initial_candidates", 50), "max_context_chars": sizes.get("max_context_chars", 15000), "style": given.get("recommended_style")}


def merged_filters(own: dict | None, suggested: dict | None) -> dict:
    """A caller's filters, and suggested ones only for what the caller left open."""
    return {**(suggested or {}), **(own or {})}


def per_query_limit(candidates: int, queries: int) -> int:
    return max(candidates // max(queries, 1), 20)
