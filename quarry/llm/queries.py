"""Queries of the language-model operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact, jaccard, licenses, merkle, packing, pieces, quality, sql, suffix, tiff, token_files, trie, warc
from quarry.llm.common import read, scratch


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document by a model of trusted text, against its language's threshold."""
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_key")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by Viterbi over a SentencePiece file's pieces, the text they decode to, and the ids by merges."""
    return pieces.encode_decode(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files by their end identifiers."""
    return token_files.token_counts(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), token_files.SEPARATOR)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.best_fit(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to Parquet in doc_id order and read back."""
    path = scratch(spark, "tokens")
    token_files.write_parquet(read(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read_parquet(spark, path)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates: word 5-grams, similarity 0.8 or more."""
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"), n=5, threshold=0.8).drop("text_key", "keep_id", "keep_key")


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as TIFF and read back."""
    return tiff.media_digests(read(spark, sf_dir, "documents"), width=576)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with identical texts; the largest doc_id stays."""
    return exact.groups(read(spark, sf_dir, "documents"), keep="largest")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back through a two-level index."""
    return warc.archive(spark, read(spark, sf_dir, "pages"), least_bytes=0)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeated 400-byte strings cover; n_passage counts those of PASSAGE bytes."""
    kept = suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), length=400, passage=suffix.PASSAGE)
    return kept.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that every document names, and the places of the base phrases."""
    return licenses.scan(read(spark, sf_dir, "documents")).drop("found")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash tree over all documents by source, with each document's proof; half of them are found without their line breaks."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(tampered & F.contains("text", F.lit("\n")), merkle.leaf(text=F.replace("text", F.lit("\n"), F.lit(""))))
    proofs = merkle.manifest(read(spark, sf_dir, "documents"), found=found)
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of rebuilt conversations."""
    return trie.prefix_trie(read(spark, sf_dir, "conversations")).drop("tokens")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_files": op5_token_files,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_tiff_media": op7_tiff_media,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_warc": op9_warc,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_license_scan": op11_license_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op12_merkle_manifest": sql.manifest(),
    "op13_prefix_trie": sql.prefix_trie(),
}
