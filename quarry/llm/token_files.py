"""Token files: Parquet list columns, and flat files without an index whose documents end with an identifier."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, scratch, slices, small_batches, strings, text_of
from quarry.llm.tokens import words

TOKENS = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
#: Documents of one Arrow batch that carries id lists between Python and the JVM hold about so many bytes of text.
BATCH_BYTES = 8 << 20
#: An end identifier beyond the vocabularies whose ids fit into 16 bits with it, so that a text's own special tokens count.
SEPARATOR = 65535


def write_parquet(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10) -> None:
    """Ids of every document and then ``end_id``, in ascending doc_id order, as Parquet files.

    The ids are a dictionary-encoded list column (its width adapts to the ids a row group uses) in row groups and pages
    of the given sizes; Spark's writer adds column and offset indexes. ``part`` and ``local_start`` place a document
    within its file, so readers get global offsets from one total per file. Null texts are empty documents; null ids
    come first; rows of equal ids stay, in the order of their texts.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = words(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = strings(batch, "text")
            sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
            for a, b in slices(sizes, BATCH_BYTES):
                ids, counts = encoder.encode(texts.slice(a, b - a))
                ends = np.cumsum(counts)
                full = np.insert(ids.astype(np.int32), ends, end_id)
                offsets = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
                starts = done + offsets[:-1]
                done += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(starts), pa.array(counts + 1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(full))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )

    ordered = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, TOKENS).write.option("compression", "snappy").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option(
        "parquet.enable.dictionary", "true"
    ).parquet(path)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, global start and n_tokens of every document, from the metadata columns alone."""
    meta = spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return meta.join(F.broadcast(_bases(spark, path)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each part. One row per file that was written, so small at any size of the corpus."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, its ids read from the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = np.asarray(lists.offsets)
            data = np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )

    rows = spark.read.parquet(path).select("doc_id", "part", "local_start", "ids").mapInArrow(digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(_bases(spark, path)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Flat files of unsigned 16-bit ids, each document followed by ``end_id``, without any index.

    Returns which document is the how-manieth of which file (file, n_bytes, place, doc_id), which the files don't tell.
    A task writes under a name of its own attempt, and only files of attempts that ended well are in the result.
    Ids must be below 65536 and differ from ``end_id``, which must lie beyond what the tokenizer gives; others are an
    error, so no id is lost.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = words(tokenizer), f"{folder}/tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u16"
        store, place = _open(file)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        done = 0
        with store.open_output_stream(place, compression=None) as out:
            for batch in batches:
                texts = strings(batch, "text")
                ids, counts = encoder.encode(texts)
                if len(ids) and int(ids.max()) > 65535:
                    raise ValueError("ids of more than 16 bits")
                if (ids == end_id).any():
                    raise ValueError(f"the end identifier {end_id} is an id of a text")
                out.write(np.insert(ids.astype("<u2"), np.cumsum(counts), end_id).tobytes())
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(np.arange(done, done + n)), batch.column("doc_id")], names=["file", "place", "doc_id"])
                done += n

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(write, "file string, place long, doc_id long")


def count_flat(files: DataFrame, end_id: int, block_bytes: int = 4 << 20) -> DataFrame:
    """Ids of every document in flat files: file, place (from 0) and n_tokens (without the end identifier).

    Files are cut into blocks that know nothing of documents. Each block is searched for end identifiers at once; a
    prefix scan over a file's blocks then gives the documents before each block and the last end before it, which
    completes the document that began in an earlier block.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, block = [], []
            for uri in batch.column("file").to_pylist():
                store, place = _open(uri)
                n = -(-store.get_file_info(place).size // block_bytes)
                file += [uri] * n
                block += range(n)
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(block, pa.int64())], names=["file", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                store, place = _open(uri)
                with store.open_input_file(place) as f:
                    f.seek(block * block_bytes)
                    ids = np.frombuffer(f.read(block_bytes), "<u2")
                ends = np.flatnonzero(ids == end_id) + block * (block_bytes // 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", "n_ends", "last_end", "ends"],
                )

    spread = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = files.select("file").distinct().mapInArrow(sizes, "file string, block long")
    found = blocks.repartition(spread, "file", "block").mapInArrow(scan, "file string, block long, n_ends long, last_end long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select(
        "file", "ends", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("carried")
    )
    lengths = F.transform(F.sequence(F.lit(0), F.size("ends") - 1), lambda i: F.get("ends", i) - F.when(i == 0, F.col("carried")).otherwise(F.get("ends", i - 1)) - 1)
    return placed.where(F.size("ends") > 0).select("file", "base", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("place"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str, end_id: int = SEPARATOR, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat token files.

    Every id counts, those of special tokens in a text too. Null texts have no tokens, null ids stay null, repeated rows
    count each, an empty table gives no rows.
    """
    placed = materialise(write_flat(docs, scratch(docs.sparkSession, "flat"), tokenizer, end_id), "flat-docs")
    # Spark takes the scan of a short list of files for small; it has a row per document.
    return placed.join(count_flat(placed, end_id, block_bytes).hint("merge"), ["file", "place"]).select("doc_id", "n_tokens")
