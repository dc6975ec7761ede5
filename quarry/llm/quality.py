"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams and quantiles of its perplexity.

An n-gram of up to ORDER bytes is a key: its bytes, and its order in the byte above them. Dropping the last byte gives
the context, dropping the first the shorter n-gram, so counts, continuation counts, discounts and interpolation are
joins and aggregates of keys that Spark shards by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bucketed, materialise, recording, release, slices, small_batches, strings, text_key, text_of, utf8

#: A text begins after ORDER - 1 of these bytes, which UTF-8 has not.
START = 255
#: Width of a bin of the logarithm of perplexity for the quantiles.
BIN = 0.002
#: One in so many trusted documents is left out of the training and sets the thresholds.
CALIBRATING = 5
#: Nats per byte that are added to the threshold of a language with one trusted document, and to others' by the root of their number.
MARGIN = 0.6
MODEL = "key long, logp float, backoff float"


def keys_of(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The key of the ``order`` bytes that end at each byte of each text."""
    pad = order - 1
    size = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(pad * np.arange(1, len(size) + 1), size)
    padded = np.full(len(data) + pad * len(size), START, np.uint8)
    padded[at] = data
    key = np.full(len(at), order, np.uint64)
    for i in range(pad, -1, -1):
        key = (key << np.uint64(8)) | padded[at - i]
    return key.view(np.int64)


def _order_of(key: Column, order: int) -> Column:
    """n-gram of the next lower order: the same without its first byte."""
    return F.lit((order - 1) << (8 * (order - 1))).bitwiseOR(key.bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)))


def _context_of(key: Column, order: int) -> Column:
    """n-gram of the next lower order: the same without its last byte."""
    return F.shiftright(key, 8) - F.lit(1 << (8 * (order - 1)))


def train(counts: DataFrame, order: int = 5) -> DataFrame:
    """The model from key and n of the highest order's n-grams: for every n-gram the logarithm of its probability, and of its weight as a context.

    The highest order has counts, lower ones the number of different bytes seen before them. Each order's three
    discounts follow from how many of its n-grams have count 1, 2, 3 and 4. The lowest order is interpolated with the
    same probability for each of the 256 bytes. No trusted text gives an empty model, by which all bytes are equal.
    """
    levels = {order: materialise(counts, "counts")}
    for k in range(order - 1, 0, -1):
        levels[k] = materialise(levels[k + 1].groupBy(_order_of(F.col("key"), k + 1).alias("key")).agg(F.count("*").alias("n")), "counts")
    lower = None
    model = None
    for k in range(1, order + 1):
        of = levels[k].groupBy().agg(*(F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        n1, n2, n3, n4 = (max(x, 1) for x in of)
        y = n1 / (n1 + 2 * n2)
        d1, d2, d3 = (min(max(v, 0.05), i) for i, v in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = levels[k].withColumn("context", _context_of(F.col("key"), k)).withColumn("discount", discount)
        contexts = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("discount").alias("taken"))
        joined = own.join(contexts, "context").withColumn("weight", F.col("taken") / F.col("total"))
        kept = (F.col("n") - F.col("discount")) / F.col("total")
        if k == 1:
            rows = joined.select("key", "n", (kept + F.col("weight") / 256).alias("p"))
        else:
            low = lower.select(F.col("key").alias("short"), F.col("p").alias("short_p"))
            rows = joined.withColumn("short", _order_of(F.col("key"), k)).join(low, "short").select("key", "n", (kept + F.col("weight") * F.col("short_p")).alias("p"))
        lower = materialise(rows, "level")
        weights = contexts.select(F.col("context").alias("key"), (F.col("taken") / F.col("total")).alias("weight"))
        # the weight of a context stands with the n-gram of the order below
        part = lower.select("key", F.log("p").cast("float").alias("logp"), F.lit(None).cast("float").alias("backoff"))
        rest = weights.select("key", F.lit(None).cast("float").alias("logp"), F.log("weight").cast("float").alias("backoff"))
        both = part.unionByName(rest)
        model = both if model is None else model.unionByName(both)
    return model.groupBy("key").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"))


def substrings(keys: np.ndarray, order: int) -> np.ndarray:
    """All keys that scoring the n-grams may ask for: their endings, and the contexts of these."""
    keys = keys.astype(np.uint64)
    found = [keys]
    for k in range(order, 0, -1):
        if k < order:
            mask = np.uint64((1 << (8 * k)) - 1)
            keys = np.unique(np.uint64(k << (8 * k)) | (keys & mask))
            found.append(keys)
        found.append(np.unique((keys >> np.uint64(8)) - np.uint64(1 << (8 * (k - 1)))))
    return np.unique(np.concatenate(found)).view(np.int64)


def score(keys: np.ndarray, known: np.ndarray, logp: np.ndarray, backoff: np.ndarray, order: int) -> np.ndarray:
    """Natural logarithm of the probability of each n-gram's last byte by the entries of the model that there are."""
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))
    now = keys.view(np.uint64)
    if not len(known):
        return np.full(len(keys), -np.log(256))
    for k in range(order, 0, -1):
        own = now.view(np.int64)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = (known[at] == own) & ~np.isnan(logp[at])
        out[todo[hit]] += logp[at[hit]]
        todo, now = todo[~hit], now[~hit]
        context = ((now >> np.uint64(8)) - np.uint64(1 << (8 * (k - 1)))).view(np.int64)
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        weight = np.where((known[at] == context) & ~np.isnan(backoff[at]), backoff[at], 0)
        out[todo] += weight
        if k > 1:
            now = np.uint64((k - 1) << (8 * (k - 1))) | (now & np.uint64((1 << (8 * (k - 1))) - 1))
    out[todo] -= np.log(256)
    return out


def gather(docs: DataFrame, block_bytes: int = 32 << 20) -> DataFrame:
    """Documents in blocks of bounded size: block, ids, and the documents' columns as a compressed Arrow stream.

    The blocks are a table in the shared folder, bucketed by block, so that they meet what is joined to them without
    being shuffled again.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for a, b in slices(np.diff(utf8(strings(batch, "text"))[1]) + 16, 1 << 21):
                own = pa.Table.from_batches([batch.slice(a, b - a)])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_table(own)
                raw = sink.getvalue()
                if size and size + len(raw) > block_bytes:
                    block, size = block + 1, 0
                size += len(raw)
                ids = pa.array([own["doc_id"].to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([press.compress(raw)], pa.binary())], names=["block", "ids", "docs"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows.mapInArrow(fill, "block long, ids array<long>, docs binary"), "blocks", "block", parts, compression="uncompressed")


def count_ngrams(blocks: DataFrame, good: DataFrame, order: int) -> DataFrame:
    """key and n of all n-grams of the order in the blocks' documents that are among the good ids."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        trusted = right["doc_id"].combine_chunks()
        for blob in left["docs"].to_pylist() if len(trusted) else []:
            table = _table_of(blob)
            table = table.filter(pc.is_in(table["doc_id"], trusted))
            data, offsets = utf8(table["text"])
            for a, b in slices(np.diff(offsets), 1 << 20):
                own, n = np.unique(keys_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order), return_counts=True)
                both, place = np.unique(np.concatenate((keys, own)), return_inverse=True)
                keys, counts = both, np.bincount(place, weights=np.concatenate((counts, n))).astype(np.int64)
        return pa.table({"key": keys, "n": counts})

    trusted = blocks.select("block", F.explode("ids").alias("doc_id")).join(good, "doc_id", "left_semi").select(F.col("block").alias("of"), "doc_id").distinct()
    return blocks.groupBy("block").cogroup(trusted.groupBy("of")).applyInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _table_of(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as reader:
        return reader.read_all()


def perplexities(blocks: DataFrame, model: DataFrame, order: int = 5) -> DataFrame:
    """doc_id, text_key, lang, n_bytes and log_ppl, the mean negative log probability of a byte (null for empty texts).

    A block's different n-grams are joined with the sharded model, and what the join finds goes back to the block, where
    every byte of every document is scored.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                data, offsets = utf8(_table_of(blob)["text"])
                own = np.unique(keys_of(data, offsets, order))
                if block not in held and len(held) > 1:  # a task reads few blocks; what is asked twice is put together below
                    key = next(iter(held))
                    yield asked(key, held.pop(key))
                held[block] = np.union1d(held[block], own) if block in held else own
        for key, own in held.items():
            yield asked(key, own)

    def asked(block: int, own: np.ndarray) -> pa.RecordBatch:
        keys = substrings(own, order)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys)], names=["block", "key"])

    def rate(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right["key"].to_numpy()
        turn = np.unique(known, return_index=True)[1]  # parts of a block may ask for the same
        known = known[turn]
        logp, weight = (right[c].to_numpy()[turn] for c in ("logp", "backoff"))
        out = []
        for blob in left["docs"].to_pylist():
            table = _table_of(blob)
            data, offsets = utf8(table["text"])
            sums = np.zeros(table.num_rows)
            for a, b in slices(np.diff(offsets), 1 << 20):
                keys = keys_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], order)
                kinds, place = np.unique(keys, return_inverse=True)
                each = score(kinds, known, logp, weight, order)[place]
                total = np.concatenate(([0], np.cumsum(each)))
                sums[a:b] = total[offsets[a + 1 : b + 1] - offsets[a]] - total[offsets[a:b] - offsets[a]]
            size = np.diff(offsets)
            mean = pa.array(-sums / np.maximum(size, 1), pa.float64(), mask=size == 0)
            out.append(table.select(["doc_id", "text_key", "lang"]).append_column("n_bytes", pa.array(size)).append_column("log_ppl", mean))
        return pa.concat_tables(out)

    wanted = blocks.select("block", "docs").mapInArrow(ask, "block long, key long")
    answers = wanted.join(model, "key").select(F.col("block").alias("of"), "key", "logp", "backoff")
    return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(rate, "doc_id long, text_key long, lang string, n_bytes long, log_ppl double")


def thresholds(scored: DataFrame, quantile: float, margin: float) -> DataFrame:
    """lang (null is a language too) and the largest log_ppl that is accepted: the quantile of its trusted documents.

    A quantile of n documents is known to about 1 / sqrt(n), and is too low where n is small: that of a few is their largest
    value. So thresholds exceed it by margin / sqrt(n), one rule for all n. Quantiles are exact to BIN: counts of bins, summed in order, so a language of any size is no group in one task.
    """
    bins = scored.where(F.col("log_ppl").isNotNull()).groupBy("lang", F.floor(F.col("log_ppl") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("lang").orderBy("bin")
    every = Window.partitionBy("lang")
    summed = bins.select("lang", "bin", F.sum("n").over(up_to).alias("upto"), F.sum("n").over(every).alias("total"))
    return summed.where(F.col("upto") >= F.col("total") * quantile).groupBy("lang").agg(((F.min("bin") + 1) * BIN + margin / F.sqrt(F.max("total"))).alias("threshold"))


def calibrating(doc_id: Column) -> Column:
    """Is a trusted document kept from training, so that its perplexity is like that of other good documents?"""
    return F.pmod(F.xxhash64(doc_id), F.lit(CALIBRATING)) == 0


def classify(docs: DataFrame, labels: DataFrame, order: int = 5, quantile: float = 0.99, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, text_key, lang, n_bytes, log_ppl, threshold and accepted.

    Trusted documents are all that a label calls of good quality and not toxic. One in CALIBRATING of them, by a hash of
    the id, sets the thresholds; the model is trained on the others. A document is rejected when its mean negative log
    probability exceeds its language's threshold. A language without such documents takes the largest threshold of the
    others; with none at all everything is accepted.

    Null texts count as empty; empty texts have a null log_ppl and are accepted. Null ids have no label. Repeated rows
    are scored each; of repeated labels one good one suffices. Other columns are left out.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    with recording() as tables:
        blocks = gather(docs)
        model = materialise(train(count_ngrams(blocks, good.where(~calibrating(F.col("doc_id"))), order), order), "model")
        ratings = perplexities(blocks, model, order)
    scored = materialise(ratings, "scored")
    release(docs.sparkSession, tables)
    limits = thresholds(scored.join(good.where(calibrating(F.col("doc_id"))), "doc_id", "left_semi"), quantile, margin)
    # one row per language
    limits = materialise(limits, "limits")
    most = limits.agg(F.max("threshold")).first()[0]
    joined = scored.join(F.broadcast(limits.withColumnRenamed("lang", "of")), F.col("lang").eqNullSafe(F.col("of")), "left")
    threshold = F.coalesce("threshold", F.lit(most).cast("double"))
    return joined.select("doc_id", "text_key", "lang", "n_bytes", "log_ppl", threshold.alias("threshold"), F.coalesce(F.col("log_ppl") <= threshold, F.lit(True)).alias("accepted"))
