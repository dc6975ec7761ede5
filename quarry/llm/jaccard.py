"""Similarity join of documents on their word n-gram sets: MinHash banding, then full verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, ranges, slices, small_batches, strings, text_key, text_of, utf8
from quarry.llm.graph import components

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Documents, and bytes of text, of a bucket that one task compares with as many others.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Shared n-grams that one matrix product of a block takes.
COLUMNS = 16384
#: Fewest documents of a block around one centre that are taken as linked by it.
CORE = 8


def choose_bands(threshold: float, recall: float, most_hashes: int = 96) -> tuple[int, int]:
    """Bands and rows: the most rows for which bands that reach the recall at the threshold need no more hashes."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most_hashes:
            best = (max(bands, 1), rows)
    return best


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def ngrams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every text's word n-grams in order, and their number for each text.

    Words are the lower-cased runs between white space. A text of fewer words has one n-gram of all its words, a text
    without words none.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    at = np.asarray(lists.offsets).astype(np.int64)
    at, flat = at - at[0], lists.flatten()
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices)
    known = coded.dictionary.to_numpy(zero_copy_only=False)
    word = pd.util.hash_array(known.astype(object), categorize=False).astype(np.uint64) if len(known) else np.zeros(0, np.uint64)
    word[known == ""] = 0  # splitting leaves empty words at a text's ends
    h = word[codes] if len(codes) else np.zeros(0, np.uint64)
    real = h != 0
    if not real.all():
        at = np.concatenate(([0], np.cumsum(real)))[at]
        h = h[real]
    size = np.diff(at)
    counts = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    begin = ranges(at[:-1], counts)
    left = np.repeat(at[1:], counts) - begin  # words from here to the text's end
    out = np.full(len(begin), ODD)
    for i in range(n):
        out = mix(out + np.where(left > i, padded[begin + i], np.uint64(i + 1)))
    return out, counts


def _reduce(op: np.ufunc, values: np.ndarray, counts: np.ndarray, empty: int) -> np.ndarray:
    """op over each text's values; ``empty`` where there are none."""
    out = np.full(len(counts), empty, np.uint64)
    some = counts > 0
    if some.any():
        out[some] = op.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def signatures(texts: pa.Array, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's n-gram sequence, and the hashes of its bands of MinHash values."""
    grams, counts = ngrams(texts, n)
    place = np.arange(len(grams), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
    first = _reduce(np.add, mix(grams + place * ODD), counts, 0)
    second = _reduce(np.add, mix(mix(grams ^ ODD) + place), counts, 1)
    turns = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * ODD)
    out = np.empty((len(counts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(counts), turns[band])
        for k in range(band * rows, (band + 1) * rows):
            key = mix(key ^ _reduce(np.minimum, (grams ^ turns[2 * k]) * (turns[2 * k + 1] | np.uint64(1)), counts, 0))
        out[:, band] = key
    return np.stack((first, second), axis=1), out


def _sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch, "text")
            size = np.diff(utf8(texts)[1])
            for a, b in slices(size):
                whole, band = signatures(texts.slice(a, b - a), n, bands, rows)
                whole, band = whole.view(np.int64), band.view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a), pa.array(np.ascontiguousarray(whole[:, 0])), pa.array(np.ascontiguousarray(whole[:, 1])), lists, pa.array(size[a:b])],
                    names=["doc_id", "text_key", "seq1", "seq2", "bands", "size"],
                )

    rows_of = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("text"))
    return rows_of.mapInArrow(sign, "doc_id long, text_key long, seq1 long, seq2 long, bands array<long>, size long")


def least_tied(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row that links connect it to."""
    least = np.arange(len(near))
    while True:
        new = np.minimum(least, np.where(near, least[None, :], len(near)).min(axis=1, initial=len(near)))
        new = np.minimum(new, new[new])
        if (new == least).all():
            return least
        least = new


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: do the sets with these numbers have a Jaccard similarity of the threshold or more?"""
    size = np.array([len(s) for s in sets], np.float64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = number[column[use]], owner[use]
    inter = np.zeros((len(left), len(right)), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for c in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (c, c + COLUMNS))
        matrix = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - c)), np.float32)
        matrix[owner[a:b], column[a:b] - c] = 1
        inter += matrix[left] @ matrix[right].T
    return inter >= threshold * (size[left][:, None] + size[right][None, :] - inter) - 1e-9


def met_before(buckets: list[np.ndarray], own: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Boolean matrix: do the documents with these numbers share a bucket before their ``own``, where they meet now?"""
    values, owner = np.concatenate(buckets), np.repeat(np.arange(len(buckets)), [len(x) for x in buckets])
    values, owner = values[values < own], owner[values < own]
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    use = count[column] > 1
    matrix = np.zeros((len(buckets), int((count > 1).sum())), np.float32)
    matrix[owner[use], number[column[use]]] = 1
    return matrix[left] @ matrix[right].T > 0


def around_centres(grams: np.ndarray, counts: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Two hashes of the centre that each document lies around, zeros for none.

    A centre is the set of n-grams that over half of the documents have which no earlier centre took. The Jaccard
    distance is a metric, so documents within half of the largest distance of a link from one centre are all linked.
    """
    out = np.zeros((len(counts), 2), np.uint64)
    values, column = np.unique(grams, return_inverse=True)
    if not len(values):
        return out
    owner, column = np.divmod(np.unique(np.repeat(np.arange(len(counts)), counts) * len(values) + column), len(values))
    size = np.bincount(owner, minlength=len(counts))
    free = np.ones(len(counts), bool)
    while free.sum() >= least:
        centre = 2 * np.bincount(column[free[owner]], minlength=len(values)) > free.sum()
        shared = np.bincount(owner, weights=centre[column], minlength=len(counts))
        near = free & (shared >= (1 + threshold) / 2 * (size + centre.sum() - shared) + 1e-9)
        if near.sum() < least:
            break
        out[near] = mix(values[centre]).sum(), mix(mix(values[centre] ^ ODD)).sum()
        free &= ~near
    return out


def _by_key(work: Callable[[pa.Table], pa.RecordBatch], keys: list[str]):
    """For mapInArrow: ``work`` on the rows of each key, which stream in sorted, one row a node."""

    def whole(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        return work(table.take(pa.array(np.unique(table["node"].to_numpy(), return_index=True)[1])))  # repeated rows of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key is not None and tuple(own[a]) != key:
                    yield whole(held)
                    held = []
                key = tuple(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield whole(held)

    return run


def _centred(n: int, threshold: float, least: int):
    """The centre of each document that lies around one of its block."""

    def find(table: pa.Table) -> pa.RecordBatch:
        grams, counts = ngrams(table["text"].combine_chunks(), n)
        keys = around_centres(grams, counts, threshold, least)
        some = keys.any(axis=1)
        keys = keys[some].view(np.int64)
        return pa.RecordBatch.from_arrays([table["node"].combine_chunks().filter(pa.array(some)), table["copies"].combine_chunks().filter(pa.array(some)), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1]))], names=["node", "copies", "key1", "key2"])

    return _by_key(find, ["bucket", "part"])


LINKS = "node long, tie long, links long"


def _verify(n: int, threshold: float):
    """Links within blocks of buckets: a row per linked document, its links and the least one it is tied to.

    A pair counts in the first bucket that its documents share, and not here if both lie around one centre.
    """

    def check(table: pa.Table) -> pa.RecordBatch:
        node, side, copies, core = (table[c].to_numpy() for c in ("node", "side", "copies", "core"))
        bucket, i, j = (table[c][0].as_py() for c in ("bucket", "i", "j"))
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links, tie = np.zeros(len(node), np.int64), np.arange(len(node))
        lists = table["buckets"].combine_chunks()
        new = ~met_before(np.split(lists.flatten().to_numpy(), np.asarray(lists.offsets)[1:-1]), bucket, left, right)
        new &= (core[left][:, None] != core[right][None, :]) | (core[left] < 0)[:, None]
        if i == j:
            np.fill_diagonal(new, False)
        left, right, new = left[new.any(axis=1)], right[new.any(axis=0)], new[np.ix_(new.any(axis=1), new.any(axis=0))]
        if new.any():
            both, place = np.unique(np.concatenate((left, right)), return_inverse=True)
            grams, counts = ngrams(table["text"].combine_chunks().take(pa.array(both)), n)
            ends = np.cumsum(counts)
            sets = [np.unique(grams[e - c : e]) for e, c in zip(ends, counts, strict=True)]
            near = np.zeros((len(node), len(node)), bool)
            near[np.ix_(left, right)] = linked(sets, place[: len(left)], place[len(left) :], threshold) & new
            near |= near.T
            links, tie = near @ copies, least_tied(near)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[tie[some]]), pa.array(links[some])], names=["node", "tie", "links"])

    return _by_key(check, ["bucket", "i", "j"])


def _blocks(n: Column, size: Column) -> Column:
    """Blocks of at most about BLOCK documents and BLOCK_BYTES, and of one document at least."""
    return F.least(F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)), n).cast("int")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 128) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, its number of links, the size of its class and the class's keep_id and keep_key.

    Two documents are linked when the Jaccard similarity of their sets of word ``n``-grams is ``threshold`` or more;
    a class is what links connect, named by its least doc_id; n_links counts all documents linked to this one.

    Texts of equal word sequences are one node. Nodes are shuffled by the hashes of their bands of MinHash values, and
    those in one bucket compared in full, in blocks of at most BLOCK by BLOCK documents and about BLOCK_BYTES, over as
    many tasks as a bucket needs. Buckets of the same nodes are compared once, and a pair that shares several buckets
    counts in the first, so links are exact but for the recall, and pairs are counted, never emitted. Only verified links
    are followed for classes.

    Nodes of buckets of several blocks are first compared with the centre of a block, which grows with their number
    alone: those around equal centres are linked by the triangle inequality (``around_centres``) and counted by a sum,
    and are not compared with one another. All other pairs are.

    Null texts count as empty; texts without words are one class; texts of fewer than ``n`` words have one n-gram.
    Null ids stay null and name a class only if it has no other. keep_id and keep_key are the doc_id and text_key of one
    member, that of the least id and then key, null ids last. Repeated rows count as documents. Other columns are
    left out.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    signed = materialise(_sign(docs, n, bands, rows), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    nodes = materialise(
        signed.groupBy("seq1", "seq2")
        .agg(least.alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("size").alias("size"))
        .select(F.monotonically_increasing_id().alias("node"), "seq1", "seq2", "first.doc_id", "first.text_key", "copies", "bands", "size"),
        "nodes",
    )
    banded = nodes.select("node", "size", F.explode("bands").alias("band"))
    sets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("nodes"), F.sum("size").alias("bytes")).where("n > 1")
    # buckets of one number of nodes, least node and hash of all are of the same nodes
    buckets = sets.groupBy("n", "least", "nodes").agg(F.min("band").alias("bucket"), F.max("bytes").alias("bytes"))
    sized = buckets.select("bucket", _blocks(F.col("n"), F.col("bytes")).alias("blocks"))
    members = materialise(banded.withColumnRenamed("band", "bucket").join(sized, "bucket"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_key().alias("own_key"), text_of().alias("text"))
    same_row = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))
    named = nodes.select("node", "doc_id", "text_key", "copies")
    homes = members.where("blocks > 1").groupBy("node").agg(F.max(F.struct("blocks", "bucket", "size")).alias("home")).select("node", "home.bucket", "home.size")
    parts = homes.groupBy("bucket").agg(_blocks(F.count("*"), F.sum("size")).alias("parts"))
    split = homes.join(parts, "bucket").select("node", "bucket", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    homed = split.join(named, "node").join(texts, same_row).select("bucket", "part", "node", "copies", "text")
    around = homed.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node").mapInArrow(_centred(n, threshold, CORE), "node long, copies long, key1 long, key2 long")
    around = materialise(around, "centred")
    centres = around.groupBy("key1", "key2").agg(F.min("node").alias("core"), F.sum("copies").alias("core_copies"))
    cores = materialise(around.join(centres, ["key1", "key2"]).select("node", "core", "core_copies"), "cores")
    # a bucket's sides: one of a small bucket, else those of each core, which meet all others, and those of the rest, which meet all
    of = members.join(cores.select("node", "core"), "node", "left").withColumn("core", F.coalesce("core", F.lit(-1)))
    of = of.withColumn("group", F.when(F.col("blocks") > 1, F.col("core")).otherwise(F.lit(-1)))
    groups = of.groupBy("bucket", "group").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("core").alias("low"), F.max("core").alias("high"))
    groups = groups.where("group >= 0 OR low <> high OR low < 0").withColumn("own", _blocks(F.col("n"), F.col("bytes")))
    before = Window.partitionBy("bucket").orderBy("group")
    groups = groups.select("bucket", "group", "own", (F.sum("own").over(before) - F.col("own")).cast("int").alias("at"), F.sum("own").over(Window.partitionBy("bucket")).cast("int").alias("sides"))
    groups = groups.withColumn("to", F.when(F.col("group") < 0, 0).otherwise(F.col("at") + F.col("own"))).withColumn("meets", (F.col("at") > 0) | (F.col("to") < F.col("sides")))
    sided = of.join(groups, ["bucket", "group"]).withColumn("side", (F.col("at") + F.pmod(F.xxhash64("node"), F.col("own"))).cast("int"))
    listed = sided.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("bucket", "side", "at", "to", "sides", "meets"))).alias("own"), F.first("core").alias("core"))  # one of each band at most
    wanted = listed.where(F.exists("own", lambda x: x["meets"])).join(named, "node")
    found = wanted.join(texts, same_row)
    placed = found.select("node", "core", "copies", "text", F.transform("own", lambda x: x["bucket"]).alias("buckets"), F.explode(F.filter("own", lambda x: x["meets"])).alias("met")).select("*", "met.*")
    none = F.array().cast("array<int>")
    below = F.when(F.col("at") > 0, F.sequence(F.lit(0), F.col("at") - 1)).otherwise(none)
    above = F.when(F.col("to") < F.col("sides"), F.sequence("to", F.col("sides") - 1)).otherwise(none)
    dealt = placed.withColumn("other", F.explode(F.concat(below, above))).select(
        "bucket", F.least("side", "other").cast("int").alias("i"), F.greatest("side", "other").cast("int").alias("j"), "side", "node", "core", "copies", "buckets", "text"
    )
    checked = materialise(dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(_verify(n, threshold), LINKS), "checked")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    ties = checked.select("node", "tie").unionByName(cores.select("node", F.col("core").alias("tie"))).where("node <> tie")
    roots = components(ties.select(F.col("node").alias("a"), F.col("tie").alias("b")))
    tied = nodes.select("node", "seq1", "seq2", "doc_id", "text_key", "copies").join(roots, "node", "left").join(links, "node", "left").join(cores, "node", "left")
    same = F.coalesce("core_copies", "copies") - 1
    tied = tied.select("seq1", "seq2", "doc_id", "text_key", "copies", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + same).alias("n_links"))
    classes = tied.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), least.alias("keep"))
    rated = tied.join(classes, "root").select("seq1", "seq2", "class_id", "class_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_key").alias("keep_key"), "n_links")
    return signed.select("doc_id", "text_key", "seq1", "seq2").join(rated, ["seq1", "seq2"]).select("doc_id", "text_key", "class_id", "n_links", "class_size", "keep_id", "keep_key")
