"""Prefix trie of conversations: what they share from their first turn on, and the tokens that sharing saves.

A node is a sequence of first turns; its members are the conversations that begin with it. The smallest member owns a
node, so each conversation owns the last part of its path, perhaps nothing, and (owner, depth) names a node.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, small_batches
from quarry.operators.prefix import running, segmented

#: Conversations after a multiple of this begin like that one; most turns that they take from it.
FAMILY, MOST_TURNS = 100, 5
#: Parts into which a node's members are dealt before its owner is found.
SALTS = 16
#: Ids of one piece of a node's list.
PIECE = 8192
NODE = ("depth", "k1", "k2")


def _half(content: Column, first: int) -> Column:
    """64 of the bits of a hexadecimal digest."""
    return F.conv(F.substring(content, first, 16), 16, -10).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, 128 bits of (role, text) and the text's code points; ``tie`` tells repeated rows."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), content.alias("content"), F.char_length(text).cast("long").alias("tokens"))
    return rows.select("conv_id", "turn", "role", _half(F.col("content"), 1).alias("hi"), _half(F.col("content"), 17).alias("lo"), "tokens", F.monotonically_increasing_id().alias("tie"))


def head(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its family: a number below MOST_TURNS + 1 by the CRC-32 of its id."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_TURNS + 1)).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns of those rebuilt: conv_id, place (which only tells their order), hi, lo and tokens."""
    order = ["turn", "role", "hi", "lo", "tie"]
    numbered = materialise(running(segmented(turns, ["conv_id"], order, materialise), ["conv_id"], order, sums={"n": F.lit(1)}).select("conv_id", F.col("n").alias("place"), "hi", "lo", "tokens"), "turns")
    convs = materialise(numbered.select("conv_id").distinct(), "convs")
    # at most MOST_TURNS rows of a family's first, for at most FAMILY conversations
    first = numbered.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("place") <= MOST_TURNS)).withColumnRenamed("conv_id", "first_id")
    taken = convs.withColumn("first_id", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).join(first, "first_id").where(F.col("place") <= head(F.col("conv_id"))).drop("first_id")
    own = numbered.where(F.col("place") > head(F.col("conv_id"))).withColumn("place", F.col("place") + MOST_TURNS)
    return convs, taken.unionByName(own)


def paths(turns: DataFrame) -> DataFrame:
    """The nodes on each conversation's path, the root among them: conv_id, depth, k1 and k2 (its 128-bit key), p1 and p2 (its
    parent's), tokens of its last turn, ``upto`` of all turns so far, ``upto_all`` of the conversation, its ``length``, and whether it ends here.

    A key is the exclusive or of the turns' digests with their depths, so a long conversation's are running totals too.
    """
    convs, rows = rebuilt(turns)
    by, order = ["conv_id"], ["place"]
    placed = running(segmented(rows, by, order, materialise), by, order, sums={"depth": F.lit(1).cast("long"), "upto": F.col("tokens")})
    salted = placed.withColumns({"t1": F.xxhash64("hi", "lo", "depth"), "t2": F.xxhash64("depth", "lo", "hi", F.lit(1))})
    keyed = running(materialise(salted, "placed"), by, order, xors={"k1": F.col("t1"), "k2": F.col("t2")})
    nodes = keyed.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("p2"), "tokens", "upto", "upto_all", F.col("depth_all").alias("length"))
    nodes = materialise(nodes, "paths")
    zero = F.lit(0).cast("long")
    top = convs.join(nodes.where("depth = 1").select("conv_id", "upto_all", "length"), "conv_id", "left")
    root = top.select("conv_id", *(zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "tokens", "upto")), F.coalesce("upto_all", zero).alias("upto_all"), F.coalesce("length", zero).alias("length"))
    return materialise(root.unionByName(nodes).withColumn("ends", F.col("depth") == F.col("length")), "nodes")


def owned(members: DataFrame) -> DataFrame:
    """conv_id, own_depth (the first node that it owns), ``ahead`` (tokens before that) and whether its last node is its own and childless.

    Members of a node are dealt to SALTS parts by id and summed there; a window over the parts marks the least.
    """
    first = F.min(F.struct("conv_id", (F.col("upto") - F.col("tokens")).alias("ahead"))).alias("first")
    parts = members.groupBy(*NODE, F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")).agg(first, F.count("*").alias("n"), F.sum(F.col("ends").cast("long")).alias("ends"))
    node = Window.partitionBy(*NODE)
    marked = parts.select("depth", "first", F.row_number().over(node.orderBy("first.conv_id")).alias("nth"), (F.sum("n").over(node) == F.sum("ends").over(node)).alias("childless")).where("nth = 1")
    return marked.groupBy("first.conv_id").agg(F.min("depth").alias("own_depth"), F.min_by("first.ahead", "depth").alias("ahead"), F.max("childless").alias("leaf"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal nodes, in order of ids, as pieces of their list of ids."""
    node, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*node, ids[0])), pa.array([",".join(map(str, ids))], pa.string())], names=["depth", "k1", "k2", "first", "ids"])

    for batch in batches:
        for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if ids and (own != node or len(ids) >= PIECE):
                yield piece()
                ids = []
            node = own
            ids.append(conv)
    if ids:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which stream in order: a task holds one of them."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([digest.hexdigest()])], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if own != node:
                if digest:
                    yield row()
                node, digest = own, sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if digest:
        yield row()


def ending(members: DataFrame) -> DataFrame:
    """ends_sha256 of every node at which conversations end: of their ids, ascending, joined by commas.

    A node's ids are dealt by ranges of ids and joined to pieces there, so one task reads a node's pieces, not its rows.
    """
    spark = members.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    last = small_batches(members).where("ends").select(*NODE, "conv_id")
    pieces = last.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashes, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    and saved_tokens of its subtree, ends_sha256, and tokens of its last text, which are code points.

    Turns of a conversation are ordered by turn, null first, then role, then the hash of role and text; repeated rows are
    turns each. Null roles and texts count as empty. Rows without conv_id belong to no conversation and are left out. Every
    conversation is rebuilt: the first turns of its family's first, as many as ``head`` says, then its own after as many. One
    without turns is a member of the root. An empty table has no rows. Other columns are left out.

    Conversations and nodes of any size are split over tasks: paths are running totals over segments, and members are summed
    before they are shuffled.
    """
    members = paths(materialise(turns_of(conversations), "read"))
    marks = owned(members)
    rows = members.join(marks, "conv_id", "left")
    own = F.col("own_depth").isNotNull()
    shared = F.when(~own | (F.col("depth") < F.col("own_depth")), F.coalesce("ahead", "upto_all") - (F.col("upto") - F.col("tokens"))).otherwise(0)
    child = own & (F.col("depth") + 1 >= F.col("own_depth")) & (F.col("depth") < F.col("length"))
    # the smallest member, which owns the node: its parent too unless the node is the first that it owns
    first = F.min(F.struct("conv_id", "own_depth", "p1", "p2", "tokens")).alias("first")
    nodes = materialise(
        rows.groupBy(*NODE).agg(first, F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(False)).cast("long")).alias("n_leaves"), F.sum(shared).alias("saved_tokens"))
        .select(*NODE, "first.*", "n_convs", "n_children", "n_leaves", "saved_tokens"),
        "trie",
    )
    named = nodes.join(ending(members), list(NODE), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    begins = (F.col("depth") == F.col("own_depth")) & (F.col("depth") > 0)
    looked = named.where(begins).join(above, ["depth", "p1", "p2"])
    same = named.where(~begins).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "tokens"]
    return looked.select(*columns).unionByName(same.select(*columns))
