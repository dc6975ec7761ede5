"""Merkle manifest of a dataset: a hash tree over each group's rows in order, a tree over the groups, and a proof for each row.

A digest is the SHA-256 of its inputs put together, digests among them as hex text. A node has ARITY children, the last
of a level as many as are left. Rows are range-sorted, so a partition holds a run of each of its groups' leaves: it builds
the subtrees that are whole there, and only ragged nodes at the run's ends, a few for each level, are shuffled by their
coordinates (group, level, index). What is above them is finished in blocks of LEVELS levels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed, materialise, small_batches

ARITY = 3
#: Levels that one round of blocks finishes: a block has at most ARITY ** LEVELS nodes of its lowest level.
LEVELS = 8
#: Rows of a range partition, about; a task holds as many digests.
ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BORDER = "pid int, last boolean, grp string, n long, whole boolean"
BUILT = "entry boolean, grp string, place long, size long, level int, index long, digest binary, path binary, more binary"
CLIMBED = "top boolean, grp string, size long, level int, index long, up long, done boolean, digest binary, path binary"


def parent(children: Sequence[bytes]) -> bytes:
    return sha256(b"".join(children).hex().encode()).digest()


def depth(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    n, levels = leaves, 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def subtrees(digests: Sequence[bytes], first: int, size: int) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, bytes]]]:
    """Of leaves ``first`` and on of a tree of ``size``: the entries (level, index, digest), tops of the subtrees that are whole
    here, and for each leaf its entry's level and index and the siblings up to there.
    """
    levels = [(first, list(digests))]
    n = size
    while n > 1:
        low, nodes = levels[-1]
        high = low + len(nodes)
        up, end = -(-low // ARITY), -(-high // ARITY) if high == n else high // ARITY
        if end <= up:
            break
        levels.append((up, [parent(nodes[ARITY * p - low : ARITY * p - low + ARITY]) for p in range(up, end)]))
        n = -(-n // ARITY)
    entries: list[tuple[int, int, bytes]] = []
    above: list[tuple[int, int, bytes]] = []
    for level in range(len(levels) - 1, -1, -1):
        low, nodes = levels[level]
        up = levels[level + 1][0] if level + 1 < len(levels) else 0
        own = []
        for i, digest in enumerate(nodes):
            place = (low + i) // ARITY - up
            if 0 <= place < len(above):
                top, index, path = above[place]
                begin = max(ARITY * ((low + i) // ARITY) - low, 0)
                own.append((top, index, b"".join(nodes[begin:i] + nodes[i + 1 : begin + ARITY]) + path))
            else:
                entries.append((level, low + i, digest))
                own.append((level, low + i, b""))
        above = own
    return entries, above


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(column):
        return
    change = pc.indices_nonzero(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))).to_pylist()
    cuts = [0, *(c + 1 for c in change), len(column)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last group of a partition and their rows there; ``whole`` if it has one group only."""
    pid, groups = TaskContext.get().partitionId(), []
    for batch in batches:
        column = batch.column("grp")
        for a, b in _runs(column):
            name = column[a].as_py()
            if groups and groups[-1][0] == name:
                groups[-1][1] += b - a
            else:
                groups = groups[:1] + [[name, b - a]]
    if groups:
        ends = [groups[0], groups[-1]][: len(groups)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid] * len(ends), pa.int32()), pa.array([False, True][: len(ends)]), pa.array([g for g, _ in ends]), pa.array([n for _, n in ends], pa.int64()), pa.array([len(ends) == 1] * len(ends))],
            names=["pid", "last", "grp", "n", "whole"],
        )


def offsets(borders: list[tuple[int, bool, str, int, bool]]) -> dict[tuple[int, str], tuple[int, int]]:
    """First place and size of each group that several partitions share, by partition. Borders are in order of partitions."""
    out: dict[tuple[int, str], tuple[int, int]] = {}
    run: list[tuple[int, int]] = []
    name = None

    def close() -> None:
        total, ahead = sum(n for _, n in run), 0
        for pid, n in run if len(run) > 1 else ():
            out[pid, name] = (ahead, total)
            ahead += n

    for pid, _, grp, n, _ in borders:
        if grp != name:
            close()
            run, name = [], grp
        run.append((pid, n))
    close()
    return out


def build(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Leaves and entries of nodes (grp string, digest binary, more binary and the columns of ``order``), in a table: see BUILT.

    The driver gets two rows a partition, the number of rows of its first and last group: all other groups lie in one.
    """
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-nodes.count() // ROWS))
    keys = ["grp", *order, "digest", "tie"]
    fixed = checkpointed(nodes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("grp", "digest", "more"))
    ends = sorted(map(tuple, fixed.select("grp").mapInArrow(_borders, BORDER).collect()))
    known = spark.sparkContext.broadcast(offsets(ends))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        name, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            digests, more = (pa.chunked_array([b.column(c) for b in held]) for c in ("digest", "more"))
            first, size = known.value.get((pid, name), (0, len(digests)))
            digests = digests.to_pylist()
            entries, leaves = subtrees(digests, first, size)
            place = range(first, first + len(digests))
            levels, indexes, paths = zip(*leaves, strict=True)
            yield from _rows(False, name, place, [size] * len(digests), levels, indexes, digests, paths, more.combine_chunks())
            levels, indexes, digests = zip(*entries, strict=True)
            none = [None] * len(entries)
            yield from _rows(True, name, none, [size] * len(entries), levels, indexes, digests, none, pa.array(none, pa.binary()))

        for batch in batches:
            column = batch.column("grp")
            for a, b in _runs(column):
                if column[a].as_py() != name:
                    yield from close()
                    name, held = column[a].as_py(), []
                held.append(batch.slice(a, b - a))
        yield from close()

    return materialise(fixed.mapInArrow(work, BUILT), "merkle")


def _rows(entry: bool, name: str, place, size, level, index, digest, path, more: pa.Array) -> Iterator[pa.RecordBatch]:
    columns = [pa.array([entry] * len(more)), pa.array([name] * len(more)), *(pa.array(c, t) for c, t in ((place, pa.int64()), (size, pa.int64()), (level, pa.int32()), (index, pa.int64()), (digest, pa.binary()), (path, pa.binary()))), more]
    whole = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BUILT.split(", ")])
    for a in range(0, len(more), 2000):
        yield whole.slice(a, 2000)


def _climb(turn: int):
    """Finishes the levels of one block: its nodes' siblings up to the block's top, and the top itself."""

    def work(table: pa.Table) -> pa.Table:
        size = table["size"][0].as_py()
        name, block = table["grp"][0].as_py(), table["block"][0].as_py()
        first, end = LEVELS * turn, min(LEVELS * (turn + 1), depth(size))
        given = list(zip(*(table[c].to_pylist() for c in ("level", "index", "digest")), strict=True))
        levels: list[dict[int, bytes]] = [{} for _ in range(max(end - first, 0) + 1)]
        for level, index, digest in given:
            levels[level - first][index] = digest
        n = size
        for _ in range(first):
            n = -(-n // ARITY)
        sizes = [n]
        for k in range(len(levels) - 1):
            for p in sorted({i // ARITY for i in levels[k]}):
                levels[k + 1][p] = parent([levels[k][i] for i in range(ARITY * p, min(ARITY * p + ARITY, sizes[k]))])
            sizes.append(-(-sizes[k] // ARITY))
        above: dict[int, bytes] = {i: b"" for i in levels[-1]}
        paths: dict[tuple[int, int], bytes] = {(first + len(levels) - 1, i): b"" for i in above}
        for k in range(len(levels) - 2, -1, -1):
            own = levels[k]
            above = {i: b"".join(own[j] for j in range(ARITY * (i // ARITY), min(ARITY * (i // ARITY) + ARITY, sizes[k])) if j != i) + above[i // ARITY] for i in own}
            paths |= {(first + k, i): p for i, p in above.items()}
        done = depth(size) <= LEVELS * (turn + 1)
        top = 0 if done else block
        rows = [(False, name, size, level, index, top, done, None, paths[level, index]) for level, index, _ in given]
        rows.append((True, name, size, LEVELS * (turn + 1), top, top, done, levels[-1][top], None))
        kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CLIMBED.split(", ")])

    return work


def climb(entries: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of each round of blocks with their siblings within the block, and the blocks' tops; ``most`` leaves has the largest tree."""
    rounds: list[DataFrame] = []
    for turn in range(depth(most) // LEVELS + 1):
        low, high = LEVELS * turn, LEVELS * (turn + 1)
        nodes = entries.where((F.col("level") >= low) & (F.col("level") < high)).select("grp", "size", "level", "index", "digest")
        if rounds:
            nodes = nodes.unionByName(rounds[-1].where("top and not done").select("grp", "size", "level", "index", "digest"))
        below = F.lit(high) - F.col("level")
        block = F.floor(F.col("index") / F.pow(F.lit(float(ARITY)), below.cast("double"))).cast("long")
        rounds.append(materialise(nodes.withColumn("block", block).groupBy("grp", "block").applyInArrow(_climb(turn), CLIMBED), "climb"))
    return rounds


def _forest(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The leaves of each group's tree, and the rounds above them."""
    built = build(nodes, order)
    most = built.agg(F.max("size")).first()[0] or 0
    return built.where("not entry"), climb(built.where("entry"), most)


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """grp and digest of each tree's top."""
    found = [r.where("top and done").select("grp", "digest") for r in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _above(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """grp, level, index, path to the tree's top and the columns of ``roots`` (grp, ...) for every entry: from the last round down.

    A key is a block's top or a tree's, so at most ARITY ** LEVELS nodes of a level meet in it.
    """
    known = None
    for turn in range(len(rounds) - 1, -1, -1):
        own = rounds[turn].where("not top").select("grp", "level", "index", "up", "done", "path")
        full = own.where("done").drop("up", "done").join(roots, "grp")
        if known is not None:
            upper = known.where(F.col("level") == LEVELS * (turn + 1)).drop("level").withColumnRenamed("index", "up").withColumnRenamed("path", "rest")
            low = own.where("not done").drop("done").join(upper, ["grp", "up"]).withColumn("path", F.concat("path", "rest")).drop("up", "rest")
            full = full.unionByName(low.select(*full.columns))
        known = full if known is None else full.unionByName(known)
    return known


def prove(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per node with its proof: grp, more, digest, place and size in its group, path, and of the group group_place, groups,
    group_path, subroot and root. Paths are the siblings' digests from the node's level up.
    """
    leaves, rounds = _forest(nodes, order)
    tops = materialise(_tops(rounds).select(F.lit("").alias("grp"), F.col("grp").alias("group"), "digest", F.encode("grp", "utf-8").alias("more"), F.lit(0).alias("tie")), "tops")
    groups, upper = _forest(tops, ["group"])
    root = _above(upper, _tops(upper).select("grp", F.col("digest").alias("root")))
    joined = groups.join(root.withColumnRenamed("path", "rest"), ["grp", "level", "index"])
    named = joined.select(F.decode("more", "utf-8").alias("grp"), F.col("place").alias("group_place"), F.col("size").alias("groups"), F.concat("path", "rest").alias("group_path"), F.col("digest").alias("subroot"), "root")
    above = materialise(_above(rounds, materialise(named, "groups")), "above")
    found = leaves.join(above.withColumnRenamed("path", "rest"), ["grp", "level", "index"])
    return found.select("grp", "more", "digest", "place", "size", F.concat("path", "rest").alias("path"), "group_place", "groups", "group_path", "subroot", "root")


def folded(digest: bytes, place: int, size: int, path: bytes) -> bytes:
    """The top of a tree from a leaf's digest and its siblings."""
    at = 0
    while size > 1:
        first = place // ARITY * ARITY
        others, own = min(ARITY, size - first) - 1, place - first
        siblings = path[at : at + 32 * others]
        digest = sha256((siblings[: 32 * own] + digest + siblings[32 * own :]).hex().encode()).digest()
        at, place, size = at + 32 * others, place // ARITY, -(-size // ARITY)
    return digest


def encoded(name: str, value: Column | None = None) -> Column:
    """A field of a leaf: its UTF-8 length, a colon and its value as text; - for null."""
    text = (F.col(name) if value is None else value).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[str] = FIELDS, **changed: Column) -> Column:
    """Digest of a row's fields, some of them perhaps changed."""
    return F.unhex(F.sha2(F.concat(*(encoded(f, changed.get(f)) for f in fields)), 256))


def manifest(docs: DataFrame, group: str = "source", key: str = "doc_id", fields: Sequence[str] = FIELDS, found: Column | None = None) -> DataFrame:
    """One row per document: the key, its group, its leaf and proof (see ``prove``), and whether the digest ``found`` of the
    row as it is found now (its leaf again where null) leads to the root: folded_root and verified.

    Groups are ordered by name (null first, bytewise), leaves in a group by key (null first) and then by leaf, so repeated
    rows stand side by side and each has a leaf of its own. A group of any size is split over partitions. Texts are hashed
    in place and never shuffled. Null fields are told from empty ones. An empty table has no rows. Other columns are left out.
    """
    # "" for null and = before others keeps the order
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    now = F.lit(None).cast("binary") if found is None else found
    rows = docs.select(name.alias("grp"), F.col(key).cast("long").alias("key"), leaf(fields).alias("digest"), now.alias("now"), F.monotonically_increasing_id().alias("tie"))
    rows = materialise(rows, "leaves")
    # the key and the digest found travel with a leaf as bytes
    packed = F.concat(F.when(F.col("key").isNull(), F.lit("-")).otherwise(F.col("key").cast("string")).cast("binary"), F.lit("|").cast("binary"), F.coalesce("now", F.lit(b"")))
    proofs = prove(rows.select("grp", "key", "digest", packed.alias("more"), "tie"), ["key"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(c).to_pylist() for c in ("more", "digest", "place", "size", "path", "group_place", "groups", "group_path", "root")}
            keys, proof, tops, fine = [], [], [], []
            for more, digest, place, size, path, group_place, groups, group_path, root in zip(*get.values(), strict=True):
                own, _, other = more.partition(b"|")
                top = folded(folded(other or digest, place, size, path), group_place, groups, group_path)
                keys.append(None if own == b"-" else int(own))
                proof.append(sha256((path + group_path).hex().encode()).hexdigest())
                tops.append(top.hex())
                fine.append(top == root)
            own = [batch.column(c) for c in ("grp", "place", "size", "path", "group_path")]
            hexed = [pa.array([x.hex() for x in batch.column(c).to_pylist()], pa.string()) for c in ("digest", "subroot", "root")]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *own, *hexed, pa.array(proof, pa.string()), pa.array(tops, pa.string()), pa.array(fine, pa.bool_())], names=["key", "grp", "place", "size", "path", "group_path", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "key long, grp string, place long, size long, path binary, group_path binary, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = small_batches(proofs).mapInArrow(check, schema)
    return out.select(F.col("key").alias(key), F.when(F.col("grp") != "", F.substring("grp", 2, 2**31 - 1)).alias(group), "place", "size", "leaf", "subroot", "root", "path", "group_path", "proof_sha256", "folded_root", "verified")
