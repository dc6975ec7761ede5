"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, small_batches, strings, text_of
from quarry.llm.tokens import words

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that are placed together, from the longest to the shortest. At most a batch of Spark's, which has 2000 rows.
WINDOW = 2000
PACKED = PIECES + ", sequence_id long, offset long"


class OpenBins:
    """Bounded-space online best fit.

    At most ``most`` bins are open. ``free`` is a bitset of the free spaces that open bins have, so the best fit for a
    size is the lowest set bit at or above it. When no bin fits and all are open, the fullest closes.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free, self.count, self.opened = 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def put(self, size: int) -> tuple[int, int]:
        """Number of the bin that takes the piece, and its place there."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            own = self.bins[space].pop()
            if not self.bins[space]:
                self.free &= ~(1 << space)
            self.count -= 1
        else:
            if self.count == self.most:
                self._close_fullest()
            own, space = self.opened, self.capacity
            self.opened += 1
        left = space - size
        if left:
            self.bins.setdefault(left, []).append(own)
            self.free |= 1 << left
            self.count += 1
        return own, self.capacity - space

    def _close_fullest(self) -> None:
        space = (self.free & -self.free).bit_length() - 1
        self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.count -= 1


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of each document: its ids and then ``end_id``.

    A document of more than ``capacity`` ids is cut so that all pieces but the first are full. Null texts are empty
    documents of one id; a null doc_id stays null; repeated rows are documents of their own; other columns are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words(tokenizer)
        for batch in batches:
            ids, counts = encoder.encode(strings(batch, "text"))
            ends = np.cumsum(counts)
            data = ids.astype("<u4")
            doc, piece, start, length, crc = [], [], [], [], []
            for row, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                own = data[end - n : end].tobytes() + end_id.to_bytes(4, "little")
                at, to, k = 0, (n + 1) % capacity or capacity, 0
                while at <= n:
                    doc.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(own[4 * at : 4 * to]))
                    at, to, k = to, to + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return small_batches(docs).select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(cut, PIECES)


def pack(parts: DataFrame, capacity: int, open_bins: int, rows_per_task: int, window: int = WINDOW) -> DataFrame:
    """Sequence and offset for each piece.

    Full pieces are sequences of their own. The others are dealt out evenly by a hash of all their columns, so no source
    or group of copies meets in one task. There they arrive in the order of their documents, and ``window`` of them at a
    time are placed from the longest to the shortest, while bins stay open from window to window. What tasks lose by
    packing apart is a few bins each. Sequence ids hold the task's number in their upper bits.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() + 1) << 40
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            for a in range(0, batch.num_rows, window):
                part = batch.slice(a, window)
                part = part.take(pa.array(np.argsort(-part.column("length").to_numpy(), kind="stable")))
                put = [bins.put(n) for n in part.column("length").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([base + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())],
                    names=[*part.schema.names, "sequence_id", "offset"],
                )

    full = parts.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() - F.lit(2**62)).withColumn("offset", F.lit(0).cast("long"))
    rest = parts.where(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // rows_per_task))
    dealt = rest.repartition(tasks, F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.monotonically_increasing_id(), F.lit(997))))
    packed = dealt.sortWithinPartitions("doc_id", "piece", "ids_crc32", "length").mapInArrow(fill, PACKED)
    return full.unionByName(packed)


def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, open_bins: int = 1024, rows_per_task: int = 50_000) -> DataFrame:
    """Pieces of all documents with the sequence that holds them and their place there, gapless from 0.

    Of bins that a window leaves open those of least free space close first once there are ``open_bins``; with a bound of
    half a window hardly a window's own bins close before its short pieces come.

    Pieces are written to the shared folder before packing, so a lost executor costs no second tokenising.
    An empty table gives no rows.
    """
    return pack(materialise(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, open_bins, rows_per_task)
