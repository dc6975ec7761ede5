"""Removal of every byte that a long repeated string covers, by suffix arrays of the places that can hold one.

A string of ``length`` bytes that occurs twice holds, at the same place, the window minimum of its GRAM-byte hashes. So
window starts are put together in cells, maximal runs of starts with the same minimum, and equal windows always lie in
cells of the same minimum. Minima that occur once end there. Cells of equal bytes are counted, not compared; one of
each kind goes on, and cells of one minimum meet in one shard (or a few, where a minimum has very many kinds of cells),
whose suffix array settles which windows are equal.

Several lengths are settled at once: cells are those of the least length, and carry the bytes that the greatest needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, ranges, slices, small_batches, strings, text_key, text_of, utf8
from quarry.llm.jaccard import ODD, mix

GRAM = 64
#: Bytes of a passage of over 50 words, by which 99 in 100 strings of 51 words of the sample tables are found.
PASSAGE = 240
#: Window starts that a cell holds at most; longer runs are several cells.
CELL = 1024
#: Text bytes of a vectorised step, and bytes from which a shard's suffix array is built; its arrays then fit a cache.
STEP, SHARD = 1 << 18, 1 << 17
#: Kinds of cells of one minimum beyond which they are dealt to several shards.
HOT = 1024
BASE = 0x9E3779B97F4A7C15
CELLS = "doc_id long, text_key long, s int, n int, size int, f long, ch long, occ int"


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on; the last GRAM - 1 positions have none."""
    x = b.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    for width in (8, 16, 32):
        x = mix(x)
        x = x[:-width] * np.uint64(BASE) + x[width:]
    return mix(x)


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x, done = op(x[:-done], x[done:]), 2 * done
    return op(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def cells_of(b: np.ndarray, offsets: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Cells of texts that stand one after the other: text number, first start, starts, size, minimum, contents' hash, occurrences.

    Windows have ``length`` bytes; a cell's contents reach ``reach`` bytes from its last start, or to the text's end.
    Occurrences of the minimum in a text are given with its first cell there.
    """
    width = length - GRAM + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if len(b) < length:
        return none
    h = gram_hashes(b)
    low = sliding(np.minimum, h, width)
    size = np.diff(offsets)
    valid = np.zeros(len(low), bool)
    valid[ranges(offsets[:-1][size >= length], size[size >= length] - length + 1)] = True
    if not valid.any():
        return none
    new = np.empty(len(low), bool)
    new[0], new[1:] = True, (low[1:] != low[:-1]) | ~valid[:-1]
    at = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.append(valid[:-1] & (new[1:] | ~valid[1:]), valid[-1])) + 1
    runs = -(-(stop - at) // CELL)
    number = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    s = np.repeat(at, runs) + number * CELL
    n = np.minimum(np.repeat(stop, runs) - s, CELL)
    f, text = low[s], np.searchsorted(offsets, s, side="right") - 1
    # a gram is an occurrence if it is the minimum of a window that holds it
    top = sliding(np.maximum, np.concatenate((np.zeros(width - 1, np.uint64), np.where(valid, low, np.uint64(0)), np.zeros(width - 1, np.uint64))), width)
    held = np.flatnonzero(top[: len(h)] == h)
    pair = np.concatenate((np.stack((np.searchsorted(offsets, held, side="right") - 1, h[held].view(np.int64)), 1), np.stack((text, f.view(np.int64)), 1)))
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    fresh = np.append(True, (pair[order][1:] != pair[order][:-1]).any(axis=1))
    own = np.empty(len(pair), np.int64)
    own[order] = np.cumsum(fresh) - 1
    held_own, cell_own = own[: len(held)], own[len(held) :]
    count = np.bincount(held_own, minlength=int(own.max()) + 1)
    first = np.zeros(len(s), bool)
    first[np.unique(cell_own, return_index=True)[1]] = True
    occ = np.where(first, count[cell_own], 0)
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(h), np.uint64(BASE)))))
    back = np.uint64(pow(BASE, -1, 1 << 64))
    inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(h), back))))
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(h ^ ODD) * power[: len(h)])))
    have = np.minimum(n - 1 + reach, offsets[text + 1] - s)
    ch = mix((total[s + have - GRAM + 1] - total[s]) * inverse[s] + (n + (have << 32)).astype(np.uint64))
    return text, s - offsets[text], n, have, f.view(np.int64), ch.view(np.int64), occ


def suffix_order(b: np.ndarray, need: np.ndarray, depths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the ascending depths, the suffixes with the start flagged in ``need`` by their first bytes, and the group of each.

    Larsson-Sadakane: a suffix is numbered by the place where its group begins; each round sorts only the groups of more
    than one suffix by the number of the suffix further on, which doubles the depth. A round ends at each of ``depths``,
    and the next goes on from there.
    """
    words = b.astype(np.uint64)
    for width in (1, 2, 4):
        after = np.concatenate((words[width:], np.zeros(min(width, len(b)), np.uint64)))
        words = (words << np.uint64(8 * width)) | after
    order = np.argsort(words)
    rank = np.zeros(len(b) + depths[-1], np.int64)

    def number(slots: np.ndarray, own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.append(True, keys[1:] != keys[:-1])
        head = np.maximum.accumulate(np.where(start, np.arange(len(keys)), 0))
        rank[own] = slots[head]
        alone = start & np.append(start[1:], True)
        return slots[~alone], own[~alone]

    slots, own = number(np.arange(len(b)), order, words[order])
    done = 8
    for depth in depths:
        while done < depth and len(own):
            step = min(done, depth - done)
            both = (rank[own] << 32) | rank[own + step]
            turn = np.argsort(both)
            order[slots] = own[turn]
            done += step
            slots, own = number(slots, own[turn], both[turn])
        done = max(done, depth)
        kept = order[need[order]]
        yield kept, rank[kept]


def common_prefixes(b: np.ndarray, order: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix shares with the one before it in ``order``.

    Kasai: where a suffix and the one before it both move on by one byte and are neighbours again, the prefix is one
    byte shorter, so bytes are compared only at the end of such runs. Suffixes of different groups share less than
    ``most`` and get 0.
    """
    out = np.zeros(len(order), np.int64)
    pair = np.flatnonzero(group[1:] == group[:-1]) + 1
    if not len(pair):
        return out
    before = np.full(len(b) + 1, -2, np.int64)
    before[order[pair]] = order[pair - 1]
    at = np.sort(order[pair])
    last = before[at + 1] != before[at] + 1
    ends = at[last]
    strings_at = np.lib.stride_tricks.sliding_window_view(np.concatenate((b, np.zeros(most, np.uint8))), most)
    shared = np.full(len(ends), most)
    for a, c in slices(np.full(len(ends), most), 1 << 20):
        differ = strings_at[ends[a:c]] != strings_at[before[ends[a:c]]]
        some = differ.any(axis=1)
        shared[a:c][some] = differ.argmax(axis=1)[some]
    run = np.searchsorted(np.flatnonzero(last), np.arange(len(at)))
    found = np.zeros(len(b) + 1, np.int64)
    found[at] = np.minimum(shared[run] + ends[run] - at, most)
    out[pair] = found[order[pair]]
    return out


def repeated_starts(b: np.ndarray, left: np.ndarray, depths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth, flags of the starts whose bytes to that depth also begin at another start, and the number of each start's group.

    ``left`` has the bytes from a start to the end of its text, 0 where no string of interest begins; -1 is the group of
    places with fewer than the depth.
    """
    for depth, (order, group) in zip(depths, suffix_order(b, left > 0, depths), strict=True):
        whole = left[order] >= depth
        order, group = order[whole], group[whole]
        shared = common_prefixes(b, order, group, depth) >= depth
        again = shared | np.append(shared[1:], False) if len(shared) else shared
        out = np.zeros(len(b), bool)
        out[order[again]] = True
        number = np.full(len(b), -1, np.int64)
        number[order] = group
        yield out, number


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of set flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def window_digests(b: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """First 16 bytes of the SHA-256 of each window."""
    data = b.tobytes()
    raw = b"".join(hashlib.sha256(data[i : i + length]).digest()[:16] for i in starts.tolist())
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


SPANS = "doc_id long, text_key long, length int, a long, b long"
RUNS = "f long, bucket int, shard int, d1 array<long>, d2 array<long>, single array<boolean>, ids array<long>, keys array<long>, places array<long>"
SETTLED = SPANS + ", " + RUNS
_SPAN = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
_LISTS = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _settle(lengths: list[int]):
    """Suffix arrays over cells that stream in by minimum and shard: the repeated spans of cells that no other equals.

    Where a minimum's cells are in several shards, each shard also gives its kinds of windows, in sorted runs of digests.
    """

    def settle_rows(rows: list[dict]) -> pa.RecordBatch:
        sizes = np.array([len(r["bytes"]) for r in rows])
        at = np.cumsum(sizes) - sizes
        b = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        starts = np.array([r["n"] for r in rows])
        copies = np.array([r["copies"] for r in rows])
        place = ranges(at, starts)
        left = np.zeros(len(b), np.int64)
        left[place] = np.repeat(at + sizes, starts) - place
        shards: dict[tuple, list[int]] = {}
        for k, r in enumerate(rows):
            if r["shards"] > 1:
                shards.setdefault((r["f"], r["shard"], r["buckets"]), []).append(k)
        out: list[tuple] = []
        for length, (again, number) in zip(lengths, repeated_starts(b, left, lengths), strict=True):
            x, y = runs_of(again)
            cell = np.searchsorted(at, x, side="right") - 1  # a run ends with its cell, whose last bytes are no starts
            for k, i, j in zip(cell.tolist(), (x - at[cell]).tolist(), (y - at[cell]).tolist(), strict=True):
                r = rows[k]
                if r["copies"] == 1:
                    out.append((r["doc_id"], r["text_key"], length, r["s"] + i, r["s"] + j - 1 + length, *[None] * 9))
            for (f, shard, buckets), own in shards.items():
                place = ranges(at[own], starts[own])
                cell = np.repeat(own, starts[own])
                whole = number[place] >= 0
                place, cell = place[whole], cell[whole]
                if not len(place):
                    continue
                _, kind = np.unique(number[place], return_index=True)  # one start of each kind of window
                place, cell = place[kind], cell[kind]
                digest = window_digests(b, place, length).view(np.int64)
                single = ~again[place] & (copies[cell] == 1)
                bucket = digest[:, 1] % buckets
                order = np.lexsort((digest[:, 1], digest[:, 0], bucket))
                place, cell, digest, single, bucket = place[order], cell[order], digest[order], single[order], bucket[order]
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    told = [(rows[c]["doc_id"], rows[c]["text_key"], rows[c]["s"] + p) for c, p in zip(cell[i:j].tolist(), (place[i:j] - at[cell[i:j]]).tolist(), strict=True)]
                    out.append((None, None, length, None, None, f, int(bucket[i]), shard, digest[i:j, 0], digest[i:j, 1], single[i:j], *map(list, zip(*told, strict=True))))
        return _batch(out, _names(SETTLED), [*_SPAN, pa.int64(), pa.int32(), pa.int32(), *_LISTS])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, key = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size >= SHARD and (row["f"], row["shard"]) != key:
                    yield settle_rows(held)
                    held, size = [], 0
                key = (row["f"], row["shard"])
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield settle_rows(held)

    return settle


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of one shard that another shard of the same minimum has too.

    A shard gives a kind of window once, so the runs of all shards are sorted together, and binary search tells whether
    a window stands there more than once.
    """

    def joined(run: dict) -> np.ndarray:
        out = np.empty(len(run["d1"]), "i8,i8")
        out["f0"], out["f1"] = run["d1"], run["d2"]
        return out

    def merge_runs(runs: list[dict]) -> pa.RecordBatch:
        out: list[tuple] = []
        digests = [joined(r) for r in runs]
        every = np.sort(np.concatenate(digests), order=("f0", "f1"))
        for digest, run in zip(digests, runs, strict=True):
            todo = np.flatnonzero(np.array(run["single"], bool))
            found = np.searchsorted(every, digest[todo], side="right") - np.searchsorted(every, digest[todo], side="left") > 1
            out += [(run["ids"][i], run["keys"][i], run["length"], run["places"][i], run["places"][i] + run["length"]) for i in todo[found].tolist()]
        return _batch(out, _names(SPANS), _SPAN)

    held: list[dict] = []
    key = None
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["f"], row["bucket"], row["length"])
            if held and own != key:
                yield merge_runs(held)
                held = []
            key = own
            held.append(row)
    if held:
        yield merge_runs(held)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return small_batches(docs).select(*more, F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("text"))


def repeated_spans(docs: DataFrame, lengths: list[int], hot: int = HOT) -> DataFrame:
    """Spans (doc_id, text_key, length, a, b) of whole texts' bytes: for each length their union is all that repeated strings cover.

    Spans of a document may overlap. Documents without repeats have none.
    """
    lengths = sorted(set(lengths))
    least, most = lengths[0], lengths[-1]
    if least < GRAM + 8:
        raise ValueError(f"strings of at least {GRAM + 8} bytes")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(strings(batch, "text"))
            for a, b in slices(np.diff(offsets), STEP):
                text, s, n, size, f, ch, occ = cells_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least, most)
                rows = pa.array(text + a)
                small = [pa.array(x.astype(np.int32)) for x in (s, n, size)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text_key").take(rows), *small, pa.array(f), pa.array(ch), pa.array(occ.astype(np.int32))], names=_names(CELLS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(strings(batch, "text"))
            wanted = batch.column("cells")
            at, flat = np.asarray(wanted.offsets), wanted.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            s, size = flat.field("s").to_numpy(), flat.field("size").to_numpy()
            begin = offsets[owner] + s
            raw = data.tobytes()
            for x, y in slices(size, 1 << 22):
                pieces = [raw[i : i + k] for i, k in zip(begin[x:y].tolist(), size[x:y].tolist(), strict=True)]
                rows = pa.array(owner[x:y])
                yield pa.RecordBatch.from_arrays(
                    [flat.field(c).slice(x, y - x) for c in ("f", "shard", "shards", "buckets", "copies", "s", "n")] + [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(pieces, pa.binary())],
                    names=["f", "shard", "shards", "buckets", "copies", "s", "n", "doc_id", "text_key", "bytes"],
                )

    found = materialise(_keyed(docs).mapInArrow(cells, CELLS), "cells")
    kinds = found.groupBy("f", "ch").agg(F.count("*").alias("copies"), F.sum("occ").alias("occ"), F.min(F.struct("doc_id", "text_key", "s", "n", "size")).alias("at"))
    kinds = materialise(kinds, "kinds")
    minima = kinds.groupBy("f").agg(F.count("*").alias("kinds"), F.sum("occ").alias("occ"), F.sum("copies").alias("all")).where("kinds > 1 or occ > all")
    open_kinds = kinds.join(minima.select("f", "kinds"), "f").select("f", "ch", "copies", "kinds", "at.*")
    dealt = open_kinds.withColumn("shards", F.ceil(F.col("kinds") / hot).cast("int")).select(
        "doc_id", "text_key", F.struct("f", F.pmod("ch", "shards").cast("int").alias("shard"), "shards", F.col("shards").alias("buckets"), "copies", "s", "n", "size").alias("cell")
    )
    wanted = dealt.groupBy("doc_id", "text_key").agg(F.collect_list("cell").alias("cells"))  # at most a document's own cells
    texts = _keyed(docs).alias("t")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_key") == F.col("w.text_key"))
    sources = texts.join(wanted.alias("w"), same).select("t.doc_id", "t.text_key", "text", "cells")
    bytes_of = sources.mapInArrow(cut, "f long, shard int, shards int, buckets int, copies long, s int, n int, doc_id long, text_key long, bytes binary")
    settled = materialise(bytes_of.repartition("f", "shard").sortWithinPartitions("f", "shard").mapInArrow(_settle(lengths), SETTLED), "settled")
    runs = settled.where("f is not null").select("length", *_names(RUNS))
    merged = runs.repartition("f", "bucket").sortWithinPartitions("f", "bucket", "length").mapInArrow(_merge, SPANS)
    copied = found.join(kinds.where("copies > 1").select("f", "ch"), ["f", "ch"])
    ends = [F.struct(F.lit(x).alias("length"), (F.col("s") + F.least(F.col("n") - 1 + x, "size")).cast("long").alias("b")) for x in lengths]
    copied = copied.withColumn("end", F.explode(F.array(*ends))).where(F.col("size") >= F.col("end.length")).select("doc_id", "text_key", "end.length", F.col("s").cast("long").alias("a"), "end.b")
    return settled.where("f is null").select(*_names(SPANS)).unionByName(merged).unionByName(copied)


def kept_parts(size: int, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """What of 0..size the spans leave, and the number of maximal runs that they cover."""
    left, at, runs = [], 0, 0
    for a, b in sorted(spans):
        if a > at or not runs:
            runs += 1
            if a > at:
                left.append((at, a))
        at = max(at, b)
    if at < size:
        left.append((at, size))
    return left, runs


def remove_repeats(docs: DataFrame, length: int = 400, passage: int | None = None, hot: int = HOT) -> DataFrame:
    """Every document without the bytes that a repeated string of ``length`` bytes covers.

    row (a struct of the document's own columns without its text), kept (the remaining bytes), text (these without the
    pieces of characters that a cut may leave), n_bytes, n_removed and n_spans, the number of maximal removed runs, and
    n_passage, the bytes that repeated strings of ``passage`` bytes cover (by default n_removed), which stay.
    Strings repeat within a document or across, overlaps count, and all is judged on the input. Null texts count as
    empty; texts shorter than ``length`` stay whole; repeated rows are documents, so all their long strings repeat; null
    ids stay null.
    """
    passage = passage or length

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(strings(batch, "text"))
            raw = data.tobytes()
            kept, removed, runs, passages = [], [], [], []
            for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
                left, count = kept_parts(b - a, [(x["a"], x["b"]) for x in spans or [] if x["length"] == length])
                kept.append(b"".join(raw[a + x : a + y] for x, y in left))
                removed.append(b - a - len(kept[-1]))
                runs.append(count)
                rest, _ = kept_parts(b - a, [(x["a"], x["b"]) for x in spans or [] if x["length"] == passage])
                passages.append(b - a - sum(y - x for x, y in rest))
            text = pa.array([k.decode(errors="ignore") for k in kept], pa.string())
            numbers = [pa.array(x, pa.int64()) for x in (np.diff(offsets), removed, runs, passages)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()), text, *numbers], names=["row", "kept", "text", "n_bytes", "n_removed", "n_spans", "n_passage"])

    spans = repeated_spans(docs, [length, passage], hot).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("length", "a", "b")).alias("spans"))
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_key") == F.col("w.text_key"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    joined = _keyed(docs, row).alias("t").join(spans.alias("w"), same, "left").select("t.row", "text", "spans")
    return joined.mapInArrow(remove, f"row {joined.schema['row'].dataType.simpleString()}, kept binary, text string, n_bytes long, n_removed long, n_spans long, n_passage long")
