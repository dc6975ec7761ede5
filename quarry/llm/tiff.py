"""TIFF media columns: a writer of 8-bit images, and a reader that emits one row per page."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, small_batches, text_of, utf8

WIDTH = 576
#: Rows of one page and of one strip that the writer makes.
PAGE_ROWS, STRIP_ROWS = 256, 64
# Bytes of a value of each TIFF field type, by type number.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Compression numbers.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
PAGES = "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


def write_pages(payload: bytes, width: int = WIDTH) -> bytes:
    """A little-endian TIFF of the payload as rows of ``width`` 8-bit samples, deflated strips, PAGE_ROWS rows a page."""
    rows = len(payload) // width
    body, directories = [b"II*\x00\x00\x00\x00\x00"], []
    at = 8
    for top in range(0, rows, PAGE_ROWS):
        height = min(PAGE_ROWS, rows - top)
        strips = [zlib.compress(payload[(top + r) * width : (top + min(r + STRIP_ROWS, height)) * width], 1) for r in range(0, height, STRIP_ROWS)]
        strips = [s + b"\x00" * (len(s) % 2) for s in strips]
        offsets = [at]
        for s in strips:
            offsets.append(offsets[-1] + len(s))
        at = offsets.pop()
        body += strips
        sizes = [len(s) for s in strips]
        more = struct.pack(f"<{2 * len(strips)}I", *offsets, *sizes) if len(strips) > 1 else b""
        places = (at, at + 4 * len(strips)) if more else (offsets[0], sizes[0])
        body.append(more)
        at += len(more)
        n = len(strips)
        fields = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, DEFLATE), (262, 3, 1, 1), (273, 4, n, places[0]), (277, 3, 1, 1), (278, 4, 1, STRIP_ROWS), (279, 4, n, places[1])]
        directories.append((at, len(body)))
        body.append(struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + b"\x00" * 4)
        at += len(body[-1])
    body[0] = b"II*\x00" + struct.pack("<I", directories[0][0] if directories else 0)
    for (_, place), (following, _) in zip(directories[:-1], directories[1:], strict=True):
        body[place] = body[place][:-4] + struct.pack("<I", following)
    return b"".join(body)


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a header below 128 copies that many bytes and one, one above repeats the next byte."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the high bit on, 256 clears the table, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out = list(first), 9, []
    held, bits, before = 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError("LZW code beyond the table")
        out.append(entry)
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        # the writer widens one code early, when the entry that this code will complete would need it
        width = max(width, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


def _expand(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    raise ValueError(f"compression {compression}")


def _samples(data: bytes, rows: int, columns: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """A strip's or tile's samples, the predictor undone."""
    kind = np.dtype(f"{order}u{bits // 8}")
    need = rows * columns * samples
    got = np.frombuffer(data[: need * kind.itemsize], kind)
    if len(got) < need:
        raise ValueError("too few samples")
    got = got.reshape(rows, columns, samples)
    if predictor == 2:
        return np.cumsum(got, axis=1, dtype=kind.newbyteorder("="))
    if predictor != 1:
        raise ValueError(f"predictor {predictor}")
    return got.astype(kind.newbyteorder("="))


def read_pages(data: bytes) -> Iterator[dict]:
    """Every page's geometry and samples, row by row with a pixel's samples together.

    A file or page that can't be read gives one row with an error and ends the walk; directories that were seen before
    end it too.
    """
    blank = {"page": 0, "width": None, "height": None, "samples": None, "bits": None, "compression": None, "pixels": None, "error": None}
    if data[:4] not in (b"II*\x00", b"MM\x00*"):
        yield blank | {"error": "no TIFF header"}
        return
    order = "<" if data[:2] == b"II" else ">"
    at, page, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while at and at not in seen:
        seen.add(at)
        try:
            count = struct.unpack_from(order + "H", data, at)[0]
            tags: dict[int, tuple] = {}
            for i in range(count):
                tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind in (1, 3, 4):
                    place = at + 10 + 12 * i
                    if n * TYPE_BYTES[kind] > 4:
                        place = struct.unpack_from(order + "I", data, place)[0]
                    tags[tag] = struct.unpack_from(f"{order}{n}{'?B?HI'[kind]}", data, place)
            following = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
            one = lambda tag, default=None: tags[tag][0] if tag in tags else default  # noqa: B023, E731
            width, height, samples, compression = one(256), one(257), one(277, 1), one(259, NONE)
            bits, planar, predictor = tags.get(258, (1,)), one(284, 1), one(317, 1)
            if len(set(bits)) != 1 or bits[0] not in (8, 16):
                raise ValueError(f"bits per sample {bits}")
            planes, each = (samples, 1) if planar == 2 else (1, samples)
            image = np.zeros((height, width, samples), f"u{bits[0] // 8}")
            if 322 in tags:
                high, wide, starts, sizes = one(323), one(322), tags[324], tags[325]
            else:
                high, wide, starts, sizes = min(one(278, height), height), width, tags[273], tags[279]
            down, across = -(-height // high), -(-width // wide)
            if len(starts) < planes * down * across:
                raise ValueError("too few strips or tiles")
            for k in range(planes * down * across):
                plane, row, column = k // (down * across), k // across % down * high, k % across * wide
                rows = high if 322 in tags else min(high, height - row)
                part = _samples(_expand(data[starts[k] : starts[k] + sizes[k]], compression), rows, wide, each, bits[0], predictor, order)
                part = part[: height - row, : width - column]
                own = slice(plane, plane + 1) if planar == 2 else slice(None)
                image[row : row + part.shape[0], column : column + part.shape[1], own] = part
            yield blank | {"page": page, "width": width, "height": height, "samples": samples, "bits": bits[0], "compression": compression, "pixels": image.tobytes()}
        except (struct.error, KeyError, ValueError, TypeError, zlib.error, IndexError) as e:
            yield blank | {"page": page, "error": f"{type(e).__name__}: {e}"}
            return
        at, page = following, page + 1


def encode(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and media: each text's UTF-8 bytes, padded with 255 to full rows, as a TIFF.

    Null texts count as empty (one row of padding); null ids stay null; repeated rows are images of their own; other
    columns are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            raw = data.tobytes()
            size = np.diff(offsets)
            padded = np.maximum(-(-size // width), 1) * width
            media = [write_pages(raw[a:b].ljust(n, b"\xff"), width) for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), padded.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(padded), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(write, "doc_id long, n_bytes long, payload_bytes long, media binary")


def pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of each image, after the image's other columns and its media_bytes, media_sha256 and number in its task.

    Rows of an image stand together in page order. A null image has one row with an error, like one that can't be read.
    """
    others = [f for f in media.schema.fields if f.name != column]
    names = [f.name for f in others]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", media_bytes long, media_sha256 string, image long, " + PAGES
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = -1
        for batch in batches:
            images = batch.column(column).to_pylist()
            rows, numbers, sizes, digests, found, held = [], [], [], [], [], 0
            for i, data in enumerate(images):
                image += 1
                digest = hashlib.sha256(data or b"").hexdigest()
                for page in read_pages(data or b""):
                    rows.append(i)
                    numbers.append(image)
                    sizes.append(len(data or b""))
                    digests.append(digest)
                    found.append(page)
                    held += len(page["pixels"] or b"")
                if held > 1 << 23 or i == len(images) - 1:
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(n).take(at) for n in names] + [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(numbers, pa.int64())]
                        + [pa.array([f[c.split()[0]] for f in found], k) for c, k in zip(PAGES.split(", "), kinds, strict=True)],
                        names=[*names, "media_bytes", "media_sha256", "image", *(c.split()[0] for c in PAGES.split(", "))],
                    )
                    rows, numbers, sizes, digests, found, held = [], [], [], [], [], 0

    return media.mapInArrow(walk, schema)


def digests(page_rows: DataFrame) -> DataFrame:
    """One row per image: its payload's size and digests, and as feature its geometry and a histogram of its samples' upper three bits."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def close() -> None:
            if now is not None:
                feature = f"{now['pages']}x{now['width']}x{now['rows']}:" + ",".join(map(str, now["bins"].tolist()))
                out.append((now["doc_id"], now["n_bytes"], now["size"], now["sha"].hexdigest(), zlib.crc32(now["tail"]), now["media_bytes"], now["media_sha256"], feature))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["image"] != now["image"]:
                    close()
                    now = {"image": row["image"], "pages": 0, "rows": 0, "size": 0, "tail": b"", "sha": hashlib.sha256(), "bins": np.zeros(8, np.int64)} | {k: row[k] for k in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "width")}
                pixels = row["pixels"] or b""
                now["pages"] += 1
                now["rows"] += row["height"] or 0
                now["size"] += len(pixels)
                now["sha"].update(pixels)
                now["tail"] = (now["tail"] + pixels)[-32:]
                now["bins"] += np.bincount(np.frombuffer(pixels, np.uint8) >> 5, minlength=8)
            yield batch_of()
            out = []
        close()
        yield batch_of()

    wanted = page_rows.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "image", "width", "height", "pixels")
    return wanted.mapInArrow(fold, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Texts stored as TIFF in a table of the shared folder, read back page by page, and digested.

    A null text counts as empty and has one row of padding; null ids stay null; repeated rows are stored each, and equal
    texts give equal values. Texts of any size are one image. An empty table gives no rows; other columns are left out.
    """
    return digests(pages(materialise(encode(docs, width), "media", compression="uncompressed")))
