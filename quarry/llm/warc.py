"""WARC archives with revisit records, and a two-level index of their captures."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialise, scratch, small_batches

#: Captures in a compressed block of the index.
BLOCK_LINES = 1000
#: Tasks among which the pages of one payload are dealt.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "surt string, page_id long, digest string, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """Key of a URL: lower-case host labels in reverse, then port, path and query; scheme, user, fragment and a leading www are left out, tab and newline are escaped."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", (url or "").strip()).partition("#")[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    host = host.removeprefix("www.")
    path = slash + path if slash or not path else "/" + path
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (path or "/")
    return key.replace("\t", "%09").replace("\n", "%0A")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    return re.sub(r"[\r\n\x00]", "", value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A gzip member with one record. A revisit has the headers of its response, whose Content-Length tells the payload's size, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record; a response's digest is that of its bytes."""
    raw = zlib.decompressobj(31).decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    number = lambda name: int(v) if (v := fields[name].removeprefix("<urn:page:").rstrip(">")) else None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"content-length: *(\d+)", http, re.I)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return number("warc-record-id"), size, digest, "revisit", number("warc-refers-to")
    if len(payload) != size or payload_digest(payload) != digest:
        raise ValueError("a payload differs from its record's headers")
    return number("warc-record-id"), size, digest, "response", None


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Archives of all pages, a file per task; returns the captures for the index.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one of least page_id is a response, others
    revisit it. Null html is an empty payload; a null page_id is never the least while another is there; pages that
    share the least page_id and payload are all responses.
    """

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        store, place = pafs.FileSystem.from_uri(file)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        at = 0
        with store.open_output_stream(place, compression=None) as out:
            for batch in batches:
                rows = []
                for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                    payload = html.encode()
                    digest = payload_digest(payload)
                    member = record(page_id, url, payload, digest, first, first is not None and page_id != first)
                    out.write(member)
                    rows.append((surt(url), page_id, digest, file, at, len(member)))
                    at += len(member)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CAPTURES.split(", ")])

    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha1", F.sha1("html"))
    # Minima are taken before the shuffle; pages that share a payload go to SALTS tasks, each of which gets its minimum.
    again = keyed.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    return materialise(dealt.join(salted, ["sha1", "salt"], "left").select("page_id", "url", "html", "first").mapInArrow(archive, CAPTURES), "captures")


def _line(row: tuple) -> str:
    return "\t".join("" if v is None else str(v) for v in row)


def _key(surt_key: str, page_id: int | None, digest: str) -> tuple:
    return surt_key.encode(), page_id is not None, page_id or 0, digest


def build_index(captures: DataFrame, folder: str) -> list[tuple[tuple, str]]:
    """The index of the captures: least key and file of each shard, in order.

    Captures are range-partitioned and sorted by key. A shard's file is its compressed blocks of BLOCK_LINES lines one
    after the other, its directory a line with key, offset and length for each block. There are as many shards as
    partitions, so the list that the driver holds doesn't grow with the number of captures in a shard.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{folder}/index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        store, place = pafs.FileSystem.from_uri(file)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        first, held, at, lines = None, [], 0, []

        def close(out: pa.NativeFile) -> None:
            nonlocal held, at
            block = zlib.compress("\n".join(map(_line, held)).encode(), 6)
            out.write(block)
            lines.append(_line((*held[0][:3], at, len(block))))
            at, held = at + len(block), []

        with store.open_output_stream(place + ".cdx") as out:
            for batch in batches:
                for row in zip(*(batch.column(c.split()[0]).to_pylist() for c in CAPTURES.split(", ")), strict=True):
                    first = first or row[:3]
                    held.append(row)
                    if len(held) == BLOCK_LINES:
                        close(out)
            if held:
                close(out)
        with store.open_output_stream(place + ".dir") as out:
            out.write("\n".join(lines).encode())
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([first[2]]), pa.array([file])], names=["surt", "page_id", "digest", "file"])

    ordered = captures.repartitionByRange("surt", "page_id", "digest").sortWithinPartitions("surt", "page_id", "digest")
    shards = ordered.mapInArrow(shard, "surt string, page_id long, digest string, file string").collect()
    return sorted((_key(r.surt, r.page_id, r.digest), r.file) for r in shards)


class Index:
    """Look-ups in the index's files by two binary searches: shards and block directory, then the lines of one block."""

    def __init__(self, shards: list[tuple[tuple, str]]):
        self.keys, self.files = [k for k, _ in shards], [f for _, f in shards]
        self.shard, self.block = None, None
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def _read(self, uri: str, offset: int, length: int | None) -> bytes:
        if uri not in self.open:
            store, place = pafs.FileSystem.from_uri(uri)
            self.open[uri] = store.open_input_file(place)
            if len(self.open) > 64:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(uri)
        self.open[uri].seek(offset)
        return self.open[uri].read(length) if length is not None else self.open[uri].read()

    @staticmethod
    def _parts(line: str) -> list[str]:
        return line.split("\t")

    def find(self, surt_key: str, page_id: int | None, digest: str) -> tuple[str, int, int] | None:
        """File, offset and length of a capture's record."""
        key = _key(surt_key, page_id, digest)
        shard = bisect_right(self.keys, key) - 1
        if shard < 0:
            return None
        if shard != self.shard:
            lines = [self._parts(x) for x in self._read(self.files[shard] + ".dir", 0, None).decode().split("\n")]
            self.shard, self.block = shard, None
            self.directory = [_key(x[0], int(x[1]) if x[1] else None, x[2]) for x in lines]
            self.places = [(int(x[3]), int(x[4])) for x in lines]
        block = bisect_right(self.directory, key) - 1
        if block < 0:
            return None
        if block != self.block:
            lines = [self._parts(x) for x in zlib.decompress(self._read(self.files[shard] + ".cdx", *self.places[block])).decode().split("\n")]
            self.block = block
            self.lines = [_key(x[0], int(x[1]) if x[1] else None, x[2]) for x in lines]
            self.values = [(x[3], int(x[4]), int(x[5])) for x in lines]
        at = bisect_right(self.lines, key) - 1
        return self.values[at] if at >= 0 and self.lines[at] == key else None

    def read(self, place: tuple[str, int, int]) -> bytes:
        """The record's bytes, by a range read."""
        return self._read(*place)


def lookup(pages: DataFrame, shards: list[tuple[tuple, str]]) -> DataFrame:
    """The record of each page (page_id, url, html), found through the index and read from its archive.

    A page without a capture is an error. Look-ups run in the index's order, so each task reads few blocks.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [surt(u) for u in batch.column("url").to_pylist()]
            found = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column("sha1").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("page_id"), pa.array(found, pa.string())], names=["surt", "page_id", "digest"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shards)
        for batch in batches:
            rows = []
            for key in zip(*(batch.column(c).to_pylist() for c in ("surt", "page_id", "digest")), strict=True):
                place = index.find(*key)
                if not place:
                    raise ValueError(f"no capture of page {key[1]} in the index")
                rows.append(parse(index.read(place)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("sha1"))
    keys = asked.mapInArrow(ask, "surt string, page_id long, digest string")
    return keys.repartitionByRange("surt", "page_id", "digest").sortWithinPartitions("surt", "page_id", "digest").mapInArrow(answer, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """All pages written to archives, indexed, and read back through the index: page_id, payload_bytes, payload_digest, record_type and refers_to.

    A null html is an empty payload, a null url an empty one, and a null page_id stays null. Repeated rows are a record
    each; those that share the least page_id of their payload are all responses. Texts of any size are one record. An
    empty table gives no rows; other columns are left out.
    """
    folder = scratch(spark, "warc")
    captures = write(pages, folder, least_bytes)
    return lookup(pages, build_index(captures, folder))
