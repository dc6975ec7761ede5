"""TIFF and WARC against plain readers."""

import base64
import gzip
import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import tiff, warc
from quarry.llm.common import scratch


def packbits(data):
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([257 - len(part), part[0]]) if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return out + b"\x80"


def lzw(data):
    table, out, width = {bytes([i]): i for i in range(256)}, [(256, 9)], 9
    size, now = 258, b""
    for byte in data:
        more = now + bytes([byte])
        if more in table:
            now = more
            continue
        out.append((table[now], width))
        table[more] = size
        size += 1
        now = bytes([byte])
        if size > (1 << width) - 1 and width < 12:
            width += 1
        if size == 4094:
            out.append((256, width))
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
    if now:
        out.append((table[now], width))
    size += 1
    out.append((257, 12 if size > 2047 else 11 if size > 1023 else 10 if size > 511 else 9))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


PACK = {1: lambda d: d, 5: lzw, 8: lambda d: zlib.compress(d), 32773: packbits, 32946: lambda d: zlib.compress(d)}


def image_file(image, compression, order="<", tile=None, predictor=1, planar=1, bits=8):
    """A one-page TIFF of an array (rows, columns, samples)."""
    h, w, n = image.shape
    kind = f"{order}u{bits // 8}"
    if tile:
        padded = np.pad(image, ((0, -h % tile), (0, -w % tile), (0, 0)))
        areas = [padded[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        areas = [image[r : r + 3] for r in range(0, h, 3)]
    parts = [a[:, :, k : k + 1] for k in range(n) for a in areas] if planar == 2 else areas
    if predictor == 2:
        parts = [np.concatenate((p[:, :1], p[:, 1:] - p[:, :-1]), axis=1) for p in parts]
    packed = [PACK[compression](p.astype(kind).tobytes()) for p in parts]
    body, places = b"", []
    for p in packed:
        places.append(8 + len(body))
        body += p + b"\x00" * (len(p) % 2)
    tags = {256: [w], 257: [h], 258: [bits] * n, 259: [compression], 277: [n], 284: [planar], 317: [predictor]}
    tags |= {322: [tile], 323: [tile], 324: places, 325: [len(p) for p in packed]} if tile else {273: places, 278: [3], 279: [len(p) for p in packed]}
    entries, extra, base = b"", b"", 8 + len(body) + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        values = struct.pack(f"{order}{len(tags[tag])}I", *tags[tag])
        entries += struct.pack(order + "HHI", tag, 4, len(tags[tag]))
        if len(values) > 4:
            entries += struct.pack(order + "I", base + len(extra))
            extra += values
        else:
            entries += values
    return (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(order + "I", 8 + len(body)) + body + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("compression", sorted(PACK))
@pytest.mark.parametrize("how", [{}, {"tile": 16}, {"predictor": 2}, {"tile": 16, "predictor": 2, "order": ">"}, {"planar": 2}, {"bits": 16, "predictor": 2, "order": ">"}])
def test_reader(compression, how):
    bits = how.get("bits", 8)
    image = np.random.default_rng(1).integers(0, 9, (37, 41, 3)).astype(f"u{bits // 8}")
    image[5:20] = 7
    pages = list(tiff.read_pages(image_file(image, compression, **how)))
    assert [p["error"] for p in pages] == [None] and pages[0]["pixels"] == image.tobytes() and (pages[0]["width"], pages[0]["height"], pages[0]["samples"]) == (41, 37, 3)


def test_lzw_of_long_strips():
    data = bytes(np.random.default_rng(2).integers(0, 250, 60_000).astype(np.uint8)) + b"abc" * 20_000
    assert tiff.unpack_lzw(lzw(data)) == data


def test_bad_files():
    good = tiff.write_pages(b"x" * 576 * 600)
    assert len(list(tiff.read_pages(good))) == 3
    assert [p["error"] is None for p in tiff.read_pages(b"")] == [False] and [p["error"] is None for p in tiff.read_pages(b"II*\x00\xff\xff\x00\x00")] == [False]
    broken = bytearray(good)
    broken[10:30] = b"\x00" * 20
    assert list(tiff.read_pages(bytes(broken)))[-1]["error"]
    loop = bytearray(image_file(np.zeros((3, 3, 1), np.uint8), 1))
    loop[-4:] = loop[4:8]
    assert len(list(tiff.read_pages(bytes(loop)))) == 1


def test_media(edge, edge_rows, empty):
    got = tiff.media_digests(edge).toPandas()
    want = Counter()
    for i, t, _ in edge_rows:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 576)) * 576, b"\xff")
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    own = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got.itertuples())
    assert {k[1:]: v for k, v in own.items() if k[0] is None} == {k[1:]: v for k, v in want.items() if k[0] is None}
    assert sum(own.values()) == sum(want.values()) and {(k[1], k[3]) for k in own} == {(k[1], k[3]) for k in want}
    assert got.groupby("payload_sha256").media_sha256.nunique().max() == 1 and got.groupby("payload_sha256").feature.nunique().max() == 1
    assert tiff.media_digests(empty).count() == 0


def test_pages_keep_other_columns(spark):
    media = spark.createDataFrame([("a", bytearray(tiff.write_pages(b"y" * 576 * 300))), ("b", None)], "name string, media binary")
    got = tiff.pages(media).select("name", "page", "height", "error").collect()
    assert [(r["name"], r["page"], r["height"]) for r in got if not r["error"]] == [("a", 0, 256), ("a", 1, 44)] and [r["name"] for r in got if r["error"]] == ["b"]


PAGES = [
    (5, "http://www.Example.org/a?b=1#f", "same"), (3, "https://example.org:8080/x", "same"), (9, "http://u@b.example.org", "same"), (4, "http://example.org/a?b=1", "other é"), (6, None, ""), (7, "", None), (None, "http://c.org/", "same"),
    (8, "http://c.org/\t\n", "lone"), (8, "http://c.org/\t\n", "lone"), (10, "http://d.org/", "z" * 200_000),
]


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, surt string, first int").repartition(3)
    got = warc.archive(spark, pages).toPandas()
    least = {}
    for i, _, h in PAGES:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = i != least[h or ""]
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", least[h or ""] if again else None)] += 1
    number = lambda v: None if v is None or v != v else int(v)
    assert Counter((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got.itertuples()) == want
    assert warc.archive(spark, pages.where("page_id = 99")).count() == 0


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "http://a/", "ab"), (2, "http://b/", "ab"), (3, "http://c/", "abcdef"), (4, "http://d/", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive(spark, pages, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archive_is_plain_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "body"), (2, "http://b/", "body")], "page_id long, url string, html string").coalesce(1)
    captures = warc.write(pages, scratch(spark, "w")).collect()
    raw = open(captures[0]["file"].removeprefix("file://"), "rb").read()
    assert sum(r["length"] for r in captures) == len(raw)
    text = gzip.decompress(raw).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Type: revisit" in text and "identical-payload-digest" in text


def test_surt():
    assert warc.surt("http://www.Example.org/a?b=1#f") == "org,example)/a?b=1" and warc.surt("https://u@b.example.org:8080") == "org,example,b:8080)/" and warc.surt(None) == ")/"


def test_keys_with_tabs(spark, monkeypatch):
    """Captures are sorted and searched by one key; a page that is not in the index is an error."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 1)
    urls = ["http://a/a b", "http://a/a\tb", "http://a/a\nb", "http://a/a!b", "http://a/a#b"]
    pages = spark.createDataFrame([(i, u, f"body {i}") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    folder = scratch(spark, "w")
    shards = warc.build_index(warc.write(pages, folder).coalesce(1), folder)
    assert sorted(r["page_id"] for r in warc.lookup(pages, shards).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="no capture of page 9"):
        warc.lookup(spark.createDataFrame([(9, "http://b/", "x")], "page_id long, url string, html string"), shards).collect()
