"""Encoders, token files, separator counts and packing against the libraries."""

import glob
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from conftest import table
from tokenizers import Tokenizer

from quarry.llm import packing, pieces, queries, token_files
from quarry.llm.common import materialise, scratch
from quarry.llm.tokens import Words

ODD = ["", " ", "  a", "a  b", "a \n b", "\n", "it's I'll dog's", "<|endoftext|> x<|endoftext|>", "x<|startoftext|>y Z", "été naïve ŒUVRE İstanbul ΣΑΣ", "日本 語", "a\x1cb c", "123 45a6 $$%^ a--b", " lead", "trail ", "tab\tsep\r\nline", "ſ K Å µ", "\x85a", "a​b", " x  y"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_equal_the_library(name, edge_rows):
    path = public_tokenizers.path(name)
    texts = [*ODD, *(t for _, t, _ in edge_rows if t)]
    ids, counts = Words(path).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want


def expected(rows, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x, _ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(edge, edge_rows):
    own = packing.best_fit(edge, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=64).toPandas()
    want = Counter()
    for i, ids in expected(edge_rows, "byte_bpe_50k.json"):
        ids = [*ids, 2]
        cut = len(ids) % 64 or 64
        parts = [ids[:cut], *(ids[k : k + 64] for k in range(cut, len(ids), 64))]
        at = 0
        for k, p in enumerate(parts):
            want[(i, k, at, len(p), crc(p))] += 1
            at += len(p)
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in own.itertuples())
    assert sum(got.values()) == sum(want.values())
    assert {k[1:]: v for k, v in got.items() if k[0] is not None} == {k[1:]: v for k, v in want.items() if k[0] is not None}
    for _, seq in own.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() <= 64
    assert own.sequence_id.nunique() <= -(-own.length.sum() // 64) + 8


def test_full_bins_close_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 8, 4, 2)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6), (2, 8)]
    bins = packing.OpenBins(10, 1)
    assert [bins.put(n)[0] for n in (6, 7, 3)] == [0, 1, 1]


def test_packing_by_windows(spark):
    """Pieces that arrive in any order fill few more sequences than their ids need, with a bound that closes bins."""
    r = np.random.default_rng(1)
    sizes = r.integers(1, 1024, 20_000).tolist()
    parts = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECES).repartition(3)
    got = packing.pack(parts, 1024, 1024, 50_000).toPandas()
    assert sorted(got.length) == sorted(sizes) and got.sequence_id.nunique() <= 1.01 * -(-sum(sizes) // 1024)
    assert packing.pack(parts, 1024, 16, 50_000).select("sequence_id").distinct().count() > got.sequence_id.nunique()


def test_parquet_tokens(spark, edge, edge_rows):
    path = scratch(spark, "t")
    token_files.write_parquet(edge, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    got = token_files.read_parquet(spark, path).toPandas().sort_values("start")
    ordered = sorted(zip(edge_rows, expected(edge_rows, "word_bpe_49k.json"), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] or ""))
    at = 0
    for r, (_, (i, ids)) in zip(got.itertuples(), ordered, strict=True):
        ids = [*ids, 1]
        assert (None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        at += len(ids)
    assert sorted(token_files.offsets(spark, path).toPandas().n_tokens) == sorted(got.n_tokens)
    meta = pq.ParquetFile(max(glob.glob(path.removeprefix("file://") + "/*.parquet"), key=lambda f: pq.ParquetFile(f).metadata.num_rows)).metadata
    column = [meta.row_group(0).column(k) for k in range(meta.num_columns)][-1]
    assert column.has_dictionary_page and column.has_offset_index


@pytest.mark.parametrize("block_bytes", [64, 4096])
def test_separator_counts(edge, edge_rows, block_bytes):
    got = token_files.token_counts(edge, public_tokenizers.path("word_bpe_49k.json"), block_bytes=block_bytes).collect()
    want = Counter((i, len(ids)) for i, ids in expected(edge_rows, "word_bpe_49k.json"))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want


def test_end_identifier_of_a_text(edge):
    """An end identifier that a text has is an error; nothing is left out."""
    with pytest.raises(Exception, match="end identifier"):
        token_files.token_counts(edge, public_tokenizers.path("word_bpe_49k.json"), 49407).count()


def test_sentencepiece_bpe(edge, edge_rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*(x for x in ODD if "\x85" not in x), *(t or "" for _, t, _ in edge_rows), "x" * 300 + "the cat" * 40, "    code  of " * 9]
    model = pieces.Pieces(path)
    ids, counts = model.encode(pa.array(texts))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == lib.encode(texts)
    assert [b.decode() for b in model.decode(ids, counts)] == [lib.decode(i) for i in lib.encode(texts)]
    got = pieces.encode_decode(edge, path).collect()
    assert Counter((r["doc_id"], r["merged_tokens"], r["merged_crc32"]) for r in got) == Counter((i, len(ids), crc(ids)) for i, t, _ in edge_rows for ids in [lib.encode(t or "")])


def test_sentencepiece_unigram_view(edge, edge_rows, tmp_path):
    """Viterbi over a BPE file's pieces: the ids that the library gives for a model file of the view."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.Pieces(path, unigram=True)
    parts = [(1, message((1, t.encode()), (2, model.score[i]), (3, model.type[i]))) for i, t in enumerate(model.text)]
    file = tmp_path / "unigram.model"
    file.write_bytes(message(*parts, (2, message((3, 1)) + bytes([35 << 3 & 127 | 128, 35 >> 4, 1])), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1)))))
    lib = sentencepiece.SentencePieceProcessor(model_file=str(file))
    short = [x for x in ODD if "\x85" not in x] + ["the cat " * 9, "    code  of " * 9, "Unterhaltungselektronik " * 3, *(w for t in edge_rows if t[1] for w in t[1].split(" ")[:200] if w)]
    ids, counts = model.encode(pa.array(short))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == lib.encode(short)
    # the library adds up a text's scores in 32 bits, so long texts are compared word by word
    got = {(r["doc_id"], r["decoded_sha256"]): r for r in pieces.encode_decode(edge, path).collect()}
    assert sorted(i for (i, _), r in got.items() if not r["same"]) == [10] and sum(r["n_tokens"] for r in got.values()) > 20_000
    for i, t, _ in edge_rows:
        if t and "▁" not in t and "  " not in t and t == t.strip():
            own = [p for w in t.split(" ") for p in lib.encode(w)]
            r = got[i, hashlib.sha256(t.encode()).hexdigest()]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(own), crc(own))


def message(*fields):
    """A protocol-buffer message of (number, value) pairs."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += bytes([number << 3 | 2]) + (bytes([len(value)]) if len(value) < 128 else bytes([len(value) & 127 | 128, len(value) >> 7])) + value
    return out


def test_sentencepiece_viterbi(tmp_path):
    """Viterbi on a unigram model: the best of all segmentations, tried one by one, and the library's."""
    scores = {"▁": -3.0, "a": -2.5, "b": -2.7, "c": -3.1, "ab": -3.9, "bc": -4.3, "▁a": -4.05, "abc": -6.5, "ca": -5.25, "▁ab": -5.85, "cab": -7.5}
    parts = [(1, message((1, b"<unk>"), (2, 0.0), (3, 2)))] + [(1, message((1, k.encode()), (2, v))) for k, v in scores.items()]
    path = tmp_path / "m.model"
    path.write_bytes(message(*parts, (2, message((3, 1))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1)))))
    model, lib = pieces.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["abc", "cabcab", "a b c", "bca cab abc", "aabbcc", "", "abcabcabcabc"]

    def best(word):
        if not word:
            return 0.0, []
        return max((scores[word[:k]] + best(word[k:])[0], [word[:k], *best(word[k:])[1]]) for k in range(1, 4) if word[:k] in scores)

    ids, counts = model.encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts, strict=True):
        own = [model.text[i] for i in ids[at : at + n]]
        at += n
        words = ["▁" + w for w in t.split(" ")] if t else []
        assert own == [p for w in words for p in best(w)[1]] == lib.encode(t, out_type=str)
    long = "abc" * 60
    ids, counts = model.encode(pa.array([long]))
    assert [model.text[i] for i in ids] == lib.encode(long, out_type=str)


def test_empty_tables(empty):
    word, byte = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    path = scratch(empty.sparkSession, "t")
    token_files.write_parquet(empty, path, word)
    assert token_files.read_parquet(empty.sparkSession, path).count() == 0
    assert token_files.token_counts(empty, word).count() == 0
    assert packing.best_fit(empty, byte).count() == 0
    assert pieces.encode_decode(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert materialise(empty, "x").count() == 0 and not defaultdict(int)


def test_special_tokens_in_texts_count(spark, monkeypatch):
    """The query counts every id, also that of a special token that stands in a text."""
    rows = [(1, "a<|endoftext|>b", "en"), (2, "<|endoftext|>", "en"), (3, "plain words", "en")]
    monkeypatch.setattr(queries, "read", lambda *_: table(spark, rows))
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, "").collect()}
    want = {i: len(ids) for i, ids in expected(rows, "word_bpe_49k.json")}
    assert got == want and want[2] == 1
