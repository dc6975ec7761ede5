"""SentencePiece encoding and decoding in numpy, the distinct words of a batch at once.

Words of equal length advance together: substrings of all of them are hashed from prefix hashes and probed in the sorted
keys of the pieces. A unigram model is decoded by Viterbi, whose maxima over piece lengths store backpointers. A BPE
file has ranks of merges for scores, which Viterbi can't add up: it is encoded by merges, each turn taking every word's
best pair, or by Viterbi in its unigram view, which gives the pieces probabilities by their rank.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ranges, slices, small_batches, strings, text_of, utf8

SPACE = "▁"
MULTIPLIER = 0x9E3779B97F4A7C15
UNIGRAM, BPE = 1, 2
#: First 20 bits of a hash.
BEGIN = np.uint64(44)
#: Words longer than this are encoded one by one.
LONG = 64
KEPT_WORDS = 200_000
#: What a character without a piece costs below the worst piece of a unigram model.
UNKNOWN_COST = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: number, and an int, four bytes, eight bytes or a bytes value."""

    def varint(at: int) -> tuple[int, int]:
        value, shift = 0, 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if not data[at - 1] & 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Pieces:
    """A SentencePiece model file.

    The unigram view of a BPE file has the same pieces. Their probabilities fall with the rank of their merge as Zipf's
    law has it, 1 / rank over the sum of all; nothing is trained.
    """

    def __init__(self, path: str, unigram: bool = False):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.text, self.score, self.type = [], [], []
        for _, piece in (x for x in model if x[0] == 1):
            own = dict(_fields(piece))
            self.text.append(own[1].decode())
            self.score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            self.type.append(own.get(3, 1))
        trainer = dict(_fields(next((x for k, x in model if k == 2), b"")))
        normal = dict(_fields(next((x for k, x in model if k == 3), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        self.dummy = bool(normal.get(3, 1))
        if self.kind not in (UNIGRAM, BPE) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or {4, 5} & set(self.type):
            raise ValueError("only unigram and BPE models that keep texts as they are, without own or unused pieces")
        self.unknown = self.type.index(2)
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.type[i] == 6}
        usual = [i for i, t in enumerate(self.type) if t == 1]
        if unigram and self.kind == BPE:
            self.kind = UNIGRAM
            by_rank = sorted(usual, key=lambda i: -self.score[i])
            total = np.log((1 / np.arange(1, len(usual) + 1)).sum())
            for rank, i in enumerate(by_rank, 1):
                self.score[i] = float(np.float32(-np.log(rank) - total))
        self.longest = max(len(self.text[i]) for i in usual)
        keys = np.array([self._hash(self.text[i]) for i in usual], np.uint64) * np.uint64(MULTIPLIER)  # short pieces' hashes are small
        turn = np.argsort(keys)
        self.keys, self.ids = keys[turn], np.array(usual, np.int64)[turn]
        # unigram sums are of 32 bits, as the library's are
        self.scores = np.array([self.score[i] for i in usual], np.float32 if self.kind == UNIGRAM else np.float64)[turn]
        size = np.bincount(self.keys >> BEGIN, minlength=1 << 20)
        self.begins, self.alike = size > 0, int(size.max())
        self.first = np.minimum(np.cumsum(size) - size, len(self.keys) - 1)
        self.by_text = {self.text[i]: i for i in usual}
        self.worst = np.float32(self.scores.min()) - np.float32(UNKNOWN_COST)
        self.power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(LONG + 1, MULTIPLIER, np.uint64))))
        values = [bytes([int(t[3:5], 16)]) if self.type[i] == 6 else b"" if self.type[i] == 3 else (" ⁇ " if self.type[i] == 2 else t.replace(SPACE, " ")).encode() for i, t in enumerate(self.text)]
        self.value = np.frombuffer(b"".join(values), np.uint8)
        self.value_size = np.array([len(v) for v in values], np.int64)
        self.value_start = np.cumsum(self.value_size) - self.value_size
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * MULTIPLIER + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the sorted piece keys, and whether it is one."""
        return self._places(hashes * np.uint64(MULTIPLIER))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of keys. Their first bits tell where the pieces that share these begin; the few of them are gone through."""
        at = self.first[keys >> BEGIN]
        for _ in range(self.alike - 1):
            at = np.minimum(at + (self.keys[at] < keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the hashes that are pieces', and their places; most others fall out by their first bits."""
        keys = hashes * np.uint64(MULTIPLIER)
        some = np.flatnonzero(self.begins[keys >> BEGIN])
        at, hit = self._places(keys[some])
        return some[hit], at[hit]

    def _prefixes(self, chars: np.ndarray) -> np.ndarray:
        out = np.zeros((len(chars), chars.shape[1] + 1), np.uint64)
        for i in range(chars.shape[1]):
            out[:, i + 1] = out[:, i] * np.uint64(MULTIPLIER) + chars[:, i] + np.uint64(1)
        return out

    def _viterbi(self, chars: np.ndarray) -> np.ndarray:
        """Where each word's best segmentation begins a piece; of equal ones, that of the longer last piece."""
        n, length = chars.shape
        prefix = np.ascontiguousarray(self._prefixes(chars).T)  # by place, as are the others
        best = np.full((length + 1, n), -np.inf, np.float32)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int64)
        for end in range(1, length + 1):
            for size in range(min(self.longest, end), 0, -1):
                row, at = self._hits(prefix[end] - prefix[end - size] * self.power[size])
                own = best[end - size, row] + self.scores[at]
                if size == 1:  # any character is a piece, if need be an unknown one
                    every = best[end - 1] + self.worst
                    every[row] = own
                    row, own = np.arange(n), every
                better = own > best[end, row]
                best[end, row[better]] = own[better]
                back[end, row[better]] = end - size
        begins = np.zeros((n, length), bool)
        row, at = np.arange(n), np.full(n, length)
        while len(row):
            at = back[at, row]
            begins[row, at] = True
            row, at = row[at > 0], at[at > 0]
        return begins

    def _merges(self, chars: np.ndarray) -> np.ndarray:
        """Where each word's symbols begin when no pair can merge any more."""
        n, length = chars.shape
        prefix = self._prefixes(chars)
        # by position: end of the symbol there, begin of the one before, score of its pair with the next
        end = np.tile(np.arange(1, length + 2), (n, 1))
        before = np.tile(np.arange(-1, length), (n, 1))
        pair = np.full((n, length + 1), -np.inf)

        def rate(row: np.ndarray, at: np.ndarray) -> None:
            last = end[row, at]
            fine = last < length
            stop = end[row[fine], last[fine]]
            found, hit = self._probe(prefix[row[fine], stop] - prefix[row[fine], at[fine]] * self.power[stop - at[fine]])
            pair[row, at] = -np.inf
            pair[row[fine], at[fine]] = np.where(hit, self.scores[found], -np.inf)

        if length > 1:
            every = np.arange(n * (length - 1))
            rate(every // (length - 1), every % (length - 1))
        begins = np.ones((n, length), bool)
        row = np.arange(n)
        while len(row):
            at = pair[row].argmax(axis=1)
            on = pair[row, at] > -np.inf
            row, at = row[on], at[on]
            gone = end[row, at]
            begins[row, gone] = False
            pair[row, gone] = -np.inf
            end[row, at] = end[row, gone]
            before[row, end[row, at]] = at
            rate(row, at)
            left = before[row, at]
            rate(row[left >= 0], left[left >= 0])
        return begins

    def _one(self, word: str) -> list[str]:
        """Pieces of a long word."""
        if self.kind == UNIGRAM:
            best, back = [np.float32(0)], [0]
            for end in range(1, len(word) + 1):
                found = [(best[end - k] + (np.float32(self.score[self.by_text[s]]) if (s := word[end - k : end]) in self.by_text else self.worst), k) for k in range(min(self.longest, end), 0, -1) if k == 1 or word[end - k : end] in self.by_text]
                top = max(x for x, _ in found)
                best.append(top)
                back.append(next(k for x, k in found if x == top))
            out, at = [], len(word)
            while at:
                out.append(word[at - back[at] : at])
                at -= back[at]
            return out[::-1]
        symbols, after, before = list(word), [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] >= 0 and (both := symbols[at] + symbols[after[at]]) in self.by_text:
                heapq.heappush(heap, (-self.score[self.by_text[both]], at, after[at], both))

        for i in range(len(word)):
            offer(i)
        while heap:
            _, at, right, both = heapq.heappop(heap)
            if not symbols[at] or after[at] != right or symbols[at] + symbols[right] != both:
                continue
            symbols[at], symbols[right], after[at] = both, "", after[right]
            if after[at] >= 0:
                before[after[at]] = at
            offer(before[at])
            offer(at)
        return [s for s in symbols if s]

    def _ids_of(self, piece: str) -> list[int]:
        if piece in self.by_text:
            return [self.by_text[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def _fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words as bytes of uint32."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for at in np.flatnonzero(size > LONG):
            out[at] = array("I", [i for p in self._one(words[at]) for i in self._ids_of(p)]).tobytes()
        for length in np.unique(size[(size > 0) & (size <= LONG)]).tolist():
            own = np.flatnonzero(size == length)
            for a in range(0, len(own), 1 << 15):
                part = own[a : a + (1 << 15)]
                joined = "".join([words[i] for i in part])
                chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, length)
                begins = (self._merges if self.kind == BPE else self._viterbi)(chars)
                row, begin = np.nonzero(begins)
                end = np.append(begin[1:], length)
                end[np.append(row[1:] != row[:-1], True)] = length
                prefix = self._prefixes(chars)
                at, hit = self._probe(prefix[row, end] - prefix[row, begin] * self.power[end - begin])
                ids, count = self.ids[at].astype(np.uint32), np.ones(len(row), np.int64)
                ends = np.cumsum(np.bincount(row, minlength=len(part)))
                if not hit.all():
                    extra = {int(i): self._ids_of(joined[row[i] * length + begin[i] : row[i] * length + end[i]]) for i in np.flatnonzero(~hit)}
                    for i, found in extra.items():
                        count[i] = len(found)
                    placed = np.repeat(ids, count)
                    start = np.cumsum(count) - count
                    for i, found in extra.items():
                        placed[start[i] : start[i] + len(found)] = found
                    ids, ends = placed, np.cumsum(count)[ends - 1]
                raw = ids.tobytes()
                for i, x, y in zip(part.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = raw[4 * x : 4 * y]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        found = list(map(self.kept.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(new, self._fresh([words[i] for i in new]), strict=True):
            found[i] = self.kept[words[i]] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number for each text."""
        odd = pc.match_substring_regex(texts, f"  |^ | $|{SPACE}|^$")
        plain = pc.if_else(odd, "", texts)
        lists = pc.split_pattern(plain, " ")
        at = np.asarray(lists.offsets).astype(np.int64)
        at, coded = at - at[0], lists.flatten().dictionary_encode()
        codes, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        if self.dummy:
            table = [SPACE + w if w else "" for w in words]
        else:  # a text's first word has no space before it
            begin = at[:-1][np.diff(at) > 0]
            codes[begin] += len(words)
            table = [SPACE + w if w else "" for w in words] + words
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        own: list[list[str]] = []
        for text in texts.take(pa.array(odd_at)).to_pylist():
            own.append(re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", ((" " if self.dummy and text else "") + text).replace(" ", SPACE)))
        extra = list({w for ws in own for w in ws})
        number = {w: len(table) + i for i, w in enumerate(extra)}
        if own:
            cuts = np.split(codes, at[1:-1])
            for i, ws in zip(odd_at.tolist(), own, strict=True):
                cuts[i] = np.array([number[w] for w in ws], np.int64)
            codes = np.concatenate(cuts)
            at = np.concatenate(([0], np.cumsum([len(c) for c in cuts])))
        found = self._words(table + extra)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        every, start = np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size
        lengths = size[codes]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return every[ranges(start[codes], lengths)], total[at[1:]] - total[at[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text."""
        size = self.value_size[ids]
        raw = self.value[ranges(self.value_start[ids], size)].tobytes()
        total = np.concatenate(([0], np.cumsum(size)))
        ends = np.cumsum(counts)
        out = []
        for a, b in zip(total[ends - counts].tolist(), total[ends].tolist(), strict=True):
            text = raw[a + 1 : b] if self.dummy and raw[a : a + 1] == b" " and b > a else raw[a:b]
            out.append(text)
        return out


_loaded: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, unigram: bool = False) -> Pieces:
    """The model of a file, loaded once in a worker."""
    if (path, unigram) not in _loaded:
        _loaded[path, unigram] = Pieces(path, unigram)
    return _loaded[path, unigram]


def crc32s(ids: np.ndarray, counts: np.ndarray) -> list[int]:
    """CRC-32 of each text's ids as little-endian uint32."""
    ends = np.cumsum(counts)
    raw = ids.astype("<u4").tobytes()
    return [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian uint32), decoded_sha256 and same, whether decoding gives the text.

    These are of the best segmentation, by Viterbi; a BPE file is taken in its unigram view. merged_tokens and
    merged_crc32 are of the ids by the file's own kind, which for a BPE file are those by merges.

    Null texts count as empty and have no ids; null ids stay null; repeated rows are encoded each; other columns are
    left out. ``same`` is false only for texts that hold the model's sign for a space.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, merging = pieces(model, unigram=True), pieces(model)
        for batch in batches:
            texts = strings(batch, "text")
            data, offsets = utf8(texts)
            for a, b in slices(np.diff(offsets), 16 << 20):
                part = texts.slice(a, b - a)
                ids, counts = own.encode(part)
                merged, merged_counts = merging.encode(part)
                back = own.decode(ids, counts)
                whole = data.tobytes() if (a, b) == (0, len(texts)) else data[offsets[a] : offsets[b]].tobytes()
                at = (offsets[a : b + 1] - offsets[a]).tolist()
                same = [t == whole[x:y] for t, x, y in zip(back, at[:-1], at[1:], strict=True)]
                decoded = pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string())
                sums = [pa.array(crc32s(i, n), pa.int64()) for i, n in ((ids, counts), (merged, merged_counts))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(counts), sums[0], decoded, pa.array(same, pa.bool_()), pa.array(merged_counts), sums[1]],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "same", "merged_tokens", "merged_crc32"],
                )

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(both, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, same boolean, merged_tokens long, merged_crc32 long")
