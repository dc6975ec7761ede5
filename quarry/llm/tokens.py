"""Token ids of whole texts by a `tokenizers` file, each distinct word of a batch encoded once.

A text is cut where the tokenizer itself is certain to cut (before a single space, or at white space), the distinct
words are encoded with the library, and numpy gathers their ids into the texts' order. Texts and words on which the cut
could differ from the library's go through it whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from quarry.llm.common import ranges, slices, utf8

# The pre-tokenising patterns of the two kinds of file.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space on which the libraries' definitions differ, or that isn't ASCII.
ODD_SPACE = r"[\x00\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A space that the next word doesn't own.
FREE_SPACE = r" [ \t\r\n]| $"
#: Words are kept between batches up to this number.
KEPT_WORDS = 200_000
#: Characters below this one have the same letters, cases and normal form in every Unicode version.
STABLE = "İ"


def byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def pack(ids: list[int]) -> bytes:
    """Ids as bytes of uint32."""
    return array("I", ids).tobytes()


class Words:
    """Encodes Arrow string arrays with one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.kind = self._kind(spec)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.special = sorted({t["content"][:2] for t in spec.get("added_tokens", [])})
        self.pattern = regex.compile(BYTE_PATTERN if self.kind == "byte" else WORD_PATTERN)
        self.space = self.letters[32]
        self.kept: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, spec["model"]
        if model.get("type") != "BPE" or model.get("ignore_merges") or spec.get("post_processor") or spec.get("truncation") or spec.get("padding"):
            return "whole"
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens", [])):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "byte"
        steps = [n.get("type") for n in norm.get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0].get("pattern") == {"Regex": WORD_PATTERN} and not parts[1].get("use_regex"):
            return "word"
        return "whole"

    def _atom(self, text: str, space: str = "") -> bytes:
        """Ids of a pre-token, which may have a space before it, as bytes of uint32."""
        kept = self.kept[space]
        found = kept.get(text)
        if found is None:
            mapped = text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(self.letters)
            found = pack([t.id for t in self.model.tokenize(self.space + mapped if space else mapped)])
            if len(kept) < KEPT_WORDS:
                kept[text] = found
        return found

    def _word(self, word: str, space: str) -> bytes:
        """Ids of a word and the space before it, if any."""
        stable = word.isascii() or max(word) < STABLE
        if stable and self.kind == "word":
            word = word.lower()
        if stable and word.isalpha():
            return self._atom(word, space)
        if stable and word[-1] in ".,;:" and (bare := word[:-1]).isalpha():
            return self._atom(bare, space) + self._atom(word[-1])
        if not stable or any(s in word for s in self.special):
            return pack(self.tokenizer.encode(space + word, add_special_tokens=False).ids)
        return b"".join(map(self._atom, self.pattern.findall(space + word)))

    def _words(self, words: list[str], space: str) -> list[bytes]:
        kept = self.kept[space]
        if len(kept) >= KEPT_WORDS:  # words seen since are as frequent as those kept
            kept.clear()
        found = list(map(kept.get, words))
        lower, lead, tokenize = self.kind == "word", self.space if space else "", self.model.tokenize
        for i in [i for i, x in enumerate(found) if x is None]:
            word = words[i]
            end = word[-1:]
            bare = word[:-1] if end and end in ".,;:" else word
            if bare.isalpha() and (bare.isascii() or max(bare) < STABLE):  # most words by far
                own = bare.lower() if lower else bare
                x = kept.get(own)
                if x is None:
                    mapped = own if own.isascii() else own.encode().decode("latin-1").translate(self.letters)
                    x = array("I", [t.id for t in tokenize(lead + mapped)]).tobytes()
                    if len(kept) < KEPT_WORDS:
                        kept[own] = x
                found[i] = x if bare is word else x + self._atom(end)
                continue
            found[i] = x = self._word(word, space) if word else self._atom(" ") if space else b""
            if len(kept) < KEPT_WORDS and word not in kept and not word.isalpha():
                kept[word] = x
        return found

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other as uint32, and the number for each text. The array has no nulls."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        sizes = np.diff(utf8(array)[1])
        for a, b in slices(sizes, 16 << 20):
            i, n = self._slice(array.slice(a, b - a))
            ids.append(i)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _slice(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "whole":
            got = self._whole(array.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)
        odd = pc.match_substring_regex(array, ODD_SPACE + ("|" + FREE_SPACE if self.kind == "byte" else ""))
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, "", array) if len(odd_at) else array
        ids, counts = self._plain(plain)
        if not len(odd_at):
            return ids, counts
        ends = np.cumsum(counts)
        parts, done = [], 0
        for at, own in zip(odd_at, self._whole(array.take(pa.array(odd_at)).to_pylist()), strict=True):
            parts += [ids[done : ends[at]], own]
            done = ends[at]
            counts[at] = len(own)
        return np.concatenate([*parts, ids[done:]]), counts

    def _plain(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(array, " ") if self.kind == "byte" else pc.ascii_split_whitespace(array)
        at = np.asarray(lists.offsets).astype(np.int64)
        at, flat = at - at[0], lists.flatten()
        coded = flat.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        words = coded.dictionary.to_pylist()
        found = self._words(words, " " if self.kind == "byte" else "")
        if self.kind == "byte":  # a text's first word has no space before it
            begin = at[:-1][np.diff(at) > 0]
            firsts, own = np.unique(codes[begin], return_inverse=True)
            codes[begin] = len(words) + own
            found += self._words([words[i] for i in firsts], "")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        every = np.frombuffer(b"".join(found), np.uint32)
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        lengths = size[codes] if len(codes) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = every[ranges(start[codes], lengths)] if len(codes) else np.zeros(0, np.uint32)
        return ids, total[at[1:]] - total[at[:-1]]


_loaded: dict[str, Words] = {}


def words(path: str) -> Words:
    """The encoder of a file, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]
