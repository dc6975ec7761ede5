"""Texts that differ in digits alone: what a pattern that tells no digit from another finds lies at the same places in all of them.

Where texts of one shape are many, as in tables, their patterns are tried once; what is found is cut from each text. Patterns
mean the same as in Spark's expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

#: Shapes that a task's process remembers, and bytes of texts whose shape is worth it.
REMEMBERED, LONGEST = 1 << 14, 1_000

_ZEROS = bytes.maketrans(b"0123456789", b"0" * 10)
_CODING = ("utf-8", "surrogateescape")  # a text that isn't UTF-8 keeps its bytes


def shape(text: bytes) -> bytes:
    """The text with each digit a 0."""
    return text.translate(_ZEROS)


def decoded(text: bytes) -> str:
    return text.decode(*_CODING)


def encoded(text: str) -> bytes:
    return text.encode(*_CODING)


@cache
def compiled(pattern: str) -> re.Pattern:
    """A pattern of Spark's: classes and cases are of ASCII, a word's bounds of all letters, and a dot is no end of a line."""
    pattern = pattern.replace(r"\b", r"(?u:\b)").replace(".*?", "[^\\n\\r\u0085\u2028\u2029]*?")
    return re.compile(pattern, re.ASCII)


def in_bytes(text: str, *places: int) -> tuple[int, ...]:
    """Places among the text's characters as places among its bytes."""
    return places if text.isascii() else tuple(len(encoded(text[:p])) for p in places)


def marked(text: str) -> str:
    """The text with a letter in place of each mark above or below a letter, which belongs to the word for Spark's patterns."""
    if text.isascii():
        return text
    out, on = [], False
    for c in text:
        mark = on and unicodedata.category(c) == "Mn"
        on = mark or c.isalnum()
        out.append("\u00aa" if mark else c)
    return "".join(out)
