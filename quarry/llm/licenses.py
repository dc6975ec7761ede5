"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Texts are scanned as words, so line breaks, comment marks and punctuation within a notice don't matter. What follows an
identifier tag on its line, and notices that are joined by "and" or "or", are license expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, small_batches, strings, text_of, utf8

# Phrases, as words, whose places are counted.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Words of published notices and license texts, and the labels they stand for.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "apache license 2": "apache-2",
    "bsd license": "bsd",
    "2 clause bsd license": "bsd-2",
    "3 clause bsd license": "bsd-3",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3",
    "creative commons zero": "cc0",
    "cc0 1": "cc0",
    "dedicated to the public domain": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc by 4": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution 4": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "reserved",
}
# Exceptions, which count after "with" only.
EXCEPTIONS = {"classpath exception": "classpath-exception", "gcc runtime library exception": "gcc-exception", "linking exception": "linking-exception"}
# Words of the tags that an expression follows after a colon.
TAGS = ["spdx license identifier", "license expression", "packagelicensedeclared", "packagelicenseconcluded"]
#: How much a family of licenses permits, from 0 to 1; labels belong to the longest family that begins them, others permit nothing known.
FAMILIES = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2,
    "reserved": 0.0,
}
BINDS = {"or": 1, "and": 2, "with": 3}
#: Words that may stand beside "and" and "or" between two notices of one expression, and how many.
BETWEEN, GAP = frozenset("and or with the under terms of either a an license licence version 2 3 0 at your option dual licensed".split()), 10
ITEM = re.compile(rb"[ \t]*(\(|\)|[a-z0-9.+-]+)")
COLON = re.compile(rb"[ \t]*:")
FOUND = "array<struct<label:string, kind:string, word:bigint, words:int>>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found {FOUND}"
_KIND = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("word", pa.int64()), ("words", pa.int32())]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def label_of(identifier: str) -> str:
    """The label of a license identifier: without "or later" and "only", "clause", and a version of Creative Commons."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    name = re.sub(r"-clause.*$", "", re.sub(r"\.0$", "", name))
    return re.sub(r"-\d+(\.\d+)*$", "", name) if name.startswith("cc") else name


def permits(label: str) -> float:
    """How much a label's license permits; labels of no known family permit nothing known."""
    return FAMILIES[max(own, key=len)] if (own := [f for f in FAMILIES if re.match(rf"{f}(-|\d|$)", label)]) else 0.0


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: the tokens of a well-formed expression, operators after their operands; "with" binds before "and" before "or"."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels of an expression and how much it permits: both of "and", the better of "or", half of the rest more with an exception."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix(tokens):
        if token not in BINDS:
            stack.append(({token}, permits(token)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        stack.append((left, (a + 1) / 2) if token == "with" else (left | right, max(a, b) if token == "or" else min(a, b)))
    return stack[0]


def well_formed(items: Iterator[str]) -> list[str]:
    """The longest beginning of the items that makes an expression: open ends and parentheses are closed, the rest is left out."""
    out: list[str] = []
    depth, operand = 0, True
    for item in items:
        known = operand and (item in FAMILIES or re.search(r"[\d-]", item) is not None or (out[-1:] == ["with"]))
        if item == "(" and operand and out[-1:] != ["with"]:
            depth += 1
        elif item == ")" and not operand and depth:
            depth -= 1
        elif item in BINDS and not operand and not (item == "with" and (out[-1] == ")" or out[-2:-1] == ["with"])):
            operand = True
        elif item not in "()" and item not in BINDS and known:
            operand = False
            item = item if out[-1:] == ["with"] else label_of(item)
        else:
            break
        out.append(item)
    while out and (out[-1] in BINDS or out[-1] == "("):
        depth -= out.pop() == "("
    return out + [")"] * depth


@lru_cache(maxsize=8)
def _automaton(base: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """All phrases between spaces, their UTF-8 bytes as Latin-1; each with its uses (kind, label) and number of words."""
    uses: dict[str, list[tuple[str, str]]] = {}
    for phrase, label in base:
        uses.setdefault(phrase, []).append(("base", label))
    for kind, phrases in (("notice", NOTICES), ("exception", EXCEPTIONS), ("tag", {t: "" for t in TAGS})):
        for phrase, label in phrases.items():
            uses.setdefault(phrase, []).append((kind, label))
    found = ahocorasick.Automaton()
    for phrase, own in uses.items():
        shown = f" {phrase} ".encode().decode("latin-1")
        found.add_word(shown, (len(shown), phrase.count(" ") + 1, own))
    found.make_automaton()
    return found


def _joined(words: list[bytes]) -> str | None:
    """The operator that the words between two notices stand for; none if they say something else."""
    own = {w.decode("latin-1") for w in words}
    if len(words) > GAP or not own <= BETWEEN:
        return None
    return "or" if "or" in own else "with" if "with" in own else "and" if "and" in own else None


def _statements(notices: list[tuple[int, int, str, str]], between) -> list[list[str]]:
    """Expressions of notices (word, words, kind, label), in order; those within a longer one are left out."""
    kept: list[tuple[int, int, str, str]] = []
    for hit in sorted(notices, key=lambda x: (x[0], -x[1], x[3])):
        if not kept or hit[0] + hit[1] > kept[-1][0] + kept[-1][1]:
            kept.append(hit)
    out: list[list[str]] = []
    end = None
    for word, n, kind, label in kept:
        how = _joined(between(end, word)) if end is not None and 0 <= word - end <= GAP else None
        if kind == "exception":
            if how == "with" and out and "with" not in out[-1][-2:]:
                out[-1] += ["with", label]
        elif how in ("and", "or"):
            out[-1] += [how, label]
        else:
            out.append([label])
        end = word + n if out else None
    return out


def _expression(text: bytes, at: int, end: int) -> list[str]:
    """The expression after a tag: a colon, then items on the same line; none if there is no colon."""

    def items(at: int) -> Iterator[str]:
        while found := ITEM.match(text, at, end):
            yield found[1].decode()
            at = found.end()

    colon = COLON.match(text, at, end)
    return well_formed(items(colon.end())) if colon else []


def _scan(data: np.ndarray, offsets: np.ndarray, base: tuple[tuple[str, str], ...]) -> list[tuple]:
    """A row for each text: n_words, n_base, first_word, last_word, base_labels, labels, score and found."""
    lower = _LOWER[data]
    word = _WORD[lower]
    size = np.diff(offsets)
    before = np.concatenate(([False], word[:-1])) if len(word) else word.copy()
    before[offsets[:-1][size > 0]] = False
    starts = word & ~before
    upto = np.concatenate(([0], np.cumsum(starts)))
    first = upto[offsets]  # number of each text's first word
    # words with a space before each; a space and a line break, which no word has, end a text
    doc = np.repeat(np.arange(len(size)), size)
    place = (np.cumsum(word) - 1 + np.cumsum(starts) + 2 * doc)[word]
    line = np.full(int(word.sum()) + int(upto[-1]) + 2 * len(size), ord(" "), np.uint8)
    line[place] = lower[word]
    ends = np.concatenate(([0], np.cumsum(word)))[offsets[1:]] + first[1:] + 2 * np.arange(1, len(size) + 1) - 1
    line[ends] = ord("\n")
    at = (np.cumsum(word) - 1 + np.cumsum(starts) + 2 * doc)[starts]
    after = np.concatenate((word[1:], [False])) if len(word) else word.copy()
    after[offsets[1:][size > 0] - 1] = False
    opens, closes = np.flatnonzero(starts), np.flatnonzero(word & ~after) + 1  # of each word
    hits: dict[int, list[tuple[int, int, str, str]]] = {}
    for end, (length, n, uses) in _automaton(base).iter(line.tobytes().decode("latin-1")):
        number = int(np.searchsorted(at, end - length + 2))
        own = int(np.searchsorted(first[1:], number, side="right"))
        hits.setdefault(own, []).extend((number, n, kind, label) for kind, label in uses)
    text = lower.tobytes() if hits else b""
    out = []
    for i, n_words in enumerate(np.diff(first).tolist()):
        own = hits.get(i)
        if own is None:
            out.append((n_words, 0, None, None, "", "", 0.0, []))
            continue
        spans = [(label, kind, number - int(first[i]), n) for number, n, kind, label in own if kind in ("base", "notice")]
        places = [w for _, kind, w, _ in spans if kind == "base"]
        base_labels = {label for label, kind, _, _ in spans if kind == "base"}
        expressions = _statements([h for h in own if h[2] != "tag"], lambda a, b: [text[opens[k] : closes[k]] for k in range(a, b)])
        for number, n, kind, _ in own:
            if kind == "tag":
                tokens = _expression(text, int(closes[number + n - 1]), int(offsets[i + 1]))
                if tokens:
                    expressions.append(tokens)
                    spans += [(label, "tag", number - int(first[i]), n) for label in sorted(evaluate(tokens)[0])]
        values = [evaluate(x) for x in expressions]
        labels = base_labels.union(*(x for x, _ in values))
        found = [dict(zip(("label", "kind", "word", "words"), s, strict=True)) for s in sorted(spans, key=lambda s: (s[2], s[1], s[0]))]
        out.append((n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min((v for _, v in values), default=0.0), found))
    return out


def scan(docs: DataFrame, base: Mapping[str, str] = BASE) -> DataFrame:
    """One row per document: words, places of the base phrases, labels, how much its licenses permit, and all that was found.

    A-Z count as a-z; words are runs of a-z, 0-9 and all beyond ASCII. n_base counts all places of base phrases, first_word
    and last_word are the least and largest of their first words (from 0), null without any. base_labels are theirs; labels
    has those of notices and of the expressions after identifier tags too. Both are sorted and joined by commas, empty for
    none. score is how much the text's statements permit together, the least of them, 0 without any. found lists places,
    kind base, notice or tag, with their first word and number of words.

    A notice within a longer one is no statement of its own, but base phrases always count. Notices with "and" or "or" and
    few words of no meaning between them are one expression. An expression after a tag ends with its line or where it can't
    go on; an identifier is a known family or has a digit or hyphen. Null texts count as empty; null ids stay; repeated rows
    are scanned each; long texts are scanned whole. Other columns are left out. Nothing is shuffled.
    """
    phrases = tuple(base.items())
    if any(not re.fullmatch(r"[a-z0-9\x80-\U0010ffff]+( [a-z0-9\x80-\U0010ffff]+)*", p) for p, _ in phrases):
        raise ValueError("a phrase is lower-case words with a space between them")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(strings(batch, "text"))
            for a, b in slices(np.diff(offsets)):
                rows = _scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], phrases)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), _KIND), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")[:8]] + ["found"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(work, SCHEMA)
