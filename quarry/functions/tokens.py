"""Keyword tokens of report texts as Spark column expressions."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import shapes

# Words left out of the index's keyword tokens.
INDEX_STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would "
    "could should may might must shall this that these those it its they them their which who whom what where when why how "
    "all each every both few more most other some such only own same so than too very just also being into during before "
    "after above below between under again further then once here there any no nor not can cannot now"
).split()
# Words left out of a query's keyword tokens.
QUERY_STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would "
    "could should may might must shall this that these those it its they them their which who what where when why how all "
    "some any"
).split()
# Patterns of the keyword tokens of legal references, money, years, percentages, acronyms and words.
SECTION = r"(section\s*\d+(?:\s*\([^)]+\))?)"
SECTION_NUMBER, SECTION_PART = r"section\s*(\d+)", r"\(([^)]+)\)"
RULE, FORM, ARTICLE = r"rule\s*(\d+[a-z]?)", r"form\s*(\d+[a-z]*)", r"article\s*(\d+)"
# Numbers are tried at their beginning alone and not given back, which finds the same and takes time linear in the text.
MONEY = r"(?<![\d,])[\d,]++(?:\.\d++)?+\s*+(crore|lakh|thousand|cr|lac)"
YEAR, PERCENT = r"\b(20\d{2}(?:-\d{2})?)\b", r"((?<!\d)\d++(?:\.\d++)?+\s*+(?:%|percent))"
ACRONYM, WORD = r"\b([A-Z]{2,6})\b", r"\b([a-z]{2,})\b"
#: Saturation of the term frequency.
K1 = 1.2


def _tagged(tag: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat(F.lit(tag), x))


def _found(low: Column, pattern: str, *words: str) -> Column:
    """What a pattern finds that needs one of the words; most texts lack them, and to look for them costs less than to try the pattern."""
    holds = reduce(lambda x, y: x | y, (low.contains(w) for w in words))
    return F.when(~holds, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(low, F.lit(pattern), 1))


def legal_tokens(text: Column) -> Column:
    """section_n[_sub], rule_n, form_n and article_n for references in the text."""
    low = F.lower(text)
    sections = F.transform(
        _found(low, SECTION, "section"),
        lambda x: F.concat(
            F.lit("section_"),
            F.regexp_extract(x, SECTION_NUMBER, 1),
            F.when(x.contains("("), F.concat(F.lit("_"), F.replace(F.regexp_extract(x, SECTION_PART, 1), F.lit(" "), F.lit("")))).otherwise(F.lit("")),
        ),
    )
    return F.concat(sections, *(_tagged(f"{word}_", _found(low, pattern, word)) for word, pattern in (("rule", RULE), ("form", FORM), ("article", ARTICLE))))


def money_tokens(text: Column) -> Column:
    """money_<unit> for every amount with a unit."""
    units = _found(F.lower(text), MONEY, "cr", "lakh", "thousand", "lac")
    return F.transform(units, lambda u: F.concat(F.lit("money_"), F.when(u.isin("cr", "crore"), "crore").when(u.isin("lac", "lakh"), "lakh").otherwise(u)))


def year_tokens(text: Column) -> Column:
    return _tagged("year_", F.regexp_extract_all(text, F.lit(YEAR), 1))


def acronym_tokens(text: Column) -> Column:
    return _tagged("acronym_", F.regexp_extract_all(text, F.lit(ACRONYM), 1))


def special_tokens(text: Column) -> Column:
    """All pattern tokens of an indexed text, repeats included."""
    percents = F.transform(_found(F.lower(text), PERCENT, "%", "percent"), lambda _: F.lit("has_percentage"))
    return F.concat(legal_tokens(text), money_tokens(text), year_tokens(text), percents, acronym_tokens(text))


def word_tokens(text: Column, stopwords: list[str] = INDEX_STOPWORDS) -> Column:
    """Lower-case words of two letters and more that aren't stopwords."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), 1), lambda w: ~w.isin(stopwords))


def index_tokens(text: Column) -> Column:
    """Tokens of an indexed text."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(special_tokens(text), word_tokens(text))


#: A token with digits: what stands before each of its parts, and where the part begins and ends in the small letters of its text.
Parts = tuple[tuple[bytes, int, int], ...]


def _tokens_of(text: str) -> tuple[dict[bytes, int], list[Parts]]:
    """The same tokens: how often those without digits occur, and those with digits by their parts; years are any four digits."""
    low, plain, parts = text.lower(), Counter(), []
    whole, small = shapes.marked(text), shapes.marked(low)
    find = lambda pattern, where: shapes.compiled(pattern).finditer(where)
    place = lambda m, i: shapes.in_bytes(low, *m.span(i))
    for m in find(r"section\s*(\d+)(?:\s*\(([^)]+)\))?", small):
        rest, begin = [], m.start(2)
        for piece in m[2].split(" ") if m[2] else []:  # spaces are left out
            rest.append((b"" if rest else b"_", *shapes.in_bytes(low, begin, begin + len(piece))))
            begin += len(piece) + 1
        parts.append(((b"section_", *place(m, 1)), *rest))
    for tag, pattern in ((b"rule_", RULE), (b"form_", FORM), (b"article_", ARTICLE)):
        parts += [((tag, *place(m, 1)),) for m in find(pattern, small)]
    for m in find(MONEY, small):
        plain["money_" + {"cr": "crore", "lac": "lakh"}.get(m[1], m[1])] += 1
    parts += [((b"year_", *shapes.in_bytes(text, *m.span(1))),) for m in find(YEAR.replace(r"20\d{2}", r"\d{4}"), whole)]
    plain["has_percentage"] += len(list(find(PERCENT, small)))
    plain.update("acronym_" + m[1] for m in find(ACRONYM, whole))
    plain.update(m[1] for m in find(WORD, small) if m[1] not in _STOPWORDS)
    return {shapes.encoded(t): n for t, n in plain.items() if n}, parts


_STOPWORDS = frozenset(INDEX_STOPWORDS)
_tokens_of_shape = lru_cache(shapes.REMEMBERED)(lambda shape: _tokens_of(shapes.decoded(shape)))


def occurrences(text: bytes) -> tuple[dict[bytes, int], list[bytes], bytes | None]:
    """Tokens of an indexed text: how often those without digits occur, those with digits, and the shape by which the former are known if one is."""
    if text.isascii():
        known = shapes.shape(text) if len(text) <= shapes.LONGEST else None
        plain, parts = _tokens_of_shape(known) if known else _tokens_of(text.decode())
        low = text.lower()
    else:  # small letters may be longer
        chars, known = shapes.decoded(text), None
        plain, parts = _tokens_of(chars)
        low = shapes.encoded(chars.lower())
    own = []
    for token in parts:
        tag, a, b = token[0]
        if tag == b"year_":
            if text[a : a + 2] == b"20":
                own.append(tag + text[a:b])
        else:
            own.append(tag + low[a:b] if len(token) == 1 else b"".join(tag + low[a:b] for tag, a, b in token))
    return plain, own, known


def named(tag: bytes, piece: bytes) -> bytes | None:
    """The token of what follows its tag in a text, none if it is no year."""
    return None if tag == b"year_" and not piece.startswith(b"20") else tag + piece.lower()


def by_shape(texts: pa.Array) -> tuple[list[tuple[dict[bytes, int], list[int], list[tuple[bytes, list[bytes]]]]], list[tuple[int, dict[bytes, int], list[bytes]]]]:
    """Tokens of many indexed texts: of those of one shape together, and of others one by one.

    Of a shape: how often the tokens without digits occur in each text, the texts' numbers, and for each token with digits its tag and
    what follows that in each text. Others, also those in which such a token may be twice: their number and ``occurrences``.
    """
    groups, alone = defaultdict(list), []
    every = texts.cast(pa.binary()).to_pylist()
    for row, text in enumerate(every):
        if text and len(text) <= shapes.LONGEST and text.isascii():
            groups[shapes.shape(text)].append(row)
        else:
            alone.append((row, *occurrences(text or b"")[:2]))
    same = []
    for shape, rows in groups.items():
        plain, parts = _tokens_of_shape(shape)
        if len({tuple((tag, b - a) for tag, a, b in token) for token in parts}) < len(parts):
            alone += [(row, *occurrences(every[row])[:2]) for row in rows]
        else:
            some, own = [every[row] for row in rows], []
            for (tag, a, b), *rest in parts:
                cut = [t[a:b] for t in some]
                for mark, c, d in rest:
                    cut = [x + mark + t[c:d] for x, t in zip(cut, some, strict=True)]
                own.append((tag, cut))
            same.append((plain, rows, own))
    return same, alone


def _bags(texts: pa.Array, only: frozenset[bytes] | None) -> pa.Array:
    numbers, known = {}, {}
    number = lambda token: numbers.setdefault(token, len(numbers))
    wanted = (lambda found: found) if only is None else (lambda found: [t for t in found if t in only])
    tokens, counts, ends = [], [], [0]
    for text in texts.cast(pa.binary()).to_pylist():
        plain, own, shape = occurrences(text or b"")
        of = known.get(shape) if shape else None
        if of is None:
            kept = wanted(plain)
            of = [number(t) for t in kept], [plain[t] for t in kept]
            if shape:
                known[shape] = of
        tokens += of[0]
        counts += of[1]
        own = Counter(wanted(own))
        tokens += [number(t) for t in own]
        counts += own.values()
        ends.append(len(tokens))
    names = pa.DictionaryArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(list(numbers), pa.binary()).cast(pa.string())).dictionary_decode()
    pairs = pa.StructArray.from_arrays([names, pa.array(counts, pa.int64())], names=["token", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


#: Tokens that are counted before their counts are passed on.
TALLIED = 1 << 16


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many indexed texts, of the only column, have a token so often: token, tf and n. Of a batch or more a token has a row for each tf."""
    found = Counter()

    def told() -> pa.RecordBatch:
        rows = [pa.array([t for t, _ in found], pa.binary()).cast(pa.string()), pa.array([n for _, n in found], pa.int64()), pa.array(found.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(rows, names=["token", "tf", "n"])

    for batch in batches:
        same, alone = by_shape(batch.column(0))
        cut = defaultdict(list)
        for plain, rows, own in same:
            for pair in plain.items():
                found[pair] += len(rows)
            for tag, pieces in own:
                cut[tag] += pieces
        for tag, pieces in cut.items():
            for piece, n in Counter(pieces).items():
                if token := named(tag, piece):
                    found[token, 1] += n
        for _, plain, own in alone:
            found.update(plain.items())
            found.update(Counter(own).items())
        if len(found) > TALLIED:
            yield told()
            found.clear()
    yield told()


def index_bag(text: Column, only: Sequence[str] | None = None) -> Column:
    """The different tokens of an indexed text as (token, tf), of some tokens if given: the same as those of ``index_tokens``."""
    some = None if only is None else frozenset(shapes.encoded(t) for t in only)

    def bag(texts: pa.Array) -> pa.Array:
        return _bags(texts, some)

    return F.arrow_udf(bag, T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())])))(text)


def query_tokens(text: Column) -> Column:
    """Tokens of a query: one money_crore for any mention of money, no percentages, fewer stopwords."""
    text = F.coalesce(text, F.lit(""))
    money = F.when(F.lower(text).rlike("crore|lakh|₹"), F.array(F.lit("money_crore"))).otherwise(F.array().cast("array<string>"))
    return F.concat(legal_tokens(text), money, year_tokens(text), acronym_tokens(text), word_tokens(text, QUERY_STOPWORDS))


def boost(token: Column, of_query: bool = False) -> Column:
    """Weight of a token's kind; queries know no percentages."""
    numeric = "^(money_|year_)" if of_query else "^(money_|year_|has_percentage)"
    return F.when(token.rlike("^(section_|rule_|form_|article_)"), 3.0).when(token.startswith("acronym_"), 2.5).when(token.rlike(numeric), 1.5).otherwise(1.0)


def weight(tf: Column, token: Column, of_query: bool = False) -> Column:
    """Saturated term frequency times the kind's weight."""
    return tf / (tf + F.lit(K1)) * boost(token, of_query)
