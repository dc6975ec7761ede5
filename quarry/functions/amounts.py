"""Amounts, entities and facts in answers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import shapes

# Patterns of amounts in the order they are tried (a None unit is the pattern's second group), and what a text holds
# that can match.
AMOUNT_PATTERNS = [
    (r"₹\s*([\d,]+\.?\d*)\s*(crore|lakh|cr|lac)", None, "₹"),
    (r"Rs\.?\s*([\d,]+\.?\d*)\s*(crore|lakh|cr|lac)", None, "rs"),
    (r"([\d,]+\.?\d*)\s*(crore|lakh|cr|lac)\b", None, "cr|la"),
    (r"([\d,]+\.?\d*)\s*lakh\s+crore", "lakh_crore", "lakh"),
    (r"([\d,]+\.?\d*)\s*LMT\b", "lmt", "lmt"),
    (r"([\d,]+\.?\d*)\s*MT\b", "mt", "mt"),
    (r"([\d,]+\.?\d*)\s*(?:Lakh\s+)?Metric\s+Tonnes?\b", "lmt", "tonne"),
    (r"([\d,]+\.?\d*)\s*quintals?\b", "quintal", "quintal"),
    (r"([\d,]+\.?\d*)\s*tonnes?\b", "tonne", "tonne"),
    (r"([\d,]+\.?\d*)\s*(?:sq\.?\s*)?(?:km|kilometers?|kilometres?)\b", "km", "km|kilomet"),
    (r"([\d,]+\.?\d*)\s*(?:sq\.?\s*)?m(?:eters?|etres?)?\b", "sqm", "m"),
    (r"([\d,]+\.?\d*)\s*hectares?\b", "hectare", "hectare"),
    (r"([\d,]+)\s*cases?\b", "cases", "case"),
    (r"([\d,]+)\s*godowns?\b", "godowns", "godown"),
    (r"([\d,]+)\s*depots?\b", "depots", "depot"),
    (r"([\d,]+)\s*States?(?:/UTs?)?\b", "states", "state"),
    (r"([\d,]+)\s*rakes?\b", "rakes", "rake"),
    (r"([\d,]+)\s*silos?\b", "silos", "silo"),
    (r"([\d,]+)\s*CPSEs?\b", "cpses", "cpse"),
    (r"([\d,]+)\s*ministries\b", "ministries", "ministries"),
    (r"([\d,]+)\s*departments?\b", "departments", "department"),
    (r"([\d,]+)\s*beneficiaries\b", "beneficiaries", "beneficiaries"),
    (r"([\d,]+)\s*hospitals?\b", "hospitals", "hospital"),
    (r"(-?[\d.]+)\s*per\s*cent\b", "percent", "cent"),
    (r"(-?[\d.]+)\s*%", "percent", "%"),
    (r"(-?[\d.]+)\s*percent\b", "percent", "percent"),
    (r"([\d,]+)\s*(?:years?|months?|days?)\b", "time", "year|month|day"),
    (r"indicator.*?(\d+\.?\d*)\b", "indicator", "indicator"),
]
# Forms of units and the unit they stand for.
UNITS = {
    "crore": ["cr", "crore", "crores"], "lakh": ["lac", "lakh", "lakhs"], "lakh crore": ["lakh_crore"], "lmt": ["lmt", "lakh metric tonnes", "lakh metric tonne"],
    "mt": ["mt", "metric tonnes", "metric tonne"], "quintal": ["quintal", "quintals"], "tonne": ["tonne", "tonnes"], "percent": ["%", "percent", "per cent", "percentage"],
    "cases": ["case", "cases"], "godowns": ["godown", "godowns"], "states": ["state", "states", "states/uts"], "cpses": ["cpse", "cpses"],
}
# Abbreviations of entities and other names for them.
ALIASES = {
    "nhai": ["national highways authority", "highways authority of india"],
    "pmjay": ["pradhan mantri jan arogya", "ayushman bharat", "jan arogya yojana", "ab-pmjay"],
    "cbdt": ["central board of direct taxes"],
    "fci": ["food corporation of india", "food corporation"],
    "cpse": ["central public sector enterprise", "public sector enterprise", "cpses"],
    "sebi": ["securities and exchange board"],
    "frbm": ["fiscal responsibility", "budget management"],
    "sha": ["state health agency", "state health agencies"],
    "nha": ["national health authority"],
    "tms": ["transaction management system"],
    "cwc": ["central warehousing corporation"],
    "swc": ["state warehousing corporation"],
    "peg": ["private entrepreneurs guarantee", "guarantee scheme"],
    "cap": ["covered and plinth", "cover and plinth"],
    "fsd": ["food storage depot"],
    "itd": ["income tax department"],
    "gst": ["goods and services tax"],
    "cgst": ["central gst"],
    "igst": ["integrated gst"],
}
# Words that a fact shares with any text.
COMMON_WORDS = "the and for was were that this with from have been which their there about during under total amount crore lakh percent".split()
# What names of organisations don't look like.
NOISE = [r"^\d", r"^[a-z]", r"(?i)\b(audit|noticed|noted|observed|found that)\b", r"(?i)\b(per cent|percent|below|above)\b", r"(?i)\b(as per|refer to|we noted)\b", r"(?i)\b(Chapter|Section|Table|Annexure|Para)\s+\d", r"(?i)\b(however|further|moreover|also|total)\b", r"(?i)^(The|A|An|In|It|As|We)\s"]
# What hints that a recommendation found by its verb is none, and what shows that it is one.
NO_RECOMMENDATION = [r"\b(Act|Rules?|Manual|Agreement|Clause|Section\s+\d)\b", r"(?i)\b(provided\s+that|as\s+per|in\s+accordance|stipulated|prescribed)\b", r"(?i)\b(prior\s+to|it\s+provided|it\s+stipulated)\b"]
A_RECOMMENDATION = [r"(?i)\b(Audit|CAG)\s+recommend", r"(?i)\b(CBDT|Ministry|MoRTH|NHAI|Government|Department)\s+(may|should)", r"(?i)•\s*(The\s+)?(CBDT|Ministry|MoRTH)"]


def once_a_number(pattern: str) -> str:
    """A pattern of amounts that finds the same, but tries a number at its beginning alone and gives back none of it.

    What follows a number begins with none of its characters, so a shorter number never fits where the whole one does not.
    """
    out = pattern.replace(r"([\d,]+\.?\d*)\s*", r"(?<![\d,])([\d,]++\.?+\d*+)\s*+").replace(r"([\d,]+)\s*", r"(?<![\d,])([\d,]++)\s*+")
    return out.replace(r"(-?[\d.]+)\s*", r"((?:-|(?<![\d.]))[\d.]++)\s*+").replace(r"([\d.]+)\s*", r"(?<![\d.])([\d.]++)\s*+")


def unit_of(unit: Column) -> Column:
    """A unit's usual form."""
    low = F.lower(F.trim(unit))
    usual = F.create_map(*(F.lit(x) for name, forms in UNITS.items() for form in forms for x in (form, name)))
    return F.coalesce(usual[low], low)


def _spans(text: bytes, patterns: Sequence[tuple]) -> list[tuple[int, int, int, int, str]]:
    """Of what the patterns find in a text, in their order, the bytes of the number and of all, and the unit; what isn't a number is left out."""
    out, chars = {}, shapes.decoded(text)
    low = chars.lower()
    for pattern, unit, *needed in patterns:
        if needed and not any(w in low for w in needed[0].split("|")):  # far cheaper than the pattern
            continue
        for m in shapes.compiled("(?i)" + once_a_number(pattern)).finditer(shapes.marked(chars)):
            try:
                float(m[1].replace(",", ""))
            except ValueError:
                continue
            a, b, c, d = shapes.in_bytes(chars, *m.span(1), *m.span())
            out.setdefault((a, b, m[2].lower() if unit is None else unit), (c, d))
    return [(a, b, c, d, unit) for (a, b, unit), (c, d) in out.items()]


@lru_cache(shapes.REMEMBERED)
def _amounts_of(shape: bytes) -> tuple[list[tuple[int, int]], list[int], bool]:
    """Places of an answer's numbers, their units' numbers, and whether a unit is there twice."""
    name = lambda u: next((n for n, forms in UNITS.items() if u in forms), u)
    found = {(a, b, name(unit)): None for a, b, _, _, unit in _spans(shape, AMOUNT_PATTERNS)}
    units = [_UNIT_NO.setdefault(u, len(_UNIT_NO)) for _, _, u in found]
    return [(a, b) for a, b, _ in found], units, len(set(units)) < len(units)


#: Units met so far and their numbers.
_UNIT_NO: dict[str, int] = {}
_AMOUNT = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())])


def _listed(ends: list[int], columns: dict[str, pa.Array], nulls: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)), mask=nulls)


def _amounts(answers: pa.Array) -> pa.Array:
    values, units, ends = [], [], [0]
    for text in answers.cast(pa.binary()).to_pylist():
        if text:
            tell = _amounts_of if len(text) <= shapes.LONGEST else _amounts_of.__wrapped__
            places, own, twice = tell(shapes.shape(text))
            read = [float(text[a:b].replace(b",", b"")) for a, b in places]
            if twice and len(set(zip(read, own))) < len(own):
                read, own = zip(*dict.fromkeys(zip(read, own)))
            values += read
            units += own
        ends.append(len(values))
    names = pa.DictionaryArray.from_arrays(pa.array(units, pa.int32()), pa.array(list(_UNIT_NO), pa.string())).dictionary_decode()
    return _listed(ends, {"value": pa.array(values, pa.float64()), "unit": names})


def amounts_in(text: Column) -> Column:
    """Distinct (value, unit) of all amounts of an answer; what isn't a number is left out."""
    return F.arrow_udf(_amounts, T.ArrayType(_AMOUNT))(text)


def match_kind(found: Column, value: Column, unit: Column, tolerance: float = 0.05) -> Column:
    """exact, close, wrong or missing: how an expected amount is among the found ones.

    Without an amount of the same unit it is missing, even if the number is there with another one.
    """
    named = F.array(F.struct(found.alias("found"), unit_of(unit).alias("unit")))
    return F.get(F.transform(named, lambda x: _match_kind(x["found"], value, x["unit"], tolerance)), 0)


def _match_kind(found: Column, value: Column, unit: Column, tolerance: float) -> Column:
    """The same of amounts and a unit that are named, so that they are told once."""
    same = lambda a: a["unit"] == unit
    exact = lambda a: F.abs(a["value"] - value) < 0.01
    close = lambda a: (value != 0) & (F.try_divide(F.abs(a["value"] - value), F.abs(value)) < tolerance)
    any_of = lambda test: F.coalesce(F.exists(found, test), F.lit(False))
    return F.when(~any_of(same), "missing").when(any_of(lambda a: same(a) & exact(a)), "exact").when(any_of(lambda a: (same(a) & close(a)) | exact(a)), "close").otherwise("wrong")


def contains_entity(text: Column, entity: Column) -> Column:
    """Does the text name the entity, by its own name, by another name of its abbreviation, or by the abbreviation?"""
    low, name = F.lower(text), F.lower(F.trim(entity))
    out = F.contains(low, name)
    for short, names in ALIASES.items():
        out = out | ((name == short) & low.rlike("|".join(n.replace(".", r"\.") for n in names))) | (name.isin(names) & F.contains(low, F.lit(short)))
    return out


def fact_holds(fact: Column, text: Column) -> Column:
    """Do 40 % of the fact's key words stand in the text, and its numbers above 1, to 0.1 or 5 %? Without key words any text will do."""
    low = F.lower(text)
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d+\.?\d*)"), 1), lambda x: x.try_cast("double"))
    own = numbers(low)
    near = lambda n: F.exists(own, lambda m: (F.abs(m - n) < 0.1) | ((n > 0) & (F.try_divide(F.abs(m - n), n) < 0.05)))
    all_numbers = F.forall(numbers(fact), lambda n: (n <= 1) | near(n))
    words = F.filter(F.regexp_extract_all(F.lower(fact), F.lit(r"\b([a-z]{4,})\b"), 1), lambda w: ~w.isin(COMMON_WORDS))
    share = F.try_divide(F.size(F.filter(words, lambda w: F.contains(low, w))), F.size(words))
    return F.when(F.size(words) == 0, F.lit(True)).otherwise((share >= 0.4) & all_numbers)


def noisy_entity(name: Column) -> Column:
    """Is it unlikely that this is the name of an organisation?"""
    out = (F.length(name) < 3) | (F.length(name) > 80)
    for pattern in NOISE:
        out = out | name.rlike(pattern)
    return out


def false_recommendation(text: Column) -> Column:
    """Is a recommendation that was found by its verb likely none?"""
    any_of = lambda c, patterns: c.rlike("|".join(f"(?:{p})" for p in patterns))
    return any_of(F.left(text, F.lit(150)), NO_RECOMMENDATION) & ~any_of(F.left(text, F.lit(200)), A_RECOMMENDATION)


def overall_score(factual: Column, complete: Column, relevant: Column, cited: Column, amounts: Column, entities: Column, hallucinated: Column) -> Column:
    """Score of an answer out of 100, halved if it makes things up."""
    score = factual * 6 + complete * 4 + relevant * 3 + cited * 3 + amounts * 10 + entities * 10
    return F.when(hallucinated, score * 0.5).otherwise(score)


def passed(score: Column, factual: Column, hallucinated: Column) -> Column:
    return (score >= 70) & (factual >= 3) & ~hallucinated


# Phrases that admit that data is missing.
NO_DATA = [
    "no information available", "not found", "couldn't find", "could not find", "no relevant information", "not covered", "not in the", "no data", "not available",
    "don't have information", "do not have information", "outside the scope", "not included", "not available in the indexed",
]


def admits_no_data(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(NO_DATA))


def has_forbidden(answer: Column, forbidden: Column) -> Column:
    """Does the answer hold any of the texts that it must not, whatever the case?"""
    return F.exists(forbidden, lambda x: F.contains(F.lower(answer), F.lower(x)))


def wilson(passes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share of passes."""
    p, z2 = F.try_divide(passes, n), z * z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(z) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


# Patterns of amounts that are suggested for a new case, a None unit being the pattern's second group.
SUGGESTED_AMOUNTS = [(r"₹\s*([\d,]+\.?\d*)\s*(crore|lakh)", None), (r"Rs\.?\s*([\d,]+\.?\d*)\s*(crore|lakh)", None), (r"([\d,]+\.?\d*)\s*(crore|lakh)", None), (r"([\d.]+)\s*per\s*cent", "percent"), (r"([\d.]+)\s*%", "percent")]
# Patterns of entities that are suggested for a new case.
SUGGESTED_ENTITIES = [
    r"\b(NHAI|CBDT|FCI|NHA|SHA|SEBI|CAG|CPC|MoRTH)\b",
    r"\b(\w+\s+Act,?\s+\d{4})\b",
    r"\b(NH\s+Fee\s+Rules?,?\s*\d{4})\b",
    r"\b(FRBM\s+Act)\b",
    r"\b(PMJAY|Ayushman\s+Bharat|Bharatmala)\b",
    r"\b(Bihar|Chandigarh|Tamil\s+Nadu|Uttar\s+Pradesh|Karnataka|Maharashtra|Nagaland|Tripura)\b",
    r"\b(NH\s*\d+)\b",
]


_suggested_in = lru_cache(shapes.REMEMBERED)(lambda shape: _spans(shape, SUGGESTED_AMOUNTS))
_SUGGESTED = T.StructType([*_AMOUNT.fields, T.StructField("place", T.IntegerType()), T.StructField("size", T.IntegerType())])


def _suggested(texts: pa.Array) -> pa.Array:
    values, units, places, sizes, ends = [], [], [], [], [0]
    for text in texts.cast(pa.binary()).to_pylist():
        if text:
            tell, seen, chars = _suggested_in if len(text) <= shapes.LONGEST else _suggested_in.__wrapped__, set(), text.isascii()
            for a, b, c, d, unit in tell(shapes.shape(text)):
                value, found = float(text[a:b].replace(b",", b"")), text[c:d]
                if (value, unit) not in seen:
                    seen.add((value, unit))
                    at = text.find(found)
                    values.append(value)
                    units.append(unit)
                    places.append(1 + (at if chars else len(shapes.decoded(text[:at]))))
                    sizes.append(d - c if chars else len(shapes.decoded(found)))
        ends.append(len(values))
    columns = {"value": pa.array(values, pa.float64()), "unit": pa.array(units, pa.string()), "place": pa.array(places, pa.int32()), "size": pa.array(sizes, pa.int32())}
    return _listed(ends, columns, texts.is_null())


def suggested_amounts(text: Column, around: int = 50) -> Column:
    """Distinct (value, unit) that a text suggests, in the order of patterns, each with its first place and the text around it."""
    found = F.arrow_udf(_suggested, T.ArrayType(_SUGGESTED))(text)
    context = lambda a: F.trim(F.substring(text, F.greatest(F.lit(1), a["place"] - around), a["size"] + 2 * around))
    return F.transform(found, lambda a: F.struct(a["value"].alias("value"), a["unit"].alias("unit"), a["place"].alias("place"), context(a).alias("context")))


def suggested_entities(text: Column) -> Column:
    """Distinct entities that a text suggests."""
    return F.array_distinct(F.transform(F.concat(*(F.regexp_extract_all(text, F.lit("(?i)" + p), 1) for p in SUGGESTED_ENTITIES)), lambda x: F.trim(x)))
