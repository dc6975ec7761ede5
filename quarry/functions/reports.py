"""Titles, years, question kinds and statuses of reports as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The yearly series of reports, in the order in which a title is tried; (id, name, pattern, pattern that excludes).
SERIES = [
    ("union_govt_accounts", "Union Government Accounts (Financial Audit)", r"Union.?Government.?Accounts.*Financial.?Audit|Accounts.?of.?the.?Union.?Government", None),
    ("frbm_compliance", "FRBM Act Compliance Audit", r"Fiscal.?Responsibility.*Budget.?Management|FRBM", None),
    (
        "direct_taxes_audit",
        "Direct Taxes Compliance Audit",
        r"(?:Compliance.?Audit.*Direct.?[Tt]axes|Direct.?[Tt]axes.*Compliance|^Report\s+No\.?\s*\d+\s+of\s+\d{4}\s*[-–]\s*Union\s+Government.*Direct.?Taxes)",
        r"Performance.?Audit",
    ),
]
# Words in a question that tell its kind, tried in this order.
QUESTION_WORDS = [
    ("list", ["list", "what are the", "what were the", "name all", "enumerate", "what issues", "what findings", "what problems", "what recommendations", "how many", "which states", "which ministries", "main issues", "key findings", "major issues", "all the"]),
    ("aggregation", ["total", "aggregate", "overall", "sum of", "combined", "how much in total", "what is the total", "cumulative"]),
    ("comparison", ["compare", "comparison", "difference between", "vs", "versus", "how does", "differ from", "changed from", "trend", "over the years", "year over year", "year-over-year", "across years", "between years", "how has", "evolution", "progression"]),
    ("explanation", ["why", "explain", "reason", "cause", "how did", "what caused", "what led to", "due to what"]),
]
# Kind of question -> results, candidates and characters of context.
RETRIEVAL_PARAMS = {"factual": (8, 30, 10000), "list": (18, 80, 25000), "aggregation": (18, 80, 25000), "comparison": (15, 60, 22000), "explanation": (12, 50, 18000), "procedural": (10, 40, 15000)}
# Kinds of questions that need more context.
WIDE_KINDS = ["list", "aggregation", "comparison"]
# Kind of question -> style of the answer.
STYLES = {"factual": "concise", "list": "detailed", "aggregation": "detailed", "comparison": "comparative", "explanation": "explanatory", "procedural": "detailed"}


# Years in titles and file names.
YEAR_RANGE, MARCH = r"(\d{4})-(\d{2,4})", r"(?i)(?:year|period)\s+ended\s+March\s+(\d{4})"
YEAR_OF, PERIOD_OF, FILE_YEARS = r"year\s+(\d{4})", r"period\s+(\d{4})", r"(\d{4})(\d{2})(?:_|\.pdf|$)"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match. One evaluation, so expressions built of it stay small."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), group), 0)


def year_of_title(title: Column) -> Column:
    """'YYYY-YY' from a range or the year that ended in March, else a single year, else null."""
    start, end = _first(title, YEAR_RANGE, 1), _first(title, YEAR_RANGE, 2)
    march = _first(title, MARCH)
    return F.coalesce(
        F.concat(start, F.lit("-"), F.right(end, F.lit(2))),
        F.concat((march.cast("int") - 1).cast("string"), F.lit("-"), F.right(march, F.lit(2))),
        _first(F.lower(title), YEAR_OF),
        _first(F.lower(title), PERIOD_OF),
    )


def audit_year(title: Column) -> Column:
    """Audit year of a title, '' if it has none."""
    return F.coalesce(year_of_title(title), F.lit(""))


def year_of_filename(filename: Column) -> Column:
    """'YYYY-YY' where the first six digits before '_', '.pdf' or the end are consecutive years, else null."""
    start, end = _first(filename, FILE_YEARS, 1), _first(filename, FILE_YEARS, 2)
    follows = (end.cast("int") == F.right(start, F.lit(2)).cast("int") + 1) | ((end == "00") & start.endswith("99"))
    return F.when(follows, F.concat(start, F.lit("-"), end))


def audit_year_of_filename(filename: Column) -> Column:
    """Audit year of a file name, '' if it has none."""
    return F.coalesce(year_of_filename(filename), F.lit(""))


def report_year(report_no: Column) -> Column:
    """First year of the 2000s in a report number, else 2024."""
    return F.coalesce(_first(report_no, r"(20\d{2})").cast("int"), F.lit(2024))


def series_of(title: Column) -> Column:
    """Id of the first series that a title belongs to, or null."""
    found = F.lit(None).cast("string")
    for name, _, pattern, excluded in reversed(SERIES):
        fits = title.rlike("(?i)" + pattern)
        if excluded:
            fits = fits & ~title.rlike("(?i)" + excluded)
        found = F.when(fits, F.lit(name)).otherwise(found)
    return found


def question_type(question: Column) -> Column:
    """Kind of a question by the first list with a word that it contains."""
    low = F.lower(F.coalesce(question, F.lit("")))
    kind = F.lit("factual")
    for name, found in reversed(QUESTION_WORDS):
        kind = F.when(low.rlike("|".join(found)), F.lit(name)).otherwise(kind)
    return kind


def retrieval_param(kind: Column, which: int) -> Column:
    """Results (0), candidates (1) or characters of context (2) of a kind of question."""
    out = F.lit(RETRIEVAL_PARAMS["factual"][which])
    for name, values in RETRIEVAL_PARAMS.items():
        out = F.when(kind == name, F.lit(values[which])).otherwise(out)
    return out


def status(findings: Column, high: Column) -> Column:
    """Status of a report by its findings and those of high severity."""
    return F.when(findings == 0, "Compliant").when(high > 5, "Action Pending").when(high > 0, "Under Review").otherwise("Partial Compliance")


def severity_band(crore: Column) -> Column:
    return F.when(crore > 100, "critical").when(crore >= 10, "high").when(crore >= 1, "medium").otherwise("low")


# Boilerplate of titles, removed in this order.
TITLE_STEPS = [
    (r"(?i)^Audit\s+Report\s*(No\.?\s*)?\d+\s*of\s*\d{4}\s*[-–,]?\s*", ""),
    (r"(?i)^Report\s*(No\.?\s*)?\d+\s*of\s*\d{4}\s*[-–,]?\s*", ""),
    (r"(?i)^of\s+the\s+", ""),
    (r"(?i)^Report\s+of\s+the\s+", ""),
    (r"(?i)^Union\s+Government\s*(\([^)]*\))?\s*[-–,]\s*(Ministry|Department)\s+of\s+[^–-]+[-–]\s*(Performance|Compliance|Financial)\s+Audit\s+(on|of)\s+", ""),
    (r"(?i)Comptroller and Auditor General of India\s*(on)?", ""),
    (r"(?i)CAG['’]?s?\s*", ""),
    (r"(?i)\s*\((Performance|Compliance|Financial)\s+Audit[-–]?[^)]*\)\s*$", ""),
    (r"(?i)[-–]?\s*Report\s*No\.?\s*\d+\s*of\s*\d{4}\s*(\([^)]+\))?\s*$", ""),
    (r"(?i)\s+No\.?\s*\d+\s*of\s*\d{4}\s*$", ""),
    (r"(?i)\s+Government\s*(\([^)]+\))?\s*$", ""),
    (r"(?i)\s+Union\s+Government\s*(\([^)]*\))?\s*(National\s+\w+\s+Authority\s+)?(Ministry|Department)\s+of\s+.+$", ""),
    (r"(?i)\s+Union\s+Government\s*(\([^)]+\))?\s*$", ""),
    (r"(?i)\s+Ministry\s+of\s+[\w\s]+?No\.?\s*\d+\s*of\s*\d{4}\s*$", ""),
    (r"(?i)\s*[-–]\s*(Ministry|Department)\s+of\s+.+$", ""),
    (r"(?i)^of\s+the\s+", ""),
    (r"(?i)^on\s+", ""),
    (r"^[\"“”]+", ""),
    (r"[\"“”]+$", ""),
    (r"^\s+|\s+$", ""),
    (r"^[-–,:\s]+", ""),
    (r"[-–,:\s]+$", ""),
    (r"\s+", " "),
]


def sanitize_title(title: Column) -> Column:
    """A title without boilerplate, its first letter a capital; the title itself if nothing else is left."""
    out = title
    for pattern, by in TITLE_STEPS:
        out = F.regexp_replace(out, pattern, by)
    out = F.concat(F.upper(F.left(out, F.lit(1))), F.substring(out, 2, 1_000_000))
    return F.coalesce(F.nullif(out, F.lit("")), title, F.lit(""))


# --- citations -------------------------------------------------------------------------------------------------------

# Fixed value: a citation in an answer.
CITATION = r"(?i)\[([^\]]*(?:p\.?\s*\d+|page\s*\d+)[^\]]*)\]"
# How citation keys are brought to one form, in this order, after lower-casing.
CITATION_STEPS = [(r"^\[|\]$", ""), (r"\s+", " "), (r"\s*,\s*", ","), (r"\b(page|pg)\s*", "p"), (r"p\.\s*", "p"), (r"^\s+|\s+$", "")]


def citations_in(text: Column) -> Column:
    """Inner texts of the citations of an answer, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), 1), lambda x: F.trim(x))


def citation_key(citation: Column) -> Column:
    """One form of a citation key for comparison."""
    out = F.lower(citation)
    for pattern, by in CITATION_STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def citation_section(citation: Column) -> Column:
    return _first(citation, r"(\d+(?:\.\d+)*)")


def citation_page(citation: Column) -> Column:
    return _first(citation, r"(?i)(?:p\.?|page)\s*(\d+)").cast("int")


def legacy_top_k(kind: Column, top_k: Column) -> Column:
    """Results without a plan for the question: at least 15 for lists, sums and comparisons."""
    return F.when(kind.isin(WIDE_KINDS), F.greatest(top_k, F.lit(15))).otherwise(top_k)


def legacy_chars(kind: Column, chars: Column) -> Column:
    """Characters of context without a plan for the question: half as many more for these kinds."""
    return F.when(kind.isin(WIDE_KINDS), F.floor(chars * 1.5).cast("int")).otherwise(chars)


def legacy_style(kind: Column) -> Column:
    """Style without a plan for the question."""
    return F.when(kind == "comparison", "comparative").when(kind == "explanation", "explanatory").otherwise("adaptive")


# --- executive summaries ---------------------------------------------------------------------------------------------

# How a "Context & Scope" section begins, tried in this order, and how the next one does.
SCOPE_BEGINS = [r"##\s*(?:\d+\.\s*)?Context\s*(?:&|and)\s*Scope\s*\n+", r"\d+\.\s*Context\s*(?:&|and)\s*Scope\s*\n+", r"\*\*Context\s*(?:&|and)\s*Scope\*\*\s*\n+"]
SCOPE_ENDS = r"\n(?:##\s+|(?:\d+\.\s+)?(?:\*\*)?(?:Critical|Key|Major|Significant|Important|Recommendations|Findings|Conclusion))"


def context_and_scope(content: Column) -> Column:
    """Text of the "Context & Scope" section without markup, null if there is none or it is empty."""
    rest = F.coalesce(*(F.when(content.rlike("(?i)" + b), F.regexp_replace(content, "(?is)^.*?" + b, "")) for b in SCOPE_BEGINS))
    body = F.regexp_replace(rest, "(?is)" + SCOPE_ENDS + ".*$", "")
    for pattern, by in ((r"^\s+|\s+$", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        body = F.regexp_replace(body, pattern, by)
    return F.nullif(body, F.lit(""))
