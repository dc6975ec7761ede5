"""Charts and markdown tables of reports as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of numbered visual elements.
ELEMENTS = ["figure", "chart", "graph", "box", "diagram", "exhibit", "map", "infographic"]
# Fixed value: the title of a numbered visual element.
VISUAL = r"(?i)^((Figure|Chart|Graph|Box|Diagram|Exhibit|Map|Infographic)\s+\d+[.\d]*)\s*[:\-–]\s*(.+)$"
# Words of a title that tell the type of a chart, tried in this order.
TYPE_WORDS = [
    ("pie", ["pie chart", "pie graph"]), ("bar", ["bar chart", "bar graph"]), ("line", ["line chart", "line graph"]), ("area", ["area chart"]),
    ("line", ["trend", "growth", "over time", "year-wise", "annual"]), ("pie", ["composition", "share", "distribution", "breakdown", "proportion"]),
    ("bar", ["comparison", "compare", "vs", "versus", "vis-a-vis", "vis-à-vis"]), ("bar", ["analysis", "actuals", "estimates", "budget"]),
]
# Words of a caption that tell that an image is a chart.
CHART_WORDS = ["bar chart", "pie chart", "line chart", "area chart", "graph depicting", "graph showing", "chart depicting", "chart showing", "histogram", "scatter plot", "trend line", "depicts the", "illustrates the", "shows the trend", "comparison chart", "flow chart", "flowchart"]
# Words of a caption that tell that an image is none.
NO_CHART_WORDS = ["logo", "emblem", "seal", "badge", "crest", "coat of arms", "cover", "title page", "black background", "blue background", "photo of", "photograph", "picture of a", "picture of the", "group of trucks", "building", "sandbags", "grain silo", "standing on", "man standing", "people", "person"]
# What a caption depicts, tried in this order.
SUBJECTS = [
    r"(?:depicts?|depicting|shows?|showing|illustrat(?:es?|ing))\s+(?:the\s+)?(.{10,60}?)(?:\.|,|$)",
    r"(?:bar|pie|line)\s+chart\s+(?:of|for|depicting|showing)?\s*(?:the\s+)?(.{10,60}?)(?:\.|,|$)",
]
# Words of a title that make a chart financial.
FINANCIAL = ["revenue", "expense", "budget", "loss", "crore", "lakh"]
# Fixed value: a line of a markdown table that only separates.
SEPARATOR = r"^[\s|:-]+$"


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def any_word(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def is_visual_title(content: Column) -> Column:
    """Is a paragraph of at most 250 characters the title of a numbered visual element?"""
    return (F.length(strip(content)) <= 250) & strip(content).rlike(VISUAL)


def visual_part(content: Column, part: str) -> Column:
    """number ('Figure 2.3'), kind or title of a visual element."""
    group = {"number": 1, "kind": 2, "title": 3}[part]
    found = F.trim(F.regexp_extract(strip(content), VISUAL, group))
    return F.lower(found) if part == "kind" else found


def chart_type(title: Column, kind: Column) -> Column:
    """Type of a chart by its title's words; boxes are tables and maps without such words areas."""
    low = F.lower(title)
    out = F.when(kind == "map", "area").otherwise("bar")
    for name, words in reversed(TYPE_WORDS):
        out = F.when(any_word(low, words), F.lit(name)).otherwise(out)
    return F.when(kind == "box", "table_chart").otherwise(out)


def title_of_caption(caption: Column, page: Column) -> Column:
    """What a caption says it depicts, each word with a capital, if longer than 10 characters; else a title by page."""
    low = F.lower(caption)
    subjects = [F.regexp_replace(F.regexp_replace(F.trim(F.get(F.regexp_extract_all(low, F.lit(p), 1), 0)), r"\s+", " "), r"[.,;:]+$", "") for p in SUBJECTS]
    return F.coalesce(*(F.when(F.length(s) > 10, F.initcap(s)) for s in subjects), F.concat(F.lit("Visual Element on Page "), page.cast("string")))


def describes_chart(caption: Column) -> Column:
    low = F.lower(caption)
    return any_word(low, CHART_WORDS) & ~any_word(low, NO_CHART_WORDS)


def table_lines(content: Column) -> Column:
    """Non-empty cells of each line of a markdown table but separators."""
    lines = F.transform(F.split(strip(content), "\n"), lambda x: F.trim(x))
    data = F.filter(lines, lambda x: (x != "") & ~x.rlike(SEPARATOR))
    cells = F.transform(data, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != ""))
    return F.filter(cells, lambda c: F.size(c) > 0)


def table_headers(content: Column) -> Column:
    return F.coalesce(F.get(table_lines(content), 0), F.array().cast("array<string>"))


def clean_caption(caption: Column) -> Column:
    """A caption without 'Data Table:' before a section number; 'Untitled Table' if there is none."""
    trimmed = strip(caption)
    rest = F.trim(F.substring(trimmed, 12, 1_000_000))
    numbered = F.lower(trimmed).startswith("data table:") & rest.rlike(r"^\d+\.")
    return F.when(F.coalesce(caption, F.lit("")) == "", "Untitled Table").when(numbered, rest).otherwise(trimmed)


def cut(text: Column, most: int = 12) -> Column:
    """A text of at most so many characters, with … where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def rule_summary(content: Column) -> Column:
    """Rule-based summary of a markdown table of three lines and more, else ''."""
    lines = F.split(strip(content), "\n")
    headers = F.filter(F.transform(F.split(F.get(lines, 0), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = F.size(F.filter(F.slice(lines, 3, 1_000_000), lambda x: F.contains(x, F.lit("|")))).cast("string")
    named = F.concat(F.lit("Table with "), rows, F.lit(" rows showing: "), F.array_join(F.slice(headers, 1, 4), ", "), F.lit("."))
    return F.when(F.size(lines) < 3, "").when(F.size(headers) > 0, named).otherwise(F.concat(F.lit("Table with "), rows, F.lit(" rows of data.")))


def chart_warnings(confidence: Column, marked: Column, series: Column, x_label: Column, y_label: Column, title: Column, unit: Column) -> Column:
    """What is wrong with an extracted chart."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.filter(
        F.array(
            F.when(confidence < 0.5, "low confidence"), F.when(marked & (series == 0), "no series"), F.when(blank(x_label), "no x label"), F.when(blank(y_label), "no y label"),
            F.when(any_word(F.lower(title), FINANCIAL) & blank(unit), "no unit"),
        ),
        lambda x: x.isNotNull(),
    )


# What a kind of visual element is called, and what words of its title make of it, tried in this order.
KIND_NAMES = {"figure": "figure", "chart": "chart", "graph": "graph", "box": "information box", "diagram": "diagram", "exhibit": "exhibit", "map": "map", "infographic": "infographic"}
ACTIONS = [("illustrates the trend of", ["trend"]), ("compares", ["comparison", "vis-a-vis"]), ("shows the composition of", ["composition", "component"]), ("depicts", ["depicting", "showing"])]
# Themes of a table and the words that tell them.
THEMES = [("financial figures", ["crore", "₹", "rupee", "lakh"]), ("multi-year data", ["fy ", "2020", "2021", "2022", "2023", "2024"]), ("budget comparisons", ["budget", "estimate", "actual"])]


def last_level(path: Column) -> Column:
    """Last section of a path like 'A > B'."""
    return F.element_at(F.split(path, " > "), -1)


def chart_analysis(title: Column, kind: Column, path: Column) -> Column:
    """A sentence on a visual element: its kind, what it does, its topic (after a colon) and its section."""
    low, called, action = F.lower(title), F.lit("visual element"), F.lit("presents")
    for name, words in KIND_NAMES.items():
        called = F.when(kind == name, F.lit(words)).otherwise(called)
    for name, words in reversed(ACTIONS):
        action = F.when(any_word(low, words), F.lit(name)).otherwise(action)
    topic = F.when(title.contains(":"), F.trim(F.regexp_replace(title, "^[^:]*:", ""))).otherwise(title)
    return F.concat(F.lit("This "), called, F.lit(" "), action, F.lit(" "), topic, F.lit(", as discussed in "), last_level(path), F.lit("."))


def table_analysis(content: Column, path: Column, rows: Column, columns: Column) -> Column:
    """A sentence on a table: themes of its words, its section and size."""
    low = F.lower(content)
    themes = F.array_join(F.filter(F.array(*(F.when(any_word(low, words), F.lit(name)) for name, words in THEMES)), lambda x: x.isNotNull()), ", ")
    section = F.coalesce(last_level(F.nullif(path, F.lit(""))), F.lit("this section"))
    return F.concat(F.lit("Contains "), F.coalesce(F.nullif(themes, F.lit("")), F.lit("tabular data")), F.lit(" related to "), section, F.lit(". Dimensions: "), rows.cast("string"), F.lit(" rows × "), columns.cast("string"), F.lit(" columns."))


def embedding_text(path: Column, summary: Column, content: Column, most: int = 32_000) -> Column:
    """What of a chunk is embedded: its path and a table's summary in brackets, then its text, cut to about 8000 tokens."""
    bracket = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("[" + head), c, F.lit("]")))
    return F.left(F.concat_ws("\n\n", bracket("", path), bracket("Table Summary: ", summary), content), F.lit(most))
