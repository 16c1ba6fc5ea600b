"""Documents as units, lines and elements.

A plain text has no pages of its own: PAGE_LINES lines make one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import WS, collapse, utf16_length

PAGE_LINES = 40


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, page, content): every line from 1 on, its page, its text."""
    rows = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("_pos", "content"))
    return rows.select(id_col, (F.col("_pos") + 1).alias("line"), (F.floor(F.col("_pos") / PAGE_LINES) + 1).cast("int").alias("page"), "content")


def elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-blank lines, trimmed and numbered within their page: (id, page, element_id, line, content).

    The text is split into pages and each page into lines inside the row, so nothing is shuffled.
    """
    pages = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?:[^\n]*\n){{{PAGE_LINES}}}|(?:[^\n]*\n){{0,{PAGE_LINES - 1}}}[^\n]*\z"), F.lit(0))
    paged = docs.select(F.col(id_col), F.posexplode(pages).alias("_p", "_page"))
    trimmed = F.transform(F.split("_page", "\n"), lambda x, i: F.struct(i.alias("pos"), F.regexp_replace(x, f"^[{WS}]+|[{WS}]+$", "").alias("content")))
    rows = paged.select(id_col, "_p", F.posexplode(F.filter(trimmed, lambda e: e["content"] != "")).alias("_n", "e"))
    page = (F.col("_p") + 1).cast("int")
    return rows.select(
        id_col, page.alias("page"), F.format_string("p%d-text-%d", page, F.col("_n") + 1).alias("element_id"), (F.col("_p") * PAGE_LINES + F.col("e.pos") + 1).alias("line"), F.col("e.content").alias("content")
    )


#: fixed values: the patterns that name a line's role
CAPTION = (
    r"(?iu)^(fig(?:ure)?|table|chart|graph|plot|formula|eq(?:uation)?|image|diagram|algorithm|exhibit)\.?"
    r"(?:(?:\s*(?:\(?[a-z]?\d+(?:[.-]\d+)*[a-z]?\)?|\([A-Z]\)|[ivxlcdm]+)(?:\s*[:.)–—-]|\s+|$))|\s*[:)–—-])"
)
NAMED_SECTION = r"(?iu)^(appendix|chapter|section|part)\s+([A-Z0-9]+(?:\.\d+)*)(?:\s*[:.–—-]|\s+)\s*(.+)$"
NUMBERED_SECTION = r"^(\d+(?:\.\d+)*)(?:\.)?\s+(.+)$"
ROMAN_SECTION = r"^([IVXLCDM]+)\.\s+(.+)$"
LIST_ITEM = r"(?iu)^(?:[-*•◦▪▫–—]\s+|(?:\[[ xX]\]|☐|☑)\s+|(?:\d+|[a-z]|[ivxlcdm]+)[.)]\s+)"
FOOTER = r"(?iu)^(?:page\s*)?\d+\s*(?:/|of)\s*\d+$|^page\s+\d+$|copyright|all rights reserved"
HEADER = r"(?iu)\b(?:confidential|draft|internal|prepared\s+(?:for|by))\b"


def title_like(text: Column) -> Column:
    """At most 120 UTF-16 units, no sentence end, an upper-case letter or digit first."""
    trimmed = F.trim(text)
    return (trimmed != "") & (utf16_length(trimmed) <= 120) & ~trimmed.rlike(r"[.!?]$") & trimmed.rlike(r"^[\p{Lu}0-9]")


def semantic_hint(text: Column) -> Column:
    """struct<role, confidence, signals, level> from the text alone (no geometry)."""
    value = F.trim(text)

    def hint(role: str, confidence: float, signals: list[str], level: Column | None = None) -> Column:
        lvl = F.lit(None).cast("int") if level is None else level.cast("int")
        return F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"), F.array(*map(F.lit, signals)).alias("signals"), lvl.alias("level"))

    section = lambda prefix: ["section-heading-pattern", f"{prefix}-section-prefix", "short-line"]
    depth = F.least(F.lit(6), F.size(F.split(F.regexp_extract(value, NUMBERED_SECTION, 1), r"\.")))
    return (
        F.when(value.rlike(CAPTION), hint("caption", 0.86, ["caption-prefix"]))
        .when(value.rlike(NAMED_SECTION) & title_like(F.regexp_extract(value, NAMED_SECTION, 3)), hint("heading", 0.84, section("named"), F.lit(1)))
        .when(value.rlike(NUMBERED_SECTION) & title_like(F.regexp_extract(value, NUMBERED_SECTION, 2)), hint("heading", 0.84, section("numbered"), depth))
        .when(value.rlike(ROMAN_SECTION) & title_like(F.regexp_extract(value, ROMAN_SECTION, 2)), hint("heading", 0.82, section("roman"), F.lit(1)))
        .when(value.rlike(LIST_ITEM), hint("list_item", 0.92, ["list-prefix"]))
        .otherwise(hint("paragraph", 0.5, ["default-text"]))
    )


def edge_hint(text: Column, top: Column, bottom: Column, left: Column, right: Column, bounds: Column, median: Column) -> Column:
    """'footer', 'header' or null by position on the page; bounds is struct<left, bottom, right, top>."""
    value = F.trim(text)
    zone = F.greatest(F.lit(36.0), (bounds["top"] - bounds["bottom"]) * 0.08)
    inside = (left >= bounds["left"] - 4) & (right <= bounds["right"] + 4)
    height = top - bottom
    compact = (height > 0) & F.when(median <= 0, height <= 12).otherwise(height <= F.greatest(median * 1.25, median + 2))
    short = utf16_length(value) <= 140
    footer, header = value.rlike(FOOTER), value.rlike(HEADER)
    return F.when((bottom <= bounds["bottom"] + zone) & inside & short & footer, "footer").when(
        (top >= bounds["top"] - zone) & inside & short & compact & header, "header"
    )


def size_hint(text: Column, height: Column, median: Column, tallest: Column, count: Column) -> Column:
    """Heading level 1 to 3 by text height, null for other lines."""
    large = (count > 1) & (height > 0) & (median > 0) & (height >= median * 1.3) & (height >= tallest * 0.8)
    value = F.trim(text)
    heading = large & (utf16_length(value) <= 120) & ~value.rlike(r"[.!?]$")
    return F.when(heading, F.when(height / median >= 1.8, 1).when(height / median >= 1.55, 2).otherwise(3))


def reading_order(items: DataFrame, page_cols: list[str]) -> DataFrame:
    """Items numbered from the top, then from the left; those without a place last."""
    order = Window.partitionBy(*page_cols).orderBy(F.col("top").desc_nulls_last(), F.col("left").asc_nulls_last(), "item")
    return items.filter(collapse(F.col("content")) != "").withColumn("n", F.row_number().over(order))
