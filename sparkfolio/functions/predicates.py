"""Line predicates of document layout, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: section names that stand alone as headings
NAMED_HEADINGS = (
    "abstract", "introduction", "background", "related work", "method", "methods", "methodology", "results", "discussion", "conclusion", "conclusions",
    "references", "bibliography", "acknowledgments", "acknowledgements", "appendix", "summary", "contents", "table of contents", "preface", "foreword",
    "index", "glossary",
)
#: fixed values: words that a heading of more than three words does not end with
DANGLING = "the|of|and|to|a|an|in|for|with|by|on|or"


def page_number(text: Column) -> Column:
    """A page number of at most 16 characters: decimal or roman, perhaps after 'page', perhaps with totals after '/' or 'of'."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^[-–—\s]+|[-–—\s]+$", "")
    bare = F.trim(F.regexp_replace(bare, "^page", ""))
    return (F.octet_length(bare) <= 16) & bare.rlike(r"^(?:(?:of)?[/\s]+)*(?:[0-9]+|[ivxlc]{1,6})(?:[/\s]+(?:[0-9]+|of))*[/\s]*$")


def caption_start(text: Column) -> Column:
    return F.ltrim(F.lower(text)).rlike(r"^(?:figure|fig\.|fig|table|圖|图|表)\s*[0-9０-９]")


def bullet(text: Column) -> Column:
    """A bullet with something after it; dashes and stars need a space between."""
    return text.rlike(r"^(?:[•◦▪‣●○■□·\x{F0B7}➢✓]\s*|[-*–—] \s*)\S")


def enumerated(text: Column) -> Column:
    return text.rlike(r"^(?:\([0-9A-Za-z]{1,4}(?:\)|$)|(?:[0-9]{1,3}|[a-z])[.)] )")


def equation_number(text: Column) -> Column:
    return F.trim(text).rlike(r"^\([0-9A-Za-z.]{0,6}\)$")


def named_heading(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), ":+$", "")).isin(*NAMED_HEADINGS)


def numbered_heading_level(text: Column) -> Column:
    """The level of a numbered heading such as '2.1 Data': parts of the number and one more, at most 6; null for other lines."""
    line = F.trim(text)
    number = F.regexp_replace(F.regexp_extract(line, r"^(\S+) ", 1), r"\.+$", "")
    title = F.trim(F.regexp_extract(line, r"^\S+ (.*)$", 1))
    words = F.size(F.split(title, r"\s+"))
    parts = F.size(F.split(number, r"\."))
    letters, solid = F.regexp_count(title, F.lit(r"\p{IsAlphabetic}")), F.length(F.regexp_replace(title, r"\s", ""))
    ok = (
        (F.length(number) <= 8)
        & number.rlike(r"^(?:(?:[0-9]|[12][0-9]|30|0[0-9]+)(?:\.[0-9]+){0,3}|[A-Z])$")
        & title.rlike(r"^\p{Lu}")
        & (words <= 12)
        & (F.octet_length(title) <= 90)
        & ~title.rlike(r"[.,]$")
        & ~(title.endswith(":") & (words > 6))
        & ~((words > 3) & F.lower(title).rlike(rf" (?:{DANGLING})$"))
        & (letters * 10 >= solid * 7)
    )
    return F.when(ok, F.least(F.lit(6), parts + 1))


def size_heading(size: Column, body: Column, text: Column) -> Column:
    return (size >= body * 1.15) & (F.length(text) <= 120) & ~text.rlike(r"^\p{Ll}") & text.rlike(r"\p{L}") & ~text.endswith(",")


def generated_field_name(name: Column) -> Column:
    """Names that a form editor gave: 'unnamed...', or 'field' and digits only."""
    return F.lower(name).rlike("^(unnamed.*|field[0-9]+)$")
