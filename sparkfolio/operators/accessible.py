"""Accessibility findings from what a document says of its structure: mark information, structure nodes, elements, links and form fields.

All inputs are rows keyed by document and page; each kind is aggregated by page where it lies and only the counts meet. Findings are rows (keys, page,
type, severity), page null for those of the document. Scores and grades of findings are those of evidence.accessibility.

Cases: a page without any row in a side has count 0 there; a document without pages has document findings only; repeated pages count once. Null
roles, names and labels are missing ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.predicates import generated_field_name

#: Below this share of tagged content a page's tags do not match what it shows.
LEAST_COVERAGE = 0.5


def role_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, roles, headings, figures, contents): structure nodes by page; a node without a role is a reference to content."""
    role = F.lower(F.trim("role"))
    heading = role.isin("h", "heading") | role.rlike("^h[1-6]$")
    return nodes.groupBy(*keys, "page").agg(F.count("role").alias("roles"), F.count_if(heading).alias("headings"), F.count_if(role == "figure").alias("figures"), F.count_if(F.col("role").isNull()).alias("contents"))


def document_findings(docs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of whole documents. docs: keys, marked and suspects (boolean, null if not said), permissions (array<string>, null if not said)."""
    trees = nodes.select(*keys).distinct().withColumn("_tree", F.lit(True))
    rows = docs.join(trees, keys, "left").withColumn("_tree", F.col("_tree").isNotNull())
    closed = F.coalesce((F.size("permissions") > 0) & ~F.array_contains("permissions", "copy_for_accessibility"), F.lit(False))
    kinds = (
        ("mark_info_missing", "medium", F.col("marked").isNull() & ~F.col("_tree")), ("untagged_pdf", "high", ~F.coalesce("marked", F.lit(True))), ("suspect_tags", "high", F.coalesce("suspects", F.lit(False))),
        ("structure_tree_missing", "medium", ~F.col("_tree")), ("accessibility_permission", "high", closed),
    )
    return _told(rows, [*keys, F.lit(None).cast("int").alias("page")], kinds)


def _told(rows: DataFrame, keys: list, kinds: tuple[tuple[str, object, Column], ...]) -> DataFrame:
    each = [F.when(c, F.struct(F.lit(t).alias("type"), (F.lit(s) if isinstance(s, str) else s).alias("severity"))) for t, s, c in kinds]
    return rows.withColumn("_f", F.explode(F.array_compact(F.array(*each)))).select(*keys, "_f.type", "_f.severity")


def page_facts(pages: DataFrame, elements: DataFrame, nodes: DataFrame, outline: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page, tagged, headings, figures, contents, visible, images, outline, coverage) of each page.

    pages: keys, page; elements: keys, page, type; nodes: keys, page, role; outline: keys, a row an entry at any level.
    """
    shown = elements.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("visible"), F.count_if(F.col("type") == "image").alias("images"))
    entries = outline.groupBy(*keys).agg(F.count(F.lit(1)).alias("outline"))
    joined = pages.select(*keys, "page").distinct().join(role_counts(nodes, keys), [*keys, "page"], "left").join(shown, [*keys, "page"], "left").join(entries, keys, "left")
    joined = joined.withColumn("tagged", F.col("contents").isNotNull()).fillna(0, ["roles", "headings", "figures", "contents", "visible", "images", "outline"])
    share = F.floor(F.least(F.lit(1.0), F.col("contents") / F.col("visible")) * 100 + 0.5) / 100
    return joined.withColumn("coverage", F.when(~F.col("tagged"), 0.0).when(F.col("visible") == 0, 1.0).otherwise(share)).drop("roles")


def page_findings(facts: DataFrame, links: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of pages, links and form fields. links: keys, page, url, contents, title; fields: keys, page, name, required."""
    tagged = F.col("tagged")
    kinds = (
        ("untagged_page", "medium", ~tagged), ("heading_structure", "low", tagged & (F.col("headings") == 0) & (F.col("outline") > 0)),
        ("tagged_content_mismatch", "medium", tagged & (F.col("visible") > 0) & (F.col("coverage") < LEAST_COVERAGE)),
        ("image_alt_text", F.when(tagged, "medium").otherwise("high"), (F.col("images") > 0) & (F.col("figures") < F.col("images"))),
    )
    of_pages = _told(facts, [*keys, "page"], kinds)
    known = facts.select(*keys, "page")
    nameless = (F.coalesce("name", F.lit("")) == "") | generated_field_name(F.coalesce("name", F.lit("")))
    of_fields = _told(fields.join(known, [*keys, "page"]), [*keys, "page"], (("form_field_label", F.when(F.coalesce("required", F.lit(False)), "medium").otherwise("low"), nameless),))
    bare = F.col("url").isNotNull() & F.col("contents").isNull() & F.col("title").isNull()
    of_links = _told(links.join(known, [*keys, "page"]), [*keys, "page"], (("link_label", "low", bare),))
    return reduce(DataFrame.unionByName, [of_pages, of_fields, of_links])


def type_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, types): for each document a map from type to number."""
    counted = findings.groupBy(*keys, "type").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "_n")))).alias("types"))


def grade_counts(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, good, partial, weak): pages (keys, grade) by grade."""
    return pages.groupBy(*keys).agg(*[F.count_if(F.col("grade") == g).alias(g) for g in ("good", "partial", "weak")])
