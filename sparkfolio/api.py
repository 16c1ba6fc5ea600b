"""The four tools: read, search, outline and inspect, over folders of files or DataFrames of units."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import estimate_tokens, yaml_scalar
from sparkfolio.operators import compare, evidence, outline, reading, search, units
from sparkfolio.sources import detect, office

#: What each preset of inspect computes.
PRESETS = {
    "fast": ("elements",),
    "balanced": ("elements", "safety"),
    "quality": ("elements", "safety", "layout", "chunks"),
    "research": ("elements", "safety", "layout", "chunks", "trust"),
    "full": ("elements", "safety", "layout", "chunks", "trust", "outline"),
}


@dataclass(frozen=True)
class ReadOptions:
    max_tokens: int | None = None
    pages: str | None = None
    cursor: str | None = None

    def __post_init__(self) -> None:
        if self.max_tokens is not None and not 1 <= self.max_tokens <= 10_000_000:
            raise ValueError("max_tokens must be from 1 to 10000000")
        if self.cursor is not None:
            parse_cursor(self.cursor)

    @property
    def budget(self) -> int:
        return max(500, min(1_000_000, self.max_tokens or 20_000))


def parse_cursor(value: str) -> tuple[int, int]:
    """'<unit>' or '<unit>:<offset>'; units count from 1."""
    unit, _, offset = value.partition(":")
    if not unit.isdigit() or int(unit) < 1 or (offset and not offset.isdigit()):
        raise ValueError(f"bad cursor {value!r}: expected <unit> or <unit>:<offset>")
    return int(unit), int(offset or 0)


def load(spark: SparkSession, folder: str, glob: str = "*", roots: list[str] | None = None) -> DataFrame:
    """Units (path, number, label, markdown, error) of every readable file of a folder tree. A file that was not read keeps its row, with an error."""
    files = detect.scan(spark, folder, glob, roots).filter(detect.readable(F.col("path")))
    found = office.convert(files.filter(F.col("error").isNull()))
    refused = files.filter(F.col("error").isNotNull()).select("path", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("number", "label", "markdown")), "error")
    return found.unionByName(refused)


def read(units_df: DataFrame, options: ReadOptions | None = None, cursors: DataFrame | None = None) -> DataFrame:
    """Each document's units within the budget: path, number, label, cost, markdown (what is shown of it) and cursor.

    The cursor is that of the document's next call, from where its text was cut; null where all has been shown. The options' cursor is for calls on
    one document, as it is applied to all; cursors (path, cursor) continues every document from its own, and leaves out those it does not name.
    Rows with an error are not shown.
    """
    options = options or ReadOptions()
    rows = units_df.filter(F.col("error").isNull()) if "error" in units_df.columns else units_df
    if options.pages is not None:
        wanted = rows.sparkSession.range(1).select(F.explode(reading.parse_pages(F.lit(options.pages))).alias("number"))
        rows = rows.join(F.broadcast(wanted), "number", "left_semi")  # at most 10 001 numbers for each part of the selector
    if options.cursor is not None:
        unit, offset = parse_cursor(options.cursor)
        rows = rows.withColumns({"_unit": F.lit(unit), "_offset": F.lit(offset)})
    elif cursors is not None:
        place = F.split("cursor", ":")
        parsed = cursors.filter(F.col("cursor").isNotNull()).select("path", place[0].cast("int").alias("_unit"), F.coalesce(F.get(place, 1).cast("int"), F.lit(0)).alias("_offset"))
        rows = rows.join(parsed.distinct(), "path")
    else:
        rows = rows.withColumns({"_unit": F.lit(1), "_offset": F.lit(0)})
    rows = rows.filter(F.col("number") >= F.col("_unit")).withColumn("_offset", F.when(F.col("number") == F.col("_unit"), F.col("_offset")).otherwise(0))
    rows = rows.withColumn("markdown", F.expr("substring(markdown, _offset + 1)"))
    found = reading.read_budgeted(rows, options.budget, ["path"], "number", "markdown")
    shown = found.join(rows.select("path", "number", "label", "markdown", "_offset"), ["path", "number"])
    cut = F.when(F.col("cut_at").isNotNull(), reading.cut_point(F.col("markdown"), F.col("cut_at").cast("int")).cast("int"))
    shown = shown.withColumn("_cut", F.when(F.col("shown"), cut))
    here = F.when(~F.col("shown"), F.col("number").cast("string")).when(F.col("_cut") < F.length("markdown"), F.concat_ws(":", F.col("number").cast("string"), (F.col("_offset") + F.col("_cut")).cast("string")))
    pending = F.min(F.when(here.isNotNull(), F.struct("number", here.alias("cursor")))).over(Window.partitionBy("path"))["cursor"]
    body = F.when(F.col("_cut").isNotNull(), F.expr("substring(markdown, 1, _cut)")).otherwise(F.col("markdown"))
    return shown.select("path", "number", "label", "cost", body.alias("markdown"), pending.alias("cursor"), "shown").filter("shown").drop("shown")


def front_matter(pairs: DataFrame, key_cols: list[str]) -> DataFrame:
    """Ordered (position, key, value) rows of each document as a YAML header."""
    line = F.concat(F.col("key"), F.lit(": "), yaml_scalar(F.col("value")))
    held = pairs.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("_l"))
    return held.select(*key_cols, F.concat(F.lit("---\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n---\n")).alias("header"))


def find(units_df: DataFrame, query: str, mode: str = "auto", limit: int = 20, whole_word: bool = False) -> DataFrame:
    """Search: 'literal', 'ranked', or 'auto' (ranked where nothing matches literally)."""
    keys = ["path", "number"]
    if mode == "literal":
        return search.literal_counts(units_df, query, keys, "markdown", whole_word=whole_word).orderBy(F.desc("matches"), *keys).limit(limit)
    if mode == "ranked":
        return search.ranked(units_df, query, limit, keys, "markdown")
    if mode != "auto":
        raise ValueError("mode must be auto, literal or ranked")
    return search.auto_search(units_df, query, limit, keys, "markdown")[1]


def outline_of(units_df: DataFrame) -> DataFrame:
    return outline.outlines(units_df, ["path", "number"], "markdown")


def inspect(docs: DataFrame, preset: str = "balanced", id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """The projections of a preset, each a lazy DataFrame: what is not used is not computed."""
    if preset not in PRESETS:
        raise ValueError(f"preset must be one of {', '.join(PRESETS)}")
    found = units.elements(docs, id_col, text_col)
    hinted = found.withColumn("hint", units.semantic_hint(F.col("content")))
    pages = found.groupBy(id_col, "page").agg(F.count(F.lit(1)).alias("item_count"), F.lit(0).cast("long").alias("positioned_count"))
    layout = evidence.layout_diagnostics(pages, [id_col, "page"])
    safety = evidence.safety_findings(found, id_col)
    parts = {
        "elements": lambda: hinted,
        "safety": lambda: safety,
        "layout": lambda: layout,
        "chunks": lambda: outline.citation_chunks(hinted.withColumn("role", F.col("hint.role")), id_col),
        "trust": lambda: evidence.trust_report(evidence.trust_signals(safety, layout, id_col), [id_col]),
        "outline": lambda: outline.outlines(docs, [id_col], text_col),
    }
    return {name: parts[name]() for name in PRESETS[preset]}


def page_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.length(text_col).alias("chars"), estimate_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"), F.sha2(F.encode(text_col, "UTF-8"), 256).alias("sha256"))


def cite_check(citations: DataFrame, units_df: DataFrame, key_cols: list[str]) -> DataFrame:
    return compare.cite_check(citations, units_df, key_cols, text_col="markdown")
