"""What recognition engines give back: word tables, tidied text, tables from word boxes, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import clock


def parse_tsv(pages: DataFrame, id_cols: list[str], text_col: str = "tsv") -> DataFrame:
    """Words of a recogniser's TSV: rows of level 5 with 12 columns, text, and a confidence of 0 or more."""
    rows = pages.select(*id_cols, F.posexplode(F.split(text_col, "\r?\n")).alias("_n", "_l")).withColumn("_c", F.split("_l", "\t", 12))
    cell = lambda k: F.get(F.col("_c"), F.lit(k))
    num = lambda k: F.expr(f"try_cast(get(_c, {k}) as double)")
    kept = rows.filter((F.size("_c") == 12) & (cell(0) == "5") & (num(10) >= 0) & (F.trim(cell(11)) != ""))
    return kept.select(*id_cols, F.col("_n").alias("n"), F.trim(cell(11)).alias("text"), num(6).alias("left"), num(7).alias("top"), num(8).alias("width"), num(9).alias("height"), (num(10) / 100).alias("confidence"))


def tidy(text: Column) -> Column:
    """Lines trimmed at their ends, runs of blank lines as one, none at the start or end."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+(?=\n|$)|(?<=\n)[ \t]+|^[ \t]+", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def table_rows(words: DataFrame, page_cols: list[str], gap: float = 5.0) -> DataFrame:
    """Words with the row they stand in: a step of more than `gap` downwards starts another."""
    order = Window.partitionBy(*page_cols).orderBy("top", "left", "n")
    new = F.coalesce((F.col("top") - F.lag("top").over(order) > gap).cast("int"), F.lit(0))
    return words.withColumn("_new", new).withColumn("row", F.sum("_new").over(order)).drop("_new")


def grid(words: DataFrame, page_cols: list[str], starts: DataFrame) -> DataFrame:
    """Cells (page, row, column, text): words of a row between two column starts, joined from the left.

    starts: page columns and column_start; the starts of a page are few, so each word looks them up in one sorted array.
    """
    listed = starts.groupBy(*page_cols).agg(F.array_sort(F.collect_set("column_start")).alias("_s"))
    placed = words.join(listed, page_cols).withColumn("column", F.greatest(F.lit(0), F.size(F.filter("_s", lambda s: s <= F.col("left") + 0.0001)) - 1))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "n", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*page_cols, "row", "column").agg(texts.alias("text"))


def fuse(pages: DataFrame, recognised: DataFrame, key_cols: list[str], least_chars: int = 24) -> DataFrame:
    """Pages with too little text of their own take the recognised text; the others keep theirs."""
    other = recognised.select(*key_cols, F.col("text").alias("_o"))
    poor = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{IsAlphabetic}\p{N}]", "")) < least_chars
    joined = pages.join(other, key_cols, "left")
    return joined.withColumn("layer", F.when(poor & F.col("_o").isNotNull(), "recognised").otherwise("native")).withColumn("text", F.when(F.col("layer") == "recognised", F.col("_o")).otherwise(F.col("text"))).drop("_o")


def normalize_output(raw: Column) -> Column:
    """A provider's JSON answer as struct<text, kind, confidence, rows>; null fields where it has none or is no JSON."""
    schema = "struct<text:string,kind:string,confidence:double,rows:array<array<string>>>"
    parsed = F.from_json(raw, schema)
    sure = F.when(parsed["confidence"].between(0, 1), parsed["confidence"]).when(parsed["confidence"].between(1, 100), parsed["confidence"] / 100)
    rows = F.filter(parsed["rows"], lambda r: F.size(F.filter(r, lambda c: F.trim(c) != "")) > 0)
    return F.struct(F.coalesce(parsed["text"], F.when(~F.ltrim(raw).startswith("{"), raw)).alias("text"), parsed["kind"].alias("kind"), sure.alias("confidence"), rows.alias("rows"))


def render_transcript(cues: DataFrame, id_cols: list[str]) -> DataFrame:
    """Cues as lines '[start --> end] text', in order."""
    held = cues.groupBy(*id_cols).agg(F.max("end_ms").alias("_m"), F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("_c"))
    line = lambda c: F.concat(F.lit("["), clock(c["start_ms"], F.col("_m") >= 3_600_000), F.lit(" --> "), clock(c["end_ms"], F.col("_m") >= 3_600_000), F.lit("] "), c["text"])
    return held.select(*id_cols, F.array_join(F.transform("_c", line), "\n").alias("transcript"))
