"""Page selectors, sampling, and reading within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import estimate_tokens

UNIT_OVERHEAD = 8
OPEN_RANGE = 10_000


def parse_pages(spec: Column) -> Column:
    """'1-3,5,+2,9-' as sorted distinct page numbers; null where a part is no page or range."""
    parts = F.transform(F.split(spec, ","), lambda p: F.regexp_replace(F.trim(p), r"\s", ""))
    one = lambda p: F.regexp_extract(p, r"^\+?(\d+)$", 1).cast("int")
    a = lambda p: F.regexp_extract(p, r"^\+?(\d+)-\+?(\d*)$", 1).cast("int")
    b = lambda p: F.regexp_extract(p, r"^\+?(\d+)-\+?(\d*)$", 2)
    good = lambda p: p.rlike(r"^\+?0*[1-9]\d{0,6}$") | (
        p.rlike(r"^\+?0*[1-9]\d{0,6}-(\+?0*[1-9]\d{0,6})?$") & ((b(p) == "") | (b(p).cast("int") >= a(p)))
    )
    span = lambda p: F.when(p.contains("-"), F.sequence(a(p), F.when(b(p) == "", a(p) + OPEN_RANGE).otherwise(b(p).cast("int")))).otherwise(F.array(one(p)))
    return F.when(F.forall(parts, good), F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parts, good), span)))))


def describe_pages(pages: Column) -> Column:
    """Sorted page numbers as '1-3,5'."""
    runs = F.aggregate(
        pages,
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] == p - 1),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), p.cast("int").alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.cast("int").alias("a"), p.cast("int").alias("b"))))),
    )
    return F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string")))), ",")


def compact_pages(rows: DataFrame, doc_cols: list[str], page_col: str) -> DataFrame:
    """Runs of consecutive pages of each document, as rows: (doc, first, last)."""
    order = Window.partitionBy(*doc_cols).orderBy(page_col)
    island = F.col(page_col) - F.row_number().over(order)
    return rows.select(*doc_cols, page_col).distinct().withColumn("_i", island).groupBy(*doc_cols, "_i").agg(F.min(page_col).alias("first"), F.max(page_col).alias("last")).drop("_i")


def sample_pages(total: Column, wanted: int) -> Column:
    """Evenly spaced page numbers, first and last among them."""
    n = F.least(total, F.lit(wanted))
    place = lambda i: (1 + F.floor((i * (total - 1) + F.floor((n - 1) / 2)) / (n - 1))).cast("int")
    return F.when(total <= 0, F.array().cast("array<int>")).when(n == 1, F.array(F.lit(1))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), place))
    )


def budget(max_tokens: Column) -> Column:
    return F.greatest(F.lit(500), F.least(F.lit(1_000_000), F.coalesce(max_tokens, F.lit(20_000))))


def read_budgeted(units: DataFrame, tokens: int, doc_cols: list[str], unit_col: str, text_col: str = "text", after: int | None = None) -> DataFrame:
    """Each document's units from the cursor on while the budget lasts: (doc, unit, cost, running, shown, cut_at).

    A unit costs its tokens and UNIT_OVERHEAD. The first unit that would exceed the budget, and all after it, are not shown; where
    that is the very first, it is shown up to cut_at characters.
    """
    rows = units if after is None else units.filter(F.col(unit_col) >= after)
    cost = estimate_tokens(F.coalesce(F.col(text_col), F.lit(""))) + UNIT_OVERHEAD
    order = Window.partitionBy(*doc_cols).orderBy(unit_col)
    costed = rows.select(*doc_cols, unit_col, cost.alias("cost"), F.length(text_col).alias("_chars"))
    running = costed.withColumn("running", F.sum("cost").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    room = F.greatest(F.lit(512), F.floor(F.col("_chars") * F.greatest(F.lit(tokens), F.lit(250)) / F.col("cost")))
    fits = F.col("running") <= tokens
    return running.select(*doc_cols, unit_col, "cost", "running", (fits | F.col("_first")).alias("shown"), F.when(~fits & F.col("_first"), F.least("_chars", room).cast("long")).alias("cut_at"))


def next_cursor(read: DataFrame, doc_cols: list[str], unit_col: str) -> DataFrame:
    """The cursor of each document: the first unit not shown whole, with the offset in it; null when all was shown."""
    pending = F.when(~F.col("shown") | F.col("cut_at").isNotNull(), F.struct(F.col(unit_col).alias("unit"), F.coalesce("cut_at", F.lit(0)).alias("offset")))
    return read.groupBy(*doc_cols).agg(F.min(pending).alias("_c"), F.count_if("shown").alias("shown")).select(
        *doc_cols, "shown", F.when(F.col("_c.offset") > 0, F.concat_ws(":", F.col("_c.unit").cast("string"), F.col("_c.offset").cast("string"))).otherwise(F.col("_c.unit").cast("string")).alias("cursor")
    )


def cut_point(text: Column, limit: Column) -> Column:
    """Where to cut a text of more than limit characters: after the last blank line, else the last line, in the second half; else at limit."""
    head = F.substring(text, F.lit(1), limit)
    last = lambda mark: F.length(head) - F.instr(F.reverse(head), mark) + 1
    blank = F.when(F.instr(F.reverse(head), "\n\n") > 0, last("\n\n"))
    line = F.when(F.instr(F.reverse(head), "\n") > 0, last("\n"))
    return F.when(F.length(text) <= limit, F.length(text)).when(blank > limit / 2, blank).when(line > limit / 2, line).otherwise(limit)
