"""Page geometry as windows and aggregates: margins, fonts, gaps, gutters, columns, clusters, tables.

Rows are keyed by document and page, so a window never spans more than a page's items unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import margin_key, overlap_ratio


def repeated_margin_lines(lines: DataFrame, doc_cols: list[str], page_col: str, text_col: str, pages: DataFrame) -> DataFrame:
    """Keys of margin lines on at least max(3, half) of a document's pages; pages holds (doc, n_pages)."""
    keyed = lines.select(*doc_cols, page_col, margin_key(F.col(text_col)).alias("key")).filter("key <> ''").distinct()
    counted = keyed.groupBy(*doc_cols, "key").agg(F.count(F.lit(1)).alias("on_pages"))
    return counted.join(pages, doc_cols).filter(F.col("on_pages") >= F.greatest(F.lit(3), F.ceil(F.col("n_pages") / 2))).select(*doc_cols, "key", "on_pages")


def repeated_images(images: DataFrame, doc_cols: list[str], page_col: str, key_col: str, least: int = 3) -> DataFrame:
    """Images on at least `least` pages of a document."""
    return images.groupBy(*doc_cols, key_col).agg(F.countDistinct(page_col).alias("on_pages")).filter(F.col("on_pages") >= least)


def dominant_size(rows: DataFrame, key_cols: list[str], size_col: str, weight_col: str, default: float = 10.0) -> DataFrame:
    """The half-point size that most characters have; of equals the larger."""
    bucket = F.round(F.col(size_col) * 2) / 2
    weighed = rows.groupBy(*key_cols, bucket.alias("_b")).agg(F.sum(weight_col).alias("_w"))
    return weighed.groupBy(*key_cols).agg(F.coalesce(F.max(F.struct("_w", "_b"))["_b"], F.lit(default)).alias("body_size"))


def box_union(rows: DataFrame, key_cols: list[str]) -> DataFrame:
    return rows.groupBy(*key_cols).agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"))


def uncovered_gaps(intervals: DataFrame, key_cols: list[str], start: str, end: str, least: float) -> DataFrame:
    """Gaps of at least `least` that no interval covers, between the first start and the last end."""
    order = Window.partitionBy(*key_cols).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stepped = intervals.select(*key_cols, start, reached.alias("_reach"), F.lead(start).over(order).alias("_next"))
    return stepped.filter(F.col("_next") - F.col("_reach") >= least).select(*key_cols, F.col("_reach").alias("gap_start"), F.col("_next").alias("gap_end"))


def gutters(intervals: DataFrame, key_cols: list[str], start: str, end: str, crossings: int, least: float) -> DataFrame:
    """Stretches that at most `crossings` intervals cross, at least `least` wide, with text on both sides."""
    events = intervals.select(*key_cols, F.explode(F.array(F.struct(F.col(start).alias("x"), F.lit(1).alias("d")), F.struct(F.col(end).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    at = events.groupBy(*key_cols, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*key_cols).orderBy("x")
    active = at.withColumn("active", F.sum("d").over(order)).withColumn("_next", F.lead("x").over(order))
    low = active.filter(F.col("_next").isNotNull()).withColumn("_low", F.col("active") <= crossings)
    island = low.withColumn("_i", F.sum(F.when(F.col("_low"), 0).otherwise(1)).over(order)).filter("_low")
    runs = island.groupBy(*key_cols, "_i").agg(F.min("x").alias("gutter_start"), F.max("_next").alias("gutter_end"))
    return runs.filter(F.col("gutter_end") - F.col("gutter_start") >= least).drop("_i")


def cluster_positions(values: DataFrame, key_cols: list[str], value: str, step: float) -> DataFrame:
    """Means of groups of sorted values whose steps are at most `step`."""
    order = Window.partitionBy(*key_cols).orderBy(value)
    new = (F.col(value) - F.lag(value).over(order) > step).cast("int")
    grouped = values.withColumn("_n", F.coalesce(new, F.lit(0))).withColumn("_g", F.sum("_n").over(order))
    return grouped.groupBy(*key_cols, "_g").agg(F.avg(value).alias("position"), F.count(F.lit(1)).alias("members")).drop("_g")


def column_starts(items: DataFrame, key_cols: list[str], x: str, gap: float = 15.0) -> DataFrame:
    """The first of the sorted distinct x, and each that lies `gap` or more beyond the one before."""
    order = Window.partitionBy(*key_cols).orderBy(x)
    stepped = items.select(*key_cols, x).distinct().withColumn("_p", F.lag(x).over(order))
    return stepped.filter(F.col("_p").isNull() | (F.col(x) - F.col("_p") >= gap)).select(*key_cols, F.col(x).alias("column_start"))


def column_index(x: Column, starts: Column, tolerance: float = 0.0) -> Column:
    """The last of the sorted starts at or before x (less the tolerance), from 0; 0 where none is."""
    return F.greatest(F.lit(0), F.size(F.filter(starts, lambda s: s - tolerance <= x)) - 1)


def cluster_rows(items: Column, tolerance: float = 5.0) -> Column:
    """Items (struct with y) sorted downwards into rows: a row takes items within `tolerance` of its first item.

    The rule looks at a row's anchor, not at the item before, so it is a fold over the array.
    """
    ordered = F.transform(F.sort_array(F.transform(items, lambda i: F.struct((-i["y"]).alias("k"), i.alias("v")))), lambda s: s["v"]["y"].cast("double"))
    folded = F.aggregate(
        ordered,
        F.struct(F.array().cast("array<int>").alias("rows"), F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row")),
        lambda acc, y: F.struct(
            F.concat(acc["rows"], F.array((acc["row"] + F.when(acc["anchor"].isNull() | (F.abs(acc["anchor"] - y) > tolerance), 1).otherwise(0)).cast("int"))).alias("rows"),
            F.when(acc["anchor"].isNull() | (F.abs(acc["anchor"] - y) > tolerance), y).otherwise(acc["anchor"]).alias("anchor"),
            (acc["row"] + F.when(acc["anchor"].isNull() | (F.abs(acc["anchor"] - y) > tolerance), 1).otherwise(0)).cast("int").alias("row"),
        ),
    )
    return F.arrays_zip(ordered.alias("y"), folded["rows"].alias("row"))


def heading_levels(sizes: Column, tolerance: float = 0.6, cap: int = 4) -> Column:
    """Distinct heading sizes from the largest; a size within `tolerance` of the last kept one joins it."""
    return F.slice(
        F.aggregate(
            F.reverse(F.array_sort(F.array_distinct(sizes))),
            F.array().cast("array<double>"),
            lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) - s <= tolerance), acc).otherwise(F.concat(acc, F.array(s.cast("double")))),
        ),
        1,
        cap,
    )


def level_for(size: Column, levels: Column, tolerance: float = 0.6) -> Column:
    """Position of the first level within `tolerance` of the size; 3 where none is."""
    hits = F.filter(F.transform(levels, lambda l, i: F.when(F.abs(l - size) <= tolerance, i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(3))


def regions(rows: DataFrame, key_cols: list[str], order_col: str, aligned: str, least: int = 2) -> DataFrame:
    """Runs of at least `least` consecutive rows with the flag `aligned`: (keys, first, last, n)."""
    order = Window.partitionBy(*key_cols).orderBy(order_col)
    marked = rows.withColumn("_i", F.sum(F.when(F.col(aligned), 0).otherwise(1)).over(order)).filter(F.col(aligned))
    runs = marked.groupBy(*key_cols, "_i").agg(F.min(order_col).alias("first"), F.max(order_col).alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.filter(F.col("n") >= least).drop("_i")


def space_threshold(gaps: Column) -> Column:
    """struct<letter_gap, threshold>: from which gap on two glyphs are two words."""
    n = F.size(gaps)
    letter = F.when(n >= 4, F.element_at(F.array_sort(gaps), (F.floor(n / 4) + 1).cast("int"))).otherwise(F.lit(0.0))
    return F.struct(letter.alias("letter_gap"), F.when(letter > 0.12, letter + F.greatest(letter * 0.8, F.lit(0.15))).otherwise(F.lit(0.16)).alias("threshold"))


def spacing_consistency(rows: DataFrame, key_cols: list[str], y: str) -> DataFrame:
    """1 less the relative deviation of the gaps between rows, at least 0; 1 for two rows, 0 for one."""
    order = Window.partitionBy(*key_cols).orderBy(F.col(y).desc())
    gap = F.abs(F.lag(y).over(order) - F.col(y))
    grouped = rows.withColumn("_gap", gap).groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n"), F.avg("_gap").alias("_avg"), F.stddev_pop("_gap").alias("_dev"))
    value = F.when(F.col("_n") < 2, 0.0).when(F.col("_n") == 2, 1.0).when(F.col("_avg") <= 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.col("_dev") / F.col("_avg")), 2))
    return grouped.select(*key_cols, value.alias("consistency"))


def row_alignment(items: DataFrame, key_cols: list[str], row: str, column: str, columns: int) -> DataFrame:
    """Mean share of the columns that a row fills."""
    filled = items.groupBy(*key_cols, row).agg(F.countDistinct(column).alias("_c"))
    return filled.groupBy(*key_cols).agg(F.round(F.avg(F.least(F.lit(1.0), F.col("_c") / columns)), 2).alias("alignment"))


def header_similarity(a: Column, b: Column) -> Column:
    """Shared header cells over the larger header, lower-cased, blanks left out."""
    norm = lambda h: F.array_distinct(F.filter(F.transform(h, lambda c: F.lower(F.trim(c))), lambda c: c != ""))
    return F.when((F.size(norm(a)) == 0) | (F.size(norm(b)) == 0), 0.0).otherwise(F.size(F.array_intersect(norm(a), norm(b))) / F.greatest(F.size(norm(a)), F.size(norm(b))))


def table_continuations(tables: DataFrame, doc_cols: list[str], least: float = 0.6) -> DataFrame:
    """Tables with the next one where it goes on with them: next page, equal columns, like header.

    tables: doc columns, page, table_index, n_cols, header array<string>.
    """
    order = Window.partitionBy(*doc_cols).orderBy("page", "table_index")
    nxt = tables.withColumn("_next", F.lead(F.struct("page", "table_index", "n_cols", "header")).over(order))
    alike = header_similarity(F.col("header"), F.col("_next.header"))
    goes_on = (F.col("_next.page") == F.col("page") + 1) & (F.col("_next.n_cols") == F.col("n_cols")) & (alike >= least)
    return nxt.select(*doc_cols, "page", "table_index", F.when(goes_on, F.col("_next.page")).alias("next_page"), F.when(goes_on, F.round(alike, 2)).alias("similarity"))


def merge_tables(selectable: DataFrame, recognised: DataFrame, page_cols: list[str], least: float = 0.6) -> DataFrame:
    """All selectable tables, and the recognised ones that overlap none of their page by `least` or more of the smaller area."""
    s, r = selectable.alias("s"), recognised.alias("r")
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(F.col(f"s.{b}"), F.col(f"r.{b}")) - F.greatest(F.col(f"s.{a}"), F.col(f"r.{a}")))
    area = lambda t: (F.col(f"{t}.right") - F.col(f"{t}.left")) * (F.col(f"{t}.top") - F.col(f"{t}.bottom"))
    same = F.lit(True)
    for c in page_cols:
        same = same & (F.col(f"s.{c}") == F.col(f"r.{c}"))
    kept = r.join(s, same & (side("left", "right") * side("bottom", "top") / F.least(area("s"), area("r")) >= least), "left_anti")
    return selectable.withColumn("origin", F.lit("selectable")).unionByName(kept.withColumn("origin", F.lit("recognised")))


def caption_links(captions: DataFrame, targets: DataFrame, page_cols: list[str], reach: float = 96.0) -> DataFrame:
    """Each caption with the table of its page that it most likely belongs to: (page, caption_id, target_id, confidence).

    captions and targets: page columns, id, left, bottom, right, top. A table above or below needs an overlap of 0.2 and a gap of at
    most `reach`, one beside it 0.32. A join on the page with that condition; of equals the first target.
    """
    c, t = captions.alias("c"), targets.alias("t")
    across = overlap_ratio(F.col("c.left"), F.col("c.right"), F.col("t.left"), F.col("t.right"))
    along = overlap_ratio(F.col("c.bottom"), F.col("c.top"), F.col("t.bottom"), F.col("t.top"))
    apart = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.col(b0) - F.col(a1), F.col(a0) - F.col(b1))
    gap_v, gap_h = apart("c.bottom", "c.top", "t.bottom", "t.top"), apart("c.left", "c.right", "t.left", "t.right")
    stacked, beside = (across >= 0.2) & (gap_v <= reach), (along >= 0.32) & (gap_h <= reach)
    score = lambda overlap, gap: F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.62 + 0.18 * overlap + 0.12 - gap / 480))
    same = F.lit(True)
    for col in page_cols:
        same = same & (F.col(f"c.{col}") == F.col(f"t.{col}"))
    confidence = F.round(F.when(stacked, score(across, gap_v)).otherwise(score(along, gap_h)), 4)
    pairs = c.join(t, same & (stacked | beside)).select(*[F.col(f"c.{x}") for x in page_cols], F.col("c.id").alias("caption_id"), F.col("t.id").alias("target_id"), confidence.alias("confidence"))
    # the largest confidence, then the smallest target: one aggregate with map-side combine
    best = pairs.groupBy(*page_cols, "caption_id").agg(F.min(F.struct((-F.col("confidence")).alias("k"), "target_id")).alias("_b"))
    return best.select(*page_cols, "caption_id", F.col("_b.target_id").alias("target_id"), (-F.col("_b.k")).alias("confidence"))


def page_labels(pages: DataFrame, ranges: DataFrame, doc_cols: list[str], label) -> DataFrame:
    """As-of join: each page with the last label range that starts at or before it.

    ranges: doc columns, start, style, prefix, first. Both are merged into one ordered stream per document.
    """
    stream = pages.select(*doc_cols, F.col("page").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<start:int,style:string,prefix:string,first:int>").alias("_r")).unionByName(
        ranges.select(*doc_cols, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("start").cast("int").alias("start"), "style", "prefix", F.col("first").cast("int").alias("first")).alias("_r"))
    )
    order = Window.partitionBy(*doc_cols).orderBy("_at", "_kind")
    known = stream.withColumn("_r", F.last("_r", ignorenulls=True).over(order)).filter("_kind = 1")
    number = F.col("_r.first") + F.col("_at") - F.col("_r.start")
    return known.select(*doc_cols, F.col("_at").alias("page"), F.when(F.col("_r").isNull(), F.col("_at").cast("string")).otherwise(label(F.col("_r.style"), number, F.col("_r.prefix"))).alias("label"))
