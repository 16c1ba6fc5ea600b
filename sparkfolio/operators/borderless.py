"""Tables without lines: rows of text by height, column boundaries voted by the places of all rows, runs of aligned rows, and how far to trust them.

Items are rows (keys, text, left, bottom, right, top); keys name the page. Items without text or with a side that is no number are left out. Tables are found
on pages of any size; only table_items, which gives each item all boundaries of its page, has limits of what it admits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.operators import paged
from sparkfolio.session import ROWS_A_TASK, cut_lineage, parts_for, ship_package, spread

# They decide what is a row, a column and a table.
ROW, GAP = 5.0, 15.0
#: What table_items admits of a page; tables themselves have no such limit.
MAX_ITEMS, MAX_BOUNDARIES, MAX_CELLS = 4_096, 256, 16_384
#: Pages of more items than this go by windows and joins over all pages, others inside a task.
PAGE_ITEMS = 65_536
#: So many items and more, of whole pages, are looked at at a time.
ITEMS_AT_ONCE = 65_536
LEAST_CONFIDENCE, LOW_CONFIDENCE, IRREGULAR = 0.3, 0.65, 0.75
SIDES = ("left", "bottom", "right", "top")
#: Written tables are far smaller than their rows in memory, so joins with them do not broadcast.
MERGE = "merge"


def _hundredths(value: Column) -> Column:
    """Rounded as a product with 100 is: 0.575 is a little less than it seems, so it gives 0.57."""
    return F.floor(value * 100 + 0.5) / 100


def anchored(values: DataFrame, keys: list[str], value: str, step: float) -> DataFrame:
    """(keys, value, anchor): the group of each distinct value, upwards: a group takes values up to `step` beyond its first, its anchor.

    An anchor follows from the one before, so the distinct values of a page pass a task in order, a batch at a time, and nothing but the last is kept.
    """
    distinct = values.select(*keys, value).distinct()
    schema = T.StructType([*distinct.schema, T.StructField("anchor", T.DoubleType())])

    def work(batches):
        last, anchor = [], 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = paged.changes(pa.Table.from_batches([*last, batch]), keys)[len(last) :]
            last, found = [batch.slice(batch.num_rows - 1)], []
            for new, x in zip(fresh.tolist(), batch.column(value).to_pylist()):
                anchor = x if new or (x != anchor and not x - anchor <= step) else anchor
                found.append(anchor)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], schema.names)

    ship_package(values.sparkSession)
    return distinct.repartition(*keys).sortWithinPartitions(*keys, value).mapInArrow(work, schema)


def _placed(whole: pa.Table, keys: list[str], columns: list[str], limited: bool) -> pa.RecordBatch:
    """The items of all tables, of whole pages of items sorted downwards; limited leaves out the pages that table_items does not admit."""
    fresh = paged.changes(whole, keys)
    page, down, left = np.cumsum(fresh) - 1, -whole["bottom"].to_numpy(), whole["left"].to_numpy()
    begins = paged.anchor_starts(fresh, down, ROW)
    line = np.cumsum(begins) - 1
    anchor, of_page, n = down[begins], page[begins], fresh.sum()
    size = np.bincount(line)
    held = np.flatnonzero(size[line] >= 2)
    full = size >= 2
    # starts of columns, by the places of the items in rows of two and more: those within GAP of a start belong to it
    order = held[np.lexsort((left[held], page[held]))]
    x, p = left[order], page[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (x[1:] - x[:-1] >= GAP)])[: len(x)]
    starts, n_starts = x[new], np.bincount(p[new], minlength=n)
    first = np.cumsum(n_starts) - n_starts
    column = np.cumsum(new) - 1
    near = np.bincount(line[order[x - starts[column] < GAP]], minlength=len(size))
    good = (np.bincount(of_page[full], minlength=n) >= 2) & (n_starts >= 2) & (not limited or n_starts <= MAX_BOUNDARIES)
    # runs of at least two aligned rows
    rows = np.flatnonzero(full & good[of_page])
    aligned = near[rows] >= n_starts[of_page[rows]] - 1
    run = np.cumsum(~aligned | (np.diff(of_page[rows], prepend=-1) != 0))[aligned]  # another page is another run
    rows = rows[aligned]
    same = np.unique(run, return_inverse=True)[1]
    long = np.bincount(same)[same] >= 2 if len(same) else np.zeros(0, bool)
    run, rows = run[long], rows[long]
    if limited:
        fit = np.bincount(of_page[rows], weights=n_starts[of_page[rows]], minlength=n)[of_page[rows]] <= MAX_CELLS
        run, rows = run[fit], rows[fit]
    begins = np.diff(run, prepend=-1) != 0
    count = lambda marks: np.arange(len(rows)) - np.maximum.accumulate(np.where(marks, np.arange(len(rows)), 0))
    turn = np.diff(of_page[rows], prepend=-1) != 0
    tables = np.cumsum(begins)
    table = tables - tables[np.arange(len(rows)) - count(turn)]
    number, at = np.full(len(size), -1), np.zeros(len(size), np.int64)
    number[rows], at[rows] = table, count(begins)
    kept = order[number[line[order]] >= 0]
    col = (column - first[p])[number[line[order]] >= 0]
    out = {k: whole[k].combine_chunks().take(pa.array(kept)) for k in (*keys, "left", "bottom", "right", "top", "text")}
    out |= {"table_index": pa.array(number[line[kept]], pa.int32()), "row": pa.array(at[line[kept]], pa.int32()), "y": pa.array(-anchor[line[kept]])}
    out["col"] = pa.array(col, pa.int32())
    if limited:
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_starts)]), pa.int32()), pa.array(starts))
        out["starts"] = listed.take(pa.array(page[kept]))
    else:
        # how many starts of the page the right side reaches
        right, of_start = whole["right"].to_numpy()[kept], p[new]
        is_start = np.arange(len(starts) + len(kept)) < len(starts)
        sorted_ = np.lexsort((~is_start, np.concatenate([starts - GAP / 2, right]), np.concatenate([of_start, page[kept]])))
        reached = np.empty(len(sorted_), np.int64)
        reached[sorted_] = np.cumsum(is_start[sorted_])
        span = np.maximum(reached[len(starts) :] - first[page[kept]] - col - 1, 0) + 1
        out |= {"span": pa.array(span, pa.int32()), "cols": pa.array(n_starts[page[kept]], pa.int32())}
    return pa.RecordBatch.from_pydict({c: out[c] for c in columns})


def _placed_by_joins(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_index, row, y, col, span, cols): as _placed without limits, for pages of any size: what is sorted by page are distinct values."""
    page = Window.partitionBy(*keys)
    down = items.select(*keys, "left", "right", (-F.col("bottom")).alias("_down"))
    lines = cut_lineage(down.join(anchored(down, keys, "_down", ROW).hint(MERGE), [*keys, "_down"]).drop("_down"))
    full = lines.groupBy(*keys, "anchor").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")
    held = lines.join(full.hint(MERGE), [*keys, "anchor"])
    along = page.orderBy("left")
    new = F.coalesce(F.col("left") - F.lag("left").over(along) >= GAP, F.lit(True))
    lefts = held.select(*keys, "left").distinct().withColumn("_new", new).withColumns({"col": F.sum(F.col("_new").cast("int")).over(along) - 1, "_start": F.last(F.when(F.col("_new"), F.col("left")), True).over(along)})
    lefts = cut_lineage(lefts)
    starts = lefts.filter("_new").select(*keys, "_start")
    many = starts.groupBy(*keys).agg(F.count(F.lit(1)).alias("cols"))
    placed = cut_lineage(held.join(lefts.drop("_new").hint(MERGE), [*keys, "left"]))
    rows = placed.groupBy(*keys, "anchor").agg(F.count_if(F.col("left") - F.col("_start") < GAP).alias("_near")).join(many.hint(MERGE), keys)
    rows = rows.withColumn("_rows", F.count(F.lit(1)).over(page)).filter("_rows >= 2 AND cols >= 2").withColumn("_aligned", F.col("_near") >= F.col("cols") - 1)
    rows = rows.withColumn("_run", F.sum((~F.col("_aligned")).cast("int")).over(page.orderBy("anchor"))).filter("_aligned")
    run = Window.partitionBy(*keys, "_run")
    rows = rows.withColumns({"_long": F.count(F.lit(1)).over(run), "row": F.row_number().over(run.orderBy("anchor")) - 1}).filter("_long >= 2")
    rows = cut_lineage(rows.select(*keys, "anchor", (F.dense_rank().over(page.orderBy("_run")) - 1).alias("table_index"), "row", (-F.col("anchor")).alias("y"), "cols"))
    found = placed.join(rows.hint(MERGE), [*keys, "anchor"]).select(*keys, "table_index", "row", "y", "col", "right", "cols")
    ends = found.select(*keys, F.col("right").alias("_x")).distinct().withColumn("_start", F.lit(False))
    ends = ends.unionByName(starts.select(*keys, (F.col("_start") - GAP / 2).alias("_x"), F.lit(True).alias("_start")))
    ends = ends.withColumn("_reached", F.count_if("_start").over(page.orderBy("_x"))).filter("NOT _start").select(*keys, F.col("_x").alias("right"), "_reached")
    reached = found.join(ends.hint(MERGE), [*keys, "right"]).withColumn("span", F.greatest(F.col("_reached") - F.col("col") - 1, F.lit(0)) + 1)
    return reached.select(*keys, *[F.col(c).cast("int") for c in ("table_index", "row")], "y", *[F.col(c).cast("int") for c in ("col", "span", "cols")])


def _items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items with text and with sides that are numbers."""
    good = items.select(*keys, F.trim("text").alias("text"), *[F.col(s).cast("double").alias(s) for s in SIDES]).filter("text <> ''").dropna(subset=keys)
    for s in SIDES:
        good = good.filter(F.col(s).isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))
    return good


def _placed_in_tasks(good: DataFrame, keys: list[str], total: int, columns: str, limited: bool) -> DataFrame:
    schema = T.StructType([*(good.schema[c] for c in keys), *T.StructType.fromDDL(columns)])

    def work(batches):
        for whole in paged.whole_pages(batches, keys, ITEMS_AT_ONCE):
            yield _placed(whole, keys, schema.names, limited)

    ship_package(good.sparkSession)
    return spread(good, *keys, parts=parts_for(good.sparkSession, total, ROWS_A_TASK)).sortWithinPartitions(*keys, F.col("bottom").desc()).mapInArrow(work, schema)


def table_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items of all tables: (keys, table_index, row, y, col, starts, left, bottom, right, top, text); row counts from 0 downwards.

    Pages of more than MAX_ITEMS items, MAX_BOUNDARIES boundaries or MAX_CELLS cells have none: each item carries all boundaries of its page.
    """
    good = _items(items, keys)
    total, large = paged.sized(good, keys, MAX_ITEMS)
    good = good if large is None else good.join(large, keys, "left_anti")
    return _placed_in_tasks(good, keys, total, "table_index int, row int, y double, col int, starts array<double>, left double, bottom double, right double, top double, text string", True)


def placed_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_index, row, y, col, span, cols) of the items of all tables, on pages of any size: the columns that an item reaches into and those of its page.

    Pages of at most PAGE_ITEMS items are shuffled once and looked at where they land.
    """
    good = _items(items, keys)
    total, large = paged.sized(good, keys, PAGE_ITEMS)
    small = good if large is None else good.join(large.hint(MERGE), keys, "left_anti")
    found = _placed_in_tasks(small, keys, total, "table_index int, row int, y double, col int, span int, cols int", False)
    return found if large is None else found.unionByName(_placed_by_joins(good.join(large.hint(MERGE), keys, "left_semi"), keys))


def table_cells(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_index, row, y, col, text, right, col_span, starts): the cells that hold text, with the columns that their box reaches into."""
    cells = found.groupBy(*keys, "table_index", "row", "y", "col").agg(F.sort_array(F.collect_list(F.struct("left", "text"))).alias("_t"), F.max("right").alias("right"), F.first("starts").alias("starts"))
    beyond = F.slice("starts", F.col("col") + 2, F.size("starts"))
    short = F.array_position(F.transform(beyond, lambda s: F.col("right") >= s - GAP / 2), F.lit(False))
    span = F.when(short > 0, short).otherwise(F.size(beyond) + 1)
    return cells.select(*keys, "table_index", "row", "y", "col", F.array_join(F.transform("_t", lambda t: t["text"]), " ").alias("text"), "right", span.cast("int").alias("col_span"), "starts")


def borderless_tables(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_index, row_count, col_count, confidence, completeness, non_empty, alignment, spacing, missing, merged, signals) of each table.

    confidence is the mean of the rows' shares of filled columns and of the evenness of their distances; tables below LEAST_CONFIDENCE are none.
    """
    table = [*keys, "table_index"]
    cells = placed_items(items, keys).groupBy(*table, "row", "y", "col").agg(F.max("span").alias("_span"), F.first("cols").alias("cols"))
    rows = cells.groupBy(*table, "row", "y").agg(F.count(F.lit(1)).alias("_filled"), F.count_if(F.col("_span") > 1).alias("_merged"), F.first("cols").alias("_cols"))
    step = F.abs(F.lag("y").over(Window.partitionBy(*table).orderBy("row")) - F.col("y"))
    facts = rows.withColumn("_step", step).groupBy(*table).agg(
        F.count(F.lit(1)).alias("row_count"), F.first("_cols").alias("col_count"), F.sum("_filled").alias("_full"), F.sum("_merged").alias("merged"),
        F.avg("_step").alias("_avg"), F.stddev_pop("_step").alias("_std"),
    )
    even = F.when(F.col("_avg") > 0, F.greatest(F.lit(0.0), 1 - F.col("_std") / F.col("_avg"))).otherwise(0.0)
    facts = facts.withColumn("_shares", F.col("_full") / F.col("col_count"))
    n = F.col("row_count") * F.col("col_count")
    sure = F.least(F.lit(1.0), (F.col("_shares") + even) / (F.col("row_count") + 1))
    spacing = F.when(F.col("row_count") < 3, 1.0).otherwise(_hundredths(even))
    kept = facts.withColumn("_sure", sure).filter(F.col("_sure") >= LEAST_CONFIDENCE).withColumns(
        {"confidence": _hundredths(F.col("_sure")), "non_empty": _hundredths(F.col("_full") / n), "alignment": _hundredths(F.col("_shares") / F.col("row_count")), "spacing": spacing, "missing": n - F.col("_full")}
    )
    signals = {"complete_grid": F.col("missing") == 0, "missing_cells": F.col("missing") > 0, "merged_cell_candidates": F.col("merged") > 0, "incomplete_cell_geometry": F.col("missing") > 0, "irregular_row_spacing": F.col("spacing") < IRREGULAR, "low_confidence": F.col("confidence") < LOW_CONFIDENCE}
    listed = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in signals.items()]))
    return kept.select(*table, "row_count", "col_count", "confidence", _hundredths(F.col("non_empty") * F.col("alignment")).alias("completeness"), "non_empty", "alignment", "spacing", "missing", "merged", listed.alias("signals"))
