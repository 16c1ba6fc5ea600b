"""Delimited text and Markdown tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import table_cell
from sparkfolio.session import ship_package

ROW_CAP = 2_000


def trimmed(rows: list[list[str]]) -> list[list[str]]:
    """Rows of equal width without blank rows and without blank columns at the edges."""
    kept = [[c.strip() for c in r] for r in rows if any(c.strip() for c in r)]
    width = max(map(len, kept), default=0)
    kept = [r + [""] * (width - len(r)) for r in kept]
    filled = [k for k in range(width) if any(r[k] for r in kept)]
    return [r[filled[0] : filled[-1] + 1] for r in kept] if filled else []


def markdown_table(rows: list[list[str]], cap: int | None = ROW_CAP) -> str:
    """The first row is the header; rows beyond the cap are counted only."""
    rows = trimmed(rows)
    if not rows:
        return ""
    cell = lambda c: " ".join(c.replace("\\", "\\\\").replace("|", "\\|").splitlines()).strip()
    line = lambda r: "|" + "|".join(map(cell, r)) + "|"
    shown = rows[1:] if cap is None else rows[1 : cap + 1]
    out = [line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, shown)]
    more = len(rows) - 1 - len(shown)
    return "\n".join(out) + (f"\n\n… {more} more rows" if more else "")


def csv_to_markdown(text: str, delimiter: str = ",", cap: int | None = ROW_CAP) -> str:
    return markdown_table(list(csv.reader(io.StringIO(text.lstrip("﻿"), newline=""), delimiter=delimiter)), cap)


def convert(files: DataFrame, id_col: str, text_col: str = "text", delimiter: str = ",") -> DataFrame:
    """(id, markdown, error) of delimited texts, one a row."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, errors = [], []
            for raw in batch.column(1).to_pylist():
                try:
                    done.append(csv_to_markdown(raw or "", delimiter))
                    errors.append(None)
                except csv.Error as e:
                    done.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string()), pa.array(errors, pa.string())], [id_col, "markdown", "error"])

    rows = files.select(id_col, text_col)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, markdown string, error string")


def row_line(columns: list[Column]) -> Column:
    """One Markdown table row of a DataFrame's columns."""
    return F.concat(F.lit("|"), F.concat_ws("|", *[table_cell(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]), F.lit("|"))


def render(df: DataFrame, key_cols: list[str], order_cols: list[str], columns: list[str], cap: int = ROW_CAP) -> DataFrame:
    """Each group's first rows as a Markdown table: (keys, markdown, n_rows).

    The cap is the feature; the number of all rows is counted. Rows beyond it leave the plan before the tables are gathered, by a
    window limit that each task applies to its own rows first.
    """
    order = Window.partitionBy(*key_cols).orderBy(*order_cols)
    head = F.lit("|" + "|".join(columns) + "|\n|" + "---|" * len(columns))
    shown = df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).select(*key_cols, "_n", row_line([F.col(c) for c in columns]).alias("_l"))
    tables = shown.groupBy(*key_cols).agg(F.sort_array(F.collect_list(F.struct("_n", "_l"))).alias("_r"))
    counts = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n_rows"))
    body = F.concat_ws("\n", head, F.array_join(F.transform("_r", lambda r: r["_l"]), "\n"))
    more = F.when(F.col("n_rows") > cap, F.concat(F.lit("\n\n… "), (F.col("n_rows") - cap).cast("string"), F.lit(" more rows"))).otherwise(F.lit(""))
    return counts.join(tables, key_cols).select(*key_cols, F.concat(body, more).alias("markdown"), "n_rows")


def number(value: float) -> str:
    """A number as a spreadsheet shows it: no '.0', at most 15 significant digits."""
    if value != value or value in (float("inf"), float("-inf")):
        return str(value)
    if value == int(value) and abs(value) < 1e15:
        return str(int(value))
    out = f"{value:.15g}"
    return "0" if out in ("-0", "0") else out
