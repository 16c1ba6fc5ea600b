"""Pages that come sorted to a task, a few whole ones at a time, as Arrow tables. Keys name the page."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import cut_lineage


def sized(rows: DataFrame, keys: list[str], most: int) -> tuple[int, DataFrame | None]:
    """How many rows there are, and the keys of pages of more than `most` rows, None if no page is so large."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, n_large = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(F.col("_n") > most)).first()
    return total, cut_lineage(sizes.filter(F.col("_n") > most).drop("_n")) if n_large else None


def changes(whole: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row differs in one of the keys from the row before; the first one does."""
    differ = lambda c: pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy().astype(bool)
    return np.concatenate([[True], np.logical_or.reduce([differ(whole[k]) for k in keys])])


def whole_pages(batches: Iterable[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Batches sorted by keys as tables of whole pages, of `least` rows or more but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            whole = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(changes(whole, keys))[-1])  # the last page may go on
            if cut:
                yield whole.slice(0, cut)
            held, n = whole.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held)


def anchor_starts(fresh: np.ndarray, value: np.ndarray, step: float) -> np.ndarray:
    """Where a group of sorted values begins: with its anchor, and it takes values up to `step` beyond that. fresh marks the first value of each page."""
    found, first = [], 0.0
    for new, x in zip(fresh.tolist(), value.tolist()):
        new = new or (x != first and not x - first <= step)
        first = x if new else first
        found.append(new)
    return np.array(found, bool)
