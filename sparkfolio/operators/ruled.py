"""Tables drawn with ruling lines: pieces of lines are merged, lines that touch form a component, a component is a grid of cells.

Rules are rows (keys, horizontal, at, start, stop): a straight line at one coordinate, from start to stop along the other. Keys name the page. Pages of
ordinary size are shuffled once and done where they land. The others go by windows, joins and rounds, and every join is an equality on the page and a
square of it, so that one page with a third of all rules is split by its squares.

Cases: rules with start > stop are turned round; null coordinates make no line. Components of fewer than two horizontal lines, rows or columns are no grid;
how many pairs of lines a page has and how many cells a grid has is not limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.operators import paged
from sparkfolio.operators.borderless import anchored
from sparkfolio.operators.graph import connected_components, labels
from sparkfolio.operators.layout import cluster_positions
from sparkfolio.session import ROWS_A_TASK, cut_lineage, parts_for, ship_package, spread

# They decide what counts as one line, as touching, and as a table.
SNAP = 2.0
COVERED = 0.6
SPARSE = 0.25
#: So many pairs of lines and one line's more are looked at at a time.
PAIRS_AT_ONCE = 4_000_000
#: The cells of larger grids are joined in rounds over all such grids, of others inside a task.
GRID_CELLS = 10_000
#: Pages of more rules than this are merged and find their components in rounds over all pages, others inside a task.
PAGE_LINES = 65_536
#: So many rules and more, of whole pages, are worked on at a time.
RULES_AT_ONCE = 131_072
#: So many cells of grids are joined at a time, and one grid's more.
CELLS_AT_ONCE = 1_000_000
#: Written tables are far smaller than their rows in memory, so joins with them do not broadcast.
MERGE = "merge"
#: What a rule and a line hold besides the keys.
FIELDS = ("horizontal", "at", "start", "stop")
#: Side of the squares that pages are split into for joins, in points.
SQUARE = 72.0
#: How many rows at one place are gathered in one row.
GATHERED = 1_024
#: Tasks for each core where pairs are made: squares differ in pairs, not in rows.
TASKS_A_CORE = 8


def _square(x: Column, side: float) -> Column:
    return F.floor(x / side)


def _turned(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Rules that have all their coordinates, from the lesser end to the greater."""
    turned = rules.select(*keys, "horizontal", F.col("at").cast("double"), F.least("start", "stop").cast("double").alias("start"), F.greatest("start", "stop").cast("double").alias("stop"))
    return turned.dropna(subset=[*FIELDS])


def merged_rules(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Rules of one orientation at about one position become one line where they overlap or nearly touch: (keys, horizontal, at, start, stop).

    A line takes positions up to SNAP / 2 beyond its first one, and along them pieces that leave no gap of more than SNAP.
    """
    turned = _turned(rules, keys)
    side = [*keys, "horizontal"]
    places = anchored(turned, side, "at", SNAP / 2).withColumnRenamed("anchor", "_anchor")
    line = Window.partitionBy(*side, "_anchor")
    along = line.orderBy("start", "stop")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = turned.join(places.hint(MERGE), [*side, "at"]).withColumn("_new", (F.col("start") > reach + SNAP).cast("int"))
    runs = runs.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(along)).groupBy(*side, "_anchor", "_run")
    out = runs.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("at").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    out = out.withColumn("at", F.sum("_sum").over(line) / F.sum("_n").over(line)).filter(F.col("stop") - F.col("start") >= 2 * SNAP)
    return out.select(*side, "at", "start", "stop")


def _edges(lines: DataFrame, keys: list[str], across: bool) -> DataFrame:
    """Column edges (across) or row edges of each component: its lines' positions, and the ends of the lines that cross them."""
    own = lines.filter("NOT horizontal" if across else "horizontal").select(*keys, "grid", "at")
    other = lines.filter("horizontal" if across else "NOT horizontal").groupBy(*keys, "grid").agg(F.min("start").alias("_low"), F.max("stop").alias("_high"))
    ends = other.select(*keys, "grid", F.explode(F.array("_low", "_high")).alias("at"))
    found = cluster_positions(own.unionByName(ends), [*keys, "grid"], "at", SNAP)
    return found.groupBy(*keys, "grid").agg(F.array_sort(F.collect_list("position")).alias("xs" if across else "ys"))


def _touching(owner: np.ndarray, horizontal: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lines of one owner that touch, or that others which touch lead to: all lines that touch another one, in their components.

    Lines are sorted by owner, owners count from 0. All pairs of horizontal and vertical lines are looked at, and what PAIRS_AT_ONCE of them give is kept as one pair a line.
    """
    h, v = np.flatnonzero(horizontal), np.flatnonzero(~horizontal)
    n_v = np.bincount(owner[v], minlength=owner[-1] + 1)
    many, begin = n_v[owner[h]], (np.cumsum(n_v) - n_v)[owner[h]]
    near = lambda x, i: (at[x] >= start[i] - SNAP) & (at[x] <= stop[i] + SNAP)
    part, found = np.cumsum(many) // PAIRS_AT_ONCE, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for k in np.unique(part):
        own = slice(*np.searchsorted(part, [k, k + 1]))
        a = np.repeat(h[own], many[own])
        b = v[np.repeat(begin[own], many[own]) + np.arange(len(a)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])]
        meet = near(b, a) & near(a, b)
        found = tuple(np.concatenate(x) for x in zip(found, (a[meet], b[meet])))
        if len(found[0]) > len(owner):
            root = labels(len(owner), *found)
            led = np.flatnonzero(root != np.arange(len(owner)))
            found = led, root[led]
    return found


def _merged(fresh: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As merged_rules, of rules sorted by page, orientation and position, where fresh marks the first of each orientation: (row, at, start, stop)."""
    anchors = paged.anchor_starts(fresh, at, SNAP / 2)
    group = np.cumsum(anchors) - 1
    order = np.lexsort((stop, start, group))
    low, high, row = start[order], stop[order], np.flatnonzero(anchors)
    runs, reach = [], 0.0
    for new, x, end in zip(anchors.tolist(), low.tolist(), high.tolist()):  # groups lie where they lay before sorting
        new = new or x > reach + SNAP
        reach = end if new or end > reach else reach
        runs.append(new)
    heads = np.flatnonzero(runs)
    position = (np.bincount(group, weights=at) / np.bincount(group))[group[heads]]
    start, stop = low[heads], np.maximum.reduceat(high, heads)
    long = stop - start >= 2 * SNAP
    return row[group[heads]][long], position[long], start[long], stop[long]


def _axes(c: np.ndarray, horizontal: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """As _edges, of lines with their components c, from 0: for rows from the top down, then for columns, the edges and how many each component has."""
    n, side = c.max() + 1, horizontal.astype(np.int64)
    low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
    np.minimum.at(low, (c, side), start)
    np.maximum.at(high, (c, side), stop)
    axis = np.concatenate([2 * c + 1 - side, np.arange(2 * n), np.arange(2 * n)])  # odd ones are columns
    value = np.concatenate([at, low.ravel(), high.ravel()])
    order = np.lexsort((value, axis))
    axis, value = axis[order], value[order]
    new = np.concatenate([[True], (axis[1:] != axis[:-1]) | (value[1:] - value[:-1] > SNAP)])
    edge = np.cumsum(new) - 1
    position, axis = np.bincount(edge, weights=value) / np.bincount(edge), axis[new]
    rows = np.lexsort((-position, axis))
    rows, columns = rows[axis[rows] % 2 == 0], np.flatnonzero(axis % 2 == 1)
    return [(position[k], np.bincount(axis[k] // 2, minlength=n)) for k in (rows, columns)]


def _listed(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _components(whole: pa.Table, keys: list[str]):
    """Batches of the components of lines that touch, of whole pages of sorted rules."""
    fresh = paged.changes(whole, keys)
    horizontal, *values = (whole[f].to_numpy() for f in FIELDS)
    row, *values = _merged(fresh | paged.changes(whole, ["horizontal"]), *values)
    owner, horizontal = (np.cumsum(fresh) - 1)[row], horizontal[row].astype(bool)
    n = fresh.sum()
    n_h, n_v = np.bincount(owner[horizontal], minlength=n), np.bincount(owner[~horizontal], minlength=n)
    pairs = np.where((n_h >= 2) & (n_v >= 1), n_h * n_v, 0)
    fit = pairs[owner] > 0
    row, owner, lines = row[fit], owner[fit], [x[fit] for x in (horizontal, *values)]
    part = (np.cumsum(pairs) // PAIRS_AT_ONCE)[owner]  # so many pages at a time
    for k in np.unique(part):
        low, high = np.searchsorted(part, [k, k + 1])
        own, held = owner[low:high] - owner[low], [x[low:high] for x in lines]
        a, b = _touching(own, *held)
        met = np.union1d(a, b)
        if not len(met):
            continue
        least, first, c = np.unique(labels(high - low, a, b)[met], return_index=True, return_inverse=True)
        met_lines = [x[met] for x in held]
        (ys, n_ys), (xs, n_xs) = _axes(c, *met_lines)
        order = np.argsort(c, kind="stable")
        kinds = [pa.bool_(), *[pa.float64()] * 3]
        columns = {key: whole[key].combine_chunks().take(pa.array(row[low:high][met[first]])) for key in keys}
        columns |= {"grid": pa.array(least - np.searchsorted(own, own[least]), pa.int64()), "xs": _listed(n_xs, pa.array(xs)), "ys": _listed(n_ys, pa.array(ys))}
        columns |= {"n_cols": pa.array(n_xs - 1, pa.int32()), "n_rows": pa.array(n_ys - 1, pa.int32()), "_h": pa.array(np.bincount(c[met_lines[0]], minlength=len(least)), pa.int64())}
        columns["_l"] = _listed(np.bincount(c), pa.StructArray.from_arrays([pa.array(x[order], kind) for x, kind in zip(met_lines, kinds)], FIELDS))
        yield pa.RecordBatch.from_pydict(columns)


def _grids_of_pages(rules: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """(keys, grid, xs, ys, n_cols, n_rows, _h, _l): the components of lines of each page, whose rules come sorted, a few pages at a time."""

    def work(batches):
        for whole in paged.whole_pages(batches, keys, RULES_AT_ONCE):
            yield from _components(whole, keys)

    ship_package(rules.sparkSession)
    kept = ", ".join(f"{f}: double" if f != "horizontal" else f"{f}: boolean" for f in FIELDS)
    own = T.StructType.fromDDL(f"grid long, xs array<double>, ys array<double>, n_cols int, n_rows int, _h long, _l array<struct<{kept}>>")
    schema = T.StructType([*(rules.schema[c] for c in keys), *own])
    return spread(rules, *keys, parts=parts).sortWithinPartitions(*keys, "horizontal", "at").mapInArrow(work, schema)


def _links(lines: DataFrame, keys: list[str], square: float = SQUARE) -> DataFrame:
    """(a, b): numbers of lines (column line) that touch or that others lead to, so that all lines that touch another one are in their components.

    A line goes to every square that it runs through, and two meet in the square of their crossing point. Merged lines of one direction lie apart, so a
    square holds some hundreds at most, and gives no more pairs than it holds lines.
    """
    through = F.sequence(_square(F.col("start") - SNAP, square), _square(F.col("stop") + SNAP, square))
    rows = lines.select(*keys, "line", *FIELDS, F.explode(through).alias("_along"), _square(F.col("at"), square).alias("_across"))
    rows = rows.select(*keys, *[F.when(F.col("horizontal"), F.col(a)).otherwise(F.col(b)).alias(c) for c, a, b in (("_x", "_along", "_across"), ("_y", "_across", "_along"))], "line", *FIELDS)
    place = [*keys, "_x", "_y"]

    def work(batches):
        for whole in paged.whole_pages(batches, place, RULES_AT_ONCE):
            owner = np.cumsum(paged.changes(whole, place)) - 1
            a, b = _touching(owner, *(whole[f].to_numpy().astype(bool if f == "horizontal" else float) for f in FIELDS))
            line = whole["line"].to_numpy()
            yield pa.RecordBatch.from_pydict({"a": pa.array(line[a], pa.int64()), "b": pa.array(line[b], pa.int64())})

    ship_package(lines.sparkSession)
    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(work, "a long, b long")


def _lines_in_rounds(rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grid, horizontal, at, start, stop): lines that touch another one with their component, for pages of any size."""
    lines = cut_lineage(merged_rules(rules, keys).withColumn("line", F.monotonically_increasing_id()))
    found = connected_components(_links(lines, keys))
    return cut_lineage(lines.join(found.hint(MERGE), lines["line"] == found["node"]).select(*keys, F.col("component").alias("grid"), *FIELDS))


def ruled_grids(rules: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Grids (keys, grid, xs, ys, n_cols, n_rows) and their lines (keys, grid, horizontal, at, start, stop). ys go from the top down."""
    turned = _turned(rules, keys).dropna(subset=keys)
    total, large = paged.sized(turned, keys, PAGE_LINES)
    small = turned if large is None else turned.join(large, keys, "left_anti")
    enough = "_h >= 2 AND n_cols >= 2 AND n_rows >= 2"
    pages = cut_lineage(_grids_of_pages(small, keys, parts_for(rules.sparkSession, total, ROWS_A_TASK)).filter(enough).drop("_h"))
    grids, lines = pages.drop("_l"), pages.select(*keys, "grid", F.inline("_l"))
    if large is None:
        return grids, lines
    parted = _lines_in_rounds(turned.join(large, keys, "left_semi"), keys)
    more = _edges(parted, keys, True).join(_edges(parted, keys, False).hint(MERGE), [*keys, "grid"])
    more = more.select(*keys, "grid", "xs", F.reverse("ys").alias("ys"), (F.size("xs") - 1).alias("n_cols"), (F.size("ys") - 1).alias("n_rows"))
    more = more.join(parted.groupBy(*keys, "grid").agg(F.count_if("horizontal").alias("_h")).hint(MERGE), [*keys, "grid"]).filter(enough).drop("_h")
    return grids.unionByName(cut_lineage(more)), lines.unionByName(parted)


def _covered(grids: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grid, n_rows, n_cols, down, r, c): the cell borders that a line covers for the most part; down is that below the cell, else that on its right."""
    met = lines.join(grids.hint(MERGE), [*keys, "grid"])
    overlap = lambda low, high: F.least("stop", high) - F.greatest("start", low) >= (high - low) * COVERED
    inner = lambda n: F.when(F.col(n) > 1, F.sequence(F.lit(1), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    v = met.filter("NOT horizontal").withColumn("_i", F.explode(F.filter(inner("n_cols"), lambda i: F.abs(F.col("at") - F.get("xs", i)) <= SNAP)))
    v = v.withColumn("r", F.explode(F.filter(every("n_rows"), lambda r: overlap(F.get("ys", r + 1), F.get("ys", r))))).select(*keys, "grid", "n_rows", "n_cols", F.lit(False).alias("down"), "r", (F.col("_i") - 1).alias("c"))
    h = met.filter("horizontal").withColumn("_i", F.explode(F.filter(inner("n_rows"), lambda i: F.abs(F.col("at") - F.get("ys", i)) <= SNAP)))
    h = h.withColumn("c", F.explode(F.filter(every("n_cols"), lambda c: overlap(F.get("xs", c), F.get("xs", c + 1))))).select(*keys, "grid", "n_rows", "n_cols", F.lit(True).alias("down"), (F.col("_i") - 1).alias("r"), "c")
    return v.unionByName(h)


def _covered_by_joins(grids: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grid, down, r, c): as _covered, each border once, without an array of a grid's edges beside a line."""
    named = [*keys, "grid"]
    found = []
    for down, edges, others, most, crossing in ((False, "xs", "ys", "n_cols", "r"), (True, "ys", "xs", "n_rows", "c")):
        own = lines.filter("horizontal" if down else "NOT horizontal")
        inner = grids.select(*named, most, F.posexplode(edges).alias("_i", "_e")).filter(f"_i > 0 AND _i < {most}").select(*named, F.col("_i") - 1, "_e", _square(F.col("_e"), SQUARE).alias("_s"))
        inner = inner.toDF(*named, "_i", "_e", "_s")
        at = own.withColumn("_s", F.explode(F.array_distinct(F.array(*[_square(F.col("at") + d, SQUARE) for d in (-SNAP, SNAP)]))))
        at = at.join(inner.hint(MERGE), [*named, "_s"]).filter(F.abs(F.col("at") - F.col("_e")) <= SNAP).select(*named, "_i", "start", "stop")
        ends = F.arrays_zip(F.slice(others, 1, F.size(others) - 1).alias("p"), F.slice(others, 2, F.size(others)).alias("q"))
        spans = grids.select(*named, F.posexplode(ends).alias("_j", "_z")).select(*named, "_j", F.least("_z.p", "_z.q").alias("_low"), F.greatest("_z.p", "_z.q").alias("_high"))
        through = lambda low, high: F.explode(F.sequence(_square(F.col(low), SQUARE), _square(F.col(high), SQUARE)))
        reach = grids.select(*named, F.array_min(others).alias("_least"), F.array_max(others).alias("_most"))
        at = at.join(reach.hint(MERGE), named).withColumns({"start": F.greatest("start", "_least"), "stop": F.least("stop", "_most")}).filter("start <= stop")
        met = at.withColumn("_s", through("start", "stop")).join(spans.withColumn("_s", through("_low", "_high")).hint(MERGE), [*named, "_s"])
        met = met.filter(F.col("_s") == _square(F.greatest("start", "_low"), SQUARE)).filter(F.least("stop", "_high") - F.greatest("start", "_low") >= (F.col("_high") - F.col("_low")) * COVERED)
        r, c = ("_i", "_j") if down else ("_j", "_i")
        found.append(met.select(*named, F.lit(down).alias("down"), F.col(r).alias("r"), F.col(c).alias("c")))
    return found[0].unionByName(found[1]).distinct()


def _cells_in_rounds(grids: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """As ruled_cells, for grids of any number of cells: cells are rows, runs of open cells along a row fall together by a window, and runs over each other by rounds."""
    named = [*keys, "grid"]
    covered = cut_lineage(_covered_by_joins(grids, lines, keys).withColumn("_closed", F.lit(True)))
    numbered = cut_lineage(grids.select(*named, "n_rows", "n_cols").withColumn("_g", F.monotonically_increasing_id()))
    rows = numbered.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).repartition("_g", "r")
    cells = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    for name, down in (("_right", "NOT down"), ("_below", "down")):
        cells = cells.join(covered.filter(down).drop("down").withColumnRenamed("_closed", name).hint(MERGE), [*named, "r", "c"], "left")
    along = Window.partitionBy("_g", "r").orderBy("c")
    first = F.coalesce(F.lag("_right").over(along), F.col("c") == 0)
    run = F.last(F.when(first, F.col("c")), True).over(along)
    cells = cut_lineage(cells.select(*named, "_g", "r", "c", run.alias("_c"), (F.col("_below").isNull() & (F.col("r") + 1 < F.col("n_rows"))).alias("_open")))
    node = lambda r, c: F.struct("_g", F.col(r).alias("r"), F.col(c).alias("c"))
    under = cells.select("_g", (F.col("r") - 1).alias("r"), "c", F.col("r").alias("_r2"), F.col("_c").alias("_c2"))
    edges = cells.filter("_open").join(under.hint(MERGE), ["_g", "r", "c"]).select(node("r", "_c").alias("a"), node("_r2", "_c2").alias("b"))
    found = connected_components(edges).select("node._g", F.col("node.r").alias("r"), F.col("node.c").alias("_c"), "component")
    rooted = cells.join(found.hint(MERGE), ["_g", "r", "_c"], "left")
    return rooted.select(*named, "r", "c", F.coalesce("component.r", "r").alias("root_r"), F.coalesce("component.c", "_c").alias("root_c"))


def ruled_cells(grids: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grid, r, c, root_r, root_c): each grid cell and the first cell of the one that it is part of: cells that no line parts are one."""
    large = grids.filter(F.col("n_rows").cast("long") * F.col("n_cols") > GRID_CELLS)
    if not large.isEmpty():
        small = grids.filter(F.col("n_rows").cast("long") * F.col("n_cols") <= GRID_CELLS)
        return _cells_in_tasks(small, lines, keys).unionByName(_cells_in_rounds(large, lines, keys))
    return _cells_in_tasks(grids, lines, keys)


def _cells_in_tasks(grids: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    size = F.col("n_rows") * F.col("n_cols")
    place = F.when(F.col("down"), size).otherwise(0) + F.col("r") * F.col("n_cols") + F.col("c")
    covered = _covered(grids, lines, keys).groupBy(*keys, "grid").agg(F.collect_set(place).alias("_covered"))
    sized = grids.select(*keys, "grid", "n_rows", "n_cols").join(covered.hint(MERGE), [*keys, "grid"], "left")
    sized = sized.withColumn("_covered", F.coalesce("_covered", F.array().cast("array<int>")))
    named = [*keys, "grid"]

    def join_cells(batches):
        for whole in batches:
            cells = np.cumsum(whole.column("n_rows").to_numpy() * whole.column("n_cols").to_numpy())
            cuts = np.unique([0, *np.searchsorted(cells, np.arange(CELLS_AT_ONCE, cells[-1] if len(cells) else 0, CELLS_AT_ONCE)), whole.num_rows])
            for low, high in zip(cuts[:-1], cuts[1:]):
                batch = whole.slice(low, high - low)
                n_cols, n = batch.column("n_cols").to_numpy().astype(np.int64), batch.column("n_rows").to_numpy().astype(np.int64) * batch.column("n_cols").to_numpy()
                first = np.cumsum(n) - n
                owner = np.repeat(np.arange(len(n)), n)
                at, width = np.arange(len(owner)) - first[owner], n_cols[owner]
                closed = np.zeros((2, len(owner)), bool)
                held = batch.column("_covered")
                of = np.repeat(np.arange(len(n)), np.diff(held.offsets.to_numpy()))
                down, where = np.divmod(held.flatten().to_numpy().astype(np.int64), n[of])
                closed[down, first[of] + where] = True
                right = np.flatnonzero(~closed[0] & (at % width + 1 < width))
                below = np.flatnonzero(~closed[1] & (at + width < n[owner]))
                root = labels(len(owner), np.concatenate([right, below]), np.concatenate([right + 1, below + width[below]])) - first[owner]
                columns = {c: batch.column(c).take(pa.array(owner)) for c in named}
                yield pa.RecordBatch.from_pydict(columns | {k: pa.array(x, pa.int32()) for k, x in {"r": at // width, "c": at % width, "root_r": root // width, "root_c": root % width}.items()})

    ship_package(grids.sparkSession)
    schema = T.StructType([*(grids.schema[c] for c in named), *(T.StructField(c, T.IntegerType()) for c in ("r", "c", "root_r", "root_c"))])
    return sized.mapInArrow(join_cells, schema)


def _gathered(rows: DataFrame, at: list[str], name: str) -> DataFrame:
    """Rows that are equal in `at` as one row with what else they hold, in arrays of at most GATHERED."""
    number = F.row_number().over(Window.partitionBy(*at).orderBy(F.lit(0)))
    rest = [F.col(c) for c in rows.columns if c not in at] or [F.lit(0).alias("_")]
    return rows.withColumn("_chunk", F.floor((number - 1) / GATHERED)).groupBy(*at, "_chunk").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("_chunk")


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], square: float = SQUARE) -> DataFrame:
    """points (keys, x, y, ...) joined to the boxes (keys, x0, bottom, x1, top, ...) that hold them strictly inside; each pair once.

    A box goes to every square that it covers, a point to its own: the two meet there only. Points at one place meet a box once for all of them, and
    equal boxes a point, so that only what comes out grows with the square of copies. It is made in many tasks a core, as some squares hold far more pairs.
    """
    sides = ["x0", "bottom", "x1", "top"]
    spread = lambda low, high: F.explode(F.sequence(_square(F.col(low), square), _square(F.col(high), square)))
    spread_boxes = _gathered(boxes.filter("x0 < x1 AND bottom < top"), [*keys, *sides], "_b").withColumn("_x", spread("x0", "x1")).withColumn("_y", spread("bottom", "top"))
    placed = _gathered(points.filter("x IS NOT NULL AND y IS NOT NULL"), [*keys, "x", "y"], "_p").withColumns({"_x": _square(F.col("x"), square), "_y": _square(F.col("y"), square)})
    inside = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("bottom")) & (F.col("y") < F.col("top"))
    parts = parts_for(points.sparkSession, TASKS_A_CORE * points.sparkSession.sparkContext.defaultParallelism, 1)
    placed, spread_boxes = (frame.repartition(parts, *keys, "_x", "_y") for frame in (placed, spread_boxes))
    met = placed.join(spread_boxes, [*keys, "_x", "_y"]).filter(inside).coalesce(parts)  # the same tasks, but what a place and a box give is handed on before the next box comes
    met = met.withColumn("_p", F.explode("_p"))
    held = lambda frame, at: [c for c in frame.columns if c not in (*keys, *at)]
    p, b = held(points, ("x", "y")), held(boxes, sides)
    pairs = met.select(*keys, "x", "y", *sides, *[F.col(f"_p.{c}").alias(f"_p_{c}") for c in p], F.inline("_b").alias(*[f"_b_{c}" for c in b or ["_"]]))
    own = lambda frame, rest, name: [F.col(f"{name}{c}").alias(c) if c in rest else F.col(c) for c in frame.columns if c not in keys]
    return pairs.select(*keys, *own(points, p, "_p_"), *own(boxes, b, "_b_"))


def place_in_cells(words: DataFrame, grids: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grid, root_r, root_c, text): words (keys, x, y, text) gathered in the cells that hold their centres, from the top down and left to right."""
    boxes = grids.select(*keys, "grid", "xs", "ys", F.get("xs", F.lit(0)).alias("x0"), F.element_at("xs", -1).alias("x1"), F.get("ys", F.lit(0)).alias("top"), F.element_at("ys", -1).alias("bottom"))
    held = points_in_boxes(words, boxes, keys)
    c = F.size(F.filter("xs", lambda e: e < F.col("x"))) - 1
    r = F.size(F.filter("ys", lambda e: e > F.col("y"))) - 1
    placed = held.select(*keys, "grid", F.greatest(r, F.lit(0)).alias("r"), F.greatest(c, F.lit(0)).alias("c"), "x", "y", "text")
    rooted = placed.join(cells, [*keys, "grid", "r", "c"])
    gathered = rooted.groupBy(*keys, "grid", "root_r", "root_c").agg(F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("k"), "x", "text"))).alias("_w"))
    return gathered.select(*keys, "grid", "root_r", "root_c", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"))


def ruled_tables(rules: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, grid, x0, bottom, x1, top, n_rows, n_cols, n_cells, filled, accepted): grids with their merged cells and the words in them.

    A grid is accepted as a table if three cells or more hold text, and a quarter of all.
    """
    grids, lines = ruled_grids(rules, keys)
    cells = cut_lineage(ruled_cells(grids, lines, keys))
    texts = place_in_cells(words, grids, cells, keys).groupBy(*keys, "grid").agg(F.count_if(F.trim("text") != "").alias("filled"))
    merged = cells.filter("r = root_r AND c = root_c").groupBy(*keys, "grid").agg(F.count(F.lit(1)).alias("n_cells"))
    out = grids.join(merged, [*keys, "grid"]).join(texts, [*keys, "grid"], "left")
    filled = F.coalesce("filled", F.lit(0))
    return out.select(
        *keys, "grid", F.get("xs", F.lit(0)).alias("x0"), F.element_at("ys", -1).alias("bottom"), F.element_at("xs", -1).alias("x1"), F.get("ys", F.lit(0)).alias("top"),
        "n_rows", "n_cols", "n_cells", filled.alias("filled"), ((filled >= 3) & (filled >= F.col("n_rows") * SPARSE * F.col("n_cols"))).alias("accepted"),
    )
