"""Reading order by recursive splitting: a page falls into bands, a band with a gutter into columns, a column into bands again.

The recursion is level by level over a frontier of regions: all regions of all pages that can still be split are looked at in one round; at most MAX_DEPTH
rounds. Pages of ordinary size are shuffled once, and the rounds go over the pages that a task holds. For larger ones (reading_regions) a round is windows and
aggregates by region, and is written; there a region is named by its path, a string that sorts in reading order.

Segments are rows (keys, item, x0, x1, top, bottom, chars, body): keys name the page, body is the page's font size. Cases: segments without a place are
left out; a page of one segment, or without a gutter, is one region. Repeated rows stay together.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.operators import paged
from sparkfolio.session import cut_lineage, parts_for, ship_package, spread

# They decide what is a band, a gutter and a column of text.
MAX_DEPTH = 8
BAND_GAP, GUTTER, SAME_GUTTER, SLACK = 0.55, 0.9, 2.0, 0.5
LEAST_SEGMENTS, CROSSINGS = 6, 12
LINE_CHARS, PROSE_CHARS = 10, 25
COLUMN_CHARS, INNER_CHARS, FILL, SHARE = 18.0, 30.0, 0.55, 0.2
BARRIER_WIDTH, BARRIER_GAP = 0.5, 0.3
#: Tables of regions grow with the pages, and their written files are far smaller than their rows in memory: none of them goes through the driver.
MERGE = "merge"
#: How far a side that is no column itself may be looked at for columns of its own.
NESTED = 1
#: Pages of more segments than this are split in rounds that are written, others inside a task.
PAGE_SEGMENTS = 65_536
#: So many segments and more, of whole pages, are split at a time, and so many pairs of segments and strips are looked at.
SEGMENTS_AT_ONCE, PAIRS_AT_ONCE = 65_536, 1_000_000
#: So many segments a task sorts: with fewer, more than 200 tasks at 6 GB, Spark sorts what it shuffles and spills it first.
SEGMENTS_A_TASK = 2_000_000


def bands(items: DataFrame, region: list[str]) -> DataFrame:
    """items with _band: a new one begins where no segment covers BAND_GAP of the font size or more of the height."""
    order = Window.partitionBy(*region).orderBy(F.desc("top"), F.desc("bottom"), "item")
    reached = F.min("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reached - F.col("top") >= F.col("body") * BAND_GAP).cast("int")
    return items.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_band", F.sum("_new").over(order)).drop("_new")


def _upper_median(column: str):
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -cast({column} AS double))")


def _clear_strips(items: DataFrame, region: list[str], facts: DataFrame) -> DataFrame:
    """Strips that few segments of a region cross, between strips that more cross: (region, start, stop)."""
    events = items.select(*region, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    at = events.groupBy(*region, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d")).join(facts.select(*region, "_allowed").hint(MERGE), region)
    order = Window.partitionBy(*region).orderBy("x")
    low = at.withColumn("_low", F.sum("d").over(order) <= F.col("_allowed")).withColumn("_next", F.lead("x").over(order))
    runs = low.withColumn("_run", F.sum((~F.col("_low")).cast("int")).over(order)).filter("_low AND _run > 0")
    strips = runs.groupBy(*region, "_run").agg(F.min("x").alias("start"), F.max("_next").alias("stop"), F.count_if(F.col("_next").isNull()).alias("_open"))
    return strips.filter("_open = 0").drop("_open", "_run")


def column_cuts(items: DataFrame, region: list[str], nested: int = NESTED) -> DataFrame:
    """The widest gutter of each region that has one: (region, start, stop). items have _depth, the depth of their region."""
    facts = items.groupBy(*region).agg(
        F.count(F.lit(1)).alias("_n"), F.min("x0").alias("_left"), F.max("x1").alias("_right"), F.max("body").alias("_size"), F.max("_depth").alias("_level")
    )
    facts = facts.filter((F.col("_n") >= LEAST_SEGMENTS) & (F.col("_right") - F.col("_left") > 4 * F.col("_size"))).withColumn("_allowed", F.floor(F.col("_n") / CROSSINGS))
    width, mid = F.col("_right") - F.col("_left"), (F.col("start") + F.col("stop")) / 2
    wide = _clear_strips(items, region, facts).join(facts.hint(MERGE), region).filter(F.col("stop") - F.col("start") >= F.col("_size") * GUTTER)
    strips = wide.filter(mid.between(F.col("_left") + width * SHARE, F.col("_right") - width * SHARE)).select(*region, "start", "stop", width.alias("_width"), "_level")
    side = F.when(F.col("x1") <= F.col("start") + SLACK, 0).when(F.col("x0") >= F.col("stop") - SLACK, 1)
    sided = cut_lineage(items.join(strips.hint(MERGE), region).withColumn("_side", side).filter("_side IS NOT NULL"))
    cell = [*region, "start", "stop", "_side"]
    line = F.col("chars") >= LINE_CHARS
    judged = sided.withColumns({"_span": F.when(line, F.col("x1") - F.col("x0")), "_chars": F.when(line, F.col("chars"))}).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_n"), F.count("_span").alias("_lines"), F.min(F.when(line, F.col("x0"))).alias("_lo"), F.max(F.when(line, F.col("x1"))).alias("_hi"),
        _upper_median("_chars").alias("_mc"), _upper_median("_span").alias("_ms"), F.max("_width").alias("_width"), F.max("_level").alias("_level"),
    )
    across = F.col("_hi") - F.col("_lo")
    text = (F.col("_lines") >= 3) & (F.col("_lines") * 3 >= F.col("_n")) & (across >= F.col("_width") * SHARE)
    text = text & (F.col("_mc") >= F.when(F.col("_level") == 0, COLUMN_CHARS).otherwise(INNER_CHARS)) & (F.col("_ms") / F.greatest(across, F.lit(1.0)) >= FILL)
    judged = cut_lineage(judged.select(*cell, F.coalesce(text, F.lit(False)).alias("_ok")))
    if nested:
        # a side that is no column may be columns by itself
        rest = sided.join(judged.filter("NOT _ok").hint(MERGE), cell, "left_semi").select(*cell, "item", "x0", "x1", "top", "bottom", "chars", "body", (F.col("_depth") + 1).alias("_depth"))
        outer = {"start": f"_start{nested}", "stop": f"_stop{nested}", "_side": f"_side{nested}"}
        inner = column_cuts(cut_lineage(rest.withColumnsRenamed(outer)), [*region, *outer.values()], nested - 1)
        inner = inner.select(*region, *[F.col(new).alias(old) for old, new in outer.items()], F.lit(True).alias("_split"))
        judged = judged.join(inner.hint(MERGE), cell, "left").select(*cell, (F.col("_ok") | F.coalesce("_split", F.lit(False))).alias("_ok"))
    both = judged.filter("_ok").groupBy(*region, "start", "stop").agg(F.countDistinct("_side").alias("_sides")).filter("_sides = 2")
    best = both.groupBy(*region).agg(F.max(F.struct((F.col("stop") - F.col("start")).alias("w"), (-F.col("start")).alias("k"), "start", "stop")).alias("_b"))
    return cut_lineage(best.select(*region, "_b.start", "_b.stop"))


def _crosses():
    return (F.col("x0") < F.col("start") - SLACK) & (F.col("x1") > F.col("stop") + SLACK)


def _with_page_gutter(items: DataFrame, cuts: DataFrame, region: list[str]) -> DataFrame:
    """(region, _band, start, stop) of all bands: their own gutter, or on whole pages that of the band with most segments where it fits."""
    band = [*region, "_band"]
    sizes = items.groupBy(*band).agg(F.count(F.lit(1)).alias("_n"), F.max("_depth").alias("_level")).join(cuts.hint(MERGE), band, "left")
    best = sizes.filter("start IS NOT NULL AND _level = 0").groupBy(*region).agg(F.max(F.struct("_n", "_band", "start", "stop")).alias("_t"))
    page = best.select(*region, F.col("_t.start").alias("start"), F.col("_t.stop").alias("stop"))
    tried = items.join(cuts.hint(MERGE), band, "left_anti").join(page.hint(MERGE), region)
    left, right, prose = F.col("x1") <= F.col("start") + SLACK, F.col("x0") >= F.col("stop") - SLACK, F.col("chars") >= PROSE_CHARS
    fit = tried.groupBy(*band, "start", "stop").agg(
        (~F.bool_or(_crosses())).alias("_clear"), (F.bool_or(left) & F.bool_or(right) & F.bool_or((left | right) & prose)).alias("_prose")
    )
    fit = fit.select(*band, F.col("start").alias("_s"), F.col("stop").alias("_t"), "_clear", "_prose")
    order = Window.partitionBy(*region).orderBy("_band")
    known = sizes.join(fit.hint(MERGE), band, "left").withColumn("_own", F.coalesce("start", F.when(F.col("_clear") & F.col("_prose"), F.col("_s"))))
    between = F.col("_clear") & F.lag("_own").over(order).isNotNull() & F.lead("_own").over(order).isNotNull()
    takes = F.col("start").isNull() & ((F.col("_clear") & F.col("_prose")) | between)
    return known.select(*band, F.when(takes, F.col("_s")).otherwise(F.col("start")).alias("start"), F.when(takes, F.col("_t")).otherwise(F.col("stop")).alias("stop"))


def _split(items: DataFrame, region: list[str]) -> DataFrame:
    """One round: items with _group (in order), the gutter of the group if it has one, and _zone and _side in it."""
    banded = cut_lineage(bands(items, region))
    cuts = _with_page_gutter(banded, column_cuts(banded, [*region, "_band"]), region)
    order = Window.partitionBy(*region).orderBy("_band")
    size = items.groupBy(*region).agg(F.max("body").alias("_size"))
    mid = (F.col("start") + F.col("stop")) / 2
    same = (F.col("start").isNull() & F.lag("start").over(order).isNull()) | (F.abs(mid - F.lag(mid).over(order)) < SAME_GUTTER * F.col("_size"))
    new = F.when(F.row_number().over(order) == 1, 0).otherwise((~F.coalesce(same, F.lit(False))).cast("int"))
    grouped = cuts.join(size.hint(MERGE), region).withColumn("_new", new).withColumn("_group", F.sum("_new").over(order))
    group = [*region, "_group"]
    grouped = cut_lineage(grouped)
    inner = cut_lineage(banded.join(grouped.select(*region, "_band", "_group").hint(MERGE), [*region, "_band"]).drop("_band"))
    first = grouped.groupBy(*group).agg(F.min_by(F.struct("start", "stop"), "_band").alias("_f"))
    parted = inner.join(first.filter("_f.start IS NOT NULL").select(*group).hint(MERGE), group, "left_semi")
    again = column_cuts(parted, group).select(*group, F.struct("start", "stop").alias("_a"))  # on the whole group: a band alone may be too small
    gutter = first.join(again.hint(MERGE), group, "left").select(*group, F.coalesce("_a", "_f").alias("_g"))
    whole = Window.partitionBy(*group)
    cut = inner.join(gutter.hint(MERGE), group).withColumns({"start": F.col("_g.start"), "stop": F.col("_g.stop")}).drop("_g")
    wide = F.col("x1") - F.col("x0") >= (F.max("x1").over(whole) - F.min("x0").over(whole)) * BARRIER_WIDTH
    cut = cut_lineage(cut.withColumn("_barrier", F.coalesce(_crosses() & wide, F.lit(False))))
    down = Window.partitionBy(*group).orderBy(F.desc("top"), F.desc("bottom"), "item")
    lowest = F.min("bottom").over(down.rowsBetween(Window.unboundedPreceding, -1))
    barriers = cut.filter("_barrier").withColumn("_new", F.coalesce((lowest > F.col("top") + F.col("body") * BARRIER_GAP).cast("int"), F.lit(0)))
    barriers = barriers.withColumn("_zone", F.sum("_new").over(down)).drop("_new").withColumn("_side", F.lit(2))
    bottoms = barriers.groupBy(*group, "_zone").agg(F.min("bottom").alias("_low")).groupBy(*group).agg(F.collect_list("_low").alias("_lows"))
    rest = cut.filter("NOT _barrier").join(bottoms.hint(MERGE), group, "left")
    above = F.size(F.filter(F.coalesce("_lows", F.array().cast("array<double>")), lambda b: b > (F.col("top") + F.col("bottom")) / 2))
    sides = F.when(F.col("start").isNull(), 0).when((F.col("x0") + F.col("x1")) / 2 < (F.col("start") + F.col("stop")) / 2, 0).otherwise(1)
    rest = rest.withColumns({"_zone": above.cast("long"), "_side": sides}).drop("_lows")
    return barriers.unionByName(rest)


def reading_regions(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, region): the number of each segment's region, in reading order from 1."""
    region = [*keys, "path"]
    front = segments.dropna(subset=["x0", "x1", "top", "bottom"]).withColumns({"path": F.lit(""), "_depth": F.lit(0)})
    done = []
    for _ in range(MAX_DEPTH + 1):
        alone = F.count(F.lit(1)).over(Window.partitionBy(*region)) <= 1
        parts = _split(front, region)
        step = F.concat("path", F.lpad(F.col("_group").cast("string"), 6, "0"), F.lpad(F.col("_zone").cast("string"), 6, "0"), F.col("_side").cast("string"))
        parts = parts.withColumn("path", step).withColumns({"_depth": F.col("_depth") + 1, "_last": F.col("start").isNull() | F.col("_barrier")})
        parts = cut_lineage(parts.withColumn("_last", F.col("_last") | alone).select(*front.columns, "_last"))
        done.append(parts.filter("_last").drop("_last"))
        front = parts.filter("NOT _last").drop("_last")
        if front.isEmpty():
            break
    else:
        done.append(front)
    found = reduce(DataFrame.unionByName, done)
    return found.select(*keys, "item", F.dense_rank().over(Window.partitionBy(*keys).orderBy("path")).alias("region"))


class Segments(NamedTuple):
    """Columns of segments that a task holds, sorted by region and downwards; peer numbers the places that equal ones share."""

    x0: np.ndarray
    x1: np.ndarray
    top: np.ndarray
    bottom: np.ndarray
    chars: np.ndarray
    body: np.ndarray
    peer: np.ndarray

    def at(self, rows: np.ndarray) -> Segments:
        return Segments(*(column[rows] for column in self))


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs in one of the columns from the row before; the first one does."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])[: len(columns[0])]


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers of rows from 0 by their place in the order of the columns, the first one first; equal rows share one."""
    order = np.lexsort(columns[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(_new(*(c[order] for c in columns))) - 1
    return out


def _lowest_before(region: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """The least bottom of the rows before in a region, -inf for its first."""
    values, rank = np.unique(bottom, return_inverse=True)
    reach = np.minimum.accumulate(rank - region * len(values)) + region * len(values)  # a region is below all before it
    return np.where(_new(region), -np.inf, values[np.concatenate([[0], reach[:-1]])[: len(reach)]])


def _so_far(region: np.ndarray, peer: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many rows of the region are marked up to each one, those that share its place included. The first of a region is not marked."""
    total, begins = np.cumsum(marks), np.flatnonzero(_new(region, peer))
    last = np.concatenate([begins[1:], [len(marks)]]) - 1
    return np.repeat(total[last], last - begins + 1) - total[np.flatnonzero(_new(region))][np.cumsum(_new(region)) - 1]


def _strips(region: np.ndarray, size: np.ndarray, s: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _clear_strips: (region, start, stop)."""
    x, owner, step = np.concatenate([s.x0, s.x1]), np.concatenate([region, region]), np.repeat([1, -1], len(region))
    order = np.lexsort((x, owner))
    x, owner, step = x[order], owner[order], step[order]
    first = np.flatnonzero(_new(owner, x))
    x, owner, low = x[first], owner[first], np.cumsum(np.add.reduceat(step, first)) <= (size // CROSSINGS)[owner[first]]
    passed = np.cumsum(~low)
    begins = np.flatnonzero(_new(owner))
    before = (passed[begins] - ~low[begins])[np.cumsum(_new(owner)) - 1]
    kept = low & (passed > before)
    same = np.concatenate([owner[1:] == owner[:-1], [False]])  # as the next
    starts = np.flatnonzero(kept & ~np.concatenate([[False], (kept[:-1] & same[:-1])]))
    stops = np.flatnonzero(kept & ~(same & np.concatenate([kept[1:], [False]])))
    closed = same[stops]
    starts, stops = starts[closed], stops[closed]
    return owner[starts], x[starts], x[stops + 1]


def _columns(strip_width: np.ndarray, cell: np.ndarray, s: Segments, outer: bool, nested: int) -> np.ndarray:
    """Which sides of strips, their cells from 0, hold a column of text, or columns."""
    n, line = np.bincount(cell), np.flatnonzero(s.chars >= LINE_CHARS)
    of, lines = cell[line], np.bincount(cell[line], minlength=len(n))
    low, high = np.full(len(n), np.inf), np.full(len(n), -np.inf)
    np.minimum.at(low, of, s.x0[line])
    np.maximum.at(high, of, s.x1[line])
    judged = np.flatnonzero((lines >= 3) & (lines * 3 >= n))
    middle = (np.cumsum(lines) - lines + lines // 2)[judged]
    median = lambda values: values[np.lexsort((values, of))][middle]
    across = high[judged] - low[judged]
    text = (across >= strip_width[judged] * SHARE) & (median(s.chars[line]) >= (COLUMN_CHARS if outer else INNER_CHARS)) & (median((s.x1 - s.x0)[line]) / np.maximum(across, 1.0) >= FILL)
    good = np.zeros(len(n), bool)
    good[judged[text]] = True
    if nested and not good.all():
        rest = np.flatnonzero(~good[cell])
        inner = np.cumsum(~good) - 1
        good[~good] = ~np.isnan(_cuts(inner[cell[rest]], s.at(rest), False, nested - 1)[0])
    return good


def _cuts(region: np.ndarray, s: Segments, outer: bool, nested: int = NESTED) -> tuple[np.ndarray, np.ndarray]:
    """As column_cuts, of regions that count from 0: the start and the stop of each region's gutter, or no number."""
    size = np.bincount(region)
    first = np.cumsum(size) - size
    start, stop = np.full(len(size), np.nan), np.full(len(size), np.nan)
    if not len(size):
        return start, stop
    left, right, body = np.minimum.reduceat(s.x0, first), np.maximum.reduceat(s.x1, first), np.fmax.reduceat(s.body, first)
    width = right - left
    looked = np.flatnonzero(((size >= LEAST_SEGMENTS) & (width > 4 * body))[region])
    if not len(looked):
        return start, stop
    owner, a, b = _strips(region[looked], size, s.at(looked))
    mid = (a + b) / 2
    fit = (b - a >= body[owner] * GUTTER) & (mid >= left[owner] + width[owner] * SHARE) & (mid <= right[owner] - width[owner] * SHARE)
    owner, a, b = owner[fit], a[fit], b[fit]
    good, part = np.zeros(len(owner), bool), np.cumsum(size[owner]) // PAIRS_AT_ONCE
    for k in np.unique(part):
        own = np.arange(*np.searchsorted(part, [k, k + 1]))
        many = size[owner[own]]
        strip = np.repeat(own, many)
        row = np.repeat(first[owner[own]], many) + np.arange(len(strip)) - np.repeat(np.cumsum(many) - many, many)
        on_left, on_right = s.x1[row] <= a[strip] + SLACK, s.x0[row] >= b[strip] - SLACK
        sided = np.flatnonzero(on_left | on_right)
        cell = 2 * strip[sided] + ~on_left[sided]
        order = np.argsort(cell, kind="stable")
        cell, row = cell[order], row[sided][order]
        cells = cell[_new(cell)]
        text = _columns(width[owner[cells // 2]], np.cumsum(_new(cell)) - 1, s.at(row), outer, nested)
        good |= np.bincount(cells[text] // 2, minlength=len(good)) == 2
    owner, a, b = owner[good], a[good], b[good]
    order = np.lexsort((a, a - b, owner))
    best = order[_new(owner[order])]
    start[owner[best]], stop[owner[best]] = a[best], b[best]
    return start, stop


def _page_gutters(region: np.ndarray, band: np.ndarray, s: Segments, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _with_page_gutter, for bands of whole pages; region is that of each band."""
    size = np.bincount(band)
    cut = np.flatnonzero(~np.isnan(start))
    best = cut[np.lexsort((cut, size[cut], region[cut]))]
    best = best[np.concatenate([region[best][1:] != region[best][:-1], [True]])[: len(best)]]
    page = np.full((2, region[-1] + 1), np.nan)
    page[:, region[best]] = start[best], stop[best]
    own_start, own_stop = page[:, region]
    a, b = own_start[band], own_stop[band]
    left, right = s.x1 <= a + SLACK, s.x0 >= b - SLACK
    any_of = lambda marks: np.bincount(band[marks], minlength=len(size)) > 0
    clear = np.isnan(start) & ~np.isnan(own_start) & ~any_of((s.x0 < a - SLACK) & (s.x1 > b + SLACK))
    prose = clear & any_of(left) & any_of(right) & any_of((left | right) & (s.chars >= PROSE_CHARS))
    known = ~np.isnan(start) | prose
    same = region[1:] == region[:-1]
    between = clear & np.concatenate([[False], known[:-1] & same]) & np.concatenate([known[1:] & same, [False]])
    takes = prose | between
    return np.where(takes, own_start, start), np.where(takes, own_stop, stop)


def _split_held(region: np.ndarray, s: Segments, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As _split, of regions that count from 0; whole ones are pages: (group, zone, side, last), the groups of all regions in order."""
    marks = _lowest_before(region, s.bottom) - s.top >= s.body * BAND_GAP
    begins = _new(region, _so_far(region, s.peer, marks))
    band, of_band = np.cumsum(begins) - 1, region[begins]
    start, stop = _cuts(band, s, whole)
    if whole:
        start, stop = _page_gutters(of_band, band, s, start, stop)
    body = np.fmax.reduceat(s.body, np.flatnonzero(_new(region)))
    mid, none = (start + stop) / 2, np.isnan(start)
    same = (none[1:] & none[:-1]) | (np.abs(mid[1:] - mid[:-1]) < SAME_GUTTER * body[of_band[1:]])
    opens = _new(of_band) | np.concatenate([[True], ~same])
    group = (np.cumsum(opens) - 1)[band]
    start, stop = start[opens], stop[opens]
    cut = ~np.isnan(start)
    rows = np.flatnonzero(cut[group])
    again = _cuts((np.cumsum(cut) - 1)[group[rows]], s.at(rows), whole)  # on the whole group: a band alone may be too small
    start[cut], stop[cut] = (np.where(np.isnan(again[0]), old[cut], new) for old, new in ((start, again[0]), (stop, again[1])))
    first = np.flatnonzero(_new(group))
    across = np.maximum.reduceat(s.x1, first) - np.minimum.reduceat(s.x0, first)
    a, b = start[group], stop[group]
    barrier = (s.x0 < a - SLACK) & (s.x1 > b + SLACK) & (s.x1 - s.x0 >= across[group] * BARRIER_WIDTH)
    zone, side = np.zeros(len(group), np.int64), np.where(np.isnan(a) | ((s.x0 + s.x1) / 2 < (a + b) / 2), 0, 1)
    if barrier.any():
        wall, rest = np.flatnonzero(barrier), np.flatnonzero(~barrier)
        held, own = s.at(wall), group[wall]
        zone[wall] = _so_far(own, held.peer, _lowest_before(own, held.bottom) > held.top + held.body * BARRIER_GAP)
        side[wall] = 2
        begins = np.flatnonzero(_new(own, zone[wall]))
        low, of_low = np.minimum.reduceat(held.bottom, begins), own[begins]
        # how many walls of the group lie lower than the middle of each other segment, at most at it
        is_low = np.arange(len(low) + len(rest)) < len(low)
        order = np.lexsort((~is_low, np.concatenate([low, ((s.top + s.bottom) / 2)[rest]]), np.concatenate([of_low, group[rest]])))
        count = np.empty(len(order), np.int64)
        count[order] = np.cumsum(is_low[order])
        many = np.bincount(of_low, minlength=group[-1] + 1)
        zone[rest] = np.cumsum(many)[group[rest]] - count[len(low) :]
    return group, zone, side, np.isnan(a) | barrier


def _numbered(whole: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each segment's region, of whole pages of segments sorted downwards."""
    begins = paged.changes(whole, keys)
    page = np.cumsum(begins) - 1
    peer = np.cumsum(begins | paged.changes(whole.append_column("_none", pc.is_null(whole["item"])), ["top", "bottom", "item", "_none"]))
    s = Segments(*(whole[c].to_numpy() for c in Segments._fields[:-1]), peer)
    rank, front = page, np.arange(len(page))
    for depth in range(MAX_DEPTH + 1):
        group, zone, side, last = _split_held(_dense(rank[front]), s.at(front), depth == 0)
        part = _dense(group, zone, side)
        last |= np.bincount(part)[part] <= 1
        finer = np.zeros(len(rank), np.int64)
        finer[front] = part
        rank = _dense(rank, finer)
        front = front[~last]
        front = front[np.argsort(rank[front], kind="stable")]
        if not len(front):
            break
    return rank - np.minimum.reduceat(rank, np.flatnonzero(begins))[page] + 1


def page_regions(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, region): as reading_regions, where pages of at most PAGE_SEGMENTS segments are shuffled once and nothing is written for them."""
    placed = segments.select(*keys, "item", *[F.col(c).cast("double").alias(c) for c in Segments._fields[:-1]]).dropna(subset=[*keys, "x0", "x1", "top", "bottom"])
    total, large = paged.sized(placed, keys, PAGE_SEGMENTS)
    small = placed if large is None else placed.join(large.hint(MERGE), keys, "left_anti")
    named = [*keys, "item"]

    def work(batches):
        for whole in paged.whole_pages(batches, keys, SEGMENTS_AT_ONCE):
            number = pa.array(_numbered(whole, keys), pa.int32())
            yield from whole.select(named).append_column("region", number).combine_chunks().to_batches()

    ship_package(segments.sparkSession)
    schema = T.StructType([*(placed.schema[c] for c in named), T.StructField("region", T.IntegerType())])
    rows = spread(small, *keys, parts=parts_for(segments.sparkSession, total, SEGMENTS_A_TASK))
    found = rows.sortWithinPartitions(*keys, F.desc("top"), F.desc("bottom"), "item").mapInArrow(work, schema)
    return found if large is None else found.unionByName(reading_regions(placed.join(large.hint(MERGE), keys, "left_semi"), keys))
