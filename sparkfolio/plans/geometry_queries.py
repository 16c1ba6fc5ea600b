"""Page geometry that needs joins in two dimensions. The tables have none of their own: numbers of lineitem stand in for lines, words and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.operators import borderless, regions, ruled
from sparkfolio.plans.registry import query, table

#: A page for four orders each; odd line numbers are horizontal rules, even ones vertical.
_RULES = """SELECT l_orderkey // 4 AS page, l_linenumber % 2 = 1 AS horizontal,
    CASE WHEN l_linenumber % 2 = 1 THEN floor(l_quantity / 5) * 10 ELSE l_suppkey % 8 * 12 END + l_partkey % 3 * 0.5 AS pt,
    CAST(l_partkey % 4 * 5 AS DOUBLE) AS start, CAST(l_partkey % 4 * 5 + 60 + l_suppkey % 5 * 10 AS DOUBLE) AS stop FROM lineitem"""


def _rules(spark, d):
    at = F.when(F.col("l_linenumber") % 2 == 1, F.floor(F.col("l_quantity") / 5) * 10).otherwise(F.col("l_suppkey") % 8 * 12) + F.col("l_partkey") % 3 * 0.5
    start = (F.col("l_partkey") % 4 * 5).cast("double")
    return table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 4").alias("page"), (F.col("l_linenumber") % 2 == 1).alias("horizontal"), at.alias("at"), start.alias("start"), (start + 60 + F.col("l_suppkey") % 5 * 10).alias("stop")
    )


_GRIDS = f"""s AS ({_RULES}),
    a AS (SELECT page, horizontal, min(pt) AS anchor FROM s GROUP BY ALL
        UNION ALL SELECT a.page, a.horizontal, min(s.pt) FROM a JOIN s ON s.page = a.page AND s.horizontal = a.horizontal AND s.pt > a.anchor + 1 GROUP BY a.page, a.horizontal, a.anchor),
    p AS (SELECT s.*, (SELECT max(anchor) FROM a WHERE a.page = s.page AND a.horizontal = s.horizontal AND a.anchor <= s.pt) AS anchor FROM s),
    q AS (SELECT *, avg(pt) OVER (PARTITION BY page, horizontal, anchor) AS pos,
        coalesce(CAST(start > max(stop) OVER (PARTITION BY page, horizontal, anchor ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 AS INT), 0) AS fresh FROM p),
    u AS (SELECT *, sum(fresh) OVER (PARTITION BY page, horizontal, anchor ORDER BY start, stop) AS run FROM q),
    m AS (SELECT page, horizontal, pos AS pt, min(start) AS start, max(stop) AS stop FROM u GROUP BY page, horizontal, anchor, pos, run HAVING max(stop) - min(start) >= 4),
    l AS (SELECT *, row_number() OVER (ORDER BY page, horizontal, pt, start) AS id FROM m),
    x AS (SELECT h.id AS a, v.id AS b FROM l h JOIN l v ON h.page = v.page AND h.horizontal AND NOT v.horizontal AND v.pt BETWEEN h.start - 2 AND h.stop + 2 AND h.pt BETWEEN v.start - 2 AND v.stop + 2),
    e AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x),
    t AS (SELECT id, id AS root FROM l UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.id),
    g AS (SELECT l.*, r.grid FROM l JOIN (SELECT id, min(root) AS grid FROM t GROUP BY id) r USING (id)),
    k AS (SELECT page, grid, min(start) FILTER (horizontal) AS x0, max(stop) FILTER (horizontal) AS x1, min(start) FILTER (NOT horizontal) AS y0, max(stop) FILTER (NOT horizontal) AS y1
        FROM g GROUP BY page, grid HAVING count(*) FILTER (horizontal) >= 2 AND count(*) FILTER (NOT horizontal) >= 1),
    f AS (SELECT grid, NOT horizontal AS across, pt FROM g WHERE grid IN (SELECT grid FROM k) UNION ALL SELECT grid, true, unnest([x0, x1]) FROM k UNION ALL SELECT grid, false, unnest([y0, y1]) FROM k),
    c AS (SELECT *, coalesce(CAST(pt - lag(pt) OVER (PARTITION BY grid, across ORDER BY pt) > 2 AS INT), 0) AS fresh FROM f),
    d AS (SELECT grid, across, avg(pt) AS pt FROM (SELECT *, sum(fresh) OVER (PARTITION BY grid, across ORDER BY pt) AS n FROM c) GROUP BY grid, across, n),
    z AS (SELECT page, grid, xs, ys, len(xs) - 1 AS n_cols, len(ys) - 1 AS n_rows FROM k JOIN (SELECT grid, list(pt ORDER BY pt) FILTER (across) AS xs, list(pt ORDER BY pt DESC) FILTER (NOT across) AS ys FROM d GROUP BY grid) USING (grid)
        WHERE len(xs) > 2 AND len(ys) > 2)"""


@query(f"WITH RECURSIVE {_GRIDS} SELECT page, round(xs[1], 6) AS x0, round(ys[-1], 6) AS bottom, round(xs[-1], 6) AS x1, round(ys[1], 6) AS top, CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols FROM z")
def win_ruled_grids(spark, d):
    grids, _ = ruled.ruled_grids(_rules(spark, d), ["page"])
    ends = {"x0": F.get("xs", F.lit(0)), "bottom": F.element_at("ys", -1), "x1": F.element_at("xs", -1), "top": F.get("ys", F.lit(0))}
    return grids.select("page", *[F.round(v, 6).alias(k) for k, v in ends.items()], "n_rows", "n_cols")


@query(f"""WITH RECURSIVE {_GRIDS}, w AS (SELECT page, grid, xs, ys, n_rows, n_cols, r, c FROM (SELECT *, unnest(range(n_rows)) AS r FROM z), LATERAL (SELECT unnest(range(n_cols)) AS c)),
    o AS (SELECT grid, r, c, r AS r2, c + 1 AS c2 FROM w WHERE c + 1 < n_cols AND NOT EXISTS (SELECT 1 FROM g WHERE g.grid = w.grid AND NOT g.horizontal AND abs(g.pt - xs[c + 2]) <= 2 AND least(g.stop, ys[r + 1]) - greatest(g.start, ys[r + 2]) >= (ys[r + 1] - ys[r + 2]) * 0.6)
        UNION ALL SELECT grid, r, c, r + 1, c FROM w WHERE r + 1 < n_rows AND NOT EXISTS (SELECT 1 FROM g WHERE g.grid = w.grid AND g.horizontal AND abs(g.pt - ys[r + 2]) <= 2 AND least(g.stop, xs[c + 2]) - greatest(g.start, xs[c + 1]) >= (xs[c + 2] - xs[c + 1]) * 0.6)),
    b AS (SELECT grid, r, c, r2, c2 FROM o UNION ALL SELECT grid, r2, c2, r, c FROM o),
    v AS (SELECT grid, r, c, r * n_cols + c AS root, n_cols FROM w UNION SELECT v.grid, b.r2, b.c2, v.root, v.n_cols FROM v JOIN b ON v.grid = b.grid AND v.r = b.r AND v.c = b.c WHERE v.root < b.r2 * v.n_cols + b.c2),
    y AS (SELECT grid, r, c, n_cols, min(root) AS root FROM v GROUP BY ALL),
    n AS (SELECT grid, root, count(*) AS size FROM y GROUP BY grid, root)
    SELECT page, round(xs[1], 6) AS x0, round(ys[1], 6) AS top, count(*) AS n_cells, max(size) AS largest FROM n JOIN z USING (grid) GROUP BY page, grid, xs, ys""")
def win_ruled_cells(spark, d):
    grids, lines = ruled.ruled_grids(_rules(spark, d), ["page"])
    cells = ruled.ruled_cells(grids, lines, ["page"]).groupBy("page", "grid", "root_r", "root_c").agg(F.count(F.lit(1)).alias("size"))
    counted = cells.groupBy("page", "grid").agg(F.count(F.lit(1)).alias("n_cells"), F.max("size").alias("largest"))
    return counted.join(grids.hint(ruled.MERGE), ["page", "grid"]).select("page", F.round(F.get("xs", F.lit(0)), 6).alias("x0"), F.round(F.get("ys", F.lit(0)), 6).alias("top"), "n_cells", "largest")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS page, l_quantity * 10 AS x, l_discount * 7000 AS y FROM lineitem),
    b AS (SELECT l_orderkey AS box_order, l_linenumber AS box_line, l_partkey % 500 AS page, l_quantity * 10 - 15 AS x0, l_quantity * 10 + l_tax * 1000 AS x1, l_discount * 7000 - 30 AS bottom, l_discount * 7000 + l_tax * 500 + 5 AS top FROM lineitem)
    SELECT l_orderkey, l_linenumber, box_order, box_line FROM p JOIN b ON p.page = b.page AND x > x0 AND x < x1 AND y > bottom AND y < top""")
def join_points_in_boxes(spark, d):
    rows = table(spark, d, "lineitem").withColumn("page", F.col("l_partkey") % 500).withColumns({"x": F.col("l_quantity") * 10, "y": F.col("l_discount") * 7000})
    points = rows.select("l_orderkey", "l_linenumber", "page", "x", "y")
    boxes = rows.select(
        F.col("l_orderkey").alias("box_order"), F.col("l_linenumber").alias("box_line"), "page", (F.col("x") - 15).alias("x0"), (F.col("x") + F.col("l_tax") * 1000).alias("x1"),
        (F.col("y") - 30).alias("bottom"), (F.col("y") + F.col("l_tax") * 500 + 5).alias("top"),
    )
    return ruled.points_in_boxes(points, boxes, ["page"]).select("l_orderkey", "l_linenumber", "box_order", "box_line")


_WORDS = """(SELECT l_orderkey // 6 AS page, l_returnflag AS text, l_linenumber % 4 * 100 + l_partkey % 3 * 8.0 AS x0, floor(l_quantity / 6) * 12 + l_suppkey % 3 * 1.5 AS y0, l_linenumber % 4 * 100 + l_partkey % 3 * 8.0 + 20 + l_discount * 1000 AS x1 FROM lineitem)"""


@query(f"""WITH RECURSIVE i AS {_WORDS},
    a AS (SELECT page, max(y0) AS y FROM i GROUP BY page UNION ALL SELECT a.page, max(i.y0) FROM a JOIN i ON i.page = a.page AND i.y0 < a.y - 5 GROUP BY a.page, a.y),
    p AS (SELECT i.*, (SELECT min(y) FROM a WHERE a.page = i.page AND a.y >= i.y0) AS y FROM i),
    r AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY page, y) >= 2),
    s AS (SELECT page, list(x ORDER BY x) AS s FROM (SELECT page, x, lag(x) OVER (PARTITION BY page ORDER BY x) AS before FROM (SELECT DISTINCT page, x0 AS x FROM r)) WHERE before IS NULL OR x - before >= 15 GROUP BY page HAVING count(*) >= 2),
    l AS (SELECT page, y, count(*) FILTER (len(list_filter(s, lambda b: abs(x0 - b) < 15)) > 0) >= any_value(len(s)) - 1 AS aligned FROM r JOIN s USING (page) GROUP BY page, y),
    u AS (SELECT *, sum(CASE WHEN aligned THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y DESC) AS run FROM l),
    v AS (SELECT * FROM u WHERE aligned QUALIFY count(*) OVER (PARTITION BY page, run) >= 2),
    t AS (SELECT page, y, dense_rank() OVER (PARTITION BY page ORDER BY run) - 1 AS table_index FROM v),
    c AS (SELECT page, table_index, y, greatest(0, len(list_filter(s, lambda b: b - 7.5 <= x0)) - 1) AS col, max(x1) AS x1, any_value(s) AS s FROM r JOIN s USING (page) JOIN t USING (page, y) GROUP BY ALL),
    w AS (SELECT page, table_index, y, count(*) AS filled, count(*) FILTER (col + 1 < len(s) AND x1 >= s[col + 2] - 7.5) AS merged, any_value(len(s)) AS cols FROM c GROUP BY ALL),
    d AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY page, table_index ORDER BY y DESC)) AS step FROM w),
    f AS (SELECT page, table_index, count(*) AS n, any_value(cols) AS cols, sum(filled) / any_value(cols) AS shares, sum(filled) AS full_, sum(merged) AS merged,
        CASE WHEN avg(step) > 0 THEN greatest(0, 1 - stddev_pop(step) / avg(step)) ELSE 0 END AS even FROM d GROUP BY ALL),
    g AS (SELECT *, least(1, (shares + even) / (n + 1)) AS sure, floor((full_ / (n * cols)) * 100 + 0.5) / 100 AS non_empty, floor((shares / n) * 100 + 0.5) / 100 AS alignment, CASE WHEN n < 3 THEN 1.0 ELSE floor((even) * 100 + 0.5) / 100 END AS spacing, n * cols - full_ AS missing FROM f)
    SELECT page, CAST(table_index AS INT) AS table_index, n AS row_count, CAST(cols AS INT) AS col_count, floor((sure) * 100 + 0.5) / 100 AS confidence, floor((non_empty * alignment) * 100 + 0.5) / 100 AS completeness, non_empty, alignment, spacing, CAST(missing AS BIGINT) AS missing, CAST(merged AS BIGINT) AS merged,
        array_to_string(list_filter([CASE WHEN missing = 0 THEN 'complete_grid' ELSE 'missing_cells' END, CASE WHEN merged > 0 THEN 'merged_cell_candidates' END, CASE WHEN missing > 0 THEN 'incomplete_cell_geometry' END,
            CASE WHEN spacing < 0.75 THEN 'irregular_row_spacing' END, CASE WHEN floor((sure) * 100 + 0.5) / 100 < 0.65 THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS signals FROM g WHERE sure >= 0.3""")
def win_borderless_tables(spark, d):
    x = F.col("l_linenumber") % 4 * 100 + F.col("l_partkey") % 3 * 8.0
    y = F.floor(F.col("l_quantity") / 6) * 12 + F.col("l_suppkey") % 3 * 1.5
    items = table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 6").alias("page"), F.col("l_returnflag").alias("text"), x.alias("left"), y.alias("bottom"), (x + 20 + F.col("l_discount") * 1000).alias("right"), (y + 10).alias("top")
    )
    return borderless.borderless_tables(items, ["page"]).withColumn("signals", F.array_join("signals", ","))


@query()
def win_reading_regions(spark, d):
    """Pages of eight orders: short lines in two columns, and every seventh line across both."""
    wide = F.col("l_linenumber") == 7
    x = F.when(wide, 40.0).otherwise(F.col("l_linenumber") % 2 * 260 + 40.0 + F.col("l_partkey") % 3)
    top = 800.0 - F.col("l_suppkey") % 50 * 12 - F.col("l_orderkey") % 8 * 0.5
    segments = table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 8").alias("page"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("string")).alias("item"), x.alias("x0"),
        (x + F.when(wide, 480.0).otherwise(200.0 + F.col("l_tax") * 200)).alias("x1"), top.alias("top"), (top - 9.5).alias("bottom"), (F.col("l_quantity") + 15).cast("int").alias("chars"), F.lit(10.0).alias("body"),
    )
    return regions.page_regions(segments, ["page"])
