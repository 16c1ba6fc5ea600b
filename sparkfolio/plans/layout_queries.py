"""Page geometry and timed media. The tables have none of their own, so numbers of lineitem and events stand in for positions and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions.text import page_label
from sparkfolio.operators import layout, media
from sparkfolio.plans.registry import query, table
from sparkfolio.session import spread

_IV = "(SELECT l_orderkey, l_quantity * 4 AS a, l_quantity * 4 + l_discount * 200 + 1 AS z FROM lineitem)"


def _intervals(spark, d):
    q = F.col("l_quantity") * 4
    return table(spark, d, "lineitem").select("l_orderkey", q.alias("a"), (q + F.col("l_discount") * 200 + 1).alias("z"))


@query(f"""SELECT l_orderkey, round(reach, 6) AS gap_start, round(nxt, 6) AS gap_end FROM (SELECT l_orderkey, max(z) OVER (PARTITION BY l_orderkey ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS reach, lead(a) OVER (PARTITION BY l_orderkey ORDER BY a, z) AS nxt FROM {_IV})
    WHERE nxt - reach >= 10""")
def win_uncovered_gaps(spark, d):
    found = layout.uncovered_gaps(_intervals(spark, d), ["l_orderkey"], "a", "z", 10)
    return found.select("l_orderkey", F.round("gap_start", 6).alias("gap_start"), F.round("gap_end", 6).alias("gap_end"))


@query(f"""WITH e AS (SELECT l_orderkey, a AS x, 1 AS d FROM {_IV} UNION ALL SELECT l_orderkey, z, -1 FROM {_IV}), g AS (SELECT l_orderkey, x, sum(d) AS d FROM e GROUP BY 1, 2),
    s AS (SELECT l_orderkey, x, sum(d) OVER (PARTITION BY l_orderkey ORDER BY x) AS active, lead(x) OVER (PARTITION BY l_orderkey ORDER BY x) AS nx FROM g),
    i AS (SELECT *, sum(CASE WHEN active <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY x) AS i FROM s WHERE nx IS NOT NULL)
    SELECT l_orderkey, round(min(x), 6) AS gutter_start, round(max(nx), 6) AS gutter_end FROM i WHERE active <= 1 GROUP BY l_orderkey, i HAVING max(nx) - min(x) >= 8""")
def win_gutters(spark, d):
    found = layout.gutters(_intervals(spark, d), ["l_orderkey"], "a", "z", 1, 8)
    return found.select("l_orderkey", F.round("gutter_start", 6).alias("gutter_start"), F.round("gutter_end", 6).alias("gutter_end"))


@query("""WITH s AS (SELECT l_orderkey, l_quantity AS v, coalesce(CAST(l_quantity - lag(l_quantity) OVER w > 2 AS INT), 0) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)),
    g AS (SELECT l_orderkey, v, sum(n) OVER (PARTITION BY l_orderkey ORDER BY v) AS g FROM s) SELECT l_orderkey, round(avg(v), 6) AS position, count(*) AS members FROM g GROUP BY l_orderkey, g""")
def win_cluster_positions(spark, d):
    found = layout.cluster_positions(spread(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey"), ["l_orderkey"], "l_quantity", 2.0)
    return found.select("l_orderkey", F.round("position", 6).alias("position"), "members")


@query("""WITH s AS (SELECT l_orderkey, x, lag(x) OVER (PARTITION BY l_orderkey ORDER BY x) AS p FROM (SELECT DISTINCT l_orderkey, l_quantity AS x FROM lineitem)) SELECT l_orderkey, x AS column_start FROM s WHERE p IS NULL OR x - p >= 15""")
def win_column_starts(spark, d):
    return layout.column_starts(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, CAST(greatest(0, len(list_filter([5, 12, 25, 40], lambda s: s - 2 <= l_quantity)) - 1) AS INT) AS col FROM lineitem""")
def join_column_lookup(spark, d):
    starts = F.array(*[F.lit(float(x)) for x in (5, 12, 25, 40)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", layout.column_index(F.col("l_quantity"), starts, 2.0).alias("col"))


@query("""WITH b AS (SELECT l_suppkey, round(l_quantity / 3 * 2) / 2 AS b, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, b AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, b DESC) AS k FROM b) WHERE k = 1""")
def agg_body_font_size(spark, d):
    rows = table(spark, d, "lineitem").withColumn("size", F.col("l_quantity") / 3)
    return layout.dominant_size(rows, ["l_suppkey"], "size", "l_linenumber")


@query("SELECT l_orderkey, min(l_quantity) AS \"left\", min(l_tax) AS bottom, max(l_quantity + 2) AS \"right\", max(l_tax + l_discount) AS top FROM lineitem GROUP BY l_orderkey")
def agg_box_union(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("left"), F.col("l_tax").alias("bottom"), (F.col("l_quantity") + 2).alias("right"), (F.col("l_tax") + F.col("l_discount")).alias("top"))
    return layout.box_union(rows, ["l_orderkey"])


@query("""WITH k AS (SELECT DISTINCT l_suppkey, l_orderkey % 9 AS page, l_shipdate AS s FROM (SELECT l_suppkey, l_orderkey, CAST(l_partkey % 5 AS VARCHAR) AS l_shipdate FROM lineitem)),
    p AS (SELECT l_suppkey, count(DISTINCT page) AS n FROM k GROUP BY 1), c AS (SELECT l_suppkey, 'pg#' AS key, count(DISTINCT page) AS on_pages FROM k GROUP BY 1)
    SELECT c.l_suppkey, key, on_pages FROM c JOIN p USING (l_suppkey) WHERE on_pages >= greatest(3, ceil(n / 2))""")
def agg_repeated_margin_lines(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 9).alias("page"), F.concat(F.lit("PG "), (F.col("l_partkey") % 5).cast("string")).alias("text"))
    pages = lines.groupBy("l_suppkey").agg(F.countDistinct("page").alias("n_pages"))
    return layout.repeated_margin_lines(lines, ["l_suppkey"], "page", "text", pages)


@query("SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey % 40) AS on_pages FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey % 40) >= 3")
def agg_repeated_images(spark, d):
    rows = table(spark, d, "lineitem").withColumn("page", F.col("l_orderkey") % 40)
    return layout.repeated_images(rows, ["l_suppkey"], "page", "l_partkey")


@query("SELECT l_suppkey, median(l_quantity) AS median_height, max(l_quantity) AS max_height, count(*) AS items FROM lineitem GROUP BY 1")
def agg_height_statistics(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("median_height"), F.max("l_quantity").alias("max_height"), F.count(F.lit(1)).alias("items"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, abs(lag(l_extendedprice) OVER w - l_extendedprice) AS gap FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC)),
    a AS (SELECT l_orderkey, count(*) AS n, avg(gap) AS a, stddev_pop(gap) AS s FROM g GROUP BY 1)
    SELECT l_orderkey, CASE WHEN n < 2 THEN 0.0 WHEN n = 2 THEN 1.0 WHEN a <= 0 THEN 0.0 ELSE round(greatest(0.0, 1 - s / a), 2) END AS consistency FROM a""")
def agg_spacing_consistency(spark, d):
    return layout.spacing_consistency(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice")


@query("""WITH r AS (SELECT l_suppkey, l_linenumber, count(DISTINCT l_partkey % 8) AS c FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(avg(least(1.0, c / 8)), 2) AS alignment FROM r GROUP BY 1""")
def agg_row_alignment(spark, d):
    rows = table(spark, d, "lineitem").withColumn("col", F.col("l_partkey") % 8)
    return layout.row_alignment(rows, ["l_suppkey"], "l_linenumber", "col", 8)


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS ok, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem)
    SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM m WHERE ok GROUP BY l_orderkey, i HAVING count(*) >= 2""")
def win_regions(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ok", F.col("l_returnflag") == "N")
    return layout.regions(rows, ["l_orderkey"], "l_linenumber", "ok")


@query("""WITH t AS (SELECT l_suppkey, l_orderkey % 50 AS page, l_linenumber AS table_index, 2 + l_partkey % 2 AS n_cols, l_returnflag AS h FROM lineitem),
    u AS (SELECT l_suppkey, page, table_index, max(n_cols) AS n_cols, max(h) AS h FROM t GROUP BY 1, 2, 3),
    n AS (SELECT *, lead(page) OVER w AS np, lead(n_cols) OVER w AS nc, lead(h) OVER w AS nh FROM u WINDOW w AS (PARTITION BY l_suppkey ORDER BY page, table_index))
    SELECT l_suppkey, page, table_index, CASE WHEN np = page + 1 AND nc = n_cols AND nh = h THEN np END AS next_page FROM n""")
def win_table_continuation(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 50).alias("page"), F.col("l_linenumber").alias("table_index")).agg(F.max(2 + F.col("l_partkey") % 2).alias("n_cols"), F.max("l_returnflag").alias("h"))
    tables = items.select("l_suppkey", "page", "table_index", "n_cols", F.array("h").alias("header"))
    return layout.table_continuations(tables, ["l_suppkey"]).select("l_suppkey", "page", "table_index", "next_page")


def _boxes(spark, d, mod, want, name):
    rows = table(spark, d, "lineitem").filter(f"l_linenumber % {mod} = {want}")
    x, y = F.col("l_quantity") * 10, F.round(F.col("l_tax") * 5000 + F.col("l_linenumber") * 30)
    return rows.select("l_orderkey", F.col("l_linenumber").alias(name), x.alias("left"), y.alias("bottom"), (x + 120).alias("right"), (y + 20).alias("top"))


_BOX = "(SELECT l_orderkey, l_linenumber AS id, l_quantity * 10 AS l, round(l_tax * 5000 + l_linenumber * 30) AS b, l_quantity * 10 + 120 AS r, round(l_tax * 5000 + l_linenumber * 30) + 20 AS t FROM lineitem WHERE l_linenumber % 2 = {0})"


@query(f"""WITH p AS (SELECT c.l_orderkey, c.id AS caption_id, t.id AS target_id, greatest(0.0, least(c.r, t.r) - greatest(c.l, t.l)) / 120 AS ov, greatest(0.0, least(c.t, t.t) - greatest(c.b, t.b)) / 20 AS oh,
      greatest(0.0, t.b - c.t, c.b - t.t) AS gv, greatest(0.0, t.l - c.r, c.l - t.r) AS gh FROM {_BOX.format(0)} c JOIN {_BOX.format(1)} t ON c.l_orderkey = t.l_orderkey),
    s AS (SELECT *, round(CASE WHEN ov >= 0.2 AND gv <= 96 THEN greatest(0.5, least(0.95, 0.62 + 0.18 * ov + 0.12 - gv / 480)) ELSE greatest(0.5, least(0.95, 0.62 + 0.18 * oh + 0.12 - gh / 480)) END, 4) AS confidence
      FROM p WHERE (ov >= 0.2 AND gv <= 96) OR (oh >= 0.32 AND gh <= 96))
    SELECT l_orderkey, caption_id, target_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, caption_id ORDER BY confidence DESC, target_id) AS k FROM s) WHERE k = 1""")
def join_caption_links(spark, d):
    return layout.caption_links(_boxes(spark, d, 2, 0, "id"), _boxes(spark, d, 2, 1, "id"), ["l_orderkey"])


@query(f"""WITH r AS (SELECT * FROM {_BOX.format(0)}), s AS (SELECT * FROM {_BOX.format(1)})
    SELECT l_orderkey, id, 'selectable' AS origin FROM s UNION ALL SELECT l_orderkey, id, 'recognised' FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = r.l_orderkey
      AND greatest(0.0, least(s.r, r.r) - greatest(s.l, r.l)) * greatest(0.0, least(s.t, r.t) - greatest(s.b, r.b)) / 2400 >= 0.6)""")
def set_merge_tables(spark, d):
    return layout.merge_tables(_boxes(spark, d, 2, 1, "id"), _boxes(spark, d, 2, 0, "id"), ["l_orderkey"]).select("l_orderkey", "id", "origin")


@query("""WITH p AS (SELECT o_custkey, CAST(o_orderkey % 40 AS INT) AS page FROM orders GROUP BY 1, 2), r AS (SELECT DISTINCT o_custkey, st FROM orders, (SELECT unnest([5, 20]) AS st))
    SELECT p.o_custkey, page, CASE WHEN page < 5 THEN CAST(page AS VARCHAR) WHEN page < 20 THEN 'A-' || (1 + page - 5) ELSE 'B-' || (100 + page - 20) END AS label FROM p""")
def join_asof_page_labels(spark, d):
    pages = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 40).cast("int").alias("page")).distinct()
    ranges = pages.select("o_custkey").distinct().select(
        "o_custkey",
        F.explode(
            F.array(
                F.struct(F.lit(5).alias("start"), F.lit("D").alias("style"), F.lit("A-").alias("prefix"), F.lit(1).alias("first")),
                F.struct(F.lit(20).alias("start"), F.lit("D").alias("style"), F.lit("B-").alias("prefix"), F.lit(100).alias("first")),
            )
        ).alias("r"),
    ).select("o_custkey", "r.*")
    return layout.page_labels(pages, ranges, ["o_custkey"], page_label)


@query("""SELECT p_partkey, array_to_string(list_filter(['print', 'modify', 'copy', 'annotate'], lambda x, i: (p_size >> (i + 1)) & 1 = 1), ',') AS permissions FROM part""")
def sig_permissions(spark, d):
    names = F.array(*map(F.lit, ("print", "modify", "copy", "annotate")))
    allowed = F.filter(F.transform(names, lambda n, i: F.when(F.expr("p_size").bitwiseAND(F.pow(F.lit(2), i + 2).cast("int")) != 0, n)), lambda n: n.isNotNull())
    return table(spark, d, "part").select("p_partkey", F.array_join(allowed, ",").alias("permissions"))


@query("""WITH c AS (SELECT DISTINCT user_id, CAST(epoch_us(ts) // 1000 % 600000 AS BIGINT) AS cut FROM events), i AS (SELECT user_id, cut AS s FROM c WHERE cut > 60000 AND cut < 540000 UNION SELECT user_id, 60000 FROM c),
    n AS (SELECT user_id, s, row_number() OVER w AS scene, lead(s, 1, 540000) OVER w AS e, count(*) OVER (PARTITION BY user_id) AS total FROM i WINDOW w AS (PARTITION BY user_id ORDER BY s))
    SELECT user_id, CAST(scene AS INT) AS scene, s AS start_ms, CAST(e AS BIGINT) AS end_ms, total > 20 AS truncated FROM n WHERE scene <= 20""")
def media_scenes(spark, d):
    cuts = table(spark, d, "events").select("user_id", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) % 600000).alias("at"))
    return media.scenes(cuts, ["user_id"], "at", 60_000, 540_000).select("user_id", "scene", "start_ms", F.col("end_ms").cast("long").alias("end_ms"), "truncated")


@query("""SELECT event_id, event_id * 37 % 100000 AS start_ms, event_id * 37 % 100000 + CAST(floor(value) AS BIGINT) % 5000 + 1 AS end_ms FROM events
    WHERE event_id * 37 % 100000 < 50000 AND event_id * 37 % 100000 + CAST(floor(value) AS BIGINT) % 5000 + 1 > 20000""")
def media_cues_in_window(spark, d):
    start = F.col("event_id") * 37 % 100000
    cues = table(spark, d, "events").select("event_id", start.alias("start_ms"), (start + F.floor("value") % 5000 + 1).alias("end_ms"))
    return media.cues_in_window(cues, F.lit(20_000), F.lit(50_000))


@query("SELECT event_id, CASE WHEN event_id * 1001 * 1000000 % 30000 = 0 THEN event_id * 1001 * 1000000 // 30000 END AS micros FROM events")
def media_exact_micros(spark, d):
    return table(spark, d, "events").select("event_id", media.exact_micros(F.col("event_id"), F.lit(1001), F.lit(30000)).alias("micros"))


_STAMP = "lpad(CAST({0} // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0')"


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\r\n?|\n', ' ', 'g')) AS text FROM conversations)
    SELECT conv_id, CAST(turn + 1 AS INT) AS n, turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms, text FROM t WHERE text <> ''""")
def media_subtitle_cues(spark, d):
    said = F.regexp_replace("text", r"\r\n?|\n", " ")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        said = F.replace(said, F.lit(raw), F.lit(entity))
    part = lambda ms, size, most: (F.floor(ms / size) % most).cast("long")
    stamp = lambda ms: F.format_string("%02d:%02d:%02d,%03d", part(ms, 3600000, 1000), part(ms, 60000, 60), part(ms, 1000, 60), ms % 1000)
    start = F.col("turn") * 2000
    block = F.concat_ws("\n", (F.col("turn") + 1).cast("string"), F.concat(stamp(start), F.lit(" --> "), stamp(start + 1500)), F.concat(F.lit("<i>"), said, F.lit("</i>")))
    tracks = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text")
    )
    return media.cues(tracks, ["conv_id"]).select("conv_id", "n", "start_ms", "end_ms", "text")


@query("""SELECT l_orderkey, l_linenumber, CAST(coalesce(list_max(list_filter([1, 3, 5], lambda s: s <= l_linenumber)), 0) AS INT) AS node FROM lineitem""")
def join_node_at_offset(spark, d):
    nodes = F.array(*[F.lit(x) for x in (1, 3, 5)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.array_max(F.filter(nodes, lambda s: s <= F.col("l_linenumber"))), F.lit(0)).alias("node"))
