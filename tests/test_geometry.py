"""Ruled grids, points in boxes and recursive regions against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import borderless, graph, regions, ruled


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1300)] + [(2000, k) for k in range(2001, 2400)] + [(5, 5), (3, 4), (4, 3)]
    found = graph.connected_components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()
    want = components([(a, b) for a, b in pairs if a != b])
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def merged(rules):
    out = []
    for horizontal in (True, False):
        own = sorted((a, min(s, e), max(s, e)) for h, a, s, e in rules if h == horizontal)
        clusters = []
        for line in own:
            if clusters and line[0] - clusters[-1][0][0] <= 1.0:
                clusters[-1].append(line)
            else:
                clusters.append([line])
        for c in clusters:
            at, runs = sum(x[0] for x in c) / len(c), []
            for _, s, e in sorted(c, key=lambda x: x[1:]):
                if runs and s <= runs[-1][1] + 2:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            out += [(horizontal, at, s, e) for s, e in runs if e - s >= 4]
    return out


def means(values):
    groups = []
    for v in sorted(values):
        if groups and v - groups[-1][-1] <= 2:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [sum(g) / len(g) for g in groups]


def grids(rules):
    """[(xs, ys, {cell: root})] of one page."""
    lines = merged(rules)
    touch = [(i, j) for i, (h, y, a, b) in enumerate(lines) if h for j, (g, x, c, d) in enumerate(lines) if not g and a - 2 <= x <= b + 2 and c - 2 <= y <= d + 2]
    label, out = components(touch), []
    for root in set(label.values()):
        hs, vs = ([x[1:] for i, x in enumerate(lines) if label.get(i) == root and x[0] == h] for h in (True, False))
        xs = means([v[0] for v in vs] + [min(h[1] for h in hs), max(h[2] for h in hs)])
        ys = means([h[0] for h in hs] + [min(v[1] for v in vs), max(v[2] for v in vs)])[::-1]
        if len(hs) < 2 or len(xs) < 3 or len(ys) < 3:
            continue
        covered = lambda some, at, low, high: any(abs(p - at) <= 2 and min(b, high) - max(a, low) >= (high - low) * 0.6 for p, a, b in some)
        cells = [(r, c) for r in range(len(ys) - 1) for c in range(len(xs) - 1)]
        open_ = [((r, c), (r, c + 1)) for r, c in cells if c + 2 < len(xs) and not covered(vs, xs[c + 1], ys[r + 1], ys[r])]
        open_ += [((r, c), (r + 1, c)) for r, c in cells if r + 2 < len(ys) and not covered(hs, ys[r + 1], xs[c], xs[c + 1])]
        roots = components(open_)
        out.append((xs, ys, {c: roots.get(c, c) for c in cells}))
    return out


def page_rules(rng, n):
    rules = []
    for _ in range(n):
        x, y, w, h = rng.randrange(0, 400), rng.randrange(0, 600), rng.randrange(2, 5), rng.randrange(2, 5)
        for r in range(h + 1):
            for c in range(w):
                if rng.random() < 0.85:
                    rules.append((True, float(y + r * 12 + rng.choice([0, 0.5, 1.0])), x + c * 30.0, x + c * 30 + 30.0))
        for c in range(w + 1):
            rules.append((False, x + c * 30.0 + rng.choice([0, 0.5]), y + h * 12.0, float(y)))
    return rules


def shape(found):
    return sorted((tuple(round(x, 6) for x in xs), tuple(round(y, 6) for y in ys), tuple(sorted(cells.items()))) for xs, ys, cells in found)


def test_ruled_grids_and_cells_with_a_hot_page(spark):
    rng = random.Random(2)
    pages = {p: page_rules(rng, 25 if p == 0 else 2) for p in range(12)}
    pages[20], pages[21] = [(True, 10.0, 0.0, 50.0)], [(True, 10.0, 0.0, 50.0), (True, 30.0, 0.0, 50.0), (False, None, 0.0, 50.0)]
    frame = spark.createDataFrame([(p, *r) for p, rules in pages.items() for r in rules], "page int, horizontal boolean, at double, start double, stop double")
    got, lines = ruled.ruled_grids(frame, ["page"])
    cells = defaultdict(dict)
    for r in ruled.ruled_cells(got, lines, ["page"]).collect():
        cells[r["page"], r["grid"]][r["r"], r["c"]] = (r["root_r"], r["root_c"])
    found = defaultdict(list)
    for r in got.collect():
        found[r["page"]].append((r["xs"], r["ys"], cells[r["page"], r["grid"]]))
    for p, rules in pages.items():
        assert shape(found[p]) == shape(grids([r for r in rules if None not in r])), p


def test_words_go_to_their_cells(spark):
    rules = [(True, y, 0.0, 90.0) for y in (0.0, 20.0, 40.0, 60.0)] + [(False, x, 0.0, 60.0) for x in (0.0, 90.0)] + [(False, 30.0, 0.0, 60.0), (False, 60.0, 0.0, 40.0)]
    words = [(5.0, 50.0, "a"), (35.0, 52.0, "wide"), (70.0, 50.0, "head"), (5.0, 30.0, "b"), (40.0, 28.0, "c"), (65.0, 30.0, "d"), (200.0, 30.0, "outside"), (40.0, 34.0, "above")]
    keys = ["page"]
    rows = spark.createDataFrame([(1, *r) for r in rules], "page int, horizontal boolean, at double, start double, stop double")
    text = spark.createDataFrame([(1, *w) for w in words], "page int, x double, y double, text string")
    got, lines = ruled.ruled_grids(rows, keys)
    placed = ruled.place_in_cells(text, got, ruled.ruled_cells(got, lines, keys), keys).collect()
    assert {(r["root_r"], r["root_c"]): r["text"] for r in placed} == {(0, 0): "a", (0, 1): "wide head", (1, 0): "b", (1, 1): "above c", (1, 2): "d"}
    table = ruled.ruled_tables(rows, text, keys).first()
    assert (table["n_rows"], table["n_cols"], table["n_cells"], table["filled"], table["accepted"]) == (3, 3, 8, 5, True)


def test_points_in_boxes_without_a_nested_loop(spark):
    rng = random.Random(3)
    boxes = [(k % 3, k, x := rng.uniform(-200, 900), y := rng.uniform(-200, 900), x + rng.uniform(0, 300), y + rng.uniform(0, 300)) for k in range(150)]
    points = [(rng.randrange(3), k, rng.uniform(-200, 1000), rng.uniform(-200, 1000)) for k in range(400)]
    b = spark.createDataFrame(boxes, "page int, box int, x0 double, bottom double, x1 double, top double")
    p = spark.createDataFrame(points, "page int, point int, x double, y double")
    joined = ruled.points_in_boxes(p, b, ["page"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((k, n) for g, k, x, y in points for h, n, x0, y0, x1, y1 in boxes if g == h and x0 < x < x1 and y0 < y < y1)
    assert sorted((r["point"], r["box"]) for r in joined.collect()) == want


def upper(values):
    return sorted(values)[len(values) // 2]


def cut_of(items, body, depth, nested=1):
    if len(items) < 6:
        return None
    left, right = min(s[1] for s in items), max(s[2] for s in items)
    width = right - left
    if width <= body * 4:
        return None
    allowed, active, start, found = len(items) // 12, 0, None, []
    for x, d in sorted([(s[1], 1) for s in items] + [(s[2], -1) for s in items]):
        before, active = active, active + d
        if before > allowed >= active:
            start = x
        elif before <= allowed < active and start is not None:
            if x - start >= body * 0.9:
                found.append((start, x))
            start = None

    def ok(side):
        lines = [s for s in side if s[5] >= 10]
        good = len(lines) >= 3 and len(lines) * 3 >= len(side)
        if good:
            across = max(s[2] for s in lines) - min(s[1] for s in lines)
            good = across >= width * 0.2 and upper([s[5] for s in lines]) >= (18 if depth == 0 else 30) and upper([s[2] - s[1] for s in lines]) / max(across, 1) >= 0.55
        return good or (nested > 0 and cut_of(side, body, depth + 1, nested - 1) is not None)

    best = None
    for a, b in found:
        if left + width * 0.2 <= (a + b) / 2 <= right - width * 0.2 and ok([s for s in items if s[2] <= a + 0.5]) and ok([s for s in items if s[1] >= b - 0.5]) and (best is None or b - a > best[1] - best[0]):
            best = (a, b)
    return best


def split(items, body, depth=0):
    """Regions of segments (item, x0, x1, top, bottom, chars), in reading order."""
    if len(items) <= 1 or depth > 8:
        return [items]
    rows, low = [], None
    for s in sorted(items, key=lambda s: (-s[3], -s[4], s[0])):
        if low is None or low - s[3] >= body * 0.55:
            rows.append([])
        rows[-1].append(s)
        low = s[4] if low is None else min(low, s[4])
    cuts = [cut_of(b, body, depth) for b in rows]
    page = max(((len(b), k, c) for k, (b, c) in enumerate(zip(rows, cuts, strict=True)) if c), default=None) if depth == 0 else None
    if page:
        (a, z), clear, fits = page[2], [], []
        for band in rows:
            l, r = [s for s in band if s[2] <= a + 0.5], [s for s in band if s[1] >= z - 0.5]
            clear.append(not any(s[1] < a - 0.5 and s[2] > z + 0.5 for s in band))
            fits.append(clear[-1] and l and r and any(s[5] >= 25 for s in l + r))
        own = [c or ((a, z) if f else None) for c, f in zip(cuts, fits, strict=True)]
        cuts = [c or ((a, z) if clear[k] and 0 < k < len(own) - 1 and own[k - 1] and own[k + 1] else None) for k, c in enumerate(own)]
    groups = []
    for k, (band, cut) in enumerate(zip(rows, cuts, strict=True)):
        last = cuts[k - 1] if k else None
        if k and ((cut is None and last is None) or (cut and last and abs(sum(cut) - sum(last)) / 2 < body * 2)):
            groups[-1][1].extend(band)
        else:
            groups.append((cut, list(band)))
    out = []
    for cut, group in groups:
        if not cut:
            out.append(group)
            continue
        a, z = cut_of(group, body, depth) or cut
        across = max(s[2] for s in group) - min(s[1] for s in group)
        wide = lambda s: s[1] < a - 0.5 and s[2] > z + 0.5 and s[2] - s[1] >= across * 0.5  # noqa: B023, E731
        walls, low = [], None
        for s in sorted(filter(wide, group), key=lambda s: (-s[3], -s[4], s[0])):
            if low is None or low > s[3] + body * 0.3:
                walls.append([])
            walls[-1].append(s)
            low = s[4] if low is None else min(low, s[4])
        zones = [([], []) for _ in range(len(walls) + 1)]
        for s in group:
            if not wide(s):
                zones[sum(min(w[4] for w in wall) > (s[3] + s[4]) / 2 for wall in walls)][(s[1] + s[2]) / 2 >= (a + z) / 2].append(s)
        for k, sides in enumerate(zones):
            for side in sides:
                out += split(side, body, depth + 1) if side else []
            out += walls[k : k + 1]
    return out


def a_page(rng, kind):
    items, y = [], 800.0

    def block(columns, lines, chars=40):
        nonlocal y
        width = 520 / columns
        for _ in range(lines):
            for c in range(columns):
                if rng.random() < 0.95:
                    x = 40 + c * (width + 10)
                    items.append((len(items), x, x + width * rng.uniform(0.8, 0.97), y, y - 9.5, chars if rng.random() < 0.9 else 5))
            y -= 11
        y -= rng.choice([0, 2, 8])

    def wide():
        nonlocal y
        items.append((len(items), 40.0, 540.0, y, y - 9.5, 80))
        y -= 12

    for _ in range(rng.randrange(1, 6)):
        rng.choice([wide, lambda: block(2, rng.randrange(3, 14)), lambda: block(1, 3), lambda: block(3, 9), lambda: block(2, 3, 6)])()
    if kind % 7 == 0:
        items.append((len(items), 700.0, 710.0, 500.0, 490.0, 30))
    return items


@pytest.mark.parametrize("seed", [5])
def test_reading_regions_against_recursion(spark, seed):
    rng = random.Random(seed)
    pages = {p: a_page(rng, p) for p in range(40)}
    pages[60] = [(0, 1.0, 2.0, 3.0, 2.0, 50)]
    frame = spark.createDataFrame([(p, *s, 10.0) for p, items in pages.items() for s in items], "page int, item int, x0 double, x1 double, top double, bottom double, chars int, body double")
    found = defaultdict(dict)
    for r in regions.reading_regions(frame.withColumn("start_x", F.lit(1)), ["page"]).collect():
        found[r["page"]][r["item"]] = r["region"]
    assert max(len(set(f.values())) for f in found.values()) > 3
    for p, items in pages.items():
        want = {s[0]: k + 1 for k, region in enumerate(r for r in split(items, 10.0) if r) for s in region}
        assert found[p] == want, p


def test_a_table_without_lines(spark):
    words = [("Name", 10, 100), ("Qty", 100, 100), ("Price", 200, 100), ("Apple", 10, 80), ("2", 100, 80), ("1.50", 200, 80), ("Pear", 10, 60), ("green", 40, 62), ("2.00", 200, 60), ("alone", 10, 20)]
    rows = [(1, t, float(x), float(y), x + 30.0 if t != "Apple" else 95.0, y + 10.0) for t, x, y in words] + [(1, " ", 5.0, 5.0, 9.0, 9.0), (1, "no place", None, 5.0, 9.0, 9.0), (2, "a", 1.0, 1.0, 2.0, 2.0), (1, "nan", float("nan"), 1.0, 2.0, 2.0)]
    frame = spark.createDataFrame(rows, "page int, text string, left double, bottom double, right double, top double")
    cells = borderless.table_cells(borderless.table_items(frame, ["page"]), ["page"]).collect()
    assert {(r["row"], r["col"]): (r["text"], r["col_span"]) for r in cells} == {
        (0, 0): ("Name", 2), (0, 2): ("Qty", 1), (0, 3): ("Price", 1), (1, 0): ("Apple", 3), (1, 2): ("2", 1), (1, 3): ("1.50", 1), (2, 0): ("Pear", 2), (2, 1): ("green", 1), (2, 3): ("2.00", 1),
    }
    table = borderless.borderless_tables(frame, ["page"]).first()
    assert (table["row_count"], table["col_count"], table["missing"], table["merged"], table["spacing"]) == (3, 4, 3, 3, 0.95)
    assert table["confidence"] == 0.8 and table["signals"] == ["missing_cells", "merged_cell_candidates", "incomplete_cell_geometry"]
    assert borderless.borderless_tables(frame.limit(0), ["page"]).collect() == []


def test_copies_of_points_and_boxes_meet_once(spark):
    points = spark.createDataFrame([(1, k, 10.0, 10.0) for k in range(2_500)] + [(1, 9_000, None, 1.0), (2, 9_001, 70.0, 70.0)], "page int, p int, x double, y double")
    boxes = spark.createDataFrame([(1, k, 0.0, 0.0, 80.0, 80.0) for k in range(3)] + [(2, 7, 60.0, 60.0, 80.0, 80.0), (2, 8, 70.0, 0.0, 80.0, 80.0)], "page int, b int, x0 double, bottom double, x1 double, top double")
    found = ruled.points_in_boxes(points, boxes, ["page"])
    assert found.columns == ["page", "p", "x", "y", "b", "x0", "bottom", "x1", "top"]
    assert sorted((r["page"], r["p"], r["b"]) for r in found.collect()) == sorted([(1, k, b) for k in range(2_500) for b in range(3)] + [(2, 9_001, 7)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_p") < plan.index("Join Inner") < plan.index("collect_list")
    held = ruled._gathered(points.filter("page = 1 AND x IS NOT NULL"), ["page", "x", "y"], "m")
    assert sorted(len(r["m"]) for r in held.collect()) == [452, 1_024, 1_024]


def test_regions_are_not_sent_through_the_driver(spark, monkeypatch):
    seen, written = [], regions.cut_lineage
    monkeypatch.setattr(regions, "cut_lineage", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    rows = [(1, f"{side}{k:02d}", 40.0 + 260 * side, 240.0 + 260 * side, 800.0 - 12 * k, 790.5 - 12 * k, 30, 10.0) for side in (0, 1) for k in range(12)]
    frame = spark.createDataFrame(rows, "page int, item string, x0 double, x1 double, top double, bottom double, chars int, body double")
    found = {r["item"]: r["region"] for r in regions.reading_regions(frame, ["page"]).collect()}
    assert found == {item: int(item[0]) + 1 for _, item, *_ in rows}
    assert sum("SortMergeJoin" in plan for plan in seen) > 5 and not any("Broadcast" in plan for plan in seen)


def test_components_of_small_and_large_pages_agree(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(p, rng.random() < 0.5, rng.randrange(30) * 5.0, s := rng.randrange(20) * 5.0, s + rng.randrange(40, 120)) for p in range(6) for _ in range(4 + 9 * p)]
    frame = spark.createDataFrame(rows, "page int, horizontal boolean, at double, start double, stop double")

    def found():
        grids, lines = ruled.ruled_grids(frame, ["page"])
        cells = ruled.ruled_cells(grids, lines, ["page"]).groupBy("page", "grid").agg(F.sort_array(F.collect_list(F.struct("r", "c", "root_r", "root_c"))).alias("cells"))
        return sorted((r["page"], r["xs"], r["ys"], r["n_rows"], r["n_cols"], r["cells"]) for r in grids.join(cells, ["page", "grid"]).collect())

    monkeypatch.setattr(ruled, "PAGE_LINES", 10)
    monkeypatch.setattr(ruled, "CELLS_AT_ONCE", 7)
    rounds = found()
    monkeypatch.setattr(ruled, "PAGE_LINES", 4_096)
    monkeypatch.setattr(ruled, "CELLS_AT_ONCE", 1_000_000)
    monkeypatch.setattr(ruled, "connected_components", None)  # pages of ordinary size go without rounds
    assert len(rounds) > 3 and found() == rounds


def test_grids_of_pages_after_one_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(p % 7, f"p{p}", *r) for p in range(40) for r in page_rules(rng, 1 + p % 3)] + [(None, "x", True, 1.0, 0.0, 90.0), (1, "p1", True, None, 0.0, 9.0), (9, "p9", False, float("nan"), 0.0, 9.0)]
    frame = spark.createDataFrame(rows, "doc int, page string, horizontal boolean, at double, start double, stop double").repartition(3)
    keys, plans, written = ["doc", "page"], [], ruled.cut_lineage

    def found():
        grids, lines = ruled.ruled_grids(frame, keys)
        return sorted((r["doc"], r["page"], r["xs"], r["ys"], r["n"]) for r in grids.join(lines.groupBy(*keys, "grid").agg(F.count(F.lit(1)).alias("n")), [*keys, "grid"]).collect())

    monkeypatch.setattr(ruled, "PAGE_LINES", 0)
    rounds = found()
    monkeypatch.setattr(ruled, "PAGE_LINES", 65_536)
    monkeypatch.setattr(ruled, "RULES_AT_ONCE", 30)  # pages go on from one batch to the next
    monkeypatch.setattr(ruled, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    monkeypatch.setattr(ruled, "connected_components", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found() == rounds and len(rounds) > 40
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1]


def test_tables_without_lines_after_one_shuffle(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for p in range(30):
        step = rng.choice([14.5, 15.0, 40.0])
        rows += [(p % 4, f"p{p}", "w", c * step + rng.choice([0.0, 3.0]), -12.0 * r + rng.choice([0.0, 2.5]), c * step + 20, 9.0) for r in range(6) for c in range(5) if rng.random() < 0.9]
    rows += [(9, f"p{p}", "w", k % 5 * 40.0, k // 5 * -12.0, k % 5 * 40.0 + 20, 9.0) for p, n in ((90, 4_096), (91, 4_097)) for k in range(n)] + [(None, "x", "w", 0.0, 0.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "doc int, page string, text string, left double, bottom double, right double, top double").repartition(3)

    def found():
        items = borderless.table_items(frame, ["doc", "page"])
        assert items._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
        return sorted((r["doc"], r["page"], r["table_index"], r["row"], r["col"], r["y"], r["left"], tuple(r["starts"])) for r in items.collect())

    whole = found()
    assert sum(r[1] == "p90" for r in whole) == 4_095 and not any(r[1] == "p91" for r in whole)  # its last row holds one item, which is no row
    by_page = {r[1]: {} for r in whole}
    for doc, page, table, row, col, y, left, starts in whole:
        assert starts[col] <= left < starts[col] + 15 or left >= starts[col] and (col + 1 == len(starts) or left < starts[col + 1])
        assert by_page[page].setdefault((table, row), y) == y
    assert all(list(seen.values()) == sorted(seen.values(), reverse=True) for seen in by_page.values())
    monkeypatch.setattr(borderless, "ITEMS_AT_ONCE", 40)  # pages go on from one batch to the next
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_pairs_of_a_place_and_a_box_are_handed_on_one_by_one(spark):
    points = spark.createDataFrame([(k % 3, k, 10.0 * (k % 5), 10.0) for k in range(60)], "page int, id int, x double, y double")
    boxes = spark.createDataFrame([(k % 3, k, 5.0, 0.0, 25.0, 80.0) for k in range(30)], "page int, box int, x0 double, bottom double, x1 double, top double")
    found = ruled.points_in_boxes(points, boxes, ["page"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ruled.TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    assert plan.index("Generate inline(_b") < plan.index("Generate explode(_p") < plan.index(f"Repartition {parts}, false") < plan.index("Join Inner")
    assert plan.count("RepartitionByExpression") == 2 and found.rdd.getNumPartitions() == parts
    assert sorted((r["id"], r["box"]) for r in found.collect()) == [(p, b) for p in range(60) for b in range(30) if p % 3 == b % 3 and p % 5 in (1, 2)]
    assert sorted(tuple(r) for r in ruled.points_in_boxes(points.select("page", "x", "y"), boxes.drop("box"), ["page"]).distinct().collect()) == [(p, x, 10.0, 5.0, 0.0, 25.0, 80.0) for p in range(3) for x in (10.0, 20.0)]


def test_tables_without_lines_on_pages_of_any_size(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, "w", c * 40.0, r * -12.0, c * 40.0 + 20, 9.0) for r in range(1_100) for c in range(4)]  # beyond 4,096 items
    rows += [(2, "w", c * 20.0, r * -12.0, c * 20.0 + (10 if c else 19), 9.0) for r in range(3) for c in range(300)]  # and 256 boundaries
    rows += [(3, "w", c * 20.0, r * -12.0, c * 20.0 + 10, 9.0) for r in range(90) for c in range(200) if c != r]  # and 16,384 cells
    for p in range(10, 40):
        step = rng.choice([14.5, 15.0, 22.0, 40.0])
        rows += [(p, "w", c * step + rng.choice([0.0, 3.0]), -12.0 * r + rng.choice([0.0, 2.5]), c * step + rng.choice([-9.0, 20.0, step + 7.5, 70.0]), 9.0) for r in range(6) for c in range(5) if rng.random() < 0.9]
    frame = spark.createDataFrame(rows + [(None, "w", 0.0, 0.0, 1.0, 1.0), (5, "w", 0.0, float("nan"), 1.0, 1.0)], "page int, text string, left double, bottom double, right double, top double")
    found = sorted(tuple(r) for r in borderless.borderless_tables(frame, ["page"]).collect())
    facts = {r[0]: (r[2], r[3], r[9], r[10]) for r in found if r[1] == 0 and r[0] < 10}
    assert facts == {1: (1_100, 4, 0, 0), 2: (3, 300, 0, 3), 3: (90, 200, 90, 0)}
    small = [tuple(r) for r in borderless.table_cells(borderless.table_items(frame, ["page"]), ["page"]).select("page", "table_index", "row", "col", "col_span").collect()]
    placed = borderless.placed_items(frame, ["page"]).groupBy("page", "table_index", "row", "col").agg(F.max("span")).filter("page >= 10").collect()
    assert len(small) > 200 and sorted(small) == sorted(tuple(r) for r in placed)
    monkeypatch.setattr(borderless, "PAGE_ITEMS", 15)
    assert sorted(tuple(r) for r in borderless.borderless_tables(frame, ["page"]).collect()) == found


def with_cells(frame, keys=("page",)):
    got, lines = ruled.ruled_grids(frame, list(keys))
    cells = defaultdict(dict)
    for r in ruled.ruled_cells(got, lines, list(keys)).collect():
        cells[r["page"], r["grid"]][r["r"], r["c"]] = (r["root_r"], r["root_c"])
    found = defaultdict(list)
    for r in got.collect():
        found[r["page"]].append((r["xs"], r["ys"], cells[r["page"], r["grid"]]))
    return {p: shape(g) for p, g in found.items()}


RULES = "page int, horizontal boolean, at double, start double, stop double"


def test_a_grid_on_a_page_with_many_pairs_of_lines(spark, monkeypatch):
    grid = [(True, 20.0 * k, 0.0, 60.0) for k in range(4)] + [(False, 30.0 * k, 0.0, 60.0) for k in range(3)]
    page = grid + [(True, 10.0 * k, 3_000.0, 3_010.0) for k in range(2_010)] + [(False, -10.0 * k - 20, -100.0, -50.0) for k in range(2_010)]  # beyond 4,000,000
    pages = {1: page} | {p: page_rules(random.Random(p), 3) for p in range(2, 7)}
    frame = spark.createDataFrame([(p, *r) for p, rules in pages.items() for r in rules], RULES)
    found = with_cells(frame)
    assert found[1] == shape(grids(grid)) and {p: shape(grids(rules)) for p, rules in pages.items() if p > 1} == {p: g for p, g in found.items() if p > 1}
    monkeypatch.setattr(ruled, "PAIRS_AT_ONCE", 30)
    assert with_cells(frame.filter("page > 1")) == {p: g for p, g in found.items() if p > 1}
    monkeypatch.setattr(ruled, "PAGE_LINES", 0)  # and in rounds
    assert with_cells(frame) == found


def test_a_grid_of_many_cells(spark, monkeypatch):
    rng = random.Random(11)
    side = 104  # 10,816 cells
    rules = [(True, 10.0 * y, 10.0 * x, 10.0 * x + 10) for y in range(side + 1) for x in range(side) if y in (0, side) or rng.random() < 0.6]
    rules += [(False, 10.0 * x, 10.0 * y, 10.0 * y + 10) for x in range(side + 1) for y in range(side) if x in (0, side) or rng.random() < 0.6]
    found = with_cells(spark.createDataFrame([(1, *r) for r in rules], RULES))
    assert found == {1: shape(grids(rules))} and max(len(cells) for _, _, cells in found[1]) == side * side
    pages = {p: page_rules(rng, 3) for p in range(8)}
    frame = spark.createDataFrame([(p, *r) for p, own in pages.items() for r in own], RULES)
    in_tasks = with_cells(frame)
    monkeypatch.setattr(ruled, "GRID_CELLS", 5)
    assert len(in_tasks) == 8 and with_cells(frame) == in_tasks


SEGMENTS = "page int, item string, x0 double, x1 double, top double, bottom double, chars int, body double"


def test_regions_of_pages_inside_tasks(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(p, f"{s[0]:04d}", *s[1:], 10.0) for p in range(60) for s in a_page(rng, p)]
    for p in range(100, 130):  # places that repeat, overlap, are turned round or lack something
        for k in range(rng.randrange(1, 70)):
            x, y = rng.choice([0, 20, 150, 300, 320]) + rng.randrange(3), 10.0 * rng.randrange(1 if p % 5 == 0 else 40)
            row = (p, rng.choice([None, "a", f"{k}"]), float(x), x + rng.choice([30.0, 100.0, 140.0, 400.0]), y, y - rng.choice([9.0, 9.0, 30.0, -4.0]), rng.choice([None, 3, 26, 40]), rng.choice([10.0, 10.0, 10.0, 8.0, None]))
            rows += [row] * rng.choice([1, 1, 1, 2])
    rows += [(200, "gone", None, 1.0, 2.0, 1.0, 3, 10.0), (200, "alone", 0.0, 1.0, 2.0, 1.0, 3, 10.0), (None, "x", 0.0, 1.0, 2.0, 1.0, 3, 10.0)]
    frame = spark.createDataFrame(rows, SEGMENTS).repartition(5)
    shown = lambda df: sorted((r["page"], r["item"] or "", r["region"]) for r in df.collect())
    rounds = shown(regions.reading_regions(frame, ["page"]))
    found = regions.page_regions(frame, ["page"])
    assert found.columns == ["page", "item", "region"] and found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert len({r[2] for r in rounds}) > 6 and shown(found) == rounds
    monkeypatch.setattr(regions, "SEGMENTS_AT_ONCE", 20)
    monkeypatch.setattr(regions, "PAIRS_AT_ONCE", 9)
    with monkeypatch.context() as at_once:
        at_once.setattr(regions, "cut_lineage", None)  # nothing is written for pages of ordinary size
        assert shown(regions.page_regions(frame, ["page"])) == rounds
    monkeypatch.setattr(regions, "PAGE_SEGMENTS", 40)
    assert shown(regions.page_regions(frame, ["page"])) == rounds
