"""Places in originals, ignore rules, overlaps, quotas and long sequences."""

import random
import time

from pyspark.sql import functions as F

from sparkfolio.operators import compare, findings, located, search
from sparkfolio.sources import ignore


def folded(text, fold):
    """The normalised text and, letter by letter, the place of each of its letters in the original."""
    out, at = "", []
    for k, c in enumerate(text):
        if c.isspace():
            continue
        if out and text[k - 1].isspace():
            out += " "
            at.append(None)
        low = c.lower() if fold else c
        out += low
        at += [k] * len(low)
    return out, at


def test_places_of_matches_against_a_letter_map():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aAbB İé\n\t  x") for _ in range(rng.randrange(60)))
        shown, at = folded(text, True)
        norm = located.Normalised(text)
        assert norm.text == "".join(w.lower() if k == 0 else " " + w.lower() for k, w in enumerate(text.split()))
        needle = rng.choice(["a", "ab", "b a", "x", "a x b", "é"])
        want, p = [], norm.text.find(needle)
        while p >= 0:
            want.append((at[p], at[p + len(needle) - 1] + 1) if len(shown) == len(norm.text) else None)
            p = norm.text.find(needle, p + len(needle))
        begin, end = norm.spans(needle)
        assert len(begin) == len(want)
        assert all(w is None or w == g for w, g in zip(want, zip(begin.tolist(), end.tolist(), strict=True), strict=True))


def test_located_hits_and_quotes(spark):
    units = spark.createDataFrame([(1, "Net\n  Revenue rose. net revenue  fell"), (2, None), (3, ""), (4, "nothing"), (5, "x net revenue" * 1000)], "id int, text string")
    hits = located.located_hits(units, " net   REVENUE ", ["id"], per_unit=2).collect()
    assert sorted(tuple(h) for h in hits if h["id"] == 1) == [(1, 1, 0, 13, "Net\n  Revenue"), (1, 2, 20, 31, "net revenue")]
    assert [(h["start"], h["end"]) for h in hits if h["id"] == 5] == [(2, 13), (15, 26)]
    assert located.located_hits(units, "  ", ["id"]).collect() == [] and located.located_hits(units.limit(0), "net", ["id"]).collect() == []
    cites = spark.createDataFrame([(1, "Revenue rose", "k"), (1, "Net Revenue", "k"), (1, "net Revenue", "k"), (2, "x", "k"), (9, "x", "k"), (1, None, "k"), (3, "a", "k")], "id int, quote string, extra string")
    got = located.located_quotes(cites, units, ["id"]).collect()
    assert {(r["id"], r["quote"]): (r["verdict"], r["start"], r["end"]) for r in got} == {
        (1, "Revenue rose"): ("exact", 6, 18), (1, "Net Revenue"): ("normalized", 0, 13), (1, "net Revenue"): ("unmatched", None, None), (2, "x"): ("insufficient", None, None),
        (9, "x"): ("insufficient", None, None), (1, None): ("insufficient", None, None), (3, "a"): ("unmatched", None, None),
    }


def test_words_follow_each_other(spark):
    rows = [(1, "first missing second", ["first", "second"]), (2, " a  b\nc ", ["a", "", "b", None, "c"]), (3, "ab", ["a", "b"]), (4, "a b rest", ["a b"]), (5, None, None), (6, "x", []), (7, " ", [" "])]
    got = {r["id"]: ([s and tuple(s) for s in r["spans"]], r["complete"]) for r in located.align_words(spark.createDataFrame(rows, "id int, text string, words array<string>"), ["id"]).collect()}
    assert got == {
        1: ([(0, 5), None], False), 2: ([(1, 2), None, (4, 5), None, (6, 7)], True), 3: ([(0, 1), (1, 2)], True), 4: ([(0, 3)], False), 5: ([], True), 6: ([], False), 7: ([(0, 1)], True),
    }


def test_ignore_rules(spark):
    rules = [("", 1, "*.log"), ("", 2, "!keep.log"), ("", 3, "build/"), ("", 4, "/top.txt"), ("src", 1, "gen/*"), ("src", 2, "!gen/a.py"), ("src", 3, "build"), ("", 5, "#x"), ("", 6, " "), ("docs", 1, "**/old/**"), ("docs", 2, "a?[b-d].m+d"), ("", 7, "!")]
    paths = {
        "x.log": True, "sub/y.log": True, "keep.log": False, "sub/keep.log": False, "build/keep.log": True, "a/build/z": True, "build2/z": False, "top.txt": True, "sub/top.txt": False, "src/gen/a.py": False,
        "src/gen/b.py": True, "src/x/gen/b.py": False, "src/build": True, "docs/old/x": True, "docs/a/old/b/c": True, "docs/older/x": False, "docs/axc.m+d": True, "docs/axe.m+d": False, "docs/axc.mmd": False, "#x": False,
    }
    frame = spark.createDataFrame([(p, 1) for p in paths], "path string, line int")
    got = ignore.ignored_paths(frame, spark.createDataFrame(rules, "folder string, line int, pattern string")).collect()
    assert {r["path"]: r["ignored"] for r in got} == paths
    few, more = ignore.searched_files(frame, spark.createDataFrame(rules, "folder string, line int, pattern string"), limit=3)
    assert few.count() == 3 and more.first()["not_searched"] == sum(not i for i in paths.values()) - 3
    assert ignore.ignored_paths(frame, spark.createDataFrame([], "folder string, line int, pattern string")).filter("ignored").count() == 0


def test_overlaps_of_a_hot_page(spark):
    rng = random.Random(4)
    boxes = [(p, k, f"t{rng.randrange(4)}", x := rng.uniform(-50, 600), y := rng.uniform(-50, 700), x + rng.uniform(0, 90), y + rng.uniform(0, 40)) for p in range(3) for k in range(300 if p == 0 else 40)]
    boxes += [(5, k, "same", 0.0, 0.0, 50.0, 10.0) for k in range(2000)] + [(5, 3000, None, 0.0, 0.0, 50.0, 10.0), (5, 3001, "none", None, 0.0, 50.0, 10.0)]
    frame = spark.createDataFrame(boxes, "page int, item int, text string, left double, bottom double, right double, top double")
    want = set()
    for p, a, s, x, y, z, t in boxes[:380]:
        for q, b, u, c, d, e, f in boxes[:380]:
            w, h = min(z, e) - max(x, c), min(t, f) - max(y, d)
            if p == q and a < b and s != u and w > 0 and h > 0 and w * h >= 0.5 * min((z - x) * (t - y), (e - c) * (f - d)):
                want.add((p, a, b))
    got = findings.overlapping_pairs(frame, ["page"])
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want | {(5, 0, 3000)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_copies_overlap_too(spark):
    box, far = (0.0, 0.0, 50.0, 10.0), (300.0, 0.0, 350.0, 10.0)
    rows = [(1, 1, "a", *box), (1, 2, "b", *box), (1, 3, "b", *box), (1, 4, "a", *box), (1, 5, None, *box), (1, 6, None, *box), (1, 7, "a", *far), (1, 8, "a", *far), (2, 1, "b", *box)]
    frame = spark.createDataFrame(rows, "page int, item int, text string, left double, bottom double, right double, top double")
    assert sorted(tuple(r) for r in findings.first_overlaps(frame, ["page"]).collect()) == [(1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 1), (1, 6, 1)]


def test_quota_goes_on_in_the_next_source(spark):
    a = spark.createDataFrame([(1, 5, "p"), (1, 5, "q"), (2, 1, "x")], "doc int, rank int, hit string")
    b = spark.createDataFrame([(1, 1, "r"), (1, 2, "s"), (2, 1, "y"), (3, 1, "z"), (None, 1, "n")], "doc int, rank int, hit string")
    got = search.quota_union([a, b], ["doc"], ["rank"], 3).collect()
    assert sorted((r["doc"] or 0, r["place"], r["source"], r["hit"], r["truncated"]) for r in got) == [
        (0, 1, 1, "n", False), (1, 1, 0, "p", True), (1, 2, 0, "q", True), (1, 3, 1, "r", True), (2, 1, 0, "x", False), (2, 2, 1, "y", False), (3, 1, 1, "z", False),
    ]
    assert {(r["hit"]) for r in search.quota_union([a, b], ["doc"], ["rank"], 1).collect()} == {"p", "x", "z", "n"}


def test_long_sequences_in_seconds(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
        return row[-1]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            old, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
        return row[-1]

    rng = random.Random(6)
    for _ in range(150):
        a, b = ([rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(90))] for _ in range(2))
        assert compare.common_subsequence(a, b) == lcs(a, b) and compare.word_edits(a, b) == edits(a, b)
    long = [f"w{rng.randrange(2000)}" for _ in range(20_000)]
    other = [w if rng.random() < 0.9 else "new" for w in long]
    start = time.time()
    assert 17_000 < compare.common_subsequence(long, other) < 19_000 and 1_000 < compare.word_edits(long, other) < 3_000
    assert time.time() - start < 20
    rows = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, None, ["b"]), (3, [], [])], "id int, a array<string>, b array<string>")
    assert [r["value"] for r in compare.sequence_measure(rows, ["id"], "a", "b", "word_edits").orderBy("id").collect()] == [1, 1, 0]


def test_page_sources_and_white(spark):
    box = "array<struct<left:double,bottom:double,right:double,top:double>>"
    rows = [(1, "", "", 100.0, [(0.0, 0.0, 10.0, 5.0)]), (2, None, None, 100.0, [(0.0, 0.0, 5.0, 5.0)]), (3, "a", "a", 100.0, [(0.0, 0.0, 10.0, 10.0)]), (4, "", "", 100.0, None), (5, "", "x" * 24, 0.0, [(9.0, 0.0, 1.0, 5.0)])]
    got = findings.page_sources(spark.createDataFrame(rows, f"id int, text string, markdown string, area double, images {box}"), ["id"]).collect()
    assert {r["id"]: (r["image_only"], r["scanned"], r["sparse"]) for r in got} == {1: (True, True, True), 2: (True, False, True), 3: (False, False, True), 4: (False, False, True), 5: (True, False, False)}
    colors = spark.createDataFrame([("DeviceGray", [0.96]), ("DeviceGray", []), ("DeviceRGB", [1.0, 1.0, 0.9]), ("DeviceCMYK", [0.0, 0.0, 0.0, 0.0]), ("Other", [1.0]), (None, None)], "s string, c array<double>")
    assert [r[0] for r in colors.select(findings.is_white(F.col("s"), F.col("c"))).collect()] == [True, False, False, True, False, False]
