"""Operators on small fixtures, folds against plain loops."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio.operators import compare, evidence, layout, media, outline, reading, search, units
from sparkfolio.sources import html, tabular


def test_search(spark):
    docs = spark.createDataFrame([(1, "The cat. the CAT"), (2, "cathedral"), (3, None)], "id long, text string")
    assert {r["id"]: r["matches"] for r in search.literal_counts(docs, "cat", ["id"]).collect()} == {1: 2, 2: 1}
    assert {r["id"]: r["matches"] for r in search.literal_counts(docs, "cat", ["id"], whole_word=True).collect()} == {1: 2}
    hits = search.literal_hits(docs, "cat", ["id"], ["id"], 1).collect()
    assert sorted((r["id"], r["offset"]) for r in hits) == [(1, 4), (2, 0)]
    assert [r["id"] for r in search.ranked(docs, "cat", 5, ["id"]).collect()] == [1]
    assert search.auto_search(docs, "cat the nothing", 5, ["id"])[0] == "ranked"
    assert search.bm25(docs, "!!", ["id"]).count() == 0


def test_page_selectors(spark):
    parse = lambda s: spark.createDataFrame([(s,)], "s string").select(reading.parse_pages(F.col("s"))).first()[0]
    assert parse("1-3,5, 2 ,+7") == [1, 2, 3, 5, 7]
    assert parse("3-1") is None and parse("0") is None and parse("x") is None
    assert len(parse("5-")) == 10_001
    describe = spark.createDataFrame([([1, 2, 3, 5, 9, 10],)], "p array<int>").select(reading.describe_pages(F.col("p"))).first()[0]
    assert describe == "1-3,5,9-10"
    sample = spark.createDataFrame([(16,)], "n int").select(reading.sample_pages(F.col("n"), 5)).first()[0]
    assert sample == [1, 5, 9, 12, 16]


def test_budgeted_read(spark):
    rows = [(1, n, "abcde " * 100) for n in range(5)] + [(2, 0, "x " * 2000), (2, 1, "y")]
    found = reading.read_budgeted(spark.createDataFrame(rows, "id long, n long, text string"), 500, ["id"], "n")
    shown = {(r["id"], r["n"]): (r["shown"], r["cut_at"]) for r in found.collect()}
    assert [shown[1, n][0] for n in range(5)] == [True] * 4 + [False]
    assert shown[2, 0][0] and shown[2, 0][1] >= 512 and not shown[2, 1][0]
    cursors = {r["id"]: r["cursor"] for r in reading.next_cursor(found, ["id"], "n").collect()}
    assert cursors[1] == "4" and cursors[2].startswith("0:")


def test_elements_and_hints(spark):
    text = "\n".join(["1.2 Scope of Work", "", "  - item", "Table 3: Things", "plain text."] + [f"line {i}." for i in range(60)])
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = units.elements(docs).orderBy("line").collect()
    expected = []
    counts: dict[int, int] = {}
    for i, line in enumerate(text.split("\n")):
        if line.strip():
            page = i // 40 + 1
            counts[page] = counts.get(page, 0) + 1
            expected.append((page, f"p{page}-text-{counts[page]}", i + 1, line.strip()))
    assert [(r["page"], r["element_id"], r["line"], r["content"]) for r in rows] == expected
    hints = units.elements(docs).select("content", units.semantic_hint(F.col("content")).alias("h")).collect()
    roles = {r["content"]: (r["h"]["role"], r["h"]["level"]) for r in hints}
    assert roles["1.2 Scope of Work"] == ("heading", 2) and roles["- item"][0] == "list_item" and roles["Table 3: Things"][0] == "caption" and roles["plain text."][0] == "paragraph"


def test_redaction(spark):
    text = "key api_key = abcdefghijklmnop, a.b@c.org, 123-45-6789, 4111 1111 1111 1111, 1234 5678 9012 3456, 10.1.2.3, call +1 (368) 555-2854 now"
    frame = spark.createDataFrame([(text,)], "t string")
    balanced = frame.select(evidence.redact(F.col("t")).alias("r")).first()["r"]
    assert balanced["types"] == ["secret", "email", "ssn", "credit_card"]
    assert "LAST4_1111" in balanced["text"] and "1234 5678 9012 3456" in balanced["text"] and "10.1.2.3" in balanced["text"]
    strict = frame.select(evidence.redact(F.col("t"), "strict").alias("r")).first()["r"]
    assert "[REDACTED_IPV4]" in strict["text"] and "[REDACTED_PHONE_LAST4_2854]" in strict["text"]
    off = frame.select(evidence.redact(F.col("t"), "off").alias("r")).first()["r"]
    assert off["text"] == text and off["types"] == []


def test_injection_pattern(spark):
    hit = ["Ignore all previous instructions", "please disregard above instructions", "the SYSTEM PROMPT is"]
    miss = ["ignore the noise", "previous instructions", "systemprompt"]
    rows = spark.createDataFrame([(x,) for x in hit + miss], "t string").select("t", F.col("t").rlike(evidence.INJECTION).alias("m")).collect()
    assert {r["t"] for r in rows if r["m"]} == set(hit)


def test_layout_of_a_blank_page(spark):
    pages = spark.createDataFrame([(1, 0, 0), (2, 5, 5), (3, 2, 0)], "page int, item_count long, positioned_count long")
    found = {r["page"]: r for r in evidence.layout_diagnostics(pages, ["page"]).collect()}
    assert found[1]["confidence"] == 0.2 and found[1]["profile"] == "unknown" and found[1]["signals"] == ["empty-page-content"]
    assert found[2]["confidence"] == 0.92 and found[2]["profile"] == "single_column" and found[2]["warnings"] == []
    assert found[3]["confidence"] == 0.2 and "sparse-page" in found[3]["signals"]


def test_chunks_break_where_they_should():
    e = lambda i, content, role="paragraph", kind="text", page=1: {"id": f"e{i}", "page": page, "type": kind, "content": content, "role": role}
    found = outline.chunks([e(1, "Opening text"), e(2, "1 Title", "heading"), e(3, "a\tb", kind="table"), e(4, "x" * 1799), e(5, "😀")])
    assert [c[5] for c in found] == ["page", "semantic", "table", "page", "size"]
    assert [c[0] for c in found] == [f"p1-chunk-{k}" for k in range(1, 6)]
    assert len(outline.chunks([e(1, "a"), e(2, "b", page=2)])) == 2
    assert outline.chunks([]) == []


def test_outline():
    text = "# A\n\ntext\n\n```\n# no\n```\n## B ##\nC\n===\n<!-- # x -->\n### D\n# E\n"
    assert [(t, lv) for lv, t, _ in outline.headings(text)] == [("A", 1), ("B", 2), ("C", 1), ("D", 3), ("E", 1)]
    nodes = outline.outline(text)
    assert [n[0] for n in nodes] == ["n1.1", "n1.1.1", "n1.2", "n1.2.1", "n1.3"]
    assert nodes[1][3] == "A > B" and nodes[0][5] == nodes[2][4] and nodes[-1][5] == len(text)


def test_windows_against_loops(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randrange(0, 60)), float(rng.randrange(1, 12))) for k in range(30) for _ in range(rng.randrange(1, 9))]
    frame = spark.createDataFrame([(k, a, a + w) for k, a, w in rows], "k int, a double, z double")
    gaps = sorted(tuple(r) for r in layout.uncovered_gaps(frame, ["k"], "a", "z", 3.0).collect())
    wanted = []
    for k in range(30):
        reach = None
        for a, z in sorted((a, a + w) for kk, a, w in rows if kk == k):
            if reach is not None and a - reach >= 3:
                wanted.append((k, reach, a))
            reach = z if reach is None else max(reach, z)
    assert gaps == sorted(wanted)
    ys = [5.0, 9.9, 10.1, 30.0, 33.0, 35.1, 36.0]
    got = spark.createDataFrame([(ys,)], "y array<double>").select(layout.cluster_rows(F.transform("y", lambda y: F.struct(y.alias("y")))).alias("r")).first()["r"]
    anchor, row, expected = None, -1, []
    for y in sorted(ys, reverse=True):
        if anchor is None or abs(anchor - y) > 5:
            anchor, row = y, row + 1
        expected.append((y, row))
    assert [(r["y"], r["row"]) for r in got] == expected
    levels = spark.createDataFrame([([12.0, 11.5, 18.0, 10.8, 17.5],)], "s array<double>").select(layout.heading_levels(F.col("s"))).first()[0]
    assert levels == [18.0, 12.0, 10.8]
    space = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],)], "g array<double>").select(layout.space_threshold(F.col("g")).alias("s")).first()["s"]
    assert space["letter_gap"] == 0.2 and abs(space["threshold"] - 0.36) < 1e-9


def test_cues(spark):
    srt = "1\n00:00:01,500 --> 00:00:03,000\n<i>Hello</i> &amp; bye\nmore\n\nNOTE x --> y\n\n2\n01:00:00.000 --> 01:00:01.000\n<v Ann>Hi</v>\n"
    tracks = spark.createDataFrame([(1, srt), (2, None)], "id long, text string")
    found = media.cues(tracks, ["id"])
    assert [(r["n"], r["start_ms"], r["end_ms"], r["text"]) for r in found.orderBy("n").collect()] == [(1, 1500, 3000, "Hello & bye more"), (2, 3_600_000, 3_601_000, "Ann: Hi")]
    assert media.render_cues(found, ["id"]).first()["markdown"] == "[00:00:01.500] Hello & bye more\n[01:00:00] Ann: Hi"
    cuts = spark.createDataFrame([(1, t) for t in (5, 5, 9, 30)], "k int, t long")
    assert [(r["start_ms"], r["end_ms"]) for r in media.scenes(cuts, ["k"], "t", 0, 20).orderBy("scene").collect()] == [(0, 5), (5, 9), (9, 20)]
    files = spark.createDataFrame([(p,) for p in ("/a/x.mp4", "/a/x.srt", "/a/x.en.vtt", "/a/y.srt")], "path string")
    assert {r["sidecar"] for r in media.sidecars(files).collect()} == {"/a/x.srt", "/a/x.en.vtt"}


def test_tables():
    assert tabular.csv_to_markdown('a,b\n"x|y",2\n,\n3\n') == "|a|b|\n|---|---|\n|x\\|y|2|\n|3||"
    long = "h\n" + "\n".join(map(str, range(2500)))
    assert tabular.csv_to_markdown(long).endswith("… 500 more rows")
    assert tabular.csv_to_markdown("") == ""
    assert [tabular.number(v) for v in (3.0, -0.0, 0.1 + 0.2, 1e20)] == ["3", "0", "0.3", "1e+20"]


def test_html():
    page = """<html><head><title>T</title></head><body><nav><a href='/x'>nav</a></nav><article><h1>Head</h1><p>Some <b>bold</b> and <a href='/u'>link</a>.</p>
    <ul><li>one<li>two<ol start=3><li>in</ol></ul><pre><code class='language-py'>x = 1\n</code></pre><table><tr><th>a<th>b<tr><td colspan=2>c|d</table></article></body></html>"""
    found = html.to_markdown(page, "http://h/")
    assert "nav" not in found
    assert found.startswith("# Head\n\nSome **bold** and [link](http://h/u).")
    assert "- one\n- two\n  3. in" in found and "```py\nx = 1\n```" in found and "|a|b|\n|---|---|\n|c\\|d||" in found
    assert html.to_markdown(None) == "" and html.to_markdown("<p>a<p>b") == "a\n\nb"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_sequence_measures(a, b):
    from functools import lru_cache

    @lru_cache(None)
    def lcs(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + lcs(i + 1, j + 1) if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

    @lru_cache(None)
    def edits(i, j):
        if i == len(a) or j == len(b):
            return len(a) - i + len(b) - j
        return min(edits(i + 1, j + 1) + (a[i] != b[j]), edits(i + 1, j) + 1, edits(i, j + 1) + 1)

    assert compare.common_subsequence(a, b) == lcs(0, 0) and compare.word_edits(a, b) == edits(0, 0)
    assert compare.longest_increasing([3, 1, 2, 2, 5]) == 3


def test_compare_and_scores(spark):
    frame = spark.createDataFrame([("a b c", "b c. d")], "a string, b string").select(compare.compare_texts(F.col("a"), F.col("b")).alias("c")).first()["c"]
    assert frame["added"] == ["d"] and frame["removed"] == ["a"] and not frame["identical"]
    pairs = spark.createDataFrame([(1, "a a b", "a b b c"), (2, "x", "y"), (3, "", "y")], "id int, r string, o string")
    rated = {r["id"]: r for r in compare.bag_f1(pairs, ["id"], "r", "o").collect()}
    assert rated[1]["overlap"] == 2 and abs(rated[1]["f1"] - 2 * (2 / 4) * (2 / 3) / (2 / 4 + 2 / 3)) < 1e-12 and rated[2]["f1"] == 0 and rated[3]["f1"] == 0
    corpus = spark.createDataFrame([("d1", "x"), ("d2", "x"), ("d3", "y")], "doc string, category string")
    results = spark.createDataFrame([("t", "d1", "ok", 1.0), ("t", "d2", "failed", None), ("t", "d3", "ok", 0.5), ("u", "d1", "failed", None)], "tool string, doc string, status string, score double")
    board = {r["tool"]: r["overall"] for r in compare.leaderboard(corpus, results).collect()}
    assert board == {"t": 0.5, "u": 0.0}
