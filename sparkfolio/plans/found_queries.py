"""Findings, ignore rules, places in originals, quotas and intervals: places and links are numbers of the tables, by a stated rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.operators import accessible, evidence, findings, located, search, spans, twin
from sparkfolio.plans.registry import query, table
from sparkfolio.sources import ignore

_ITEMS = """(SELECT l_orderkey // 4 AS page, l_orderkey * 10 + l_linenumber AS item, l_returnflag || l_suppkey % 7 AS text, l_quantity * 10 - 20 AS "left", l_quantity * 10 + l_discount * 400 AS "right",
    CAST(l_partkey % 70 * 12 - 36 AS DOUBLE) AS bottom, CAST(l_partkey % 70 * 12 - 35 + l_suppkey % 12 AS DOUBLE) AS top, l_tax < 0.075 AS visible FROM lineitem)"""


def _items(spark, d):
    low = F.col("l_partkey") % 70 * 12
    return table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 4").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.concat("l_returnflag", (F.col("l_suppkey") % 7).cast("string")).alias("text"),
        (F.col("l_quantity") * 10 - 20).alias("left"), (F.col("l_quantity") * 10 + F.col("l_discount") * 400).alias("right"), (low - 36).cast("double").alias("bottom"),
        (low - 35 + F.col("l_suppkey") % 12).cast("double").alias("top"), (F.col("l_tax") < 0.075).alias("visible"),
    )


@query(f"""WITH i AS {_ITEMS},
    o AS (SELECT b.page, b.item, min(a.item) AS partner FROM i a JOIN i b ON a.page = b.page AND a.item < b.item AND a.text <> b.text AND a.left < a.right AND b.left < b.right
        AND least(a.right, b.right) > greatest(a.left, b.left) AND least(a.top, b.top) > greatest(a.bottom, b.bottom)
        AND (least(a.right, b.right) - greatest(a.left, b.left)) * (least(a.top, b.top) - greatest(a.bottom, b.bottom)) >= 0.5 * least((a.right - a.left) * (a.top - a.bottom), (b.right - b.left) * (b.top - b.bottom)) GROUP BY 1, 2)
    SELECT page, item, 'hidden_text' AS type, 'high' AS severity, NULL AS partner FROM i WHERE NOT visible
    UNION ALL SELECT page, item, 'tiny_text', 'low', NULL FROM i WHERE abs(top - bottom) < 4
    UNION ALL SELECT page, item, 'off_page_text', 'medium', NULL FROM i WHERE "right" <= 0 OR "left" >= 450 OR top <= 0 OR bottom >= 780
    UNION ALL SELECT page, item, 'overlapping_text', 'medium', partner FROM o""")
def safety_text_findings(spark, d):
    items = _items(spark, d)
    pages = items.select("page").distinct().select("page", F.lit(450.0).alias("width"), F.lit(780.0).alias("height"))
    return findings.text_findings(items, pages, ["page"])


@query("""WITH u AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'javascript:open(' || page_id || ')' WHEN 1 THEN ' DATA:text/html,' || page_id WHEN 2 THEN 'File:///etc/' || page_id WHEN 3 THEN NULL WHEN 4 THEN '/data:' || page_id ELSE url END AS url FROM pages)
    SELECT page_id, url, CASE WHEN regexp_matches(lower(trim(url)), '^(javascript|data|file|vbscript):') THEN 'unsafe_external_link' ELSE 'external_link' END AS type,
        CASE WHEN regexp_matches(lower(trim(url)), '^(javascript|data|file|vbscript):') THEN 'high' ELSE 'low' END AS severity FROM u WHERE url IS NOT NULL""")
def safety_link_signals(spark, d):
    k = F.col("page_id") % 9
    made = F.when(k == 0, F.concat(F.lit("javascript:open("), F.col("page_id").cast("string"), F.lit(")"))).when(k == 1, F.concat(F.lit(" DATA:text/html,"), F.col("page_id").cast("string")))
    made = made.when(k == 2, F.concat(F.lit("File:///etc/"), F.col("page_id").cast("string"))).when(k == 4, F.concat(F.lit("/data:"), F.col("page_id").cast("string"))).when(k != 3, F.col("url"))
    return findings.link_signals(table(spark, d, "pages").select("page_id", made.alias("url")), ["page_id"])


@query("""SELECT l_orderkey, l_linenumber, l_linenumber % 3 > 0 AND l_suppkey % 4 < 2 AS image_only,
        l_linenumber % 3 > 0 AND l_suppkey % 4 < 2 AND least(100 * l_quantity * CASE l_linenumber % 3 WHEN 1 THEN 1 ELSE 2 END, 5000) >= 2500 AS scanned, l_suppkey % 4 < 3 AS sparse FROM lineitem""")
def flt_page_sources(spark, d):
    k, n = F.col("l_suppkey") % 4, F.col("l_linenumber") % 3
    text = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("— … ·")).when(k == 2, F.lit("few words")).otherwise(F.lit("a line of words that is long enough to be read"))
    box = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("bottom"), F.col("l_quantity").alias("right"), F.lit(100.0).alias("top"))
    pages = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"), text.alias("markdown"), F.lit(5000.0).alias("area"), F.array_repeat(box, n.cast("int")).alias("images"))
    return findings.page_sources(pages, ["l_orderkey", "l_linenumber"])


@query("""WITH c AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'DeviceGray' WHEN 1 THEN 'DeviceRGB' WHEN 2 THEN 'DeviceCMYK' ELSE 'Pattern' END AS space, [p_retailprice % 1.2, p_partkey % 100 / 99, p_size / 50, 0.01] AS v FROM part)
    SELECT p_partkey, CASE space WHEN 'DeviceGray' THEN v[1] > 0.95 WHEN 'DeviceRGB' THEN v[1] > 0.95 AND v[2] > 0.95 AND v[3] > 0.95 WHEN 'DeviceCMYK' THEN v[1] < 0.05 AND v[2] < 0.05 AND v[3] < 0.05 AND v[4] < 0.05 ELSE false END AS white FROM c""")
def flt_white_paint(spark, d):
    k = F.col("p_size") % 4
    space = F.when(k == 0, "DeviceGray").when(k == 1, "DeviceRGB").when(k == 2, "DeviceCMYK").otherwise("Pattern")
    color = F.array(F.col("p_retailprice") % 1.2, F.col("p_partkey") % 100 / 99, F.col("p_size") / 50, F.lit(0.01))
    return table(spark, d, "part").select("p_partkey", findings.is_white(space, color).alias("white"))


_PATHS = "(SELECT doc_id, 'd' || doc_id % 7 || '/' || coalesce(lang, 'xx') || '/s' || doc_id % 5 || '/f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.log' END AS path FROM documents)"
_RULES = (
    ("", 1, "*.log"), ("", 2, "!f*7.log"), ("", 3, "d3/"), ("", 4, "# note"), ("", 5, "  "), ("d1", 1, "/en/**"), ("d1", 2, "!s2/"), ("d1/de", 1, "s[!0-2]"), ("d2", 1, "!*.log"), ("d2/en", 1, "s?/f*1*"),
    ("d4", 1, "**/s3/*.md"), ("d5", 1, "fr"), ("d5/fr", 1, "!*"), ("d6", 1, "de/**/f*.txt"), ("d6", 2, "a.b"),
)


@query(f"""WITH p AS {_PATHS},
    r(folder, line, regex, folders, takes_in) AS (VALUES ('', 1, '(.*/)?[^/]*\\.log', false, false), ('', 2, '(.*/)?f[^/]*7\\.log', false, true), ('', 3, '(.*/)?d3', true, false), ('d1', 1, 'en/.+', false, false), ('d1', 2, '(.*/)?s2', true, true),
        ('d1/de', 1, '(.*/)?s[^0-2]', false, false), ('d2', 1, '(.*/)?[^/]*\\.log', false, true), ('d2/en', 1, 's[^/]/f[^/]*1[^/]*', false, false), ('d4', 1, '(.*/)?s3/[^/]*\\.md', false, false), ('d5', 1, '(.*/)?fr', false, false),
        ('d5/fr', 1, '(.*/)?[^/]*', false, true), ('d6', 1, 'de/(.*/)?f[^/]*\\.txt', false, false), ('d6', 2, '(.*/)?a\\.b', false, false)),
    h AS (SELECT doc_id, path, string_split(path, '/') AS s, unnest(range(1, 5)) AS n FROM p),
    q AS (SELECT doc_id, path, array_to_string(s[1:n], '/') AS prefix, n < 4 AS folder_ FROM h),
    m AS (SELECT doc_id, prefix, takes_in, row_number() OVER (PARTITION BY doc_id, prefix ORDER BY length(r.folder) DESC, line DESC) AS k FROM q JOIN r
        ON (r.folder = '' OR starts_with(prefix, r.folder || '/')) AND (folder_ OR NOT folders) AND regexp_full_match(CASE WHEN r.folder = '' THEN prefix ELSE prefix[length(r.folder) + 2:] END, regex)),
    o AS (SELECT doc_id, min_by(prefix, length(prefix)) AS cut_at FROM m WHERE k = 1 AND NOT takes_in GROUP BY doc_id)
    SELECT p.doc_id, p.path, o.cut_at, o.cut_at IS NOT NULL AS ignored FROM p LEFT JOIN o USING (doc_id)""")
def src_ignored_paths(spark, d):
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    end = F.when(i % 3 == 0, ".md").when(i % 3 == 1, ".txt").otherwise(".log")
    path = F.concat(F.lit("d"), text(i % 7), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/s"), text(i % 5), F.lit("/f"), text(i), end)
    return ignore.ignored_paths(table(spark, d, "documents").select("doc_id", path.alias("path")), spark.createDataFrame(list(_RULES), "folder string, line int, pattern string"))


@query(r"""WITH d AS (SELECT doc_id, text, string_split_regex(lower(text), 'the\s+o') AS p, regexp_extract_all(lower(text), 'the\s+o') AS m FROM documents),
    n AS (SELECT *, unnest(range(1, len(m) + 1)) AS n FROM d WHERE len(m) > 0),
    s AS (SELECT doc_id, n, m, text, list_sum(list_transform(p[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:n - 1], lambda x: length(x))), 0) AS a FROM n)
    SELECT doc_id, CAST(n AS INT) AS n, CAST(a AS BIGINT) AS start, CAST(a + length(m[n]) AS BIGINT) AS "end", md5(substring(text, CAST(a AS BIGINT) + 1, length(m[n]))) AS found FROM s""")
def search_located_hits(spark, d):
    hits = located.located_hits(table(spark, d, "documents"), "The  O", ["doc_id"])
    return hits.select("doc_id", "n", "start", "end", F.md5("text").alias("found"))


_QUOTE = "CASE WHEN doc_id % 5 = 0 THEN '#' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN replace(substring(text, 50, 40), ' ', '  ') ELSE substring(text, 50, 40) END"


@query(rf"""WITH c AS (SELECT doc_id, coalesce(text, '') AS text, trim(coalesce({_QUOTE}, ''), ' ') AS q FROM documents),
    e AS (SELECT *, CASE WHEN len(regexp_extract_all(q, '\S+')) = 0 THEN NULL ELSE array_to_string(list_transform(regexp_extract_all(q, '\S+'), lambda w: regexp_escape(w)), '\s+') END AS pat FROM c),
    f AS (SELECT *, CASE WHEN pat IS NULL THEN '' ELSE regexp_extract(text, pat) END AS m FROM e)
    SELECT doc_id, CASE WHEN q = '' THEN 'insufficient' WHEN contains(text, q) THEN 'exact' WHEN m <> '' THEN 'normalized' ELSE 'unmatched' END AS verdict,
        CASE WHEN q = '' THEN NULL WHEN contains(text, q) THEN strpos(text, q) - 1 WHEN m <> '' THEN strpos(text, m) - 1 END AS start,
        CASE WHEN q = '' THEN NULL WHEN contains(text, q) THEN strpos(text, q) - 1 + length(q) WHEN m <> '' THEN strpos(text, m) - 1 + length(m) END AS "end" FROM f""")
def cite_located_quotes(spark, d):
    docs = table(spark, d, "documents")
    quote = F.concat(F.when(F.col("doc_id") % 5 == 0, "#").otherwise(""), F.when(F.col("doc_id") % 2 == 0, F.replace(F.substring("text", 50, 40), F.lit(" "), F.lit("  "))).otherwise(F.substring("text", 50, 40)))
    found = located.located_quotes(docs.select("doc_id", quote.alias("quote")), docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"])
    return found.select("doc_id", "verdict", "start", "end")


@query(r"""WITH t AS (SELECT conv_id, turn, text, string_split_regex(trim(text, chr(32) || chr(10)), '\s+') AS w FROM conversations),
    k AS (SELECT *, list_filter(range(len(w)), lambda i: (length(text) + i) % 97 = 0) AS bad FROM t)
    SELECT conv_id, turn, CAST(CASE WHEN len(bad) > 0 THEN bad[1] ELSE len(w) END AS INT) AS covered, len(bad) = 0 AS complete, true AS faithful FROM k""")
def join_word_cursor(spark, d):
    words = F.split(F.regexp_replace("text", r"^[ \n]+|[ \n]+$", ""), r"\s+")
    altered = F.transform(words, lambda w, i: F.when((F.length("text") + i) % 97 == 0, F.concat(w, F.lit("!"))).otherwise(w))
    pages = table(spark, d, "conversations").select("conv_id", "turn", "text", altered.alias("words"))
    found = located.align_words(pages, ["conv_id", "turn", "text", "words"])
    right = F.forall(F.arrays_zip("words", "spans"), lambda z: z["spans"].isNull() | (F.substr("text", z["spans"]["start"] + 1, z["spans"]["end"] - z["spans"]["start"]) == z["words"]))
    return found.select("conv_id", "turn", F.size(F.filter("spans", lambda s: s.isNotNull())).alias("covered"), "complete", right.alias("faithful"))


@query("""WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS source, l_extendedprice, count(*) OVER (PARTITION BY l_partkey) > 30 AS truncated FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY source, l_extendedprice, l_linenumber, l_orderkey) AS place FROM r)
    SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, CAST(source AS INT) AS source, CAST(place AS INT) AS place, truncated FROM n WHERE place <= 30""")
def search_quota_union(spark, d):
    rows = table(spark, d, "lineitem")
    sources = [rows.filter(F.col("l_returnflag") == f).select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice") for f in ("R", "A", "N")]
    return search.quota_union(sources, ["l_partkey"], ["l_extendedprice", "l_linenumber"], 30)


_P = twin.PRIME
_C = twin.COEFFICIENTS


@query(f"""WITH r AS (SELECT conv_id * 1000 + turn AS id, len(regexp_extract_all(text, '[A-Z]')) AS e, length(text) AS u FROM conversations),
    x AS (SELECT k, e, u, (id % {_P} * 7919 + k * 104729) % {_P} AS x FROM r, range(1, 1001) t(k)),
    h AS (SELECT k, e, u, ((({_C[0]} * x + {_C[1]}) % {_P} * x + {_C[2]}) % {_P} * x + {_C[3]}) % {_P} AS h FROM x),
    w AS (SELECT k, e, u, {" + ".join(f"CAST(h >= {p} AS INT)" for p in twin.POISSON)} AS w FROM h),
    s AS (SELECT k, sum(e * w) * 100.0 / greatest(sum(u * w), 1) AS rate FROM w GROUP BY k)
    SELECT round((SELECT sum(e) * 100.0 / greatest(sum(u), 1) FROM r), 9) AS rate, round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high FROM s""")
def score_bootstrap_interval(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_count("text", F.lit("[A-Z]")).alias("e"), F.length("text").alias("u"))
    return twin.bootstrap_interval(rows, "e", "u").select(*[F.round(c, 9).alias(c) for c in ("rate", "low", "high")])


_TOKENS = """(SELECT l_orderkey // 4 AS doc, row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CASE l_partkey % 9 WHEN 0 THEN 'open' WHEN 1 THEN 'open' WHEN 2 THEN 'close' WHEN 3 THEN 'close' WHEN 4 THEN 'comment' WHEN 5 THEN 'raw' ELSE 'text' END AS kind,
    CASE l_suppkey % 3 WHEN 0 THEN 'insertion' WHEN 1 THEN 'deletion' ELSE 'highlight' END AS mark, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS "by", l_returnflag || l_linenumber AS text FROM lineitem)"""


@query(f"""WITH t AS {_TOKENS},
    m AS (SELECT t.*, k.m AS mk, CASE WHEN mark = k.m AND kind = 'open' THEN 1 WHEN mark = k.m AND kind = 'close' THEN -1 ELSE 0 END AS step FROM t, (VALUES ('insertion'), ('deletion'), ('highlight')) k(m)),
    s AS (SELECT *, sum(step) OVER (PARTITION BY doc, mk ORDER BY pos) AS s FROM m),
    e AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc, mk ORDER BY pos)) AS open_ FROM s),
    o AS (SELECT *, last_value(CASE WHEN step = 1 AND open_ = 1 THEN {{'opened': pos, 'mark': mk, 'who': "by"}} END IGNORE NULLS) OVER (PARTITION BY doc, mk ORDER BY pos) AS node FROM e),
    l AS (SELECT doc, pos, kind, text, coalesce(list(node ORDER BY node.opened) FILTER (open_ > 0), []) AS path FROM o WHERE kind IN ('text', 'raw', 'comment') GROUP BY doc, pos, kind, text),
    n AS (SELECT doc, pos, kind, path, unnest(range(1, len(path) + 1)) AS k FROM l),
    c AS (SELECT doc, path[1:k] AS node, bool_or(kind <> 'comment') AS content, max(pos) AS ends FROM n GROUP BY doc, path[1:k]),
    x AS (SELECT n.doc, n.pos, min_by({{'content': content, 'ends': ends, 'keep': n.k - 1}}, n.k) AS o FROM n JOIN c ON n.doc = c.doc AND n.path[1:n.k] = c.node WHERE kind = 'comment' AND (NOT content OR n.path[n.k].mark = 'highlight') GROUP BY n.doc, n.pos),
    r AS (SELECT l.doc, l.kind, l.text, l.pos, CASE WHEN o IS NULL THEN path ELSE path[1:o.keep] END AS path, CASE WHEN o.content THEN o.ends ELSE l.pos END AS a, CASE WHEN o.content THEN 1 ELSE 0 END AS b FROM l LEFT JOIN x ON l.doc = x.doc AND l.pos = x.pos),
    p AS (SELECT doc, kind, text, a, b, pos, array_to_string(list_transform(path, lambda q: q.mark || ':' || coalesce(q.who, '')), '>') AS path FROM r),
    f AS (SELECT *, CASE WHEN kind = 'text' AND lag(kind) OVER w = 'text' AND path = lag(path) OVER w THEN 0 ELSE 1 END AS fresh FROM p WINDOW w AS (PARTITION BY doc ORDER BY a, b, pos)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY a, b, pos) AS run FROM f)
    SELECT doc, CAST(run AS BIGINT) AS run, any_value(path) AS path, any_value(kind) AS kind, string_agg(text, '' ORDER BY a, b, pos) AS text FROM g GROUP BY doc, run""")
def rd_span_runs(spark, d):
    k = F.col("l_partkey") % 9
    kind = F.when(k < 2, "open").when(k < 4, "close").when(k == 4, "comment").when(k == 5, "raw").otherwise("text")
    mark = F.when(F.col("l_suppkey") % 3 == 0, "insertion").when(F.col("l_suppkey") % 3 == 1, "deletion").otherwise("highlight")
    order = Window.partitionBy(F.expr("l_orderkey div 4")).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    tokens = table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 4").alias("doc"), F.row_number().over(order).alias("pos"), kind.alias("kind"), mark.alias("mark"),
        F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("by"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), F.lit(None).cast("string").alias("format"),
    )
    path = F.array_join(F.transform("path", lambda p: F.concat(p["mark"], F.lit(":"), F.coalesce(p["by"], F.lit("")))), ">")
    return spans.span_runs(tokens, ["doc"]).select("doc", "run", path.alias("path"), "kind", "text")


_FACTS = """d AS (SELECT o_orderkey AS doc, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS marked, CASE o_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS suspects,
        CASE o_custkey % 3 WHEN 0 THEN ['print'] WHEN 1 THEN ['print', 'copy_for_accessibility'] END AS permissions FROM orders),
    e AS (SELECT l_orderkey AS doc, l_linenumber % 3 AS page, CASE WHEN l_partkey % 4 = 0 THEN 'image' ELSE 'text' END AS type, CASE l_suppkey % 7 WHEN 0 THEN 'H1' WHEN 1 THEN ' Figure' WHEN 2 THEN 'h7' WHEN 3 THEN 'P' END AS role,
        CASE WHEN l_partkey % 3 = 0 THEN 'http://x/' || l_partkey END AS url, CASE WHEN l_suppkey % 2 = 0 THEN 'label' END AS contents,
        CASE l_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Field12' WHEN 2 THEN 'unnamed box' WHEN 3 THEN 'field1a' WHEN 4 THEN NULL ELSE 'Name' END AS name, l_tax > 0.04 AS required, l_orderkey % 4 > 0 AS has_tree, l_quantity > 25 AS entry FROM lineitem),
    n AS (SELECT * FROM e WHERE has_tree AND page < 2),
    r AS (SELECT doc, page, count(*) FILTER (regexp_matches(lower(trim(role)), '^h[1-6]$')) AS headings, count(*) FILTER (lower(trim(role)) = 'figure') AS figures, count(*) FILTER (role IS NULL) AS contents FROM n GROUP BY doc, page),
    s AS (SELECT doc, page, count(*) AS visible, count(*) FILTER (type = 'image') AS images FROM e GROUP BY doc, page),
    o AS (SELECT doc, count(*) AS outline FROM e WHERE entry GROUP BY doc),
    f AS (SELECT s.*, r.doc IS NOT NULL AS tagged, coalesce(headings, 0) AS headings, coalesce(figures, 0) AS figures, coalesce(contents, 0) AS contents, coalesce(outline, 0) AS outline FROM s LEFT JOIN r ON s.doc = r.doc AND s.page = r.page LEFT JOIN o ON s.doc = o.doc),
    g AS (SELECT *, CASE WHEN NOT tagged THEN 0 ELSE floor(least(1, contents / visible) * 100 + 0.5) / 100 END AS coverage FROM f),
    i AS (SELECT doc, NULL AS page, 'mark_info_missing' AS type, 'medium' AS severity FROM d WHERE marked IS NULL AND doc NOT IN (SELECT doc FROM n)
        UNION ALL SELECT doc, NULL, 'untagged_pdf', 'high' FROM d WHERE NOT marked UNION ALL SELECT doc, NULL, 'suspect_tags', 'high' FROM d WHERE suspects
        UNION ALL SELECT doc, NULL, 'structure_tree_missing', 'medium' FROM d WHERE doc NOT IN (SELECT doc FROM n)
        UNION ALL SELECT doc, NULL, 'accessibility_permission', 'high' FROM d WHERE len(permissions) > 0 AND NOT list_contains(permissions, 'copy_for_accessibility')
        UNION ALL SELECT doc, page, 'untagged_page', 'medium' FROM g WHERE NOT tagged UNION ALL SELECT doc, page, 'heading_structure', 'low' FROM g WHERE tagged AND headings = 0 AND outline > 0
        UNION ALL SELECT doc, page, 'tagged_content_mismatch', 'medium' FROM g WHERE tagged AND coverage < 0.5 UNION ALL SELECT doc, page, 'image_alt_text', CASE WHEN tagged THEN 'medium' ELSE 'high' END FROM g WHERE images > figures
        UNION ALL SELECT doc, page, 'form_field_label', CASE WHEN required THEN 'medium' ELSE 'low' END FROM e WHERE coalesce(name, '') = '' OR regexp_full_match(lower(name), 'unnamed.*|field[0-9]+')
        UNION ALL SELECT doc, page, 'link_label', 'low' FROM e WHERE url IS NOT NULL AND contents IS NULL)"""


def _accessibility(spark, d):
    by = lambda c, n: F.col(c) % n
    orders = table(spark, d, "orders")
    said = lambda c, n: F.when(by(c, n) == 0, True).when(by(c, n) == 1, False)
    rights = F.when(by("o_custkey", 3) == 0, F.array(F.lit("print"))).when(by("o_custkey", 3) == 1, F.array(F.lit("print"), F.lit("copy_for_accessibility")))
    docs = orders.select(F.col("o_orderkey").alias("doc"), said("o_orderkey", 5).alias("marked"), said("o_custkey", 4).alias("suspects"), rights.alias("permissions"))
    role = F.when(by("l_suppkey", 7) == 0, "H1").when(by("l_suppkey", 7) == 1, " Figure").when(by("l_suppkey", 7) == 2, "h7").when(by("l_suppkey", 7) == 3, "P")
    k = by("l_partkey", 6)
    name = F.when(k == 0, "").when(k == 1, "Field12").when(k == 2, "unnamed box").when(k == 3, "field1a").when(k == 5, "Name")
    e = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), by("l_linenumber", 3).alias("page"), F.when(by("l_partkey", 4) == 0, "image").otherwise("text").alias("type"), role.alias("role"),
        F.when(by("l_partkey", 3) == 0, F.concat(F.lit("http://x/"), F.col("l_partkey").cast("string"))).alias("url"), F.when(by("l_suppkey", 2) == 0, "label").alias("contents"), F.lit(None).cast("string").alias("title"),
        name.alias("name"), (F.col("l_tax") > 0.04).alias("required"), (by("l_orderkey", 4) > 0).alias("has_tree"), (F.col("l_quantity") > 25).alias("entry"),
    )
    nodes = e.filter("has_tree AND page < 2")
    facts = accessible.page_facts(e, e, nodes, e.filter("entry"), ["doc"])
    return accessible.document_findings(docs, nodes, ["doc"]).unionByName(accessible.page_findings(facts, e, e, ["doc"]))


@query(f"WITH {_FACTS} SELECT doc, CAST(page AS INT) AS page, type, severity FROM i")
def accessibility_findings(spark, d):
    return _accessibility(spark, d)


@query(f"""WITH {_FACTS}, t AS (SELECT doc, type, count(*) AS n FROM i GROUP BY doc, type), c AS (SELECT doc, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM i GROUP BY doc),
    p AS (SELECT doc, string_agg(type || ':' || n, ',' ORDER BY type) AS types FROM t GROUP BY doc)
    SELECT doc, types, high, medium, low, CAST(greatest(0, least(100, 100 - 35 * high - 18 * medium - 8 * low)) AS INT) AS score FROM c JOIN p USING (doc)""")
def accessibility_summary(spark, d):
    found = _accessibility(spark, d)
    scored = evidence.accessibility(found, ["doc"]).select("doc", "high", "medium", "low", "score")
    types = accessible.type_counts(found, ["doc"])
    listed = F.array_join(F.transform(F.map_entries("types"), lambda t: F.concat(t["key"], F.lit(":"), t["value"].cast("string"))), ",")
    return scored.join(types.select("doc", listed.alias("types")), "doc")
