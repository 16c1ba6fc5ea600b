"""Scalar operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions import predicates as P
from sparkfolio.functions import text as X
from sparkfolio.plans.registry import query, table
from sparkfolio.sources import detect, html


def T():
    return F.col("text")

_FOLD = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]{1,5}')) + len(regexp_extract_all(text, '[0-9]{1,3}'))
    + len(regexp_extract_all(text, '[\\s\\x{A0}]{3,}')) + len(regexp_extract_all(text, '[^A-Za-z0-9\\s\\x{A0}]')) AS BIGINT) AS tokens FROM documents""")
def fn_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(T()).alias("tokens"))


@query(r"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)")
def fn_terms(spark, d):
    found = table(spark, d, "documents").select("doc_id", X.terms(T()).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms"))


@query(rf"SELECT doc_id, md5({_FOLD}) AS collapsed FROM documents")
def fn_collapse_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.collapse(T())).alias("collapsed"))


@query("SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS utf16 FROM documents")
def fn_utf16_length(spark, d):
    return table(spark, d, "documents").select("doc_id", X.utf16_length(T()).alias("utf16"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(l_discount / l_tax, 2) END AS ratio FROM lineitem")
def fn_round_ratio(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.round_ratio(F.try_divide("l_discount", "l_tax")).alias("ratio"))


@query("SELECT event_id, round(value, 4) + 0.0 AS coordinate FROM events")
def fn_canonical_coordinate(spark, d):
    return table(spark, d, "events").select("event_id", X.canonical_coordinate(F.col("value")).alias("coordinate"))


@query(rf"SELECT doc_id, CASE WHEN length(f) > 160 THEN substr(f, 1, 157) || '...' ELSE f END AS snippet FROM (SELECT doc_id, {_FOLD} AS f FROM documents)")
def fn_safety_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet_160(T()).alias("snippet"))


@query(r"""SELECT doc_id, md5(CASE WHEN contains(l, ': ') OR regexp_matches(l, '^["''\[{#&*!|>%@`\-?]') OR suffix(l, ':') THEN CAST(to_json(l) AS VARCHAR) ELSE l END) AS scalar
    FROM (SELECT doc_id, regexp_replace(text, '[\r\n]', ' ', 'g') AS l FROM documents)""")
def fn_yaml_scalar(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.yaml_scalar(T())).alias("scalar"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(replace(replace(text, '\', '\\'), '|', '\|'), '\r\n|\r|\n', ' ', 'g'))) AS cell FROM documents")
def snk_table_cell(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.table_cell(T())).alias("cell"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def snk_html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("escaped"))


@query(r"SELECT doc_id, md5(translate(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[0-9]', '#', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS margin_key FROM documents")
def fn_margin_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.margin_key(T())).alias("margin_key"))


@query("SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '!+'), lambda x: length(x))), 0) AS longest FROM documents")
def fn_longest_run(spark, d):
    return table(spark, d, "documents").select("doc_id", X.longest_run(T(), "!").cast("long").alias("longest"))


@query("""SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KB', floor(s / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(s / 1048576.0 * 10 + 0.5) / 10) END AS size
    FROM (SELECT doc_id, n_chars * 173 + 1 AS s FROM documents)""")
def snk_human_size(spark, d):
    return table(spark, d, "documents").select("doc_id", X.human_size(F.col("n_chars") * 173 + 1).alias("size"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN 'p-' ELSE
      CASE p_partkey % 4 WHEN 1 THEN list_extract(['', 'x', 'xx', 'xxx', 'xl', 'l'], CAST(p_size // 10 + 1 AS INT)) || list_extract(['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'], CAST(p_size % 10 + 1 AS INT))
        ELSE repeat(chr(CAST(97 + (p_size - 1) % 26 AS INT)), CAST((p_size - 1) // 26 + 1 AS INT)) END END AS label FROM part""")
def fn_page_label_format(spark, d):
    style = F.element_at(F.array(*[F.lit(s) for s in ("D", "r", "a", "-")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    prefix = F.when(style == "-", "p-")
    return table(spark, d, "part").select("p_partkey", X.page_label(style, F.col("p_size"), prefix).alias("label"))


@query("SELECT n, CASE WHEN n < 4000 THEN format('{}', n) END AS s, repeat('M', CAST(n // 1000 AS INT)) AS thousands FROM (SELECT DISTINCT CAST(p_retailprice AS BIGINT) AS n FROM part)")
def fn_roman_thousands(spark, d):
    n = F.bround("p_retailprice", 0).cast("long")
    rows = table(spark, d, "part").select(n.alias("n")).distinct()
    return rows.select("n", F.when(F.col("n") < 4000, F.col("n").cast("string")).alias("s"), F.regexp_extract(F.coalesce(X.roman(F.col("n")), F.repeat(F.lit("M"), (F.col("n") / 1000).cast("int"))), "^(M*)(?!.*M)", 1).alias("thousands"))


@query("""SELECT event_id, printf('%02d:%02d:%02d', CAST(ms // 3600000 AS INT), CAST(ms // 60000 % 60 AS INT), CAST(ms // 1000 % 60 AS INT)) || CASE WHEN ms % 1000 > 0 THEN printf('.%03d', CAST(ms % 1000 AS INT)) ELSE '' END AS stamp
    FROM (SELECT event_id, event_id * 7919 AS ms FROM events)""")
def fn_clock(spark, d):
    return table(spark, d, "events").select("event_id", X.clock(F.col("event_id") * 7919, F.lit(True)).alias("stamp"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_partkey AS DOUBLE) / (p_size % 7) END AS fps FROM part")
def fn_frame_rate(spark, d):
    text = F.concat_ws("/", F.col("p_partkey").cast("string"), (F.col("p_size") % 7).cast("string"))
    return table(spark, d, "part").select("p_partkey", X.frame_rate(text).alias("fps"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN least(w1, w2) > 0 THEN greatest(0.0, least(a0 + w1, b0 + w2) - greatest(a0, b0)) / least(w1, w2) ELSE 0.0 END AS overlap
    FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a0, l_discount * 100 + 1 AS w1, l_tax * 500 AS b0, l_quantity / 2 AS w2 FROM lineitem)""")
def fn_overlap_ratio(spark, d):
    a0, w1, b0, w2 = F.col("l_quantity"), F.col("l_discount") * 100 + 1, F.col("l_tax") * 500, F.col("l_quantity") / 2
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a0.alias("a0"), (a0 + w1).alias("a1"), b0.alias("b0"), (b0 + w2).alias("b1"))
    ratio = X.overlap_ratio(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    return rows.select("l_orderkey", "l_linenumber", F.round(ratio, 6).alias("overlap"))


@query("""SELECT o_orderkey, (s > 0 AND s % 10 = 0) AS valid FROM (SELECT o_orderkey, list_sum(list_transform(range(1, length(t) + 1), lambda i:
      CASE WHEN (length(t) - i) % 2 = 1 THEN (CASE WHEN CAST(substr(t, i, 1) AS INT) * 2 > 9 THEN CAST(substr(t, i, 1) AS INT) * 2 - 9 ELSE CAST(substr(t, i, 1) AS INT) * 2 END) ELSE CAST(substr(t, i, 1) AS INT) END)) AS s
    FROM (SELECT o_orderkey, CAST(o_orderkey * 7 + 3 AS VARCHAR) AS t FROM orders))""")
def fn_luhn(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.luhn((F.col("o_orderkey") * 7 + 3).cast("string")).alias("valid"))


@query(r"SELECT page_id, url AS before, regexp_replace(regexp_replace(regexp_replace(url, '([?&])(utm_[^=&#]*|fbclid|gclid)=[^&#]*', '\1', 'g'), '[?&]+(#|$)', '\1'), '\?&', '?') AS clean FROM pages")
def rd_strip_tracking(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("url").alias("before"), X.strip_tracking(F.col("url")).alias("clean"))


@query(r"""SELECT page_id, regexp_matches(lower(trim(url)), '^https?://') AS is_url, split_part(url, ':', 1) AS scheme FROM pages""")
def src_url_test(spark, d):
    return table(spark, d, "pages").select("page_id", detect.is_url(F.col("url")).alias("is_url"), F.substring_index("url", ":", 1).alias("scheme"))


@query("""SELECT s_suppkey, (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
      OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS private
    FROM (SELECT s_suppkey, list_extract([10, 100, 169, 172, 192, 198, 203, 8], CAST(s_suppkey % 8 + 1 AS INT)) AS a, CAST(s_suppkey * 17 % 256 AS INT) AS b, CAST(s_suppkey % 3 AS INT) AS c FROM supplier)""")
def src_private_address(spark, d):
    k = F.col("s_suppkey")
    a = F.element_at(F.array(*map(F.lit, (10, 100, 169, 172, 192, 198, 203, 8))), (k % 8 + 1).cast("int"))
    ip = F.concat_ws(".", a.cast("string"), (k * 17 % 256).cast("string"), (k % 3).cast("string"), F.lit("9"))
    return table(spark, d, "supplier").select("s_suppkey", X.is_private_ipv4(ip).alias("private"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'html' WHEN doc_id % 5 = 1 THEN 'pdf' WHEN doc_id % 5 = 2 THEN 'image' WHEN doc_id % 5 = 3 THEN 'csv' ELSE 'text' END AS format FROM documents""")
def src_detect_format(spark, d):
    k = F.col("doc_id") % 5
    path = F.concat(F.lit("/in/f"), F.col("doc_id").cast("string"), F.when(k == 3, ".csv").when(k == 0, ".htm").otherwise(""))
    lead = F.when(k == 1, F.lit(b"%PDF-1.7\n")).when(k == 2, F.lit(b"\x89PNG\r\n\x1a\n")).otherwise(F.lit(b"x "))
    content = F.concat(lead, F.encode(T(), "UTF-8"))
    return table(spark, d, "documents").select("doc_id", detect.detect(path, content).alias("format"))


@query("SELECT p_partkey, list_extract(['pdf', 'html', 'csv', 'image', 'media', 'text', NULL], CAST(p_partkey % 7 + 1 AS INT)) AS format FROM part")
def src_mime_format(spark, d):
    types = ("application/PDF; v=1", "text/html;charset=utf-8", "text/csv", "image/png", "audio/mpeg", "text/plain", "application/x-none")
    value = F.element_at(F.array(*map(F.lit, types)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", detect.from_content_type(value).alias("format"))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def src_file_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode(T(), "UTF-8"), 256).alias("sha256"), F.octet_length(T()).cast("long").alias("size"))


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\s+', ' ', 'g')), '') AS title, nullif(regexp_extract(html, '<html\b[^>]*\blang\s*=\s*["'']([^"'']*)', 1, 'is'), '') AS lang FROM pages""")
def rd_html_head_facts(spark, d):
    facts = table(spark, d, "pages").select("page_id", html.head_facts(F.col("html")).alias("f"))
    return facts.select("page_id", F.col("f.title").alias("title"), F.col("f.lang").alias("lang"))


@query(rf"""SELECT doc_id, count(*) AS lines, CAST(sum(CAST(regexp_matches(line, '^([•◦▪‣●○■□·\x{{F0B7}}➢✓]\s*|[-*–—] \s*)\S') AS INT)) AS BIGINT) AS bullets,
    CAST(sum(CAST(regexp_matches(line, '^(\([0-9A-Za-z]{{1,4}}(\)|$)|([0-9]{{1,3}}|[a-z])[.)] )') AS INT)) AS BIGINT) AS enumerated,
    CAST(sum(CAST((strlen(pn) <= 16 AND regexp_matches(pn, '^((of)?[/\s]+)*([0-9]+|[ivxlc]{{1,6}})([/\s]+([0-9]+|of))*[/\s]*$')) AS INT)) AS BIGINT) AS page_numbers,
    CAST(sum(CAST(regexp_matches(trim(line), '^\([0-9A-Za-z.]{{0,6}}\)$') AS INT)) AS BIGINT) AS equations FROM (SELECT doc_id, line, trim(regexp_replace(regexp_replace(lower(trim(line)), '^[-–—\s]+|[-–—\s]+$', '', 'g'), '^page', '')) AS pn FROM {_LINES}) GROUP BY doc_id""")
def flt_line_predicates(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split(T(), "\n")).alias("line"))
    line = F.col("line")
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(P.bullet(line)).alias("bullets"), F.count_if(P.enumerated(line)).alias("enumerated"),
        F.count_if(P.page_number(line)).alias("page_numbers"), F.count_if(P.equation_number(line)).alias("equations"),
    )


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN CAST(l_quantity AS INT) % 3 = 0 THEN 40 WHEN CAST(l_quantity AS INT) % 3 = 1 THEN 20 ELSE 8 END AS INT) AS points,
    CASE WHEN l_quantity * 2 >= 60 THEN 'high' WHEN l_quantity * 2 >= 25 THEN 'medium' ELSE 'low' END AS risk FROM lineitem""")
def fn_severity_and_risk(spark, d):
    q = F.col("l_quantity").cast("int") % 3
    severity = F.when(q == 0, "high").when(q == 1, "medium").otherwise("low")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.severity_score(severity).alias("points"), X.risk_band(F.col("l_quantity") * 2).alias("risk"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) AS BIGINT) AS visible FROM documents")
def flt_visible_characters(spark, d):
    return table(spark, d, "documents").select("doc_id", X.visible_characters(T()).cast("long").alias("visible"))


@query("SELECT p_partkey, 'a b/' || p_brand || '%' AS decoded FROM part")
def fn_percent_decode(spark, d):
    value = F.concat(F.lit("a%20b%2F"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("%23")), F.lit("%25"))
    return table(spark, d, "part").select("p_partkey", X.percent_decode(value).alias("decoded"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '<http://x/a b>' WHEN c_custkey % 3 = 1 THEN '<http://x/(a>' ELSE 'http://x/(a)' END AS link FROM customer""")
def fn_markdown_url(spark, d):
    k = F.col("c_custkey") % 3
    url = F.when(k == 0, "http://x/a b").when(k == 1, "http://x/(a").otherwise("http://x/(a)")
    return table(spark, d, "customer").select("c_custkey", X.markdown_url(url).alias("link"))


@query(r"""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), 'e', '😀') AS t FROM documents),
    n AS (SELECT *, list_max(list_filter(range(0, 41), lambda k: k + len(regexp_extract_all(substring(t, 1, k), '[\x{10000}-\x{10FFFF}]')) <= 40)) AS k FROM d)
    SELECT doc_id, md5(substring(t, 1, k)) AS head, length(t) + len(regexp_extract_all(t, '[\x{10000}-\x{10FFFF}]')) > 40 AS truncated FROM n""")
def fn_truncate_utf16(spark, d):
    text = F.replace(F.coalesce(T(), F.lit("")), F.lit("e"), F.lit("😀"))
    found = table(spark, d, "documents").select("doc_id", X.truncate_utf16(text, 40).alias("r"))
    return found.select("doc_id", F.md5("r.text").alias("head"), "r.truncated")


_BRACKETS = "chr(91 + 2 * CAST(p_partkey % 2 AS INT)) || p_brand || chr(91 + 2 * CAST(p_size % 2 AS INT)) || p_type || chr(91 + 2 * CAST(p_partkey // 2 % 2 AS INT)) || chr(93)"


@query(rf"""WITH p AS (SELECT p_partkey, {_BRACKETS} AS t FROM part), b AS (SELECT *, regexp_replace(t, '[^\[\]]', '', 'g') AS b FROM p)
    SELECT p_partkey, CASE WHEN length(replace(b, '[', '')) * 2 = length(b) AND len(list_filter(range(1, length(b) + 1), lambda k: length(replace(substring(b, 1, k), ']', '')) * 2 < k)) = 0 THEN t
        ELSE replace(replace(t, '[', '\['), ']', '\]') END AS safe FROM b""")
def fn_bracket_safe(spark, d):
    mark = lambda c: F.when(c == 0, "[").otherwise("]")
    text = F.concat(mark(F.col("p_partkey") % 2), F.col("p_brand"), mark(F.col("p_size") % 2), F.col("p_type"), mark(F.expr("p_partkey div 2") % 2), F.lit("]"))
    return table(spark, d, "part").select("p_partkey", X.bracket_safe(text).alias("safe"))


_STEPS = ("..", "a", ".", "", "b", "../..", "c/d")


@query(f"""WITH s AS (SELECT {list(_STEPS)} AS s), p AS (SELECT p_partkey, 'x/y' || CASE WHEN p_size % 2 = 0 THEN '/' ELSE '' END AS folder, CASE WHEN p_size % 9 = 0 THEN '/' ELSE '' END || s[p_partkey % 7 + 1] || '/' || s[p_size % 7 + 1] || '/' || s[p_partkey // 7 % 7 + 1] AS href FROM part, s),
    w AS (SELECT p_partkey, string_split(CASE WHEN starts_with(href, '/') THEN href ELSE folder || '/' || href END, '/') AS w FROM p)
    SELECT p_partkey, ltrim(list_reduce(list_prepend('', w), lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END), '/') AS path FROM w""")
def fn_join_path(spark, d):
    steps = F.array(*[F.lit(x) for x in _STEPS])
    part = lambda c: F.get(steps, (c % 7).cast("int"))
    href = F.concat(F.when(F.col("p_size") % 9 == 0, "/").otherwise(""), part(F.col("p_partkey")), F.lit("/"), part(F.col("p_size")), F.lit("/"), part(F.expr("p_partkey div 7")))
    folder = F.concat(F.lit("x/y"), F.when(F.col("p_size") % 2 == 0, "/").otherwise(""))
    return table(spark, d, "part").select("p_partkey", X.join_path(folder, href).alias("path"))
