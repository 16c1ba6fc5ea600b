"""Structured projections, recognised text and revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.operators import outline, recognised, revisions, twin, units
from sparkfolio.plans.document_queries import _ELEMENTS
from sparkfolio.plans.layout_queries import _BOX, _boxes
from sparkfolio.plans.registry import query, table


@query(f"WITH {_ELEMENTS} SELECT doc_id, page, count(*) AS lines, CAST(sum(len(regexp_extract_all(content, '[^\\s\\x{{A0}}]+'))) AS BIGINT) AS words, CAST(sum(length(content)) AS BIGINT) AS chars FROM el GROUP BY 1, 2")
def agg_text_layer(spark, d):
    return twin.text_layer(units.elements(table(spark, d, "documents")), ["doc_id", "page"]).select("doc_id", "page", "lines", "words", "chars")


@query()
def join_element_chunks(spark, d):
    found = units.elements(table(spark, d, "documents")).withColumn("role", units.semantic_hint(F.col("content"))["role"])
    return twin.element_chunks(found, outline.citation_chunks(found)).select("doc_id", "element_id", F.size("chunk_ids").alias("chunks"))


@query("""WITH u AS (SELECT l_orderkey, 'text' AS type, 0 AS k, l_linenumber AS position FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_orderkey, 'image', 1, l_linenumber FROM lineitem WHERE l_returnflag = 'A'
      UNION ALL SELECT l_orderkey, 'table', 2, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
    SELECT l_orderkey, type, position, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY k, position) AS INT) AS n FROM u""")
def join_cogroup_elements(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("position"), F.col("l_linestatus").alias("content"))
    part = lambda f: rows.filter(F.col("l_returnflag") == f)
    return twin.cogroup_elements(part("N"), part("R"), part("A"), ["l_orderkey"]).select("l_orderkey", "type", "position", "n")


@query("""WITH h AS (SELECT o_custkey, o_orderkey AS n, 1 + o_orderkey * 7 // 3 % 4 AS level FROM orders)
    SELECT a.o_custkey, a.n, a.level, max(b.n) AS parent FROM h a LEFT JOIN h b ON a.o_custkey = b.o_custkey AND b.n < a.n AND b.level < a.level GROUP BY 1, 2, 3""")
def join_heading_parent(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("n"), (1 + F.floor(F.col("o_orderkey") * 7 / 3) % 4).alias("level"))
    # the nearest earlier heading of a lower level is the latest of the nearest of each lower level
    return twin.section_parents(rows, ["o_custkey"], "n").select("o_custkey", "n", "level", "parent")


@query("""WITH n AS (SELECT l_orderkey, ['r', 's' || (l_linenumber % 2), 'n' || l_linenumber] AS path, l_linenumber AS page FROM lineitem), x AS (SELECT l_orderkey, unnest(path) AS ancestor, page FROM n)
    SELECT l_orderkey, ancestor, count(*) AS nodes, min(page) AS page_start, max(page) AS page_end FROM x GROUP BY 1, 2""")
def agg_tree_rollup(spark, d):
    k = F.col("l_linenumber")
    path = F.array(F.lit("r"), F.concat(F.lit("s"), (k % 2).cast("string")), F.concat(F.lit("n"), k.cast("string")))
    rows = table(spark, d, "lineitem").select("l_orderkey", path.alias("path"), k.alias("page"))
    return twin.rollup_nodes(rows, ["l_orderkey"]).drop("deepest")


@query("""SELECT o_orderkey, coalesce(a.n, 0) AS elements, coalesce(b.n, 0) AS findings FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_orderkey = o_orderkey""")
def join_page_map(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return twin.page_map(table(spark, d, "orders"), {"elements": lines, "findings": lines.filter("l_returnflag = 'R'")}, ["o_orderkey"])


@query("SELECT l_suppkey, CASE WHEN l_returnflag = 'N' THEN 'visual_region' ELSE l_returnflag END AS kind, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_visual_kinds(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("target_element_type"))
    return twin.kind_counts(rows, ["l_suppkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def join_unmatched_enrichments(spark, d):
    known = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return twin.unmatched_enrichments(table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, ["o_orderkey"])


@query(f"""SELECT c.l_orderkey, c.id FROM {_BOX.format(0)} c WHERE NOT EXISTS (SELECT 1 FROM {_BOX.format(1)} t WHERE t.l_orderkey = c.l_orderkey AND (
      (greatest(0.0, least(c.r, t.r) - greatest(c.l, t.l)) / 120 >= 0.12 AND greatest(0.0, t.b - c.t, c.b - t.t) <= 112) OR (greatest(0.0, least(c.t, t.t) - greatest(c.b, t.b)) / 20 >= 0.32 AND greatest(0.0, t.l - c.r, c.l - t.r) <= 112)))""")
def join_captions_without_target(spark, d):
    side = lambda want: _boxes(spark, d, 2, want, "id").withColumn("kind", F.lit("table"))
    return twin.captions_without_target(side(0), side(1), ["l_orderkey"]).select("l_orderkey", "id")


@query("SELECT l_suppkey, bool_or(l_returnflag = 'R') AS has_r, bool_or(l_tax > 0.07) AS has_tax FROM lineitem GROUP BY 1")
def agg_signal_presence(spark, d):
    return twin.signal_presence(table(spark, d, "lineitem"), ["l_suppkey"], {"has_r": F.col("l_returnflag") == "R", "has_tax": F.col("l_tax") > 0.07})


@query("""WITH a AS (SELECT l_suppkey, l_partkey % 9 AS v, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2), b AS (SELECT l_suppkey, l_partkey % 9 AS v, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2)
    SELECT l_suppkey, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS matched, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS expected, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS extracted FROM a FULL JOIN b USING (l_suppkey, v) GROUP BY 1""")
def set_multiset_overlap(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 9).alias("v"), "l_linenumber")
    return twin.multiset_overlap(rows.filter("l_linenumber % 2 = 0"), rows.filter("l_linenumber % 2 = 1"), ["l_suppkey"], "v")


@query("""SELECT avg(CAST(ok AS DOUBLE)) AS answer, avg(CAST(ok AND c > 0 AS DOUBLE)) AS answer_and_page FROM (SELECT p_size % 3 = 0 AS ok, CAST(p_size % 4 IN (1, 2) AS INT) AS c FROM part)""")
def score_navigation(spark, d):
    k = F.col("p_size")
    rows = table(spark, d, "part").select(
        F.array(F.lit("The  Answer"), F.lit("x")).alias("answers"), F.when(k % 3 == 0, "the answer").otherwise("no").alias("answer"), F.array(F.lit(1), F.lit(2)).alias("evidence_pages"), F.array((k % 4).cast("int")).alias("pages")
    )
    return twin.navigation_score(rows).select("answer", "answer_and_page")


@query("""SELECT c_custkey, CAST(c_custkey % 90 + 5 AS DOUBLE) AS "left", 'w' || c_custkey AS text, (c_custkey % 100) / 100.0 AS confidence FROM customer WHERE c_custkey % 3 <> 0""")
def ext_recogniser_words(spark, d):
    k = F.col("c_custkey")
    row = F.concat_ws("\t", F.when(k % 3 == 0, "4").otherwise("5"), *map(F.lit, "11111"), (k % 90 + 5).cast("string"), F.lit("7"), F.lit("20"), F.lit("9"), (k % 100).cast("string"), F.concat(F.lit("w"), k.cast("string")))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("level\tpage\n"), row, F.lit("\n5\tshort")).alias("tsv"))
    return recognised.parse_tsv(rows, ["c_custkey"]).select("c_custkey", "left", "text", "confidence")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '(^|\n)[ \t]+', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS tidy FROM documents""")
def ext_tidy_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(recognised.tidy(F.col("text"))).alias("tidy"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber AS n, l_quantity * 2 AS top, l_linenumber * 10.0 AS x FROM lineitem), s AS (SELECT *, coalesce(CAST(top - lag(top) OVER o > 5 AS INT), 0) AS nw FROM w WINDOW o AS (PARTITION BY l_orderkey ORDER BY top, x, n))
    SELECT l_orderkey, n, CAST(sum(nw) OVER (PARTITION BY l_orderkey ORDER BY top, x, n) AS BIGINT) AS row FROM s""")
def ext_table_rows(spark, d):
    words = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), (F.col("l_quantity") * 2).alias("top"), (F.col("l_linenumber") * 10.0).alias("left"))
    return recognised.table_rows(words, ["l_orderkey"]).select("l_orderkey", "n", "row")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND conv_id % 2 = 0 THEN 'recognised' ELSE 'native' END AS layer FROM conversations""")
def ext_fuse_pages(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.lit("short")).otherwise(F.repeat(F.lit("long enough "), 9)).alias("text"))
    other = turns.filter("conv_id % 2 = 0").withColumn("text", F.lit("recognised"))
    return recognised.fuse(turns, other, ["conv_id", "turn"]).select("conv_id", "turn", "layer")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'plain' ELSE p_name END AS text, CASE WHEN p_size % 2 = 1 THEN p_size / 100.0 END AS confidence FROM part""")
def ext_normalize_answers(spark, d):
    answer = F.when(F.col("p_size") % 2 == 0, F.lit("plain")).otherwise(F.to_json(F.struct(F.col("p_name").alias("text"), (F.col("p_size") / 100).alias("confidence"))))
    rows = table(spark, d, "part").select("p_partkey", recognised.normalize_output(answer).alias("r"))
    return rows.select("p_partkey", "r.text", "r.confidence")


@query("""WITH c AS (SELECT conv_id, turn, role, CAST(turn * 2 AS INT) AS a, CAST(turn * 2 + 1 AS INT) AS z, max(turn * 2 + 1) OVER (PARTITION BY conv_id) >= 3600 AS long FROM conversations),
    l AS (SELECT conv_id, turn, '[' || CASE WHEN long THEN printf('%02d:', a // 3600) ELSE '' END || printf('%02d:%02d', CASE WHEN long THEN a // 60 % 60 ELSE a // 60 END, a % 60)
      || ' --> ' || CASE WHEN long THEN printf('%02d:', z // 3600) ELSE '' END || printf('%02d:%02d', CASE WHEN long THEN z // 60 % 60 ELSE z // 60 END, z % 60) || '] ' || role AS line FROM c)
    SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS transcript FROM l GROUP BY 1""")
def ext_render_transcript(spark, d):
    cues = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 2000).alias("start_ms"), (F.col("turn") * 2000 + 1000).alias("end_ms"), F.col("role").alias("text"))
    return recognised.render_transcript(cues, ["conv_id"])


@query("""SELECT p_partkey, 'a ' || p_brand || ' new z' AS accepted, 'a old z' AS rejected FROM part""")
def rd_resolve_revisions(spark, d):
    text = F.concat(F.lit("{>>note<<}a {++"), F.col("p_brand"), F.lit(" ++}{~~old~>new~~} {==z==}{--gone--}"))
    rejected = F.concat(F.lit("{>>note<<}a {++"), F.col("p_brand"), F.lit(" ++}{~~old~>new~~} {==z==}"))
    return table(spark, d, "part").select("p_partkey", revisions.accept(text).alias("accepted"), revisions.reject(rejected).alias("rejected"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' (2024-01-02): hi' WHEN c_custkey % 3 = 1 THEN c_name || ': hi' ELSE 'hi' END AS note FROM customer")
def rd_comment_note(spark, d):
    k = F.col("c_custkey") % 3
    return table(spark, d, "customer").select("c_custkey", revisions.comment(F.when(k < 2, F.col("c_name")), F.when(k == 0, F.lit("2024-01-02")), F.lit("hi")).alias("note"))
