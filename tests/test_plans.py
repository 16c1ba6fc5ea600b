"""Plans: what reaches the scan, what is shuffled, what stays out of Python."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__  # noqa: F401 - registers the queries
from sparkfolio import session
from sparkfolio.operators import findings
from sparkfolio.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["elements_of_lines", "semantic_roles", "search_literal_counts", "fn_token_estimate", "redact_strict"])
def test_native_and_pruned(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize("name", ["elements_of_lines", "search_literal_counts", "redact_strict", "fn_yaml_scalar", "html_to_markdown"])
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["join_caption_links", "win_gutters", "score_bag_f1", "set_merge_tables", "media_scenes"])
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_filters_reach_the_scan(spark):
    links = findings.link_signals(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id"])
    assert "PushedFilters: [IsNotNull(url)]" in plan(links) and "ReadSchema: struct<page_id:bigint,url:string>" in plan(links)


def test_partitions_grow_with_the_files(spark, tmp_path):
    spark.range(400_000).selectExpr("id div 4 AS l_orderkey", "CAST(id % 50 AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        text = plan(QUERIES["win_cluster_positions"](spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = [int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\)", text)]
    assert len(parts) == 1 and parts[0] >= 32


def test_partitions_grow_with_the_rows(spark, tmp_path, monkeypatch):
    spark.range(3_000).selectExpr("id div 3 AS conv_id", "id % 3 AS turn", "repeat('a b ', 50) AS text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(session, "CHARS_A_TASK", 10_000)
    text = plan(QUERIES["score_bag_f1"](spark, str(tmp_path)))
    assert re.findall(r"hashpartitioning\(conv_id#\d+L, turn#\d+L, (\d+)\)", text) == ["60", "60"]  # one file, 600,000 characters
    assert session.shares(spark.range(0)) >= 1
