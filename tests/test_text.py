"""Scalars on small exact cases."""

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import predicates as P
from sparkfolio.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text, tokens", [("abcdefghij", 2), ("123456", 2), ("a   b", 3), ("a b", 2), ("!!!", 3), ("", 0)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, X.estimate_tokens(F.col("t")), t=text) == tokens


@pytest.mark.parametrize("text, quoted", [("has: colon", '"has: colon"'), ("- dash", '"- dash"'), ("two\nlines", "two lines"), ('say "x": y', '"say \\"x\\": y"'), ("plain", "plain")])
def test_yaml_scalar(spark, text, quoted):
    assert one(spark, X.yaml_scalar(F.col("t")), t=text) == quoted


def test_lengths_and_ratios(spark):
    assert one(spark, X.utf16_length(F.col("t")), t="a😀") == 3
    assert one(spark, X.round_ratio(F.col("v")), v=0.123456) == 0.12
    assert one(spark, X.round_ratio(F.col("v")), v=0.125) == 0.13


def test_terms(spark):
    assert one(spark, X.terms(F.col("t")), t="Été, le 2e mot_x 漢字!") == ["été", "le", "2e", "mot", "x", "漢", "字"]
    assert one(spark, X.term_set(F.col("t")), t="(b) a, A b's b") == ["a", "b", "b's"]


def test_labels(spark):
    assert [one(spark, X.roman(F.col("n")), n=n) for n in (1, 4, 9, 14, 40, 90, 400, 1994, 3999, 4000)] == ["I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMMCMXCIX", None]
    assert [one(spark, X.alphabetic(F.col("n")), n=n) for n in (1, 26, 27, 53)] == ["a", "z", "aa", "aaa"]
    assert one(spark, X.page_label(F.lit("r"), F.lit(4), F.lit("x-"))) == "x-iv"


def test_clock_and_sizes(spark):
    assert one(spark, X.clock(F.lit(3_723_004), F.lit(True))) == "01:02:03.004"
    assert one(spark, X.clock(F.lit(62_000), F.lit(False))) == "01:02"
    assert one(spark, X.clock(F.lit(360_000_000), F.lit(True))) == "100:00:00"
    assert one(spark, X.clock(F.lit(6_001_500), F.lit(False))) == "100:01.500"
    assert [one(spark, X.human_size(F.col("n")), n=n) for n in (12, 2048, 3 << 20, 5 << 30)] == ["12 B", "2.0 KB", "3.0 MB", "5.0 GB"]
    assert one(spark, X.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01)
    assert one(spark, X.frame_rate(F.lit("1/0"))) is None


def test_luhn(spark):
    assert one(spark, X.luhn(F.lit("4111111111111111"))) is True
    assert one(spark, X.luhn(F.lit("4111111111111112"))) is False
    assert one(spark, X.luhn(F.lit("0" * 16))) is False


@pytest.mark.parametrize(
    "url, clean",
    [
        ("http://a/?utm_source=x&b=1#f", "http://a/?b=1#f"),
        ("http://a/p?fbclid=3", "http://a/p"),
        ("http://a/p?b=1&gclid=2&c=3", "http://a/p?b=1&c=3"),
        ("http://a/p", "http://a/p"),
    ],
)
def test_tracking(spark, url, clean):
    assert one(spark, X.strip_tracking(F.col("u")), u=url) == clean


def test_escapes(spark):
    assert one(spark, X.table_cell(F.lit("a|b\\c\r\nd "))) == "a\\|b\\\\c d"
    assert one(spark, X.html_escape(F.lit("<a b='c'>&\""))) == "&lt;a b=&#39;c&#39;&gt;&amp;&quot;"
    assert one(spark, X.percent_decode(F.lit("a%20b+c"))) == "a b+c"
    assert one(spark, X.percent_decode(F.lit("50%"))) == "50%"
    assert one(spark, X.margin_key(F.lit("Page 12 Of É"))) == "page##ofÉ"
    assert one(spark, X.longest_run(F.lit("a``b```c"), "`")) == 3
    assert one(spark, X.snippet_160(F.lit("ab " * 80))) == ("ab " * 80)[:157] + "..."


def test_predicates(spark):
    yes = lambda c: one(spark, c)
    assert all(yes(P.page_number(F.lit(x))) for x in ("12", "Page 3", "iv", "3 / 10", "- 7 -"))
    assert not any(yes(P.page_number(F.lit(x))) for x in ("12 monkeys", "chapter"))
    assert yes(P.caption_start(F.lit("Figure 3: x"))) and yes(P.caption_start(F.lit("表 2"))) and not yes(P.caption_start(F.lit("Figures are")))
    assert yes(P.bullet(F.lit("• x"))) and yes(P.bullet(F.lit("- x"))) and not yes(P.bullet(F.lit("-x")))
    assert yes(P.enumerated(F.lit("(iv) x"))) and yes(P.enumerated(F.lit("12. x"))) and not yes(P.enumerated(F.lit("1234. x"))) and not yes(P.enumerated(F.lit("A. x")))
    assert yes(P.equation_number(F.lit("(3.1a)"))) and not yes(P.equation_number(F.lit("(see below)")))
    assert yes(P.named_heading(F.lit("References:"))) and not yes(P.named_heading(F.lit("References and more")))
    assert yes(P.numbered_heading_level(F.lit("2.1 Data and Models"))) == 3 and yes(P.numbered_heading_level(F.lit("2.1 data"))) is None
    assert yes(P.size_heading(F.lit(14.0), F.lit(10.0), F.lit("Intro"))) and not yes(P.size_heading(F.lit(11.0), F.lit(10.0), F.lit("Intro")))


def test_private_addresses(spark):
    private = ("10.0.0.1", "127.0.0.1", "172.16.3.4", "192.168.1.1", "100.64.0.1", "169.254.1.1", "224.0.0.1", "198.18.0.1")
    assert all(one(spark, X.is_private_ipv4(F.lit(i))) for i in private)
    assert not any(one(spark, X.is_private_ipv4(F.lit(i))) for i in ("8.8.8.8", "172.32.0.1", "100.128.0.1"))


def test_cuts_brackets_and_paths(spark):
    rows = [("ab😀c", "a[b]c", "x/y", "../z"), ("😀😀", "]a[", "", "/a/./b//c"), ("", "", "x", "../../.."), (None, "[[]", "x", "")]
    frame = spark.createDataFrame(rows, "t string, b string, d string, h string")
    got = frame.select(X.truncate_utf16(F.col("t"), 3).alias("t"), X.bracket_safe(F.col("b")).alias("b"), X.join_path(F.col("d"), F.col("h")).alias("p")).collect()
    assert [(r["t"]["text"], r["t"]["truncated"]) for r in got] == [("ab", True), ("😀", True), ("", False), (None, None)]
    assert [r["b"] for r in got] == ["a[b]c", "\\]a\\[", "", "\\[\\[\\]"] and [r["p"] for r in got] == ["x/z", "a/b/c", "", "x"]
