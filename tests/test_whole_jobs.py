"""Registered queries on rows that a cut of texts, rows or turns would lose."""

import duckdb

import __spark_entry__  # noqa: F401 - registers the queries
from sparkfolio.operators import compare
from sparkfolio.plans.registry import QUERIES, SQL


def saved(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(diagonal + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


TURNS = "conv_id long, turn long, role string, text string"


def test_error_rate_takes_whole_texts(spark, tmp_path):
    texts = ["ab" * 60 + "".join(chr(97 + k * k % 23) for k in range(200)), "x" * 130, "abé", "", None]
    d = saved(spark, tmp_path, "conversations", [(1, k, "user", t) for k, t in enumerate(texts)], TURNS)
    plain = [t for t in texts if t is not None]
    row = QUERIES["score_error_rate"](spark, d).first()
    assert (row["errors"], row["units"]) == (sum(edits(t, t[3:]) for t in plain), sum(map(len, plain)))


def test_error_rate_of_texts_near_and_far(spark):
    far = "".join(chr(97 + k * k % 23) for k in range(300))
    pairs = [("abc", "abd"), ("", "abc"), (far, far[::-1]), (far, far[40:] + "z" * 10), (far, "é" * 300), ("a", None), (far, far[17:])]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    found = {r["k"]: r["errors"] for r in compare.error_rate(rows, ["k"], "a", "b").collect()}
    assert found == {k: None if b is None else edits(a, b) for k, (a, b) in enumerate(pairs)}


def test_subtitle_cues_hold_whole_turns(spark, tmp_path):
    long = "Été & <b>plus</b> --> loin, " * 9 + "1 < 2\r\nfin\n\nNOTE 2"
    rows = [(1, 0, "user", long), (1, 1, "user", "  "), (1, 2, "user", None), (1, 3, "user", "漢字 &amp; &lt;"), (2, 1800, "user", "late"), (3, 0, "user", "")]
    d = saved(spark, tmp_path, "conversations", rows, TURNS)
    found = [tuple(r) for r in QUERIES["media_subtitle_cues"](spark, d).orderBy("conv_id", "n").collect()]
    flat = long.replace("\r\n", " ").replace("\n", " ")
    assert found == [(1, 1, 0, 1500, flat), (1, 2, 6000, 7500, "漢字 &amp; &lt;"), (2, 1, 3_600_000, 3_601_500, "late")]


def test_page_labels_of_all_parts(spark, tmp_path):
    d = saved(spark, tmp_path, "part", [(1, 39), (5, 40), (9, 49), (13, 50), (17, 1994), (2, 50), (3, 53), (4, 50)], "p_partkey long, p_size int")
    found = {r["p_partkey"]: r["label"] for r in QUERIES["fn_page_label_format"](spark, d).collect()}
    assert found == {1: "xxxix", 5: "xl", 9: "xlix", 13: "l", 17: "mcmxciv", 2: "xx", 3: "p-", 4: "50"}


def test_transcript_of_all_turns(spark, tmp_path):
    d = saved(spark, tmp_path, "conversations", [(1, k, "user", "t") for k in range(60)] + [(2, 0, "user", "t"), (2, 1800, "system", "t")], TURNS)
    found = {r["conv_id"]: r["transcript"] for r in QUERIES["ext_render_transcript"](spark, d).collect()}
    assert found[1].split("\n") == [f"[{2 * k // 60:02d}:{2 * k % 60:02d} --> {2 * k // 60:02d}:{2 * k % 60 + 1:02d}] user" for k in range(60)]
    assert found[2] == "[00:00:00 --> 00:00:01] user\n[01:00:00 --> 01:00:01] system"


def test_bag_f1_of_every_turn_and_the_next(spark, tmp_path):
    texts = ["a b b", "b b c", "c", "d"]
    d = saved(spark, tmp_path, "conversations", [(1, k, "user", t) for k, t in enumerate(texts)] + [(2, 0, "user", "a")], TURNS)
    found = [tuple(r) for r in QUERIES["score_bag_f1"](spark, d).orderBy("conv_id", "turn").collect()]
    assert found == [(1, 0, 2, 0.666667), (1, 1, 1, 0.5), (1, 2, 0, 0.0)]


def test_redaction_of_customers_with_long_numbers(spark, tmp_path):
    d = saved(spark, tmp_path, "customer", [(7,), (10_000,), (123_457,), (6_000_000,)], "c_custkey long")
    found = {r["c_custkey"]: r["redacted"] for r in QUERIES["redact_patterns"](spark, d).collect()}
    assert all("id [REDACTED_SSN], password=[REDACTED_SECRET]," in text for text in found.values())
    assert [f"not {k:04d}-{k % 900:03d}-1." in found[k] for k in found] == [True] * 4


def test_bag_f1_of_turns_without_words(spark, tmp_path):
    d = saved(spark, tmp_path, "conversations", [(1, 0, "user", "..."), (1, 1, "user", None), (1, 2, "user", "a")], TURNS)
    frame = QUERIES["score_bag_f1"](spark, d)
    assert sorted(tuple(r) for r in frame.collect()) == [(1, 0, 0, 0.0), (1, 1, 0, 0.0)]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 2 * plan.count("AdaptiveSparkPlan isFinalPlan=true") + 2 * plan.count("== Initial Plan ==")  # words are not shuffled


def test_bag_f1_halfway_between_decimals(spark, tmp_path):
    words = lambda both, n, own: " ".join(["a"] * both + [f"{own}{k}" for k in range(n - both)])
    cases = [(15, 100, 156), (15, 120, 136), (15, 31, 225), (19, 128, 128), (41, 640, 640), (323, 500, 780), (1, 640, 640)]  # 2 * 15 / 256 = 0.1171875
    d = saved(spark, tmp_path, "conversations", [(k, t, "user", words(both, n, "xy"[t])) for k, (both, *pair) in enumerate(cases) for t, n in enumerate(pair)], TURNS)
    found = sorted(tuple(r) for r in QUERIES["score_bag_f1"](spark, d).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{d}/conversations.parquet/*.parquet')")
        assert found == sorted(db.sql(SQL["score_bag_f1"]).fetchall())
    assert found[0] == (0, 0, 15, 0.117188)
