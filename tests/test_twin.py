"""Structured projections, recognised text and revisions on small fixtures."""

from pyspark.sql import functions as F

from sparkfolio.operators import recognised, revisions, twin


def test_sections(spark):
    rows = spark.createDataFrame([(1, n, lv) for n, lv in enumerate([2, 1, 2, 3, 3, 2, 1, 3])], "d int, n long, level int")
    assert [r["parent"] for r in twin.section_parents(rows, ["d"], "n").orderBy("n").collect()] == [None, None, 1, 2, 2, 1, None, 6]
    items = spark.createDataFrame([([(1, "A"), (2, "B"), (2, "C"), (1, "D")],)], "h array<struct<level:int,title:string>>")
    assert items.select(twin.section_path(F.col("h"))).first()[0] == ["A", "A > B", "A > C", "D"]


def test_words(spark):
    found = spark.createDataFrame([(" a😀  b",)], "t string").select(twin.words_of(F.col("t"))).first()[0]
    assert [tuple(w) for w in found] == [("a😀", 1, 4), ("b", 6, 7)]


def test_bootstrap(spark):
    rows = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("int").alias("e"), F.lit(1).alias("u"))
    rate, low, high = twin.bootstrap_interval(rows, "e", "u", 200).first()
    assert rate == 25 and 18 < low < 25 < high < 32
    assert twin.bootstrap_interval(rows.repartition(7), "e", "u", 200).first() == (rate, low, high)
    assert twin.bootstrap_interval(rows.limit(0), "e", "u", 200).collect() == []


def test_recognised(spark):
    tsv = "level\n5\t1\t1\t1\t1\t1\t10\t20\t30\t8\t91.5\tHello\n5\t1\t1\t1\t1\t1\t60\t20\t30\t8\t-1\tno\n4\t1\t1\t1\t1\t1\t0\t0\t0\t0\t9\tx\n5\t1\t1\t1\t1\t1\t11\t40\t3\t8\t80\tyou\n5\t1\t1\t1\t1\t1\t70\t41\t3\t8\t80\ttoo"
    words = recognised.parse_tsv(spark.createDataFrame([(1, tsv)], "p int, tsv string"), ["p"])
    rows = recognised.table_rows(words, ["p"])
    assert [(r["text"], r["row"]) for r in rows.orderBy("n").collect()] == [("Hello", 0), ("you", 1), ("too", 1)]
    starts = spark.createDataFrame([(1, 10.0), (1, 65.0)], "p int, column_start double")
    assert {(r["row"], r["column"], r["text"]) for r in recognised.grid(rows, ["p"], starts).collect()} == {(0, 0, "Hello"), (1, 0, "you"), (1, 1, "too")}
    tidy = spark.createDataFrame([("\n\n a \n\n\n\n b\r\n",)], "t string").select(recognised.tidy(F.col("t"))).first()[0]
    assert tidy == "a\n\nb"
    answers = spark.createDataFrame([('{"text": "t", "confidence": 87, "rows": [["a", ""], [" "]]}',), ("plain",), ("{bad",)], "r string").select(recognised.normalize_output(F.col("r")).alias("n")).collect()
    assert (answers[0]["n"]["confidence"], answers[0]["n"]["rows"]) == (0.87, [["a", ""]]) and answers[1]["n"]["text"] == "plain" and answers[2]["n"]["text"] is None


def test_revisions(spark):
    frame = spark.createDataFrame([("a {++b\nc++}{--d--} {~~e~>f~~}{>>note<<} {==g==}",)], "t string")
    row = frame.select(revisions.accept(F.col("t")).alias("a"), revisions.reject(F.col("t")).alias("r"), revisions.changes(F.col("t")).alias("c")).first()
    assert row["a"] == "a b\nc f g" and row["r"] == "a d e g" and tuple(row["c"]) == (1, 1, 1, 1, 1)


def test_links(spark):
    elements = spark.createDataFrame([(1, "e1"), (1, "e2")], "doc_id int, element_id string")
    chunks = spark.createDataFrame([(1, "c1", ["e1"]), (1, "c2", ["e1", "e9"])], "doc_id int, chunk_id string, element_ids array<string>")
    assert {r["element_id"]: r["chunk_ids"] for r in twin.element_chunks(elements, chunks).collect()} == {"e1": ["c1", "c2"], "e2": []}
