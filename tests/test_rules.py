"""Filters and rules across fields."""

from pyspark.sql import functions as F

from scriptorium.operators import domain, filters
from tests_boxes import boxes


def ixs(df):
    return sorted(r.node_ix for r in df.collect())


def test_filters(spark):
    n = boxes(spark, [(1, 0, "To_tal:", 0, 0, 40, 10), (1, 1, "9.50", 50, 0, 80, 10), (1, 2, "****", 0, 30, 40, 40), (1, 3, "", 0, 50, 10, 60), (1, 4, "above", 0, -40, 30, -30)])
    assert ixs(filters.find_nodes(n, ["Total"])) == [0] and ixs(filters.find_nodes(n, ["tal", ""], complete=True)) == []
    assert ixs(filters.clear_ignore(n, ["Total"], same_line=True)) == [2, 3, 4] and ixs(filters.clear_ignore(n, ["Total"])) == [1, 2, 3, 4]
    assert ixs(filters.clear_above(n, "Total")) == [0, 1, 2, 3]
    assert ixs(filters.dense(n, F.lit(7.0))) == [0, 4] and ixs(filters.not_asterisks(n)) == [0, 1, 3, 4] and ixs(filters.min_length(n, 4)) == [0, 4]
    assert filters.count_matching(n, "[0-9]").first().n == 1 and filters.has_keywords(n, ["tal"]).first().found
    areas = spark.createDataFrame([(1, 0.0, 0.0, 45.0, 20.0)], "doc_id long, left double, top double, right double, bottom double")
    assert ixs(filters.banned(n, areas)) == [0]
    got = filters.rescue(n.filter("node_ix = 0"), n.withColumn("doc_id", F.col("doc_id") + 1), lambda d: d.filter("node_ix = 1"), ["doc_id"])
    assert {(r.doc_id, r.node_ix) for r in got.collect()} == {(1, 0), (2, 1)}


def test_rules_of_cells(spark):
    c = spark.createDataFrame([(1, 0, "a", "x1"), (1, 0, "b", "y"), (1, 1, "a", "TOTAL"), (1, 1, "b", "9")], "doc_id long, line int, column string, text string")
    assert {(r.line, r.column) for r in filters.drop_by_rules(c, {"a": "x"}, ["total"]).collect()} == {(0, "b")}
    r = spark.createDataFrame([(1, 0, 0, "p"), (1, 2, 2, "q"), (1, 2, 3, "sum"), (1, 2, 4, "r")], "doc_id long, key_line int, line int, text string")
    assert [x.line for x in filters.truncate_last(r, F.col("text") == "sum").orderBy("line").collect()] == [0, 2]


def test_dictionaries(spark):
    words = spark.createDataFrame([("hospital",), ("hospice",), ("clinic one",)], "word string")
    items = spark.createDataFrame([(1, "hospitol"), (2, "zzzzzzzz"), (3, "clinic\none")], "doc_id long, content string")
    got = {r.doc_id: r.corrected for r in domain.corrected(items, words, [(1, 5), (2, 8)]).collect()}
    assert got == {1: "hospital", 2: "zzzzzzzz", 3: "clinic one"}
    assert {r.doc_id: r.content for r in domain.lines_then_words(items, words).collect()}[3] == "clinic one"
    codes = spark.createDataFrame([("12345678", "north")], "code string, name string")
    t = spark.createDataFrame([(1, 0, "x 00000000"), (1, 1, "no 12345678")], "doc_id long, ord int, text string")
    assert domain.by_code(t, codes).first().name == "north"
    pre = spark.createDataFrame([("AB12",)], "word string")
    assert domain.prefix_corrected(spark.createDataFrame([("AB129",), ("A812z",)], "content string"), pre, 4).orderBy("content").collect()[1][0] == "AB12z"


def test_money_nearby(spark):
    n = boxes(spark, [(1, 0, "sum", 0, 0, 30, 10), (1, 1, "9.50", 40, 0, 60, 10), (1, 2, "7.00", 40, 80, 60, 90)])
    assert domain.nearby_money(n, {"total": "sum"}).first().content == "9.50"
    h = boxes(spark, [(1, 0, "unit", 0, 0, 30, 10), (1, 1, "price", 0, 11, 30, 21)]).withColumn("header_type", F.lit("p"))
    assert domain.stacked_headers(h).first().text == "unitprice"
