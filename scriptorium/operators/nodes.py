"""The table of text boxes: schema, constructors and the layout derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Box

#: One row a box; ``node_ix`` carries the order in which boxes came and breaks all ties.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("node_ix", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("left", T.DoubleType()), T.StructField("top", T.DoubleType()), T.StructField("right", T.DoubleType()), T.StructField("bottom", T.DoubleType()),
    T.StructField("quad", T.ArrayType(T.IntegerType())), T.StructField("angle", T.DoubleType()),
])


def layout(documents: DataFrame) -> DataFrame:
    """Boxes of the words of ``documents`` (doc_id, text) by whole-number arithmetic: doc_id, r (line),
    k (place in the line), text, left, top, right, bottom, score. The texts are dealt out by
    document once; lines, words and every later window of a document stay in that partition."""
    lines = documents.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("r", "line"))
    words = lines.select("doc_id", "r", F.posexplode(F.split("line", " ")).alias("k", "text"))
    before = Window.partitionBy("doc_id", "r").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    n = words.withColumn("c", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).filter("text <> ''")
    size = F.length("text")
    top = 20 * F.col("r") + (7 * F.col("doc_id") + 3 * F.col("k")) % 5
    return n.select("doc_id", "r", "k", "text", (10 * F.col("c")).cast("long").alias("left"), top.cast("long").alias("top"), (10 * (F.col("c") + size)).cast("long").alias("right"),
                    (top + 12 + size % 4).cast("long").alias("bottom"), (((31 * F.col("doc_id") + 17 * F.col("r") + 7 * F.col("k")) % 100) / 100.0).alias("score"))


def from_points(records: DataFrame) -> DataFrame:
    """Recogniser's records ``doc_id, items: array<struct<points, content, probabilities>>`` as boxes;
    the points are four corners, clockwise from the left top."""
    x = records.select("doc_id", F.posexplode("items").alias("node_ix", "i"))
    quad = F.flatten(F.transform("i.points", lambda p: F.array(p["x"], p["y"])))
    b = Box.from_quad(F.col("quad"))
    x = x.select("doc_id", F.lit(0).alias("page"), "node_ix", F.col("i.content").alias("text"), F.lit(0).alias("label"), F.col("i.probabilities").alias("scores"), quad.alias("quad"))
    return x.select("*", *[c.cast("double").alias(n) for c, n in zip((b.left, b.top, b.right, b.bottom), ("left", "top", "right", "bottom"), strict=True)], F.lit(0.0).alias("angle"))


def from_rows(records: DataFrame) -> DataFrame:
    """Positional rows ``doc_id, rows: array<struct<text,left,top,right,bottom,label,scores>>`` as boxes; right
    and bottom get the usual one-pixel correction."""
    x = records.select("doc_id", F.posexplode("rows").alias("node_ix", "i"))
    return x.select("doc_id", F.lit(0).alias("page"), "node_ix", F.col("i.text").alias("text"), F.col("i.label").alias("label"), F.col("i.scores").alias("scores"),
                    F.col("i.left").cast("double").alias("left"), F.col("i.top").cast("double").alias("top"), (F.col("i.right") + 1).cast("double").alias("right"), (F.col("i.bottom") + 1).cast("double").alias("bottom"),
                    F.lit(None).cast("array<int>").alias("quad"), F.lit(0.0).alias("angle"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Adds ``node_ix`` in reading order of the derived layout."""
    return nodes.withColumn("node_ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("r", "k")) - 1)
