"""Readers of recogniser output, ground truth and dictionaries. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import half_width

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
ITEM = T.StructType([T.StructField("points", T.ArrayType(POINT)), T.StructField("content", T.StringType()), T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
RECOGNISED = T.StructType([T.StructField("items", T.ArrayType(ITEM))])
SUBJECTS = T.StructType([T.StructField("subjects", T.ArrayType(T.StructType([T.StructField("recognition", T.StructType([T.StructField("texts", T.ArrayType(ITEM))]))]))), T.StructField("rotation", T.DoubleType()), T.StructField("scale", T.DoubleType()), T.StructField("roi", T.ArrayType(T.IntegerType()))])
REQUEST = T.StructType([T.StructField("request_method", T.StringType()), T.StructField("primary_class", T.StringType()), T.StructField("secondary_class", T.StringType()), T.StructField("class_name", T.StringType()), T.StructField("pages", T.ArrayType(RECOGNISED)), T.StructField("items", T.ArrayType(ITEM))])


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+?)(?:\\.[^./]*)?$", 1)


def documents_json(spark: SparkSession, path: str, schema: T.StructType = SUBJECTS, glob: str = "*.json") -> DataFrame:
    """One row a file: ``doc_id`` (the file's stem) and its content."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(path)
    return df.select(_stem(F.col("_metadata.file_path")).alias("doc_id"), "*")


def subjects(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser files as records ``doc_id, items`` with roi, scale and rotation; missing texts are an empty list."""
    d = documents_json(spark, path)
    items = F.flatten(F.transform(F.coalesce("subjects", F.array()), lambda s: F.coalesce(s["recognition"]["texts"], F.array())))
    return d.select("doc_id", items.alias("items"), "roi", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.coalesce("rotation", F.lit(0.0)).alias("rotation"))


def requests(df: DataFrame, column: str = "value") -> DataFrame:
    """Logged requests (JSON text) of one page, rotated or several pages: ``doc_id, page, items`` and class codes."""
    r = df.select("doc_id", F.from_json(column, REQUEST).alias("r"))
    pages = F.when(F.col("r.request_method") == "ProcessMultiImage", F.transform("r.pages", lambda p: p["items"])).otherwise(F.array("r.items"))
    return r.select("doc_id", "r.class_name", "r.primary_class", "r.secondary_class", F.posexplode(pages).alias("page", "items"))


def predictions(df: DataFrame, column: str = "value") -> DataFrame:
    """``fid, item_name, value, prob`` of prediction texts in three layouts: subjects with structuring_data, rawImage, or plain."""
    any_ = "map<string,struct<content:string,probability:double,scores:array<double>>>"
    x = df.select("fid", F.coalesce(F.get_json_object(column, "$.subjects[0].structuring_data[0]"), F.get_json_object(column, "$.rawImage.structuring_data[0]"), F.get_json_object(column, "$.structuring_data[0]"), F.col(column)).alias("j"))
    x = x.select("fid", F.explode(F.map_entries(F.from_json("j", any_))).alias("e")).select("fid", F.col("e.key").alias("item_name"), "e.value.*")
    mean = F.aggregate("scores", F.lit(0.0), lambda s, y: s + y) / F.nullif(F.size("scores"), F.lit(0))
    return x.select("fid", "item_name", F.col("content").alias("value"), F.coalesce("probability", mean, F.lit(0.0)).alias("prob"))


def truths(df: DataFrame, column: str = "value") -> DataFrame:
    """``fid, item_name, gt`` of ground-truth texts."""
    x = df.select("fid", F.explode(F.map_entries(F.from_json(F.coalesce(F.get_json_object(column, "$.structuring_data[0]"), F.col(column)), "map<string,struct<content:string>>"))).alias("e"))
    return x.select("fid", F.col("e.key").alias("item_name"), F.col("e.value.content").alias("gt"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Words of a file, one a line, trimmed and in half width: word."""
    return spark.read.text(path).select(half_width(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def corpora(spark: SparkSession, path: str) -> DataFrame:
    """Class corpora, one file a class, blanks removed: class_name, text."""
    t = spark.read.option("wholetext", True).text(path)
    return t.select(_stem(F.col("_metadata.file_path")).alias("class_name"), F.regexp_replace("value", "\\s", "").alias("text"))


def detections(df: DataFrame, column: str = "value") -> DataFrame:
    """Side-channel boxes of a document: doc_id, label, l, t, r, b; anything malformed is no box."""
    x = df.select("doc_id", F.explode(F.coalesce(F.from_json(F.get_json_object(column, "$.table_detectron.labeled_bboxes"), "array<struct<label:string,bbox:array<double>>>"), F.array())).alias("x"))
    return x.select("doc_id", "x.label", *[F.col("x.bbox")[i].alias(c) for i, c in enumerate("ltrb")])
