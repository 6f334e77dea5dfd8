"""Writers of results: nested JSON at the edge, long tables inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_json(items: DataFrame) -> DataFrame:
    """``doc_id, value``: JSON with structuring_data (a list of one map of items) of each document."""
    entry = F.struct("item_name", F.struct("item_name", "show_name", "content", "probability").alias("v"))
    g = items.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return g.select("doc_id", F.to_json(F.struct(F.array("m").alias("structuring_data"), F.expr("array()").cast("array<string>").alias("structuring_meta"))).alias("value"))


def write_results(items: DataFrame, path: str) -> None:
    result_json(items).select("value").write.mode("overwrite").text(path)


def response(items: DataFrame, failed: DataFrame) -> DataFrame:
    """``doc_id, code, message, data``: code 0 with data, 500000 with the message of a document in ``failed`` (doc_id, message)."""
    j = result_json(items).join(failed, "doc_id", "full")
    return j.select("doc_id", F.when(F.col("message").isNull(), 0).otherwise(500000).alias("code"), F.coalesce("message", F.lit("")).alias("message"), F.when(F.col("message").isNull(), F.col("value")).alias("data"))


def prediction_maps(items: DataFrame) -> DataFrame:
    """``doc_id, pred, probability``: two maps by item."""
    g = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_name", "content", "probability"))).alias("a"))
    return g.select("doc_id", F.map_from_entries(F.transform("a", lambda x: F.struct(x["item_name"], x["content"]))).alias("pred"), F.map_from_entries(F.transform("a", lambda x: F.struct(x["item_name"], x["probability"]))).alias("probability"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    metrics.write.mode("overwrite").json(f"{path}/json")


def write_wrong(rows: DataFrame, path: str) -> None:
    """Wrong rows in a folder for each item."""
    rows.write.mode("overwrite").partitionBy("item_name").json(path)


def with_doc_type(pages: DataFrame, kind: str) -> DataFrame:
    return pages.select(F.lit(kind).alias("doc_type"), "*")
