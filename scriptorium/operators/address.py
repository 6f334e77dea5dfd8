"""Addresses against a gazetteer (province, city, county), which is an input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reduce import top_one

PARTS = "^(.*?(?:省|自治区|特别行政区))?(.*?(?:市|自治州|盟))?(.*?(?:区|县|旗))?(.*)$"


def parts(c: Column) -> Column:
    return F.struct(*[F.regexp_extract(c, PARTS, k).alias(n) for k, n in enumerate(("province", "city", "county", "rest"), 1)])


def province_of(addresses: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Fills or repairs the province by an exact city."""
    g = gazetteer.groupBy("city").agg(F.min("province").alias("_p")).withColumnRenamed("city", "_c")
    return addresses.join(g, F.col("city") == F.col("_c"), "left").withColumn("province", F.coalesce("_p", "province")).drop("_p", "_c")


def city_of(addresses: DataFrame, gazetteer: DataFrame, key: str = "id") -> DataFrame:
    """Repairs the city: of the cities that have the county, the one with fewest edits."""
    g = gazetteer.select(F.col("county").alias("_k"), F.col("city").alias("_c"))
    j = addresses.join(g, F.col("county") == F.col("_k"), "left").withColumn("_ed", F.levenshtein("city", "_c"))
    return top_one(j, [key], F.asc_nulls_last("_ed"), "_c").withColumn("city", F.coalesce("_c", "city")).drop("_k", "_c", "_ed")


def repaired(addresses: DataFrame, gazetteer: DataFrame, key: str = "id", most: int = 2) -> DataFrame:
    """Adds ``fixed``: names of all levels replaced by the gazetteer's within ``most`` edits, joined. Fuzzy
    lookups are blocked by pieces (see joins.fuzzy_within), never a product with the gazetteer."""
    from .joins import fuzzy_within

    a = addresses.withColumn("_x", parts(F.col("address"))).select("*", "_x.province", "_x.city", "_x.county", "_x.rest").drop("_x")
    for level in ("province", "city", "county"):
        hits = fuzzy_within(a.filter(F.col(level) != ""), gazetteer, most, level, level)
        best = top_one(hits, ["q"], "ed", "word").select(F.col("q").alias("_q"), F.col("word").alias("_w"))
        a = a.join(best, F.col(level) == F.col("_q"), "left").withColumn(level, F.coalesce("_w", level)).drop("_q", "_w")
    a = city_of(province_of(a, gazetteer), gazetteer, key)
    return a.withColumn("fixed", F.concat("province", "city", "county", "rest"))
