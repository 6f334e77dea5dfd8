"""Document routing: explicit names, codes, rules and character TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reduce import top_one


def characters(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, ch, tf``: lower-cased characters with runs of blanks as one."""
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "\\s\\s+", " ")
    per = texts.select(key, F.explode(F.split(clean, "")).alias("ch")).filter("ch <> ''")
    return per.groupBy(key, "ch").agg(F.count("*").alias("tf"))


def tfidf(corpora: DataFrame, texts: DataFrame, key: str, cls: str = "class_name") -> DataFrame:
    """``key, class_name, cosine`` of every text and class: idf = ln((1 + n) / (1 + df)) + 1 over the
    class corpora, vectors of length one; characters that no corpus has are ignored. Texts meet classes on characters only."""
    c = characters(corpora, cls)
    n = corpora.select(cls).distinct().agg(F.count("*").alias("n"))
    idf = c.groupBy("ch").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("ch", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row

    def unit(v: DataFrame, k: str, name: str) -> DataFrame:
        v = v.join(idf, "ch").select(k, "ch", (F.col("tf") * F.col("idf")).alias("w"))
        norm = v.groupBy(k).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return v.join(norm, k).select(k, "ch", (F.col("w") / F.col("norm")).alias(name))

    j = unit(characters(texts, key), key, "a").join(unit(c, cls, "b"), "ch")
    return j.groupBy(key, cls).agg(F.sum(F.col("a") * F.col("b")).alias("cosine"))


def route_tfidf(corpora: DataFrame, texts: DataFrame, key: str, cls: str = "class_name") -> DataFrame:
    return top_one(tfidf(corpora, texts, key, cls), [key], F.desc(F.round("cosine", 9)), cls)


def route(docs: DataFrame, codes: DataFrame, scored: DataFrame) -> DataFrame:
    """``doc_id, class_name``: the document's own class, else that of its primary and secondary code
    (the first candidate), else the one of ``scored`` (doc_id, class_name)."""
    c = codes.select(F.col("primary_class").alias("_p"), F.col("secondary_class").alias("_s"), F.col("class_name").alias("_c"))
    c = c.groupBy("_p", "_s").agg(F.min("_c").alias("_c"))
    j = docs.join(c, (F.col("primary_class") == F.col("_p")) & F.col("secondary_class").eqNullSafe(F.col("_s")), "left")
    j = j.join(scored.select(F.col("doc_id").alias("_d"), F.col("class_name").alias("_t")), F.col("doc_id") == F.col("_d"), "left")
    return j.select("doc_id", F.coalesce("class_name", "_c", "_t").alias("class_name"))


def duplicated_classes(codes: DataFrame) -> DataFrame:
    """Class names that the taxonomy holds more than once."""
    return codes.groupBy("class_name").agg(F.count("*").alias("n")).filter("n > 1")


def guess_by_characters(names: DataFrame, priors: DataFrame, key: str, given: str) -> DataFrame:
    """Naive Bayes over the characters of a given name; ``priors`` has ch, p_male, p_female (frequencies)."""
    ch = names.select(key, F.explode(F.split(given, "")).alias("ch")).filter("ch <> ''").join(priors, "ch")
    s = ch.groupBy(key).agg(F.sum(F.log("p_male")).alias("m"), F.sum(F.log("p_female")).alias("f"))
    p = F.exp(F.col("m")) / (F.exp(F.col("m")) + F.exp(F.col("f")))
    return s.select(key, F.when(p >= 0.5, "male").otherwise("female").alias("gender"), F.greatest(p, 1 - p).alias("confidence"))


def stroke_difference(pairs: DataFrame, strokes: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Absolute difference of two texts' stroke totals; ``strokes`` has ch, n."""
    long = pairs.select(key, F.explode(F.concat(F.transform(F.split(a, ""), lambda c: F.struct(c.alias("ch"), F.lit(1).alias("s"))), F.transform(F.split(b, ""), lambda c: F.struct(c.alias("ch"), F.lit(-1).alias("s"))))).alias("x"))
    return long.select(key, "x.ch", "x.s").join(strokes, "ch", "left").groupBy(key).agg(F.abs(F.sum(F.coalesce("n", F.lit(0)) * F.col("s"))).alias("difference"))


def rank_within(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
