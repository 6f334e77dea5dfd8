"""Scoring of extracted items against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("gt", "pass", "hit", "pass_hit", "err", "pass_err", "invalid", "pass_invalid")


def compared(gt: Column, pred: Column, prob: Column, keep: float = 0.8, equal=None, skip_empty: bool = False) -> Column:
    """Struct of booleans: hit, passed, invalid. Empty equals empty unless a comparison is given; a truth
    that ends in &1..&5, && or - is invalid and never hit; numbers are equal as numbers."""
    g, p = F.coalesce(gt, F.lit("")), F.coalesce(pred, F.lit(""))
    invalid = F.rlike(g, F.lit("(?:&[1-5&]|-)$"))
    numeric = F.coalesce(g.try_cast("double") == p.try_cast("double"), F.lit(False))
    same = equal(g, p) if equal else (g == p) | numeric
    passed = pred.isNotNull() & (F.coalesce(prob, F.lit(0.0)) >= keep)
    if skip_empty:
        passed = passed & (p != "")
    return F.struct((same & ~invalid).alias("hit"), passed.alias("passed"), invalid.alias("invalid"))


def counters(rows: DataFrame, keys: list[str] = ("item_name",), total: bool = False, **how) -> DataFrame:
    """Counters of rows (keys, gt, pred, prob); ``total`` adds the row of all items (null keys)."""
    c = rows.select(*keys, compared(F.col("gt"), F.col("pred"), F.col("prob"), **how).alias("c"))
    g = c.rollup(*keys) if total else c.groupBy(*keys)
    n = lambda x: F.sum(x.cast("long"))
    hit, ok, bad = F.col("c.hit"), F.col("c.passed"), F.col("c.invalid")
    return g.agg(
        F.count("*").alias("cnt_gt"), n(ok).alias("cnt_pass"), n(hit).alias("cnt_hit"), n(hit & ok).alias("cnt_pass_hit"), n(~hit).alias("cnt_err"),
        n(~hit & ok).alias("cnt_pass_err"), n(bad).alias("cnt_invalid"), n(bad & ok).alias("cnt_pass_invalid"),
    )


def ratios(c: DataFrame) -> DataFrame:
    """Adds acc, keep, keep_acc, fscore, valid_acc, valid_keep_acc; a ratio without a base is 0."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    col = F.col
    c = c.select("*", div(col("cnt_hit"), col("cnt_gt")).alias("acc"), div(col("cnt_pass"), col("cnt_gt")).alias("keep"), div(col("cnt_pass_hit"), col("cnt_pass")).alias("keep_acc"),
                 div(col("cnt_hit"), col("cnt_gt") - col("cnt_invalid")).alias("valid_acc"), div(col("cnt_pass_hit"), col("cnt_pass") - col("cnt_pass_invalid")).alias("valid_keep_acc"))
    return c.withColumn("fscore", div(2 * col("keep") * col("keep_acc"), col("keep") + col("keep_acc")))


def compare_rows(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Cells (fid, table_name, row_ix, col_name, value) by place: surplus predicted rows do not count."""
    p = pred.select("fid", "table_name", "row_ix", "col_name", F.col("value").alias("pred"), F.col("prob"))
    return gt.withColumnRenamed("value", "gt").join(p, ["fid", "table_name", "row_ix", "col_name"], "left")


def compare_keys(gt: DataFrame, pred: DataFrame, key: str, value: str) -> DataFrame:
    """Rows by a key column; of several predictions for a key the first wins."""
    w = Window.partitionBy("fid", key).orderBy("row_ix")
    p = pred.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("fid", key, F.col(value).alias("pred"), "prob")
    return gt.select("fid", key, F.col(value).alias("gt")).join(p, ["fid", key], "left")


def compare_headless(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Tables ``fid, cells: array<array<string>>`` by place, commas and blanks ignored."""
    long = lambda df, n: df.select("fid", F.posexplode("cells").alias("row_ix", "row")).select("fid", "row_ix", F.posexplode("row").alias("col_ix", n)).withColumn(n, F.translate(n, ", ", ""))
    return long(gt, "gt").join(long(pred, "pred"), ["fid", "row_ix", "col_ix"], "left")


def thresholds(rows: DataFrame, low: float, high: float, step: float, keys: list[str] = ("item_name",), zero_as_one: bool = False) -> DataFrame:
    """Counters at each threshold low, low + step .. high. Rows are counted once for each distinct probability bucket and
    summed from above: the sweep is a window over at most (high - low) / step buckets for each item, not a product."""
    n = round((high - low) / step)
    prob = F.when(F.col("prob") == 0, 1.0).otherwise(F.col("prob")) if zero_as_one else F.col("prob")
    hit = compared(F.col("gt"), F.col("pred"), F.lit(1.0))["hit"]
    b = F.when(F.col("pred").isNull() | prob.isNull() | (prob < low), -1).otherwise(F.least(F.floor(F.round((prob - low) / step, 6)), F.lit(n)))
    per = rows.select(*keys, b.cast("int").alias("b"), hit.alias("hit")).groupBy(*keys, "b").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("h"))
    grid = per.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(-1), F.lit(n))).alias("b"))
    full = grid.join(per, [*keys, "b"], "left").fillna(0, ["n", "h"])
    w = Window.partitionBy(*keys).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    out = full.select(*keys, "b", F.sum("n").over(all_).alias("cnt_gt"), F.sum("n").over(w).alias("cnt_pass"), F.sum("h").over(w).alias("cnt_pass_hit"))
    return out.filter("b >= 0").withColumn("thresh", F.round(low + F.col("b") * step, 6)).drop("b")


def with_keep(t: DataFrame) -> DataFrame:
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = t.withColumn("keep", div(F.col("cnt_pass"), F.col("cnt_gt"))).withColumn("keep_acc", div(F.col("cnt_pass_hit"), F.col("cnt_pass")))
    return t.withColumn("fscore", div(2 * F.col("keep") * F.col("keep_acc"), F.col("keep") + F.col("keep_acc")))


def best_thresholds(t: DataFrame, least_keep: float = 0.6, keys: list[str] = ("item_name",)) -> DataFrame:
    """Of each item the best keep_acc with enough kept, or else the best F; ties to the lower threshold."""
    good = F.col("keep") >= least_keep
    w = Window.partitionBy(*keys).orderBy(F.desc(good.cast("int")), F.desc(F.when(good, F.col("keep_acc")).otherwise(F.col("fscore"))), F.desc("keep"), "thresh")
    return with_keep(t).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def thresholds_for(t: DataFrame, targets: list[float], keys: list[str] = ("item_name",)) -> DataFrame:
    """Of each item and target accuracy the threshold of the best F whose keep_acc is above the target."""
    goal = with_keep(t).select("*", F.explode(F.array(*map(F.lit, targets))).alias("target")).filter("keep_acc > target")
    w = Window.partitionBy(*keys, "target").orderBy(F.desc("fscore"), "thresh")
    return goal.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def wrong_rows(rows: DataFrame) -> DataFrame:
    """Rows that are no hit, with their edits."""
    hit = compared(F.col("gt"), F.col("pred"), F.col("prob"))["hit"]
    return rows.filter(~hit).withColumn("edits", F.coalesce(F.levenshtein("gt", "pred"), F.lit(0)))


def experiment_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Wrong rows (keys, pred) of two experiments: only_a, only_b, same_error or other_error."""
    x = a.select(*keys, F.col("pred").alias("pred_a"), F.lit(1).alias("_a"))
    y = b.select(*keys, F.col("pred").alias("pred_b"), F.lit(1).alias("_b"))
    j = x.join(y, keys, "full")
    kind = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("pred_a").eqNullSafe(F.col("pred_b")), "same_error").otherwise("other_error")
    return j.withColumn("kind", kind).drop("_a", "_b")


def perfect_documents(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fid").agg(F.bool_and(compared(F.col("gt"), F.col("pred"), F.col("prob"))["hit"]).alias("all_hit"))


def field_names(gt: DataFrame, pred: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Distinct item names of both sides without those to ignore, with whether they are tables."""
    n = gt.select("item_name").union(pred.select("item_name")).distinct().filter(~F.col("item_name").isin(list(ignore)))
    return n.withColumn("is_table", F.contains("item_name", F.lit("table")))
