"""Reductions: groups to boxes, fields to one value, pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box


def top_one(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


FIELD = ["doc_id", "item_name"]


def max_weight(passed: DataFrame, keys: list[str] = FIELD) -> DataFrame:
    """Default reducer: greatest weight, then IoU with the field's area, then order."""
    return top_one(passed, keys, F.desc("w"), F.desc_nulls_last("iou"), "node_ix")


def select_above(passed: DataFrame, keys: list[str] = FIELD) -> DataFrame:
    return top_one(passed, keys, F.col("top") + F.col("bottom"), "node_ix")


def select_below(passed: DataFrame, keys: list[str] = FIELD) -> DataFrame:
    return top_one(passed, keys, F.desc(F.col("top") + F.col("bottom")), "node_ix")


def max_weight_above(passed: DataFrame, keys: list[str] = FIELD) -> DataFrame:
    return top_one(passed, keys, F.desc("w"), F.col("top") + F.col("bottom"), "node_ix")


def max_weight_below(passed: DataFrame, keys: list[str] = FIELD) -> DataFrame:
    return top_one(passed, keys, F.desc("w"), F.desc(F.col("top") + F.col("bottom")), "node_ix")


def max_area(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return top_one(nodes, keys, F.desc(Box.of().area), "node_ix")


def exists_flag(passed: DataFrame, keys: list[str] = FIELD) -> DataFrame:
    return passed.groupBy(*keys).agg(F.lit("1").alias("text"))


def decide_key(keys_found: DataFrame) -> DataFrame:
    """Of several key boxes the one with the fewest edits."""
    return top_one(keys_found, ["doc_id"], "ed", "node_ix")


def final_weight(area_ws: Column, regex_ws: Column, filtered: Column) -> Column:
    return F.when(filtered, 0.0).otherwise(F.array_max(area_ws) * F.array_max(regex_ws))


def best_regex_match(matches: Column) -> Column:
    """Of array<struct<w, text, scores>> the greatest weight, then the greatest mean score (above zero)."""
    mean = lambda m: F.aggregate(m["scores"], F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(m["scores"]), F.lit(1))
    keyed = F.transform(F.filter(matches, lambda m: mean(m) > 0), lambda m: F.struct(m["w"].alias("w"), mean(m).alias("s"), m["text"].alias("text"), m["scores"].alias("scores")))
    return F.array_max(keyed)


def mean_score(nodes: DataFrame, keys: list[str], scores: str = "scores") -> DataFrame:
    """Mean over all character scores of a group (no mean of means), 0 if there is none."""
    total = F.sum(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x))
    n = F.sum(F.size(scores))
    return nodes.groupBy(*keys).agg(F.when(n > 0, total / n).otherwise(0.0).alias("probability"))


def year_mode(nodes: DataFrame, as_of: int) -> DataFrame:
    """The year of the last four before ``as_of`` that most boxes of a document hold; the latest on ties."""
    years = nodes.select("doc_id", F.explode(F.sequence(F.lit(as_of - 3), F.lit(as_of))).alias("year"), "text")
    n = years.groupBy("doc_id", "year").agg(F.sum(F.contains("text", F.col("year").cast("string")).cast("long")).alias("n"))
    return top_one(n.filter("n > 0"), ["doc_id"], F.desc("n"), F.desc("year"))


def merge_pages(items: DataFrame) -> DataFrame:
    """Items of pages (doc_id, page, item_name, content) to documents: names with "table" concatenate in page order, for others the last page wins."""
    arr = F.array_sort(F.collect_list(F.struct("page", "content")))
    g = items.groupBy("doc_id", "item_name").agg(arr.alias("_a"))
    return g.select("doc_id", "item_name", F.when(F.contains("item_name", F.lit("table")), F.array_join(F.transform("_a", lambda x: x["content"]), "\n")).otherwise(F.element_at("_a", -1)["content"]).alias("content"))


def pages_struct(items: DataFrame) -> DataFrame:
    """One row a document: pages, and a map of page to its items."""
    per = items.groupBy("doc_id", "page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item_name", "content")))).alias("items"))
    return per.groupBy("doc_id").agg(F.count("*").alias("pages"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "items")))).alias("per_page"))


def categories(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """First category (by ``ord``) with a rule whose ``must`` texts all occur and none of ``must_not`` does; rules are few (see matching.broadcast_rules)."""
    from .matching import broadcast_rules

    text = nodes.groupBy("doc_id").agg(F.collect_set("text").alias("_t"))
    has = lambda p: F.exists("_t", lambda t: F.contains(t, p))
    hit = text.join(broadcast_rules(rules), F.forall("must", has) & ~F.exists("must_not", has))
    return top_one(hit, ["doc_id"], "ord").select("doc_id", "category")


def larger_nodes(nodes: DataFrame, times: float = 1.0) -> DataFrame:
    """Boxes taller than ``times`` the document's mean height."""
    h = F.col("bottom") - F.col("top")
    return nodes.withColumn("_m", F.avg(h).over(Window.partitionBy("doc_id"))).filter(h > times * F.col("_m")).drop("_m")


def all_same_line(nodes: DataFrame, thresh: float = 0.15) -> DataFrame:
    """``doc_id, same_line``: whether all pairs of a document's boxes are on a line."""
    from .joins import spatial_join

    p = spatial_join(nodes, nodes, lambda a, b: F.col("a_node_ix") <= F.col("b_node_ix"))
    return p.groupBy(F.col("a_doc_id").alias("doc_id")).agg(F.bool_and(Box.of("a_").same_line(Box.of("b_"), thresh)).alias("same_line"))


def filter_areas(nodes: DataFrame, areas: DataFrame) -> DataFrame:
    """Boxes x areas (item_name, area_ord, l, t, r, b, w, ioo): those whose own area is inside by more than the threshold, with ``iou``."""
    from .matching import broadcast_rules

    own, area = Box.of(), Box(F.col("l"), F.col("t"), F.col("r"), F.col("b"))
    j = nodes.join(broadcast_rules(areas), own.ioo(area) > F.col("ioo"))
    return j.withColumn("iou", own.iou(area)).withColumnRenamed("w", "area_w").drop("l", "t", "r", "b", "ioo")


def filter_regex(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``value`` (group 1 of the rule's pattern) and ``regex_w`` for rules (item_name, pattern, w) of the box's field."""
    from .matching import broadcast_rules

    r = broadcast_rules(rules.select(F.col("item_name").alias("_i"), "pattern", F.col("w").alias("regex_w")))
    j = nodes.join(r, (F.col("item_name") == F.col("_i")) & F.expr("text rlike pattern"))
    return j.withColumn("value", F.expr("regexp_extract(text, pattern, 1)")).drop("_i")


def filter_contents(nodes: DataFrame, contents: list[str]) -> DataFrame:
    return nodes.filter(F.exists(F.array(*map(F.lit, contents)), lambda c: F.contains("text", c)))


def extract_fields(nodes: DataFrame, areas: DataFrame, rules: DataFrame) -> DataFrame:
    """Template fields: area filter, regex filter, then for each field the first area by weight that
    yields a value, reduced by weight and IoU. All areas are tried in one pass."""
    passed = filter_regex(filter_areas(nodes, areas), rules).filter("value <> ''")
    passed = passed.withColumn("w", F.col("area_w") * F.col("regex_w"))
    return top_one(passed, FIELD, F.desc("area_w"), "area_ord", F.desc("w"), F.desc_nulls_last("iou"), "node_ix").select(*FIELD, F.col("value").alias("content"), F.col("score").alias("probability") if "score" in nodes.columns else F.lit(None).cast("double").alias("probability"))


def complete_items(items: DataFrame, docs: DataFrame, fields: DataFrame) -> DataFrame:
    """One row for every document and field (item_name, show_name, should_output): a missing value is '' with probability 0; hidden fields go."""
    from .matching import broadcast_rules

    grid = docs.select("doc_id").distinct().join(broadcast_rules(fields.filter("should_output")), F.lit(True))
    return grid.join(items, FIELD, "left").select("doc_id", "item_name", "show_name", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


# registration searches with closed candidate sets
def offset_by_anchor(pairs: DataFrame, most: int) -> DataFrame:
    """Whole-number shift (dx, dy) of a document's pairs (doc_id, ax, ay, bx, by: left centres of
    anchor and match) in [-most, most]^2 with the least mean distance; the first in scan order on ties."""
    grid = pairs.select("*", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("dx")).select("*", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("dy"))
    d = F.sqrt((F.col("bx") + F.col("dx") - F.col("ax")) ** 2 + (F.col("by") + F.col("dy") - F.col("ay")) ** 2)
    cost = grid.groupBy("doc_id", "dx", "dy").agg(F.avg(d).alias("cost"))
    return top_one(cost, ["doc_id"], F.round("cost", 9), "dx", "dy")


def offset_candidates(width: float, height: float) -> list[tuple[float, float, int]]:
    """Offsets (dx, dy, order) of the multi-resolution search: steps -D/2 + i D/10 for D = max/6, then D/5, while D > 1.
    The centre never moves, so all candidates are known beforehand."""
    d, out = max(width, height) / 6, []
    while d > 1:
        out += [(-d / 2 + i * d / 10, -d / 2 + j * d / 10) for i in range(10) for j in range(10)]
        d /= 5
    return [(x, y, k) for k, (x, y) in enumerate(out)]


def offset_by_iou(nodes: DataFrame, anchors: DataFrame, width: float, height: float) -> DataFrame:
    """Best shift of a document's boxes onto anchors (anchor, text, must, left ..): must * 1e4 + hits * 100 + sum of best IoU * similarity
    (equal text: 1). Anchors and candidates are template constants. No candidate: (0, 0)."""
    from .matching import broadcast_rules

    spark = nodes.sparkSession
    cand = offset_candidates(width, height)
    if not cand:
        return nodes.select("doc_id").distinct().select("doc_id", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("score"))
    c = broadcast_rules(spark.createDataFrame(cand, "dx double, dy double, ord int"))
    a = broadcast_rules(anchors.select(*[F.col(x).alias("t_" + x) for x in ("anchor", "text", "must", "left", "top", "right", "bottom")]))
    j = nodes.join(a, F.col("text") == F.col("t_text")).join(c, F.lit(True))
    iou = Box.of().shift(F.col("dx"), F.col("dy")).iou(Box.of("t_"))
    best = j.groupBy("doc_id", "dx", "dy", "ord", "t_anchor").agg(F.max(iou).alias("sim"), F.max("t_must").alias("must"))
    hit = F.col("sim") > 0
    total = best.groupBy("doc_id", "dx", "dy", "ord").agg((F.sum(F.when(hit & F.col("must"), 1e4).otherwise(0.0)) + F.sum(F.when(hit, 100.0).otherwise(0.0)) + F.sum("sim")).alias("score"))
    return top_one(total, ["doc_id"], F.desc(F.round("score", 6)), "ord").select("doc_id", "dx", "dy", "score")


def match_similarity(pairs: DataFrame) -> DataFrame:
    """Mean over anchors of exp(-least distance / 1000) (pairs: doc_id, anchor, distance)."""
    near = pairs.groupBy("doc_id", "anchor").agg(F.min("distance").alias("d"))
    return near.groupBy("doc_id").agg((F.sum(F.exp(-F.col("d") / 1000)) / F.count("*")).alias("similarity"))


def perspective_gate(pairs: DataFrame, width: Column, height: Column) -> DataFrame:
    """``doc_id, ok``: four matches or more in three quadrants or more of the page (pairs: doc_id, x, y)."""
    q = (F.col("x") >= width / 2).cast("int") * 2 + (F.col("y") >= height / 2).cast("int")
    return pairs.groupBy("doc_id").agg(((F.count("*") >= 4) & (F.count_distinct(q) >= 3)).alias("ok"))


def outlier_gate(nodes: DataFrame) -> DataFrame:
    """``doc_id, normal``: at most a fifth of the boxes beyond -20 and none beyond -200."""
    low = F.least("left", "top")
    return nodes.groupBy("doc_id").agg(((F.avg((low < -20).cast("double")) <= 0.2) & (F.min(low) >= -200)).alias("normal"))


def impute_summary(charges: DataFrame, totals: DataFrame) -> DataFrame:
    """Charges (doc_id, name, amount, score): if exactly one has score zero, it becomes the total less the others."""
    w = Window.partitionBy("doc_id")
    zero = F.col("score") == 0
    j = charges.join(totals, "doc_id", "left")
    return j.withColumn("amount", F.when(zero & (F.sum(zero.cast("int")).over(w) == 1), F.round(F.col("total") - F.sum(F.when(~zero, F.col("amount")).otherwise(0.0)).over(w), 2)).otherwise(F.col("amount"))).drop("total")


def zero_far_amounts(charges: DataFrame, most: float) -> DataFrame:
    """Amounts whose gap to their name is twice the document's mean gap or more become zero; gaps of ``most`` do not count."""
    mean = F.avg(F.when(F.col("gap") < most, F.col("gap"))).over(Window.partitionBy("doc_id"))
    return charges.withColumn("amount", F.when(F.col("gap") >= 2 * mean, 0.0).otherwise(F.col("amount")))


def next_money(cells: DataFrame) -> DataFrame:
    """Adds ``money_ix``: the next cell to the right in the row that looks like money."""
    w = Window.partitionBy("doc_id", "line").orderBy("left", "node_ix").rowsBetween(1, Window.unboundedFollowing)
    return cells.withColumn("money_ix", F.first(F.when(F.rlike("text", F.lit("^[0-9,]+\\.[0-9]{1,2}$")), F.col("node_ix")), ignorenulls=True).over(w))
