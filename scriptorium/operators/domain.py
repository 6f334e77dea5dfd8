"""Rules across fields: dictionary corrections in cascades, code lookups, imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import fuzzy_best, fuzzy_within, nearest
from .reduce import top_one


def corrected(items: DataFrame, words: DataFrame, steps: list[tuple[int, int]], key: str = "doc_id", value: str = "content") -> DataFrame:
    """Adds ``corrected``: dictionary words tried in steps of (edits, least length), the first step that hits wins;
    without a hit the value stays."""
    out, hits = items, []
    for n, (k, least) in enumerate(steps):
        best = fuzzy_best(items, words, k, least, value).select(F.col("q").alias(f"_q{n}"), F.col("word").alias(f"_w{n}"))
        out = out.join(best, F.col(value) == F.col(f"_q{n}"), "left")
        hits.append(F.col(f"_w{n}"))
    return out.withColumn("corrected", F.coalesce(*hits, F.col(value))).drop(*[f"_{a}{n}" for n in range(len(steps)) for a in "qw"])


def by_code(texts: DataFrame, codes: DataFrame, size: int = 8) -> DataFrame:
    """Name of the first code of ``size`` digits (in the order of ``ord``) that the table (code, name) knows."""
    c = texts.select("doc_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(f"[0-9]{{{size}}}"), F.lit(0))).alias("code"))
    return top_one(c.join(codes, "code"), ["doc_id"], "ord", "code").select("doc_id", "code", "name")


def prefix_corrected(items: DataFrame, prefixes: DataFrame, size: int, value: str = "content") -> DataFrame:
    """A value whose first ``size`` characters are within one edit of a known prefix takes it over."""
    p = items.select(F.substring(value, 1, size).alias("q")).distinct()
    best = top_one(fuzzy_within(p, prefixes, 1), ["q"], "ed", "word").select(F.col("q").alias("_q"), F.col("word").alias("_w"))
    j = items.join(best, F.substring(value, 1, size) == F.col("_q"), "left")
    return j.withColumn(value, F.concat(F.coalesce("_w", F.substring(value, 1, size)), F.substr(value, F.lit(size + 1)))).drop("_q", "_w")


def summary_items(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Names (CJK cells within half their length of a dictionary word) with the next money cell of the row; a money cell
    belongs to the latest name before it."""
    from .reduce import next_money

    n = next_money(cells).filter(F.col("money_ix").isNotNull())
    names = fuzzy_within(n.select(F.col("text").alias("q")).distinct(), words, 2).filter(F.col("ed") * 2 <= F.length("q"))
    best = top_one(names, ["q"], "ed", "word").select(F.col("q").alias("text"), "word")
    return top_one(n.join(best, "text"), ["doc_id", "money_ix"], F.desc("left"), F.desc("node_ix")).select("doc_id", "node_ix", "word", "money_ix")


def nearby_money(nodes: DataFrame, labels: dict[str, str]) -> DataFrame:
    """For each label (item_name: pattern) the nearest money box to its right or below."""
    tagged = nodes.select("*", F.explode(F.array_compact(F.array(*[F.when(F.rlike("text", F.lit(p)), F.lit(i)) for i, p in labels.items()]))).alias("item_name"))
    money = nodes.filter(F.rlike("text", F.lit("^[0-9,]+\\.[0-9]{1,2}$")))
    out = nearest(tagged, money, where=lambda a, b: (b.left >= a.left) & (b.cy >= a.top))
    return top_one(out, ["a_doc_id", "a_item_name"], "distance", "a_node_ix").select(F.col("a_doc_id").alias("doc_id"), F.col("a_item_name").alias("item_name"), F.col("b_text").alias("content"))


def pay_type(self_paid: Column, insured: Column) -> Column:
    zero = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0)) == 0
    return F.when(~zero(insured), "insured").when(~zero(self_paid), "self").otherwise("unknown")


def lines_then_words(items: DataFrame, words: DataFrame, edits: tuple[int, int, int] = (2, 3, 4)) -> DataFrame:
    """Names of several lines (content with line breaks): the joined text within 2, 3 or 4 edits by length, else the best line, else a word the text holds."""
    joined = items.withColumn("_j", F.replace("content", F.lit("\n"), F.lit("")))
    k = F.when(F.length("q") < 8, edits[0]).when(F.length("q") < 15, edits[1]).otherwise(edits[2])
    whole = top_one(fuzzy_within(joined.select(F.col("_j").alias("q")), words, max(edits)).filter(F.col("ed") <= k), ["q"], "ed", "word").select(F.col("q").alias("_j"), F.col("word").alias("_a"))
    lines = joined.select("doc_id", F.posexplode(F.split("content", "\n")).alias("_o", "q"))
    by_line = top_one(lines.join(fuzzy_within(lines, words, edits[0]), "q"), ["doc_id"], "ed", "_o", "word").select("doc_id", F.col("word").alias("_b"))
    return joined.join(whole, "_j", "left").join(by_line, "doc_id", "left").withColumn("content", F.coalesce("_a", "_b", "_j")).drop("_j", "_a", "_b")


def discount_grades(rows: DataFrame) -> DataFrame:
    """Adds ``grade``: the bracketed marker a detail row begins with."""
    return rows.withColumn("grade", F.nullif(F.regexp_extract("text", "^[\\[(（【]([^\\])）】]+)[\\])）】]", 1), F.lit("")))


def receipt_total(charges: DataFrame, totals: DataFrame) -> DataFrame:
    """``doc_id, total, sum, equal``: the declared total against the rounded sum of charges."""
    s = charges.groupBy("doc_id").agg(F.round(F.sum(F.col("amount").cast("double")), 2).alias("sum"))
    return totals.join(s, "doc_id", "left").withColumn("equal", F.round("total", 2) == F.coalesce("sum", F.lit(0.0)))


def without_items(items: DataFrame, names: list[str]) -> DataFrame:
    return items.filter(~F.col("item_name").isin(names))


def stacked_headers(cells: DataFrame) -> DataFrame:
    """Header cells that stand on one another become one: doc_id, header_type, text, box (cells: doc_id, header_type, node_ix, text, box)."""
    w = Window.partitionBy("doc_id", "header_type").orderBy("top", "node_ix")
    far = F.coalesce(F.col("top") - F.lag("bottom").over(w) > (F.col("bottom") - F.col("top")), F.lit(False)) | F.coalesce(F.col("left") > F.lag("right").over(w), F.lit(False))
    g = cells.withColumn("_g", far.cast("int"))
    g = g.withColumn("_g", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("doc_id", "header_type", "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "node_ix", "text"))), lambda x: x["text"]), "").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom")).drop("_g")


def header_groups(groups: DataFrame) -> DataFrame:
    """The best header of a document (doc_id, n, nodes, cut, width, angle, group): most headers, most boxes, fewest cut; then the widest and the least tilted."""
    return top_one(groups.dropDuplicates(["doc_id", "n", "nodes", "cut", "width", "angle"]), ["doc_id"], F.desc(F.col("n") * 1e4 + F.col("nodes") * 1e2 - F.col("cut")), F.desc("width"), F.abs("angle"))


def collinear(angles: Column, most: float = 2.0) -> Column:
    """Whether angles (array, degrees) differ by at most ``most`` from their mean on average."""
    mean = F.aggregate(angles, F.lit(0.0), lambda s, x: s + x) / F.size(angles)
    return F.aggregate(F.transform(angles, lambda x: F.abs(x - mean)), F.lit(0.0), lambda s, x: s + x) / F.size(angles) <= most
