"""Tables: header, columns, rows, records. Assignment is joins and windows; the fit of cells
to rows, sequential by nature, runs one document's cells at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from .joins import assign_columns, header_intervals, nearest_header
from .reduce import top_one


def header_cells(nodes: DataFrame, headers: dict[str, Column]) -> DataFrame:
    """Header boxes with ``header_type``: each type's first match; where a type has many, the one nearest to the types that have one."""
    tagged = nodes.select("*", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in headers.items()]))).alias("header_type"))
    n = tagged.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "header_type")))
    sure = n.filter("_n = 1").groupBy("doc_id").agg(F.avg((F.col("top") + F.col("bottom")) / 2).alias("_cy"))
    j = n.join(sure, "doc_id", "left")
    return top_one(j, ["doc_id", "header_type"], F.abs((F.col("top") + F.col("bottom")) / 2 - F.coalesce("_cy", F.col("top"))), "node_ix").drop("_n", "_cy")


def fill_headers(cells: DataFrame, order: DataFrame) -> DataFrame:
    """Header cells for every type of ``order`` (header_type, ord): a missing one is put beside its nearest
    neighbour, as wide as that one."""
    from .matching import broadcast_rules

    grid = cells.select("doc_id").distinct().join(broadcast_rules(order), F.lit(True)).join(cells, ["doc_id", "header_type"], "left")
    w = Window.partitionBy("doc_id").orderBy("ord")
    box = F.when(F.col("left").isNotNull(), F.struct("left", "top", "right", "bottom", "ord"))
    before = F.last(box, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(box, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    g = grid.withColumn("_b", before).withColumn("_a", after)
    step = lambda p, k: (F.col(f"{p}.right") - F.col(f"{p}.left")) * k
    gap_b, gap_a = F.col("ord") - F.col("_b.ord"), F.col("_a.ord") - F.col("ord")
    side = lambda c: F.coalesce(F.col(c), F.when(F.col("_b").isNotNull(), F.col(f"_b.{c}") + step("_b", gap_b)).otherwise(F.col(f"_a.{c}") - step("_a", gap_a)))
    level = lambda c: F.coalesce(F.col(c), F.col(f"_b.{c}"), F.col(f"_a.{c}"))
    return g.select("doc_id", "header_type", "ord", F.col("left").isNull().alias("virtual"), side("left").alias("left"), level("top").alias("top"), side("right").alias("right"), level("bottom").alias("bottom"))


def below_headers(nodes: DataFrame, headers: DataFrame) -> DataFrame:
    """Boxes under the header line; the line may be tilted: its slope is the median of neighbouring header cells' slopes."""
    w = Window.partitionBy("doc_id").orderBy("left")
    cy = (F.col("top") + F.col("bottom")) / 2
    h = headers.withColumn("_s", (cy - F.lag(cy).over(w)) / F.nullif(F.col("left") - F.lag("left").over(w), F.lit(0)))
    line = h.groupBy("doc_id").agg(F.coalesce(F.median("_s"), F.lit(0.0)).alias("_k"), F.min("left").alias("_x"), F.min_by("bottom", "left").alias("_y"))
    j = nodes.join(line, "doc_id")
    return j.filter(cy > F.col("_y") + F.col("_k") * (F.col("left") - F.col("_x"))).drop("_k", "_x", "_y")


def footer_cut(nodes: DataFrame, footers: Column) -> DataFrame:
    """Boxes above the first footer of their document; all if it has none."""
    first = F.min(F.when(footers, (F.col("top") + F.col("bottom")) / 2)).over(Window.partitionBy("doc_id"))
    return nodes.withColumn("_f", first).filter(F.col("_f").isNull() | ((F.col("top") + F.col("bottom")) / 2 < F.col("_f"))).drop("_f")


def columns_by_interval(nodes: DataFrame, headers: DataFrame) -> DataFrame:
    return assign_columns(nodes, header_intervals(headers))


def columns_by_nearest(nodes: DataFrame, headers: DataFrame, max_x: float | None = None) -> DataFrame:
    return nearest_header(nodes, headers, max_x)


def align_rows(cells: DataFrame) -> DataFrame:
    """Adds ``row`` to cells (doc_id, column, node_ix, top, bottom): columns side by side, a cell joins the first
    row whose centre it holds or that holds its centre; rows may lack cells."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows, out = pdf.sort_values(["top", "column", "node_ix"], kind="stable"), [], []
        for r in pdf.itertuples():
            cy, hit = (r.top + r.bottom) / 2, None
            for k in range(len(rows) - 1, -1, -1):
                top, bottom, used = rows[k]
                if r.column not in used and (top <= cy <= bottom or r.top <= (top + bottom) / 2 <= r.bottom):
                    hit = k
                    break
                if bottom < r.top - 4 * (r.bottom - r.top):
                    break
            if hit is None:
                rows.append((r.top, r.bottom, {r.column}))
                hit = len(rows) - 1
            else:
                rows[hit][2].add(r.column)
            out.append(hit)
        return pdf.assign(row=out)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return cells.groupBy("doc_id").applyInPandas(run, f"{ddl}, row int")


def row_gaps(rows: DataFrame, least: float, most: float) -> DataFrame:
    """Rows (doc_id, row, top, bottom) whose gap to the row kept before is within [least, most] of its height; the first stays.
    Whether a row is kept depends on which before it was: a fold over the document's rows as an array."""
    acc = F.struct(F.lit(None).cast("struct<row:int,top:double,bottom:double>").alias("last"), F.expr("cast(array() as array<int>)").alias("kept"))
    arr = F.array_sort(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"))))

    def step(s: Column, x: Column) -> Column:
        gap, h = x["top"] - s["last"]["bottom"], s["last"]["bottom"] - s["last"]["top"]
        ok = s["last"].isNull() | gap.between(least * h, most * h)
        return F.struct(F.when(ok, x).otherwise(s["last"]).alias("last"), F.when(ok, F.concat(s["kept"], F.array(x["row"]))).otherwise(s["kept"]).alias("kept"))

    kept = rows.groupBy("doc_id").agg(arr.alias("a")).select("doc_id", F.explode(F.aggregate("a", acc, step, lambda s: s["kept"])).alias("row"))
    return rows.join(kept, ["doc_id", "row"], "left_semi")


def max_empty(rows: DataFrame, most: int) -> DataFrame:
    """Rows (cells: array) with at most ``most`` null cells."""
    return rows.filter(F.size(F.filter("cells", lambda c: c.isNull())) <= most)


def too_high(rows: DataFrame) -> DataFrame:
    """Rows no more than twice as high as the one before."""
    h, w = F.col("bottom") - F.col("top"), Window.partitionBy("doc_id").orderBy("row")
    return rows.withColumn("_p", F.lag(h).over(w)).filter(F.col("_p").isNull() | (h <= 2 * F.col("_p"))).drop("_p")


def records(cells: DataFrame, char: str = "_") -> DataFrame:
    """One row a record: ``doc_id, key_line, fields`` (map of column to text, lines in order)."""
    per = cells.groupBy("doc_id", "key_line", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "left", "text"))), lambda x: x["text"]), char).alias("text"))
    return per.groupBy("doc_id", "key_line").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "text")))).alias("fields"))


def fetch_other(records_: DataFrame, column: str, other: str, pattern: str) -> DataFrame:
    """Adds ``value``: the own column's text, or else what ``pattern`` finds in another column."""
    found = F.nullif(F.regexp_extract(F.col("fields")[other], pattern, 0), F.lit(""))
    return records_.withColumn("value", F.coalesce(F.nullif(F.col("fields")[column], F.lit("")), found))


def key_rows(lines: DataFrame, rules: list[tuple[str, str]], unexpected: list[list[str]] = ()) -> DataFrame:
    """Lines (doc_id, line, column, text) that every rule (column, pattern) which finds any line finds, less those
    where all patterns of an unexpected set occur."""
    hits = None
    for k, (column, pattern) in enumerate(rules):
        h = lines.filter((F.col("column") == column) & F.rlike("text", F.lit(pattern))).select("doc_id", "line", F.lit(k).alias("rule"))
        hits = h if hits is None else hits.unionByName(h)
    live = hits.groupBy("doc_id").agg(F.count_distinct("rule").alias("need"))
    good = hits.groupBy("doc_id", "line").agg(F.count_distinct("rule").alias("n")).join(live, "doc_id").filter("n = need").select("doc_id", "line")
    for pats in unexpected:
        seen = lines.groupBy("doc_id", "line").agg(*[F.bool_or(F.rlike("text", F.lit(p))).alias(f"_{i}") for i, p in enumerate(pats)])
        bad = seen.filter(" and ".join(f"_{i}" for i in range(len(pats)))).select("doc_id", "line")
        good = good.join(bad, ["doc_id", "line"], "left_anti")
    return good


def one_to_one(keys: DataFrame, values: DataFrame, most: float) -> DataFrame:
    """Greedy pairs of a key and a value on its line, nearest first, each used once: doc_id, key_ix, value_ix."""
    from .joins import spatial_join

    p = spatial_join(keys, values, lambda a, b: a.same_line(b, 0.5) & (b.left >= a.left) & (b.left - a.right <= most))
    p = p.select(F.col("a_doc_id").alias("doc_id"), F.col("a_node_ix").alias("key_ix"), F.col("b_node_ix").alias("value_ix"), F.abs(Box.of("a_").cy - Box.of("b_").cy).alias("d"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ks, vs, out = set(), set(), []
        for r in pdf.sort_values(["d", "key_ix", "value_ix"], kind="stable").itertuples():
            if r.key_ix not in ks and r.value_ix not in vs:
                ks.add(r.key_ix)
                vs.add(r.value_ix)
                out.append((r.doc_id, r.key_ix, r.value_ix))
        return pd.DataFrame(out, columns=["doc_id", "key_ix", "value_ix"])

    k = dict(p.dtypes)
    return p.groupBy("doc_id").applyInPandas(run, f"doc_id {k['doc_id']}, key_ix {k['key_ix']}, value_ix {k['value_ix']}")


def charges(rows: DataFrame) -> DataFrame:
    """Charges of rows (doc_id, line, texts): a name with one amount is a summary charge, with more a detail charge
    (unit the second largest, total the largest); a quantity stands in where there is no amount."""
    from ..functions.text import charge_type

    kinds = F.transform("texts", lambda t: F.struct(charge_type(t).alias("k"), t.alias("t")))
    x = rows.select("doc_id", "line", kinds.alias("x"))
    of = lambda k: F.transform(F.filter("x", lambda y: y["k"] == k), lambda y: y["t"])
    num = lambda arr: F.array_sort(F.transform(arr, lambda t: F.regexp_extract(t, "[0-9]+(?:\\.[0-9]+)?", 0).try_cast("double")))
    x = x.select("doc_id", "line", F.try_element_at(of("NAME"), F.lit(1)).alias("name"), num(of("AMOUNT")).alias("a"), num(of("QUANTITY")).alias("q"))
    v = F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("q"))
    return x.filter(F.col("name").isNotNull() & (F.size(v) > 0)).select("doc_id", "line", "name", F.when(F.size(v) > 1, "detail").otherwise("summary").alias("kind"), F.when(F.size(v) > 1, F.try_element_at(v, F.lit(-2))).alias("unit_price"), F.element_at(v, -1).alias("total_price"))
