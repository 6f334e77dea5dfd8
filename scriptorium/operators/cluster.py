"""Lines, columns, segments and paragraphs of boxes.

Lines and columns look sequential (each box joins the first line whose last member is
near) but only the newest line can accept a box, so they are gaps and islands
over one window per document; segments merge intervals by a running maximum.
Only folds that compare with a group's first member, or admit several groups,
run as grouped pandas functions, on one document's boxes at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, bounding
from .packed import memberships

DOC = ["doc_id"]


def _islands(nodes: DataFrame, keys: list[str], at: Column, tie: list[str], gap: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("_at", *tie)
    n = nodes.withColumn("_at", at).withColumn("_gap", gap)
    n = n.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(w) >= F.col("_gap")).cast("int"), F.lit(0)))
    return n.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_at", "_gap", "_new")


def row_lines(nodes: DataFrame, thresh: float = 0.15, keys: list[str] = DOC, tie: tuple[str, ...] = ("node_ix",), name: str = "line") -> DataFrame:
    """Adds ``line``: boxes in order of cy start a line where they are ``thresh`` mean heights or more below the one before."""
    height = F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy(*keys))
    return _islands(nodes, keys, (F.col("top") + F.col("bottom")) / 2, list(tie), height * thresh, name)


def col_lines(nodes: DataFrame, thresh: float = 1.0, keys: list[str] = DOC, tie: tuple[str, ...] = ("node_ix",), name: str = "column") -> DataFrame:
    """Adds ``column``, by cx."""
    height = F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy(*keys))
    return _islands(nodes, keys, (F.col("left") + F.col("right")) / 2, list(tie), height * thresh, name)


def x_segments(nodes: DataFrame, thresh: float = 1.0, keys: list[str] | None = None, tie: tuple[str, ...] = ("node_ix",), name: str = "segment") -> DataFrame:
    """Adds ``segment``: within a line, boxes whose gap to all before is below ``thresh`` mean heights."""
    keys = keys or [*DOC, "line"]
    height = F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy("left", *tie)
    n = nodes.withColumn("_h", height).withColumn("_r", F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    n = n.withColumn("_new", F.coalesce((F.col("left") - F.col("_r") >= F.col("_h") * thresh).cast("int"), F.lit(0)))
    return n.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_h", "_r", "_new")


def joined(nodes: DataFrame, keys: list[str], order: list[str], char: str = "", text: str = "text", scores: str | None = None) -> DataFrame:
    """Each group as one box: joined text, bounding box, mean height, scores in order."""
    row = F.struct(*order, F.col(text).alias("_t"), *([F.col(scores).alias("_s")] if scores else []))
    arr = F.array_sort(F.collect_list(row))
    out = nodes.groupBy(*keys).agg(arr.alias("_a"), *bounding(), F.avg(F.col("bottom") - F.col("top")).alias("mean_height"), F.count("*").alias("n"))
    cols = [F.array_join(F.transform("_a", lambda x: x["_t"]), char).alias("text")]
    if scores:
        cols.append(F.flatten(F.transform("_a", lambda x: x["_s"])).alias("scores"))
    return out.select(*keys, *cols, "left", "top", "right", "bottom", "mean_height", "n")


# folds that are sequential by nature, a document at a time
def anchored_rows(nodes: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Adds ``line``: a box joins the newest line if its cy is within ``fraction`` of both heights of the line's FIRST box."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "node_ix"], kind="stable")
        lines, anchor, k = [], None, -1
        for r in pdf.itertuples():
            cy, h = (r.top + r.bottom) / 2, r.bottom - r.top
            if anchor is None or abs(cy - anchor[0]) >= fraction * min(h, anchor[1]):
                anchor, k = (cy, h), k + 1
            lines.append(k)
        return pdf.assign(line=lines)

    return nodes.groupBy(*DOC).applyInPandas(run, f"{_ddl(nodes)}, line int")


def blocks(rows: DataFrame, offset: float) -> DataFrame:
    """Adds ``block``: rows (doc_id, line, left, ..) whose left differs by ``offset`` or more from the block's first row open the next."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, first, k = pdf.sort_values("line", kind="stable"), [], None, -1
        for left in pdf["left"]:
            if first is None or abs(left - first) >= offset:
                first, k = left, k + 1
            out.append(k)
        return pdf.assign(block=out)

    return rows.groupBy(*DOC).applyInPandas(run, f"{_ddl(rows)}, block int")


def running_mean_columns(nodes: DataFrame, units: float = 2.0) -> DataFrame:
    """Adds ``column``: boxes by left; a column ends where left is more than ``units`` character widths beyond the running mean."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["left", "node_ix"], kind="stable")
        chars = ((pdf["right"] - pdf["left"]) / pdf["text"].str.len().clip(lower=1)).mean()
        out, total, n, k = [], 0.0, 0, 0
        for left in pdf["left"]:
            if n and left - total / n > units * chars:
                total, n, k = 0.0, 0, k + 1
            total, n = total + left, n + 1
            out.append(k)
        return pdf.assign(column=out)

    return nodes.groupBy(*DOC).applyInPandas(run, f"{_ddl(nodes)}, column int")


def running_mean_rows(nodes: DataFrame, offset: float = 0.5) -> DataFrame:
    """Adds ``line``: a box joins the row whose running mean top and bottom it meets within ``offset`` of its height."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows, out = pdf.sort_values(["top", "node_ix"], kind="stable"), [], []
        for r in pdf.itertuples():
            h = r.bottom - r.top
            for k, (t, b, n) in enumerate(rows):
                if abs(t / n - r.top) <= offset * h and abs(b / n - r.bottom) <= offset * h:
                    rows[k] = (t + r.top, b + r.bottom, n + 1)
                    out.append(k)
                    break
            else:
                rows.append((r.top, r.bottom, 1))
                out.append(len(rows) - 1)
        return pdf.assign(line=out)

    return nodes.groupBy(*DOC).applyInPandas(run, f"{_ddl(nodes)}, line int")


def paragraphs(nodes: DataFrame) -> DataFrame:
    """Bridge ``doc_id, paragraph, node_ix``: boxes top down enter every open paragraph with which they are
    left aligned or overlap by a tenth in x; a paragraph closes at a gap of a mean height. A box may be in several."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "left", "node_ix"], kind="stable")
        at, groups = [], []
        memberships(*(pdf[c].tolist() for c in ("left", "top", "right", "bottom")), at, groups)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at], "paragraph": groups, "node_ix": pdf["node_ix"].iloc[at]})

    kinds = dict(nodes.dtypes)
    nodes = nodes.select("doc_id", "node_ix", "left", "top", "right", "bottom")
    return nodes.groupBy(*DOC).applyInPandas(run, f"doc_id {kinds['doc_id']}, paragraph int, node_ix {kinds['node_ix']}")


def tilted_lines(nodes: DataFrame, angle: float, ratio: float | None = None) -> DataFrame:
    """Adds ``line`` for text at ``angle`` degrees: cy is corrected by the slope, then lines are islands; with
    ``ratio`` the gap is that share of the mean of line gaps between their 15th and 85th percentile."""
    import math

    slope = math.tan(math.radians(angle))
    flat = nodes.withColumn("_y", (F.col("top") + F.col("bottom")) / 2 - F.lit(slope) * F.col("left"))
    height = F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy(*DOC))
    gap = height * 0.5
    if ratio is not None:
        w = Window.partitionBy(*DOC).orderBy("_y", "node_ix")
        step = F.col("_y") - F.lag("_y").over(w)
        flat = flat.withColumn("_step", F.when(step > height * 0.3, step))
        lo, hi = (F.percentile("_step", F.lit(p)).over(Window.partitionBy(*DOC)) for p in (0.15, 0.85))
        flat = flat.withColumn("_trim", F.when(F.col("_step").between(lo, hi), F.col("_step")))
        gap = F.coalesce(F.avg("_trim").over(Window.partitionBy(*DOC)) / ratio, height * 0.5)
    out = _islands(flat, DOC, F.col("_y"), ["node_ix"], gap, "line")
    return out.drop("_y", "_step", "_trim")


def merge_touching(lines: DataFrame) -> DataFrame:
    """Adds ``merged`` to lines (doc_id, line, top, bottom): lines that overlap by half or more of the smaller are one, chained."""
    w = Window.partitionBy(*DOC).orderBy("line")
    over = F.lag("bottom").over(w) - F.col("top")
    small = F.least(F.col("bottom") - F.col("top"), F.lag("bottom").over(w) - F.lag("top").over(w))
    x = lines.withColumn("_new", F.coalesce((over < small * 0.5).cast("int"), F.lit(0)))
    return x.withColumn("merged", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def is_sequence(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys, ordered``: whether values never fall."""
    w = Window.partitionBy(*keys).orderBy(order)
    return values.withColumn("_ok", F.coalesce(F.col(value) >= F.lag(value).over(w), F.lit(True))).groupBy(*keys).agg(F.bool_and("_ok").alias("ordered"))


def row_stats(cells: DataFrame) -> DataFrame:
    """Adds row_rank, row_nodes, row_columns to cells (doc_id, line, column)."""
    w = Window.partitionBy("doc_id", "line")
    return cells.select("*", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("line")).alias("row_rank"), F.count("*").over(w).alias("row_nodes"), F.size(F.collect_set("column").over(w)).cast("long").alias("row_columns"))


def assign_key_rows(lines: DataFrame) -> DataFrame:
    """As-of: each line (doc_id, line, top, bottom, is_key) gets the latest key line at or above it; a line
    that overlaps the next key line by half (y IoU) goes to that one; lines above the first are dropped."""
    w = Window.partitionBy("doc_id").orderBy("line")
    key = F.struct("line", "top", "bottom")
    n = lines.withColumn("_at", F.last(F.when(F.col("is_key"), F.col("line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = n.withColumn("_next", F.first(F.when(F.col("is_key"), key), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    own, nxt = Box(F.lit(0), F.col("top"), F.lit(1), F.col("bottom")), Box(F.lit(0), F.col("_next.top"), F.lit(1), F.col("_next.bottom"))
    pulled = ~F.col("is_key") & F.col("_next").isNotNull() & F.coalesce(own.y_iou(nxt) > 0.5, F.lit(False))
    return n.withColumn("key_line", F.when(pulled, F.col("_next.line")).otherwise(F.col("_at"))).filter(F.col("key_line").isNotNull()).drop("_at", "_next")


def cut_at_stop(lines: DataFrame, stop: Column) -> DataFrame:
    """Lines above the first that is a stop line: it and all below go."""
    first = F.min(F.when(stop, F.col("line"))).over(Window.partitionBy("doc_id"))
    return lines.withColumn("_stop", first).filter(F.col("_stop").isNull() | (F.col("line") < F.col("_stop"))).drop("_stop")


def cut_tail(lines: DataFrame, times: float = 5.0) -> DataFrame:
    """Lines of each document's last record (doc_id, key_line, line, top, bottom) end at a gap over ``times`` mean heights."""
    d, w = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "key_line").orderBy("line")
    gap = F.col("top") - F.lag("bottom").over(w) > times * F.avg(F.col("bottom") - F.col("top")).over(Window.partitionBy("doc_id", "key_line"))
    n = lines.withColumn("_last", F.col("key_line") == F.max("key_line").over(d)).withColumn("_gap", F.coalesce(gap, F.lit(False)))
    n = n.withColumn("_cut", F.max("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return n.filter(~(F.col("_last") & F.col("_cut"))).drop("_last", "_gap", "_cut")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
