"""Tables drawn as lattices of typed corner points: edges, missing points, cells, grid places.

Corner types are numbered row by row: 0 left-top, 1 top, 2 right-top, 3 left, 4 cross, 5 right,
6 left-bottom, 7 bottom, 8 right-bottom. A type says whether an edge leaves to the right or down."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RIGHT, LEFT, DOWN, UP = (0, 1, 3, 4, 6, 7), (1, 2, 4, 5, 7, 8), (0, 1, 2, 3, 4, 5), (3, 4, 5, 6, 7, 8)


def dedup_points(points: DataFrame, threshold: float) -> DataFrame:
    """Points (doc_id, label, x, y): of those within ``threshold`` in x and y the one with most edges (a cross before a side before a corner) stays."""
    rank = {4: 0, 1: 1, 3: 1, 5: 1, 7: 1}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_r=pdf["label"].map(lambda k: rank.get(k, 2))).sort_values(["_r", "y", "x"], kind="stable")
        kept: list = []
        grid: dict = {}
        for r in pdf.itertuples():
            cell = (int(r.x // threshold), int(r.y // threshold))
            near = (p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in grid.get((cell[0] + i, cell[1] + j), ()))
            if not any(abs(p[0] - r.x) <= threshold and abs(p[1] - r.y) <= threshold for p in near):
                grid.setdefault(cell, []).append((r.x, r.y))
                kept.append((r.doc_id, r.label, r.x, r.y))
        return pd.DataFrame(kept, columns=["doc_id", "label", "x", "y"])

    return points.groupBy("doc_id").applyInPandas(run, f"doc_id {dict(points.dtypes)['doc_id']}, label int, x double, y double")


def edges(points: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, ax, ay, bx, by, kind``: each point's nearest neighbour to the right on its line, and below in its column, where both types have that edge."""
    a = points.select("doc_id", *[F.col(c).alias("a" + c) for c in ("label", "x", "y")])
    b = points.select(F.col("doc_id").alias("_d"), *[F.col(c).alias("b" + c) for c in ("label", "x", "y")])
    right = (F.col("bx") > F.col("ax") + threshold) & (F.abs(F.col("ay") - F.col("by")) <= threshold) & F.col("alabel").isin(*RIGHT) & F.col("blabel").isin(*LEFT)
    down = (F.col("by") > F.col("ay") + threshold) & (F.abs(F.col("ax") - F.col("bx")) <= threshold) & F.col("alabel").isin(*DOWN) & F.col("blabel").isin(*UP)
    out = None
    for kind, cond, order in (("right", right, "bx"), ("down", down, "by")):
        j = a.join(b, (F.col("doc_id") == F.col("_d")) & cond)
        w = Window.partitionBy("doc_id", "ax", "ay").orderBy(order, "bx", "by")
        j = j.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("doc_id", "ax", "ay", "bx", "by", F.lit(kind).alias("kind"))
        out = j if out is None else out.unionByName(j)
    return out


def add_lost_points(points: DataFrame, threshold: float, rounds: int = 5) -> DataFrame:
    """Points with crosses added where a row and a column of points meet without one, up to ``rounds`` times or until nothing is added."""
    def lines(vals: list[float]) -> list[float]:
        out: list[list[float]] = []
        for v in sorted(vals):
            if out and v - out[-1][-1] <= threshold:
                out[-1].append(v)
            else:
                out.append([v])
        return [sum(g) / len(g) for g in out]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = list(pdf[["label", "x", "y"]].itertuples(index=False, name=None))
        for _ in range(rounds):
            xs, ys = lines([p[1] for p in pts]), lines([p[2] for p in pts])
            spot = lambda v, axis: min(range(len(axis)), key=lambda i: abs(axis[i] - v))
            have = {(spot(x, xs), spot(y, ys)) for _, x, y in pts}
            new = []
            for i in range(len(xs)):
                for j in range(len(ys)):
                    around = ((i - 1, j) in have) + ((i + 1, j) in have) + ((i, j - 1) in have) + ((i, j + 1) in have)
                    if (i, j) not in have and around >= 3:
                        new.append((4, xs[i], ys[j]))
            if not new:
                break
            pts += new
        return pd.DataFrame([(pdf["doc_id"].iloc[0], *p) for p in pts], columns=["doc_id", "label", "x", "y"])

    return points.groupBy("doc_id").applyInPandas(run, f"doc_id {dict(points.dtypes)['doc_id']}, label int, x double, y double")


def cells(edge_table: DataFrame) -> DataFrame:
    """``doc_id, left, top, right, bottom`` of cells: a right and a down edge from one point; the fourth corner may be missing."""
    r = edge_table.filter("kind = 'right'").select("doc_id", "ax", "ay", F.col("bx").alias("rx"), F.col("by").alias("ry"))
    d = edge_table.filter("kind = 'down'").select("doc_id", "ax", "ay", F.col("bx").alias("dx"), F.col("by").alias("dy"))
    return r.join(d, ["doc_id", "ax", "ay"]).select("doc_id", F.col("ax").alias("left"), F.col("ay").alias("top"), F.col("rx").alias("right"), F.col("dy").alias("bottom"))


def grid(cell_table: DataFrame, threshold: float) -> DataFrame:
    """Adds ``row`` and ``col``: ordinals of the cells' tops and lefts, those within ``threshold`` of the one before alike."""
    def ordinal(df: DataFrame, by: str, name: str) -> DataFrame:
        w = Window.partitionBy("doc_id").orderBy(by, "left", "top")
        df = df.withColumn("_new", F.coalesce((F.col(by) - F.lag(by).over(w) > threshold).cast("int"), F.lit(0)))
        return df.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    return ordinal(ordinal(cell_table, "top", "row"), "left", "col")


def crossings(segments: DataFrame) -> DataFrame:
    """Where a document's level and upright segments (doc_id, x1, y1, x2, y2) cross: doc_id, x, y."""
    flat = segments.filter(F.abs(F.col("y2") - F.col("y1")) <= F.abs(F.col("x2") - F.col("x1"))).select("doc_id", *[F.col(c).alias("h" + c) for c in ("x1", "y1", "x2", "y2")])
    up = segments.filter(F.abs(F.col("y2") - F.col("y1")) > F.abs(F.col("x2") - F.col("x1"))).select(F.col("doc_id").alias("_d"), *[F.col(c).alias("v" + c) for c in ("x1", "y1", "x2", "y2")])
    from ..functions.geometry import line_contains, line_cross

    h1, h2, v1, v2 = ((F.col(p + "x" + k), F.col(p + "y" + k)) for p, k in (("h", "1"), ("h", "2"), ("v", "1"), ("v", "2")))
    j = flat.join(up, F.col("doc_id") == F.col("_d")).withColumn("p", line_cross(h1, h2, v1, v2)).filter("p is not null")
    ok = line_contains(h1, h2, F.col("p.x"), (h1[1] + h2[1]) / 2) & line_contains(v1, v2, (v1[0] + v2[0]) / 2, F.col("p.y"))
    return j.filter(ok).select("doc_id", "p.x", "p.y").distinct()


def point_scores(gt: DataFrame, pred: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, precision, recall, f1`` of points by greedy one-to-one matching, nearest first."""
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        doc = (a if len(a) else b)["doc_id"].iloc[0]
        pairs = sorted((((r.x - s.x) ** 2 + (r.y - s.y) ** 2) ** 0.5, i, j) for i, r in enumerate(a.itertuples()) for j, s in enumerate(b.itertuples()) if r.label == s.label)
        us, vs = set(), set()
        for dist, i, j in pairs:
            if dist <= threshold and i not in us and j not in vs:
                us.add(i)
                vs.add(j)
        p, r = len(us) / max(1, len(b)), len(us) / max(1, len(a))
        return pd.DataFrame([(doc, p, r, 2 * p * r / (p + r) if p + r else 0.0)], columns=["doc_id", "precision", "recall", "f1"])

    return gt.groupBy("doc_id").cogroup(pred.groupBy("doc_id")).applyInPandas(run, f"doc_id {dict(gt.dtypes)['doc_id']}, precision double, recall double, f1 double")
