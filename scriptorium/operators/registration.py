"""Registration of a page to a template: scale, homography and best scale with angle, one document at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.geometry import Box


def resize(nodes: DataFrame, sx, sy) -> DataFrame:
    """Axis-wise rescale to the template's size."""
    b = Box.of().scale_to(sx, sy)
    return nodes.withColumns(dict(zip(("left", "top", "right", "bottom"), (b.left, b.top, b.right, b.bottom), strict=True)))


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Homography of point pairs (n, 2) by the direct linear transform with normalised points."""
    def norm(p):
        c = p.mean(axis=0)
        s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(axis=1)).mean(), 1e-9)
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return (p - c) * s, t

    a, ta = norm(np.asarray(src, float))
    b, tb = norm(np.asarray(dst, float))
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    h = np.linalg.inv(tb) @ h @ ta
    return h / h[2, 2]


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    return q[:, :2] / q[:, 2:]


def rotation_of(h: np.ndarray) -> float:
    """Degrees by which a homography turns the top edge of a normal box."""
    p = project(h, np.array([[100.0, 100.0], [200.0, 100.0]]))
    return float(np.degrees(np.arctan2(p[1, 1] - p[0, 1], p[1, 0] - p[0, 0])))


def ternary_max(lo: float, hi: float, f: Callable[[float], float], eps: float = 1e-5) -> float:
    """Where a unimodal function is greatest."""
    while hi - lo > eps:
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        if f(a) < f(b):
            lo = a
        else:
            hi = b
    return (lo + hi) / 2


def scale_and_angle(src: np.ndarray, dst: np.ndarray, pivot: int, angles=(-3.0, 3.0), scales=(0.5, 2.0)) -> tuple[float, float, float]:
    """Scale and angle about the pivot pair that bring ``src`` nearest to ``dst`` (mean of exp(-d / 1000)), by nested
    ternary search, with the score."""
    d, e = src - src[pivot], dst - dst[pivot]

    def score(s: float, a: float) -> float:
        r = np.radians(a)
        q = s * d @ np.array([[np.cos(r), np.sin(r)], [-np.sin(r), np.cos(r)]])
        return float(np.exp(-np.sqrt(((q - e) ** 2).sum(axis=1)) / 1000).mean())

    def inner(s: float) -> float:
        return ternary_max(*angles, lambda a: score(s, a), 0.1)

    best = ternary_max(*scales, lambda s: score(s, inner(s)), 0.01)
    return best, inner(best), score(best, inner(best))


def registered(nodes: DataFrame, pairs: DataFrame, perspective: bool = True) -> DataFrame:
    """Boxes in template coordinates. ``pairs`` (doc_id, sx, sy, dx, dy) are matched centres: a homography with four or
    more pairs, else the best scale and angle over at most five pivots, else unchanged."""
    cols = ["left", "top", "right", "bottom"]
    kinds = nodes.schema
    ddl = ", ".join(f"`{f.name}` {'double' if f.name in cols else f.dataType.simpleString()}" for f in kinds)

    def run(n: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        n = n.astype(dict.fromkeys(cols, float))
        src, dst = p[["sx", "sy"]].to_numpy(float), p[["dx", "dy"]].to_numpy(float)
        if not len(n) or not len(p):
            return n
        if perspective and len(p) >= 4:
            h = homography(src, dst)
            corners = [project(h, n[[x, y]].to_numpy(float)) for x, y in (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"))]
            xs, ys = np.stack([c[:, 0] for c in corners]), np.stack([c[:, 1] for c in corners])
            return n.assign(left=xs.min(0), top=ys.min(0), right=xs.max(0), bottom=ys.max(0))
        if len(p) < 2:
            dx, dy = dst[0] - src[0]
            return n.assign(left=n["left"] + dx, right=n["right"] + dx, top=n["top"] + dy, bottom=n["bottom"] + dy)
        s, a, _, k = max(((*scale_and_angle(src, dst, k), k) for k in range(min(5, len(p)))), key=lambda x: x[2])
        r = np.radians(a)
        m = s * np.array([[np.cos(r), np.sin(r)], [-np.sin(r), np.cos(r)]])
        c = np.c_[(n["left"] + n["right"]) / 2, (n["top"] + n["bottom"]) / 2]
        q = (c - src[k]) @ m + dst[k]
        w, h = (n["right"] - n["left"]) * s / 2, (n["bottom"] - n["top"]) * s / 2
        return n.assign(left=q[:, 0] - w, right=q[:, 0] + w, top=q[:, 1] - h, bottom=q[:, 1] + h)

    return nodes.groupBy("doc_id").cogroup(pairs.groupBy("doc_id")).applyInPandas(run, ddl)


def polygon_ioo(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection of two convex polygons over the first one's area (clipping edge by edge)."""
    def area(p):
        return 0.5 * abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) if len(p) > 2 else 0.0

    def turn(p):
        return p if np.dot(p[:, 0], np.roll(p[:, 1], -1)) >= np.dot(p[:, 1], np.roll(p[:, 0], -1)) else p[::-1]

    out, b = list(turn(np.asarray(a, float))), turn(np.asarray(b, float))
    for i in range(len(b)):
        p, q, src, out = b[i], b[(i + 1) % len(b)], out, []
        side = lambda x, p=p, q=q: (q[0] - p[0]) * (x[1] - p[1]) - (q[1] - p[1]) * (x[0] - p[0])
        for j in range(len(src)):
            u, v = src[j - 1], src[j]
            su, sv = side(u), side(v)
            if (su >= 0) != (sv >= 0):
                out.append(u + (v - u) * su / (su - sv))
            if sv >= 0:
                out.append(v)
    return area(np.array(out)) / (area(np.asarray(a, float)) + 1e-8) if out else 0.0
