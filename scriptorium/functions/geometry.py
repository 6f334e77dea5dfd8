"""Geometry of text boxes as Column expressions (y grows downward).

A ``Box`` bundles four columns; every method returns a Column or another Box, so
all of it stays inside one projection and whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


@dataclass(frozen=True)
class Box:
    """An axis-aligned box of four columns."""

    left: Column
    top: Column
    right: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + c) for c in ("left", "top", "right", "bottom")))

    @classmethod
    def from_quad(cls, quad: Column) -> Box:
        """Bounding box of an array x1, y1 .. x4, y4."""
        xs, ys = [quad[i] for i in (0, 2, 4, 6)], [quad[i] for i in (1, 3, 5, 7)]
        return cls(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip((self.left, self.top, self.right, self.bottom), ("left", "top", "right", "bottom"), strict=True)]

    def struct(self) -> Column:
        return F.struct(*self.columns())

    # sizes and points
    @property
    def width(self) -> Column:
        return self.right - self.left

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    @property
    def cx(self) -> Column:
        return (self.left + self.right) / 2

    @property
    def cy(self) -> Column:
        return (self.top + self.bottom) / 2

    @property
    def area(self) -> Column:
        return self.width * self.height

    # containment and overlap
    def contains(self, o: Box) -> Column:
        return (self.left <= o.left) & (self.top <= o.top) & (self.right >= o.right) & (self.bottom >= o.bottom)

    def contains_point(self, x: Column, y: Column) -> Column:
        return x.between(self.left, self.right) & y.between(self.top, self.bottom)

    def contains_center(self, o: Box) -> Column:
        return (o.cx > self.left) & (o.cx < self.right) & (o.cy > self.top) & (o.cy < self.bottom)

    def center_in(self, o: Box) -> Column:
        return o.contains_center(self)

    def x_overlaps(self, o: Box) -> Column:
        return (self.left < o.right) & (self.right > o.left)

    def y_overlaps(self, o: Box, compat: bool = False) -> Column:
        """``compat`` keeps the inverted comparison of older pipelines, false for every valid box."""
        return (self.top > o.bottom) & (self.bottom < o.top) if compat else (self.top < o.bottom) & (self.bottom > o.top)

    def x_inside(self, o: Box) -> Column:
        return (self.left > o.left) & (self.right < o.right)

    # relative placement; thresholds are in units of mean height unless said otherwise
    def _unit(self, o: Box) -> Column:
        return (self.height + o.height) / 2

    def same_line(self, o: Box, thresh: float = 0.15) -> Column:
        t = self._unit(o) * thresh
        return (F.abs(self.top - o.top) <= t) & (F.abs(self.bottom - o.bottom) <= t)

    def below(self, o: Box, thresh: float = 0.15) -> Column:
        return self.cy - o.cy > self._unit(o) * thresh

    def above(self, o: Box, thresh: float = 0.15) -> Column:
        return o.cy - self.cy > self._unit(o) * thresh

    def left_of(self, o: Box, thresh: float = 0.15) -> Column:
        return o.cx - self.cx > self._unit(o) * thresh

    def close_left(self, o: Box, thresh: float = 0.15) -> Column:
        """``o`` follows on the right: gap below ``thresh`` of the summed widths."""
        return (F.abs(o.left - self.right) < thresh * (self.width + o.width)) & (o.cx > self.cx)

    def close_up(self, o: Box, thresh: float = 0.5) -> Column:
        return (F.abs(o.top - self.bottom) < thresh * (self.height + o.height)) & (o.cy > self.cy)

    def relation(self, o: Box, thresh_x: float = 2.5, thresh_y: float = 4.0) -> Column:
        """Struct of left, right, up, down: where ``o`` lies in a window scaled by the own size."""
        dx, dy = o.cx - self.cx, o.cy - self.cy
        near = (F.abs(dx) <= thresh_x * self.width) & (F.abs(dy) <= thresh_y * self.height)
        return F.struct(
            (near & (dx < -self.width / 3)).alias("left"), (near & (dx > self.width / 3)).alias("right"),
            (near & (dy < -self.height / 2)).alias("up"), (near & (dy > self.height / 2)).alias("down"),
        )

    def align_left(self, o: Box, thresh: float = 1.5) -> Column:
        return F.abs(self.left - o.left) < self._unit(o) * thresh

    def align_right(self, o: Box, thresh: float = 1.5) -> Column:
        return F.abs(self.right - o.right) < self._unit(o) * thresh

    # distances
    def center_distance(self, o: Box) -> Column:
        return F.sqrt((self.cx - o.cx) ** 2 + (self.cy - o.cy) ** 2)

    def left_center_distance(self, o: Box) -> Column:
        return F.sqrt((self.left - o.left) ** 2 + (self.cy - o.cy) ** 2)

    def center_manhattan(self, o: Box) -> Column:
        return F.abs(self.cx - o.cx) + F.abs(self.cy - o.cy)

    def left_top_distance(self, o: Box) -> Column:
        return F.sqrt((self.left - o.left) ** 2 + (self.top - o.top) ** 2)

    def left_top_manhattan(self, o: Box) -> Column:
        return F.abs(self.left - o.left) + F.abs(self.top - o.top)

    # areas
    def intersection_area(self, o: Box) -> Column:
        w = F.least(self.right, o.right) - F.greatest(self.left, o.left)
        h = F.least(self.bottom, o.bottom) - F.greatest(self.top, o.top)
        return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))

    def ioo(self, o: Box) -> Column:
        """Intersection over the own area."""
        return self.intersection_area(o) / (self.area + EPS)

    def iou(self, o: Box) -> Column:
        both = self.intersection_area(o)
        union = self.area + o.area - both
        return F.when(union > 0, both / union).otherwise(0.0)

    def y_iou(self, o: Box) -> Column:
        both = F.greatest(F.least(self.bottom, o.bottom) - F.greatest(self.top, o.top), F.lit(0))
        union = F.greatest(self.bottom, o.bottom) - F.least(self.top, o.top)
        return F.when(union > 0, both / union).otherwise(0.0)

    def merge(self, *others: Box) -> Box:
        all_ = (self, *others)
        return Box(F.least(*(b.left for b in all_)), F.least(*(b.top for b in all_)), F.greatest(*(b.right for b in all_)), F.greatest(*(b.bottom for b in all_)))

    def intersection(self, o: Box) -> Column:
        """The common box as a struct, null if empty."""
        i = Box(F.greatest(self.left, o.left), F.greatest(self.top, o.top), F.least(self.right, o.right), F.least(self.bottom, o.bottom))
        return F.when((i.width > 0) & (i.height > 0), i.struct())

    # movement
    def shift(self, dx, dy) -> Box:
        return Box(self.left + dx, self.top + dy, self.right + dx, self.bottom + dy)

    def unshift(self, dx, dy) -> Box:
        return Box(self.left - dx, self.top - dy, self.right - dx, self.bottom - dy)

    def transform(self, offset1=(0, 0), scale=1, angle=0, offset2=(0, 0)) -> Box:
        """Shift, scale, rotate the centre by ``angle`` degrees, shift. The second shift only
        applies when the angle is not zero: callers rely on it."""
        b = self.shift(*offset1)
        b = Box(b.left * scale, b.top * scale, b.right * scale, b.bottom * scale)
        if not isinstance(angle, Column) and angle == 0:
            return b
        a = angle if isinstance(angle, Column) else F.lit(float(angle))
        x, y = rotate(b.cx, b.cy, a)
        turned = b.shift(x - b.cx + offset2[0], y - b.cy + offset2[1])
        pick = lambda p, q: F.when(a != 0, p).otherwise(q)
        return Box(pick(turned.left, b.left), pick(turned.top, b.top), pick(turned.right, b.right), pick(turned.bottom, b.bottom))

    def scale_to(self, sx, sy) -> Box:
        """Axis-wise rescale."""
        return Box(self.left * sx, self.top * sy, self.right * sx, self.bottom * sy)

    def window(self, col_offset=0, row_offset=0, width_ratio=1, height_ratio=1, late: bool = False) -> Box:
        """The box shifted by own widths and heights, resized about its left-top corner; from zero up, whole
        numbers. The size scales before the shift, or after it if ``late``."""
        w, h = self.width, self.height
        w2, h2 = w * width_ratio, h * height_ratio
        sx, sy = (w, h) if late else (w2, h2)
        left, top = self.left + sx * col_offset, self.top + sy * row_offset
        whole = lambda c: F.greatest(c, F.lit(0)).cast("int")
        return Box(whole(left), whole(top), whole(left + w2), whole(top + h2))

    def pad(self, w_pad, h_pad) -> Box:
        """Padded by ratios of its size; left and top stay at zero or above."""
        return Box(F.greatest(self.left - self.width * w_pad, F.lit(0)), F.greatest(self.top - self.height * h_pad, F.lit(0)), self.right + self.width * w_pad, self.bottom + self.height * h_pad)


def bounding(prefix: str = "") -> list[Column]:
    """Aggregates: the bounding box of a group."""
    b = Box.of(prefix)
    return [F.min(b.left).alias("left"), F.min(b.top).alias("top"), F.max(b.right).alias("right"), F.max(b.bottom).alias("bottom")]


def rotate(x: Column, y: Column, degrees: Column, about=(0, 0)) -> tuple[Column, Column]:
    a, dx, dy = F.radians(degrees), x - about[0], y - about[1]
    return dx * F.cos(a) - dy * F.sin(a) + about[0], dx * F.sin(a) + dy * F.cos(a) + about[1]


def ordered_quad(quad: Column) -> Column:
    """Points of a quad, clockwise from the left top: the two leftmost by y, the two rightmost by y."""
    pts = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(quad, i * 2).cast("double").alias("x"), F.get(quad, i * 2 + 1).cast("double").alias("y"))))
    by_y = lambda a, b: F.array_sort(F.array(a, b), lambda p, q: F.when(p["y"] < q["y"], -1).when(p["y"] > q["y"], 1).otherwise(0))
    lefts, rights = by_y(pts[0], pts[1]), by_y(pts[2], pts[3])
    return F.array(lefts[0], rights[0], rights[1], lefts[1])


def quad_angle(quad: Column) -> Column:
    """Degrees of the top edge of the ordered quad."""
    p = ordered_quad(quad)
    return F.degrees(F.atan2(p[1]["y"] - p[0]["y"], p[1]["x"] - p[0]["x"]))


def _edge(p: Column, i: int, j: int) -> Column:
    return F.sqrt((p[i]["x"] - p[j]["x"]) ** 2 + (p[i]["y"] - p[j]["y"]) ** 2)


def quad_height(quad: Column) -> Column:
    return _edge(ordered_quad(quad), 0, 3)


def quad_width(quad: Column) -> Column:
    return _edge(ordered_quad(quad), 0, 1)


def quad_to_rectangle(quad: Column) -> Column:
    """Struct cx, cy, w, h, theta of a quad."""
    p = ordered_quad(quad)
    mean = lambda f: F.aggregate(F.transform(p, lambda q: q[f]), F.lit(0.0), lambda s, x: s + x) / 4
    return F.struct(mean("x").alias("cx"), mean("y").alias("cy"), _edge(p, 0, 1).alias("w"), _edge(p, 0, 3).alias("h"), quad_angle(quad).alias("theta"))


def relative_quad(cx: Column, cy: Column, dl, dt, dr, db, angle: Column) -> Column:
    """Quad around an anchor by distances to its sides, turned about the anchor."""
    corners = [(-dl, -dt), (dr, -dt), (dr, db), (-dl, db)]
    out = []
    for x, y in corners:
        out += rotate(cx + x, cy + y, angle, (cx, cy))
    return F.array(*out)


def best_box(*boxes: Column) -> Column:
    """The first box that is set: offset before scaled before raw."""
    return F.coalesce(*boxes)


def char_width(text: Column, width: Column) -> Column:
    return F.when(F.length(text) > 0, width / F.length(text)).otherwise(0.0)


def mean_char_width(text: Column, width: Column, narrow: float = 0.65) -> Column:
    """Width of a unit character: ASCII counts ``narrow``, all else one."""
    thin = F.length(F.regexp_replace(text, "[^\\x00-\\x7f]", ""))
    units = thin * narrow + (F.length(text) - thin)
    return F.when(units > 0, (width / units).cast("int")).otherwise(0)


def split_box(text: Column, box: Box, start: Column, end: Column) -> Column:
    """Struct text, left, top, right, bottom of the substring [start, end) by display width; null if
    empty; an end of -1 is the text's length. Characters from U+1100 count two."""
    n = F.length(text)
    stop = F.when(end == -1, n).otherwise(F.least(end, n))
    shown = lambda s: F.length(s) + F.length(F.regexp_replace(s, "[^\\x{1100}-\\x{10FFFF}]", ""))
    total = shown(text)
    a = box.left + box.width * shown(F.substr(text, F.lit(1), start)) / total
    b = box.left + box.width * shown(F.substr(text, F.lit(1), stop)) / total
    part = F.substr(text, start + 1, stop - start)
    up = lambda c: F.ceil(c).cast("double")
    return F.when((start >= 0) & (stop > start) & (total > 0), F.struct(part.alias("text"), up(a).alias("left"), up(box.top).alias("top"), up(b).alias("right"), up(box.bottom).alias("bottom")))


# lines as y = k x + b, given by two points (x1, y1), (x2, y2)
def line_cross(p1, p2, q1, q2) -> Column:
    """Struct x, y where two lines meet; null if parallel."""
    d = (p1[0] - p2[0]) * (q1[1] - q2[1]) - (p1[1] - p2[1]) * (q1[0] - q2[0])
    a, b = p1[0] * p2[1] - p1[1] * p2[0], q1[0] * q2[1] - q1[1] * q2[0]
    x = (a * (q1[0] - q2[0]) - (p1[0] - p2[0]) * b) / F.nullif(d, F.lit(0))
    y = (a * (q1[1] - q2[1]) - (p1[1] - p2[1]) * b) / F.nullif(d, F.lit(0))
    return F.when(d != 0, F.struct(x.alias("x"), y.alias("y")))


def line_contains(p1, p2, x: Column, y: Column) -> Column:
    return x.between(F.least(p1[0], p2[0]), F.greatest(p1[0], p2[0])) & y.between(F.least(p1[1], p2[1]), F.greatest(p1[1], p2[1]))


def under_line(p1, p2, x: Column, y: Column) -> Column:
    """Whether the point lies below the line (y grows downward)."""
    on = F.when(p1[0] == p2[0], F.lit(None)).otherwise(p1[1] + (p2[1] - p1[1]) * (x - p1[0]) / F.nullif(p2[0] - p1[0], F.lit(0)))
    return y > on


def parallel_line(p1, p2, x: Column, y: Column) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    return (x, y), (x + p2[0] - p1[0], y + p2[1] - p1[1])


def normal_line(p1, p2, x: Column, y: Column) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    return (x, y), (x - (p2[1] - p1[1]), y + p2[0] - p1[0])


def interval_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Largest overlap ratio of two intervals."""
    both = F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0))
    return F.greatest(both / (a2 - a1 + EPS), both / (b2 - b1 + EPS))
