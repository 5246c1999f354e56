"""Rectangles, points and placement, as column expressions. Rectangles are tuples of columns (x, y, width, height)."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

Rect = tuple[Column, Column, Column, Column]
Point = tuple[Column, Column]


def lit(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def clamped(v: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(lit(low), F.least(lit(high), v))


def unit(v: Column) -> Column:
    """Between 0 and 1; what isn't a number is 0."""
    return F.when(finite(v), clamped(v, 0, 1)).otherwise(0.0)


def clamp(r: Rect, least: float = 0.01) -> Rect:
    """Within the unit square, at least `least` wide and high."""
    m = max(0.001, min(1.0, least))
    own = lambda v, other: F.when(finite(v), v).otherwise(float(other))
    x, y = (clamped(own(v, 0), 0, 1 - m) for v in r[:2])
    return x, y, F.greatest(lit(m), F.least(1 - x, own(r[2], m))), F.greatest(lit(m), F.least(1 - y, own(r[3], m)))


def centre(r: Rect) -> Point:
    return r[0] + r[2] / 2, r[1] + r[3] / 2


def clamp_turned(r: Rect, degrees: Column, least: float = 0.01) -> Rect:
    """As clamp(), for a rectangle that is turned about its centre."""
    x, y, w, h = clamp(r, least)
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    half_w, half_h = F.least((c * w + s * h) / 2, lit(0.5)), F.least((s * w + c * h) / 2, lit(0.5))
    cx, cy = centre((x, y, w, h))
    return clamp((clamped(cx, half_w, 1 - half_w) - w / 2, clamped(cy, half_h, 1 - half_h) - h / 2, w, h), least)


def between(a: Point, b: Point, least: float = 0.01) -> Rect:
    """The rectangle that two corners span."""
    size = lambda p, q: F.greatest(lit(least), F.abs(q - p))
    return clamp((F.least(a[0], b[0]), F.least(a[1], b[1]), size(a[0], b[0]), size(a[1], b[1])), least)


def moved(r: Rect, dx: Column, dy: Column) -> Rect:
    w, h = (clamped(F.when(finite(v), v).otherwise(0.01), 0.001, 1) for v in r[2:])
    return clamped(r[0] + dx, 0, 1 - w), clamped(r[1] + dy, 0, 1 - h), w, h


def resized(r: Rect, handle: str, to: Point, least: float = 0.02) -> Rect:
    """A side (n, e, s, w) or corner pulled to a point."""
    x, y, w, h = r
    right, bottom = x + w, y + h
    if "w" in handle:
        x = F.least(to[0], right - least)
        w = right - x
    if "e" in handle:
        w = F.greatest(lit(least), to[0] - x)
    if "n" in handle:
        y = F.least(to[1], bottom - least)
        h = bottom - y
    if "s" in handle:
        h = F.greatest(lit(least), to[1] - y)
    return clamp((x, y, w, h), least)


def scaled(r: Rect, sx: Column, sy: Column, least: float = 0.02) -> Rect:
    cx, cy = centre(r)
    w, h = F.greatest(lit(least), r[2] * sx), F.greatest(lit(least), r[3] * sy)
    return clamp((cx - w / 2, cy - h / 2, w, h), least)


def snapped(value: Column, guides: Column, within: float = 0.018) -> Column:
    """The nearest guide that is near enough, the last of equals; else null."""
    far = F.transform(guides, lambda g, i: F.struct(F.abs(g - value).alias("d"), (-i).alias("i"), g.alias("g")))
    return F.array_min(F.filter(far, lambda s: s.d <= within))["g"]


def distance(a: Point, b: Point) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def turned_point(p: Point, c: Point, radians: Column) -> Point:
    dx, dy = p[0] - c[0], p[1] - c[1]
    return c[0] + dx * F.cos(radians) - dy * F.sin(radians), c[1] + dx * F.sin(radians) + dy * F.cos(radians)


def handles(r: Rect) -> dict[str, Point]:
    x, y, w, h = r
    at = {"w": x, "": x + w / 2, "e": x + w}, {"n": y, "": y + h / 2, "s": y + h}
    return {v + u: (at[0][u], at[1][v]) for v in at[1] for u in at[0] if u or v}


def product(a: list[Column], b: list[Column]) -> list[Column]:
    """Of two affine matrices of six numbers."""
    out = [a[i] * b[2 * j] + a[i + 2] * b[2 * j + 1] for j in range(2) for i in range(2)]
    return out + [a[i] * b[4] + a[i + 2] * b[5] + a[i + 4] for i in range(2)]


# pages under a turn of 0, 90, 180 or 270 degrees

def by_turn(turn: Column, quarter: Column, half: Column, three: Column, none: Column) -> Column:
    return F.when(turn == 90, quarter).when(turn == 180, half).when(turn == 270, three).otherwise(none)


def visible(media: Rect, crop: Rect) -> Rect:
    """The crop box within the media box; the media box where they don't meet or the crop box is empty."""
    x, y = F.greatest(media[0], crop[0]), F.greatest(media[1], crop[1])
    right, top = (F.least(media[k] + media[k + 2], crop[k] + crop[k + 2]) for k in range(2))
    use = (crop[2] > 0) & (crop[3] > 0) & (right > x) & (top > y)
    return tuple(F.when(use, a).otherwise(b) for a, b in zip((x, y, right - x, top - y), media))


def on_page(box: Rect, turn: Column, u: Column, v: Column) -> Point:
    """A place on the page as it is shown (from the top left, in fractions) in the page's own space."""
    x, y, w, h = box
    return by_turn(turn, x + v * w, x + (1 - u) * w, x + (1 - v) * w, x + u * w), by_turn(turn, y + u * h, y + v * h, y + (1 - u) * h, y + (1 - v) * h)


def shown_frame(box: Rect, turn: Column) -> list[Column]:
    """The matrix under which the page's bottom left corner as shown is the origin."""
    x, y, w, h = box
    n = [by_turn(turn, *map(lit, v)) for v in ((0, -1, 0, 1), (1, 0, -1, 0), (-1, 0, 1, 0), (0, -1, 0, 1))]
    return [*n, by_turn(turn, x + w, x + w, x, x), by_turn(turn, y, y + h, y + h, y)]


def turned_vector(turn: Column, x: Column, y: Column) -> Point:
    return by_turn(turn, -y, -x, y, x), by_turn(turn, x, -y, -x, y)


def fitted(fit: Column, anchor: Column, stamp: Point, page: Point) -> Rect:
    """Where a stamp lies on a page: contain, cover, stretch or actual size, pinned to one of nine anchors; y from the
    bottom."""
    across, down = page[0] / stamp[0], page[1] / stamp[1]
    even = F.when(fit == "contain", F.least(across, down)).when(fit == "cover", F.greatest(across, down)).otherwise(1.0)
    w, h = (F.when(fit == "stretch", whole).otherwise(own * even) for own, whole in zip(stamp, page))
    left = F.when(anchor.endswith("left"), 0.0).when(anchor.endswith("right"), 1.0).otherwise(0.5)
    top = F.when(anchor.startswith("top"), 0.0).when(anchor.startswith("bottom"), 1.0).otherwise(0.5)
    return (page[0] - w) * left + 0.0, (page[1] - h) * (1 - top) + 0.0, w, h


def alignment(block: Point, column: Point, body: Column, flush: Column, n_lines: Column) -> Column:
    """left, center, right or justify, of a block (left, right) in a column. flush: all lines but the last reach the
    column's right edge."""
    width = column[1] - column[0]
    left, right, slack = block[0] - column[0], column[1] - block[1], F.greatest(lit(2), 0.015 * width)
    centred = (left > F.greatest(body, 0.05 * width)) & (F.abs(left - right) <= slack)
    ragged = (left > F.greatest(1.5 * body, 0.05 * width)) & (right <= slack)
    return F.when(width <= 0, "left").when(centred, "center").when(ragged, "right").when((n_lines > 1) & flush, "justify").otherwise("left")


# polygons, as lists of points

def cross(o: tuple, a: tuple, b: tuple) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull(points: list[tuple]) -> list[tuple]:
    """The corners of the convex hull, in order."""
    if len(points) < 4:
        return list(points)
    out: list[tuple] = []
    for way in (sorted(points), sorted(points, reverse=True)):
        half: list[tuple] = []
        for p in way:
            while len(half) > 1 and cross(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        out += half[:-1]
    return out


def area(points: list[tuple]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def simplified(points: list[tuple], most: int) -> list[tuple]:
    """At most so many corners: those go first whose loss takes the least area."""
    points = list(points)
    while len(points) > most:
        loss = [abs(cross(points[i - 1], p, points[(i + 1) % len(points)])) for i, p in enumerate(points)]
        points.pop(loss.index(min(loss)))
    return points


def largest_quad(corners: list[tuple]) -> list[tuple] | None:
    """The four of the corners that span most."""
    return max(map(list, itertools.combinations(corners, 4)), key=area, default=None)


def ordered(quad: list[tuple]) -> list[tuple]:
    """Clockwise as seen (y grows downwards) from the corner nearest to the top left."""
    cx, cy = (sum(p[k] for p in quad) / 4 for k in range(2))
    ring = sorted(quad, key=lambda p: math.atan2(p[1] - cy, p[0] - cx))
    start = min(range(4), key=lambda i: sum(ring[i]))
    return ring[start:] + ring[:start]


# Corners of a sheet of paper, its sides and their proportion; the largest side and picture made of it.
CORNER, SIDE, ASPECT, EDGE, PIXELS = (50.0, 132.0), 8.0, 6.0, 2200.0, 12e6


def sides(quad: list[tuple]) -> tuple[float, float]:
    """Width and height: the longer of two opposite sides each."""
    a, b, c, d = quad
    return max(math.dist(a, b), math.dist(d, c)), max(math.dist(a, d), math.dist(b, c))


def quad_problem(quad: list[tuple]) -> str | None:
    """Why four corners are no page: count, position, close, straight, crossed, mirrored, small; None if they are one."""
    if len(quad) != 4:
        return "count"
    if not all(math.isfinite(v) for p in quad for v in p):
        return "position"
    turns = [cross(quad[i - 1], quad[i], quad[(i + 1) % 4]) for i in range(4)]
    for i in range(4):
        if math.dist(quad[i], quad[(i + 1) % 4]) < 2:
            return "close"
        if turns[i] == 0:
            return "straight"
        if turns[i] * turns[0] < 0:
            return "crossed"
    return "mirrored" if turns[0] < 0 else "small" if min(sides(quad)) < SIDE else None


def plausible(quad: list[tuple]) -> bool:
    """Whether four corners may be a sheet of paper: convex, no corner too sharp or flat, no side too short or long."""
    turns = [cross(quad[i - 1], quad[i], quad[(i + 1) % 4]) for i in range(4)]
    if min(turns) <= 0 <= max(turns):
        return False
    for i, p in enumerate(quad):
        a, b = ((q[0] - p[0], q[1] - p[1]) for q in (quad[i - 1], quad[(i + 1) % 4]))
        angle = math.degrees(math.acos(max(-1.0, min(1.0, (a[0] * b[0] + a[1] * b[1]) / (math.hypot(*a) * math.hypot(*b))))))
        if not CORNER[0] <= angle <= CORNER[1]:
            return False
    width, height = sides(quad)
    return min(width, height) >= SIDE and 1 / ASPECT <= width / height <= ASPECT


def homography(source: list[tuple], target: list[tuple]) -> list[float] | None:
    """The eight numbers that map the corners of one quad to those of another; None where they don't."""
    rows, values = [], []
    for (u, v), (x, y) in zip(source, target):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        values += [x, y]
    try:
        return np.linalg.solve(np.array(rows, float), np.array(values, float)).tolist()
    except np.linalg.LinAlgError:
        return None


def unwarped_size(quad: list[tuple]) -> tuple[int, int]:
    """Width and height in pixels of the page that a quad is."""
    width, height = sides(quad)
    scale = min(1.0, EDGE / max(width, height))
    if width * height * scale * scale > PIXELS:
        scale = math.sqrt(PIXELS / (width * height))
    return tuple(max(1, math.floor(v * scale + 0.5)) for v in (width, height))


POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
QUAD = StructType([StructField("corners", ArrayType(POINT)), StructField("area", DoubleType()), StructField("problem", StringType()), StructField("plausible", BooleanType()), StructField("width", LongType()), StructField("height", LongType())])


@F.pandas_udf(QUAD)
def page_quad(points: pd.Series) -> pd.DataFrame:
    """The page in a cloud of points (an array of x, y): the largest quad of their hull, its corners in order."""
    out = []
    for cloud in points:
        quad = largest_quad(simplified(hull([(p["x"], p["y"]) for p in cloud]), 24))
        if quad is None:
            out.append((None, None, "count", False, None, None))
            continue
        quad = ordered(quad)
        out.append(([{"x": x, "y": y} for x, y in quad], area(quad), quad_problem(quad), plausible(quad), *unwarped_size(quad)))
    return pd.DataFrame(out, columns=[f.name for f in QUAD]).astype({"width": "Int64", "height": "Int64"})


@F.pandas_udf(ArrayType(DoubleType()))
def quad_map(source: pd.Series, target: pd.Series) -> pd.Series:
    as_points = lambda q: [(p["x"], p["y"]) for p in q]
    return pd.Series([homography(as_points(a), as_points(b)) for a, b in zip(source, target)])
