"""Quads and boxes. A point is struct<x, y>; a quad is an array of four points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT


def points(flat: Column, n: int = 4) -> Column:
    """n points from x0, y0, x1, y1, ..."""
    return F.array(*(F.struct(flat[2 * i].alias("x"), flat[2 * i + 1].alias("y"), F.lit(i).alias("i")) for i in range(n)))


def _by(key: str):
    return lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(a["i"] - b["i"])


def order_points(quad: Column) -> Column:
    """Top left, top right, bottom right, bottom left: by y, halves by x, lower half turned round. Ties by i (input order)."""
    by_y = F.array_sort(quad, _by("y"))
    low = F.array_sort(F.slice(by_y, 1, 2), _by("x"))
    high = F.array_sort(F.slice(by_y, 3, 2), _by("x"))
    return F.concat(low, F.reverse(high))


def _next(p: Column, i: Column) -> Column:
    return F.element_at(p, (i % F.size(p)) + 1)


def area(p: Column) -> Column:
    """Shoelace area of a polygon."""
    i = F.sequence(F.lit(1), F.size(p))
    cross = F.transform(i, lambda k: F.element_at(p, k)["x"] * _next(p, k)["y"] - _next(p, k)["x"] * F.element_at(p, k)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def perimeter(p: Column) -> Column:
    i = F.sequence(F.lit(1), F.size(p))
    side = F.transform(i, lambda k: F.sqrt(F.pow(F.element_at(p, k)["x"] - _next(p, k)["x"], 2) + F.pow(F.element_at(p, k)["y"] - _next(p, k)["y"], 2)))
    return F.aggregate(side, F.lit(0.0), lambda a, x: a + x)


def unclip_distance(p: Column, ratio: float = DEFAULT.unclip_ratio) -> Column:
    """How far a polygon grows; degenerate ones stay."""
    a, n = area(p), perimeter(p)
    return F.when((a < 1) | (n < 1), 0.0).otherwise(a * ratio / n)


def rescale_clip(v: Column, scale: float, bound: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(v * F.lit(scale), F.lit(float(bound))))


def crop_bounds(p: Column, width: int, height: int) -> Column:
    """x0, y0, x1, y1 of the box round a quad inside the image, and whether it is empty."""
    xs, ys = F.transform(p, lambda q: q["x"].cast("int")), F.transform(p, lambda q: q["y"].cast("int"))
    clamp = lambda v, top: F.greatest(F.lit(0), F.least(v, F.lit(top)))
    box = F.struct(clamp(F.array_min(xs), width).alias("x0"), clamp(F.array_min(ys), height).alias("y0"), clamp(F.array_max(xs), width).alias("x1"), clamp(F.array_max(ys), height).alias("y1"))
    return box.withField("empty", (box["x1"] <= box["x0"]) | (box["y1"] <= box["y0"]))


def ceil32(v: Column) -> Column:
    """The next multiple of 32, of whole numbers; exact beyond 2 ** 53, and negative ones are cut toward zero as SQL does."""
    return F.call_function("div", v.cast("long") + 31, F.lit(32)) * 32


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; by zero it is infinite, or not a number for zero by zero, and no error in ANSI mode."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def recognizer_width(w: Column, h: Column, height: int = DEFAULT.input_height, least: int = DEFAULT.min_width) -> Column:
    return F.greatest(F.lit(least), (w * (F.lit(float(height)) / h)).cast("int"))


def bbox_quad(b: Column) -> Column:
    x0, y0, x1, y1 = (b[i] for i in range(4))
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def pad_right(a: Column, size: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(size - F.size(a), F.lit(0))))


def mask(p: Column, threshold: float = DEFAULT.threshold) -> Column:
    """Strictly above; not a number is below."""
    return (p > threshold) & ~F.isnan(p)


def normalize(v: Column, channel: int) -> Column:
    return (v / 255.0 - DEFAULT.mean[channel]) / DEFAULT.std[channel]
