"""Planar geometry on rings, as array expressions; line simplification where they don't reach."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def ring(numbers: Column) -> Column:
    """An array x0, y0, x1, y1, ... as points."""
    return F.transform(F.sequence(F.lit(0), (F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct(F.get(numbers, i * 2).cast("double").alias("x"), F.get(numbers, i * 2 + 1).cast("double").alias("y")))


def _edges(points: Column) -> Column:
    """Each point with the next one, the last with the first."""
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), F.coalesce(F.get(points, i + 1), F.get(points, F.lit(0))).alias("b")))


def _total(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + term(e["a"], e["b"]))


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def signed_area(points: Column) -> Column:
    """Half the sum of the cross products; positive when counter-clockwise."""
    return _total(_edges(points), _cross) / 2


def area(points: Column) -> Column:
    return F.abs(signed_area(points))


def oriented(points: Column, hole: bool = False) -> Column:
    """Outer rings clockwise, holes counter-clockwise."""
    turn = signed_area(points) < 0 if hole else signed_area(points) > 0
    return F.when(turn, F.reverse(points)).otherwise(points)


def centroid(points: Column) -> Column:
    """Area-weighted; the mean of the points where the area vanishes."""
    edges = _edges(points)
    total = _total(edges, _cross)
    x = _total(edges, lambda a, b: (a["x"] + b["x"]) * _cross(a, b))
    y = _total(edges, lambda a, b: (a["y"] + b["y"]) * _cross(a, b))
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / F.size(points)
    flat = F.abs(total) < 1e-9
    return F.struct(F.when(flat, mean("x")).otherwise(x / (3 * total)).alias("x"), F.when(flat, mean("y")).otherwise(y / (3 * total)).alias("y"))


def bounds(points: Column) -> Column:
    """(min_x, min_y, max_x, max_y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def mercator(lon: Column, lat: Column) -> Column:
    """Web Mercator on the unit sphere, latitude clamped."""
    phi = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    return F.struct(F.radians(lon).alias("x"), F.log(F.tan(F.lit(math.pi / 4) + phi / 2)).alias("y"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment, the projection clamped to it."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def view_box(box: Column, least: float = 22.0, padding: float = 0.1, aspect: float = 12 / 7) -> Column:
    """A padded box of fixed proportions around bounds."""
    w = F.greatest(box["max_x"] - box["min_x"], F.lit(least)) * (1 + 2 * padding)
    h = F.greatest(box["max_y"] - box["min_y"], F.lit(least)) * (1 + 2 * padding)
    wide, high = F.greatest(w, h * aspect), F.greatest(h, w / aspect)
    return F.struct(((box["min_x"] + box["max_x"]) / 2 - wide / 2).alias("x"), ((box["min_y"] + box["max_y"]) / 2 - high / 2).alias("y"), wide.alias("width"), high.alias("height"))


def svg_path(points: Column, digits: int = 2) -> Column:
    """M x,y L x,y ... Z; empty for fewer than four points."""
    mark = lambda p: F.concat(F.regexp_replace(F.round(p["x"], digits).cast("string"), r"\.0$", ""), F.lit(","), F.regexp_replace(F.round(p["y"], digits).cast("string"), r"\.0$", ""))
    return F.when(F.size(points) < 4, "").otherwise(F.concat(F.lit("M"), F.array_join(F.transform(points, mark), "L"), F.lit("Z")))


def simplify_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Keep the ends; keep the farthest point of a span while it lies beyond the tolerance."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        low, high = spans.pop()
        if high - low < 2:
            continue
        a, b, inner = points[low], points[high], points[low + 1 : high]
        d = b - a
        length = float(d @ d)
        t = np.clip(((inner - a) @ d) / length, 0, 1) if length else np.zeros(len(inner))
        far = np.hypot(*(inner - (a + t[:, None] * d)).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            at = low + 1 + k
            keep[at] = True
            spans += [(low, at), (at, high)]
    return points[keep]


def simplified(points: Column, tolerance: float) -> Column:
    """Line simplification of point arrays."""

    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        out = []
        for own in rings:
            xy = np.array([(p["x"], p["y"]) for p in own], float)
            out.append([{"x": float(x), "y": float(y)} for x, y in (simplify_points(xy, tolerance) if len(xy) > 2 else xy)])
        return pd.Series(out)

    return run(points)


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring, split at its first point and the one farthest from it; both halves are simplified as lines."""
    own = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    if len(own) < 4:
        return ring
    at = 1 + int(np.hypot(*(own[1:] - own[0]).T).argmax())
    one, two = simplify_points(own[: at + 1], tolerance), simplify_points(np.vstack([own[at:], own[:1]]), tolerance)
    return np.vstack([one, two[1:]])


def simplified_rings(points: Column, tolerance: float) -> Column:
    """Simplification of closed rings."""

    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(x), "y": float(y)} for x, y in simplify_ring(np.array([(p["x"], p["y"]) for p in own], float).reshape(-1, 2), tolerance)] for own in rings])

    return run(points)


def fitted(point: Column, box: Column, width: float, height: float, padding: float = 28.0) -> Column:
    """A point of a map scaled evenly into a padded drawing, centred, with y downwards."""
    wide, high = box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]
    scale = F.least((width - 2 * padding) / wide, (height - 2 * padding) / high)
    x = (width - wide * scale) / 2 + (point["x"] - box["min_x"]) * scale
    y = height - ((height - high * scale) / 2 + (point["y"] - box["min_y"]) * scale)
    return F.struct(x.alias("x"), y.alias("y"))


def geometry_type(polygons: Column) -> Column:
    return type_of(F.size(polygons))


def type_of(count: Column) -> Column:
    """A geometry's type by its number of polygons."""
    return F.when(count == 1, "Polygon").when(count > 1, "MultiPolygon")
