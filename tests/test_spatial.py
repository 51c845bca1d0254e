"""Clipped cells against the even-odd rule over all edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evlake.operators import spatial

EDGES = "array<struct<x1: double, y1: double, x2: double, y2: double>>"
POLYGON = f"region_id string, poly_ord long, name string, min_x double, min_y double, max_x double, max_y double, edges {EDGES}"


def ring(points):
    return [(*map(float, a), *map(float, b)) for a, b in zip(points, [*points[1:], points[0]])]


def row(name, *rings, order=0):
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    return (name, order, name, float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys)), [e for r in rings for e in ring(r)])


def inside(points, edges):
    """The rule itself, in numpy."""
    out = np.zeros(len(points), bool)
    for x1, y1, x2, y2 in edges:
        straddles = (y1 > points[:, 1]) != (y2 > points[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            out ^= straddles & (points[:, 0] < x1 + (points[:, 1] - y1) * (x2 - x1) / (y2 - y1))
    return out


def held(spark, polygons, points, cell):
    frame = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, lon double, lat double")
    return {(r.id, r.region_id) for r in spatial.polygon_hits(frame, spark.createDataFrame(polygons, POLYGON), ["id"], cell=cell).collect()}


def expected(polygons, points):
    out = set()
    for name, _, _, x0, y0, x1, y1, edges in polygons:
        boxed = (points[:, 0] >= x0) & (points[:, 0] <= x1) & (points[:, 1] >= y0) & (points[:, 1] <= y1)
        out |= {(int(i), name) for i in np.flatnonzero(boxed & inside(points, edges))}
    return out


@pytest.mark.parametrize("cell", [0.25, 0.1, 3.0])
def test_random_and_round_shapes(spark, cell):
    """Vertices and points on cell corners, borders and each other's heights; holes; shapes that cross themselves; slivers."""
    rng = np.random.default_rng(2)
    grid = lambda n: rng.integers(-8, 9, (n, 2)) * 0.25
    polygons = [row(f"grid{i}", grid(int(rng.integers(3, 12)))) for i in range(12)]
    polygons += [row(f"free{i}", rng.uniform(-2, 2, (int(rng.integers(3, 40)), 2))) for i in range(8)]
    polygons += [row("box", [(-1, -1), (1, -1), (1, 1), (-1, 1)], [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]), row("sliver", [(-2, 0), (2, 1e-10), (2, 2e-10)]), row("steep", [(0.25, -2), (0.25 + 1e-9, 2), (0.25 + 2e-7, 2)]), row("dot", [(0.5, 0.5)] * 3), ("none", 0, "none", None, None, None, None, None)]
    points = np.concatenate([grid(300), rng.integers(-80, 81, (300, 2)) * 0.025, rng.uniform(-2.2, 2.2, (300, 2)), np.nextafter(grid(200), 9), np.nextafter(grid(200), -9)])
    assert held(spark, polygons, points, cell) == expected(polygons[:-1], points)


def test_large_zone_carries_clipped_edges(spark):
    """A zone of 100,000 vertices: the same as the rule, and its rows have little more than its edges."""
    rng = np.random.default_rng(4)
    angle = np.sort(rng.uniform(0, 2 * np.pi, 100_000))
    far = 6 + np.cumsum(rng.normal(0, 0.01, len(angle))) * np.sin(angle / 2)
    zone = row("zone", np.stack([far * np.cos(angle), far * np.sin(angle)], 1))
    points = np.concatenate([rng.uniform(-9, 9, (1500, 2)), np.round(rng.uniform(-9, 9, (1500, 2)) * 4) / 4])
    assert held(spark, [zone], points, 0.25) == expected([zone], points)
    cells = spatial.covering_cells(spark.createDataFrame([zone], POLYGON)).agg(F.sum(F.size("edges")), F.max(F.size("edges")), F.count_if(F.size("edges") == 0)).first()
    assert cells[0] < 1.2 * len(angle) and cells[1] < 0.05 * len(angle) and cells[2] > 500


def test_no_polygons_and_no_points(spark):
    assert held(spark, [], np.zeros((1, 2)), 0.25) == set()
    assert held(spark, [row("box", [(0, 0), (1, 0), (1, 1)])], np.zeros((0, 2)), 0.25) == set()
