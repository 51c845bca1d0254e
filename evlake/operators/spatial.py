"""Points in named polygons: grid-cell equi-joins with a cover of cells inside and on the border, and an exact even-odd test over the border cell's own edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees of a grid cell.
CELL = 0.25
#: Degrees within which an edge counts as touching a cell, so that rounding loses none.
_NEAR = 1e-9


def contains(edges: Column, lat: Column, lon: Column) -> Column:
    """Even-odd rule over all rings, so holes are outside; edges is array<struct<x1, y1, x2, y2>>, x the longitude."""
    crosses = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < e["x1"] + (lat - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))
    return F.size(F.filter(edges, crosses)) % 2 == 1


def _cell_rows(e: np.ndarray, cell: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(column, rows, odd, edges) of each column of cells: its cells with edges or inside the polygon.

    e has a row (x1, y1, x2, y2) for each edge. odd says whether the polygon holds the cell's upper right
    corner: how many edges cross the line up from there, by the comparisons that crosses_corner() makes,
    so that both agree to the last bit. Edges stand in all cells that they touch, or nearly so.
    """
    x1, y1, x2, y2 = e.T
    low_x, high_x, low_y, high_y = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    first = np.floor((low_x - _NEAR) / cell).astype(np.int64)
    n = np.floor((high_x + _NEAR) / cell).astype(np.int64) - first + 1
    of = np.repeat(np.arange(len(e)), n)
    column = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    wide = np.where(high_x - low_x < 1e-6, np.nan, x2 - x1)[of]
    slope = (y2 - y1)[of] / wide
    at = lambda x: np.clip(y1[of] + (x - x1[of]) * slope, low_y[of], high_y[of])
    ends = np.stack([at(np.maximum(low_x[of], column * cell)), at(np.minimum(high_x[of], (column + 1) * cell))])
    near = _NEAR + 1e-12 * np.abs(np.nan_to_num(slope))
    bottom = np.floor((np.where(np.isnan(wide), low_y[of], ends.min(0)) - near) / cell).astype(np.int64)
    top = np.floor((np.where(np.isnan(wide), high_y[of], ends.max(0)) + near) / cell).astype(np.int64)
    start, rows = int(bottom.min()), int(top.max() - bottom.min()) + 1
    order = np.argsort(column, kind="stable")
    cuts = np.searchsorted(column[order], np.arange(column.min(), column.max() + 2))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        k += int(column.min())
        mine, right = order[a:b], (k + 1) * cell
        line = of[mine][(x1[of[mine]] > right) != (x2[of[mine]] > right)]
        above = np.zeros(rows + 1, np.int64)
        if len(line):
            u1, v1, u2, v2 = e[line].T
            near_row = np.floor((v1 + (right - u1) * (v2 - v1) / (u2 - u1)) / cell).astype(np.int64)
            np.add.at(above, np.clip(near_row - 2 - start, 0, rows), 1)  # all rows below are under the edge
            above = len(line) - np.cumsum(above)
            for d in (-2, -1, 0, 1):
                y = (near_row + d + 1) * cell
                with np.errstate(divide="ignore", invalid="ignore"):
                    beyond = u1 + (y - v1) * (u2 - u1) / (v2 - v1) > right
                over = np.where((v1 > y) != (v2 > y), (np.where(v1 > y, u1, u2) > right) != beyond, v1 > y)
                own = near_row + d - start
                fits = (own >= 0) & (own < rows)
                np.add.at(above, own[fits], over[fits].astype(np.int64))
        odd = above[:rows] % 2 == 1
        height = top[mine] - bottom[mine] + 1
        row = np.repeat(bottom[mine] - start, height) + np.arange(height.sum()) - np.repeat(np.cumsum(height) - height, height)
        edge = np.repeat(of[mine], height)
        by_row = np.argsort(row, kind="stable")
        parts = np.split(edge[by_row], np.searchsorted(row[by_row], np.arange(1, rows)))
        kept = np.flatnonzero(odd | (np.bincount(row, minlength=rows)[:rows] > 0))
        yield k, kept + start, odd[kept], [parts[i] for i in kept]


def covering_cells(polygons: DataFrame, cell: float = CELL) -> DataFrame:
    """(region_id, poly_ord, name, box, cell_x, cell_y, corner_x, corner_y, odd, edges): the cells that each polygon covers or whose border it crosses.

    A cell's row has only the edges that touch it, none where it lies inside, and whether its upper right
    corner is inside; contains_clipped() needs no more. So a polygon's edges are sent about once, whatever
    the number of its cells. Points that aren't finite are left out.
    """
    box = ["min_x", "min_y", "max_x", "max_y"]
    keys = ["region_id", "poly_ord", "name", *box]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flat = batch.column("edges")[i].values
                e = np.stack([pc.fill_null(flat.field(c), np.nan).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], 1) if flat is not None and len(flat) else np.zeros((0, 4))
                e = e[np.isfinite(e).all(1)]
                for k, row, odd, parts in _cell_rows(e, cell) if len(e) else ():
                    if not len(row):
                        continue
                    edges = e[np.concatenate(parts)]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.StructArray.from_arrays([pa.array(edges[:, c]) for c in range(4)], ["x1", "y1", "x2", "y2"]))
                    own = [pa.array([batch.column(c)[i].as_py()] * len(row), batch.schema.field(c).type) for c in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(row), k)), pa.array(row), pa.array(np.full(len(row), (k + 1) * cell)), pa.array((row + 1) * cell), pa.array(odd), lists], [*keys, "cell_x", "cell_y", "corner_x", "corner_y", "odd", "edges"])

    types = dict(polygons.select(*keys).dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", cell_x long, cell_y long, corner_x double, corner_y double, odd boolean, edges array<struct<x1: double, y1: double, x2: double, y2: double>>"
    return polygons.select(*keys, "edges").mapInArrow(rows, schema)


def contains_clipped(odd: Column, edges: Column, corner_x: Column, corner_y: Column, lat: Column, lon: Column) -> Column:
    """contains() of a cell's row: edges that lie between the point and the cell's upper right corner turn what holds there.

    From the point to the right as far as the cell goes, and up from there. An edge that passes a turn
    of the path is put on one side of it by one comparison for both legs.
    """
    x_at = lambda e, y: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    straddles = lambda e, y: (e["y1"] > y) != (e["y2"] > y)
    west, east = lambda e: ~(e["x1"] > corner_x) & ~(e["x2"] > corner_x), lambda e: (e["x1"] > corner_x) & (e["x2"] > corner_x)
    beyond = lambda e, y: ~west(e) & (east(e) | (x_at(e, y) > corner_x))
    above = lambda e, y: F.when(straddles(e, y), (F.when(e["y1"] > y, e["x1"]).otherwise(e["x2"]) > corner_x) != beyond(e, y)).otherwise(e["y1"] > y)
    right_leg = F.size(F.filter(edges, lambda e: straddles(e, lat) & ((lon < x_at(e, lat)) != beyond(e, lat))))
    up_leg = F.size(F.filter(edges, lambda e: ~west(e) & ~east(e) & (above(e, lat) != above(e, corner_y))))
    return F.when(F.size(edges) == 0, odd).otherwise((right_leg + up_leg + odd.cast("int")) % 2 == 1)


def on_border(edges: Column, lat: Column, lon: Column) -> Column:
    """Whether a point lies on one of the edges."""
    within = lambda v, a, b: v.between(F.least(a, b), F.greatest(a, b))
    level = lambda e: (lon - e["x1"]) * (e["y2"] - e["y1"]) == (lat - e["y1"]) * (e["x2"] - e["x1"])
    return F.exists(edges, lambda e: within(lon, e["x1"], e["x2"]) & within(lat, e["y1"], e["y2"]) & level(e))


def polygon_hits(points: DataFrame, polygons: DataFrame, keys: list[str], lat: str = "lat", lon: str = "lon", cell: float = CELL, border: bool = False) -> DataFrame:
    """(keys, region_id, poly_ord, name) for each point and polygon that contains it. Points without a location hit nothing.

    By the even-odd rule a point on the border is inside on some sides only; with border it is on all.
    """
    placed = points.select(*keys, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).where("_lat is not null and _lon is not null")
    placed = placed.withColumns({"cell_x": F.floor(F.col("_lon") / cell), "cell_y": F.floor(F.col("_lat") / cell)})
    met = placed.join(covering_cells(polygons, cell), ["cell_x", "cell_y"])
    boxed = met.where("_lon between min_x and max_x and _lat between min_y and max_y")
    inside = contains_clipped(*map(F.col, ("odd", "edges", "corner_x", "corner_y", "_lat", "_lon")))
    if border:
        inside |= on_border(F.col("edges"), F.col("_lat"), F.col("_lon"))
    return boxed.where(inside).select(*keys, "region_id", "poly_ord", "name")


def region_members(points: DataFrame, polygons: DataFrame, keys: list[str], **at: str | bool) -> DataFrame:
    """(keys, region_id), once for each region that holds a point."""
    return polygon_hits(points, polygons, keys, **at).select(*keys, "region_id").distinct()


def area_labels(points: DataFrame, polygons: DataFrame, keys: list[str], **at: str) -> DataFrame:
    """points with area: the name of the first polygon, in file order, that contains each; null without one."""
    first = polygon_hits(points, polygons, keys, **at).groupBy(*keys).agg(F.min_by("name", "poly_ord").alias("area"))
    return points.drop("area").join(first, keys, "left")


def zone_of_points(points: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """points with tz from a table of zone polygons; none for Etc zones, which are sea."""
    return area_labels(points, zones.where("name not like 'Etc/%'"), keys).withColumnRenamed("area", "found_tz")
