"""Polygons from GeoJSON texts, as edge arrays with boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RING = "array<array<double>>"
_FEATURES = "array<struct<properties: struct<name: string>, geometry: struct<type: string, coordinates: string>>>"
_GEOMETRY = "struct<type: string, coordinates: string>"


def _rings(kind: Column, coordinates: Column) -> Column:
    """An array of polygons, each an array of rings of points."""
    one = F.from_json(coordinates, f"array<{_RING}>")
    many = F.from_json(coordinates, f"array<array<{_RING}>>")
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def _edges(ring: Column) -> Column:
    """Edges of a ring, the last point linked to the first; further dimensions are ignored."""

    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % F.size(ring))
        return F.struct(F.get(p, F.lit(0)).alias("x1"), F.get(p, F.lit(1)).alias("y1"), F.get(q, F.lit(0)).alias("x2"), F.get(q, F.lit(1)).alias("y2"))

    return F.transform(ring, edge)


def polygons(files: DataFrame) -> DataFrame:
    """(region_id, poly_ord, name, min_x, min_y, max_x, max_y, edges) of files(region_id, body), in file order.

    A body is a FeatureCollection, a Feature or a bare polygon. A file without a polygon fails the job.
    """
    parsed = files.select("region_id", F.from_json("body", f"struct<type: string, features: {_FEATURES}, properties: struct<name: string>, geometry: {_GEOMETRY}, coordinates: string>").alias("j"))
    single = F.array(F.struct(F.col("j.properties").alias("properties"), F.coalesce("j.geometry", F.struct("j.type", "j.coordinates")).alias("geometry")))
    features = F.coalesce("j.features", single)
    found = F.flatten(F.transform(features, lambda f, i: F.transform(
        F.coalesce(_rings(f["geometry"]["type"], f["geometry"]["coordinates"]), F.array().cast(f"array<array<{_RING}>>")),
        lambda rings, k: F.struct(i.alias("_feature"), k.alias("_part"), f["properties"]["name"].alias("name"), rings.alias("rings")))))
    some = F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.concat(F.lit("no polygon in region "), "region_id")))
    shapes = parsed.select("region_id", F.explode(some).alias("s")).select("region_id", "s.*")
    outer = F.get("rings", F.lit(0))
    xs, ys = F.transform(outer, lambda p: F.get(p, F.lit(0))), F.transform(outer, lambda p: F.get(p, F.lit(1)))
    out = shapes.select(
        "region_id", (F.col("_feature") * F.lit(1 << 20).cast("long") + F.col("_part")).alias("poly_ord"), "name",
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"), F.flatten(F.transform("rings", _edges)).alias("edges"))
    return out


def check_polygons(files: DataFrame) -> DataFrame:
    """(region_id, problem) for files without any polygon."""
    shape = r'"type"\s*:\s*"(?:Multi)?Polygon"'
    return files.where(~F.coalesce(F.col("body").rlike(shape), F.lit(False))).select("region_id", F.lit("no polygon").alias("problem"))
