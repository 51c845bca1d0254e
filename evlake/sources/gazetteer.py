"""Centroid tables from gazetteer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import place_key, place_name


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A pipe-separated file with a header, its column names trimmed."""
    rows = spark.read.csv(path, sep="|", header=True)
    return rows.toDF(*[c.strip() for c in rows.columns])


def zip_centroids(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim("GEOID").alias("zip"), F.round(F.col("INTPTLAT").cast("double"), 5).alias("lat"), F.round(F.col("INTPTLONG").cast("double"), 5).alias("lon"))


def place_centroids(rows: DataFrame) -> DataFrame:
    """(state, place, lat, lon): of places with one name in a state the one with most land, then the least id."""
    point = F.struct(F.round(F.col("INTPTLAT").cast("double"), 5).alias("lat"), F.round(F.col("INTPTLONG").cast("double"), 5).alias("lon"))
    best = rows.groupBy(F.trim("USPS").alias("state"), place_key(place_name(F.col("NAME"))).alias("place")).agg(F.max_by(point, F.struct(F.col("ALAND").cast("bigint"), -F.col("GEOID").cast("bigint"))).alias("p"))
    return best.select("state", "place", "p.lat", "p.lon")
