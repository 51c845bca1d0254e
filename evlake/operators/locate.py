"""Locations from addresses: a cache of look-ups, then postal and place centroids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import address_key, city_state, place_key, state_abbr

RETRY_DAYS = 30
LOOKUP_BUDGET = 200


def missing_locations(events: DataFrame, now: Column) -> DataFrame:
    return events.where(F.col("lat").isNull() & F.col("address").isNotNull() & (F.col("attendance_mode") != "online") & (F.coalesce("end_utc", "start_utc") >= now))


def missing_zones(events: DataFrame, now: Column) -> DataFrame:
    return events.where(F.col("tz").isNull() & F.col("lat").isNotNull() & (F.coalesce("end_utc", "start_utc") >= now))


def lookup_plan(events: DataFrame, cache: DataFrame, now: Column, retry_days: int = RETRY_DAYS) -> DataFrame:
    """(address_key, first_start, plan, lat, lon, precision) for each different address: cached, offline or needs_lookup.

    A miss in the cache is looked up again after retry_days; until then only centroids answer.
    """
    keys = events.groupBy(address_key(F.col("address")).alias("address_key")).agg(F.min("start_utc").alias("first_start"))
    joined = keys.join(cache, "address_key", "left")
    recent = F.col("looked_up_at") > now - F.make_dt_interval(F.lit(retry_days))
    plan = F.when(F.col("lat").isNotNull(), "cached").when(recent, "offline").otherwise("needs_lookup")
    return joined.select("address_key", "first_start", plan.alias("plan"), "lat", "lon", F.when(F.col("lat").isNotNull(), F.coalesce("precision", F.lit("address"))).alias("precision"))


def budgeted(plan: DataFrame, budget: int = LOOKUP_BUDGET) -> DataFrame:
    """The addresses to look up in a run, those of the earliest events; a request limit of the service."""
    return plan.where("plan = 'needs_lookup'").orderBy("first_start", "address_key").limit(budget)


def postal_points(addresses: DataFrame, centroids: DataFrame, key: str = "address_key") -> DataFrame:
    """(key, lat, lon, precision): the centroid of the last 'ST 12345' or 'California 12345' pair whose state and code are known.

    centroids(zip, lat, lon) is a table of a country's codes, a few megabytes.
    """
    text, pattern = F.upper(key), r"\b([A-Z]{2}|CALIFORNIA)\s+(\d{5})(?:-\d{4})?\b"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("state"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("zip"))
    exploded = addresses.select(F.col(key), F.posexplode(pairs).alias("_pos", "_pair")).where(state_abbr(F.col("_pair.state")).isNotNull())
    joined = exploded.join(centroids, F.col("_pair.zip") == F.col("zip"))
    return joined.groupBy(key).agg(F.max_by(F.struct("lat", "lon"), "_pos").alias("_at")).select(key, "_at.lat", "_at.lon", F.lit("postal").alias("precision"))


def place_points(addresses: DataFrame, centroids: DataFrame, key: str = "address_key") -> DataFrame:
    """(key, lat, lon, precision) by state and city; centroids(state, place, lat, lon) with places in place_key() form."""
    parts = addresses.select(key, city_state(F.col(key)).alias("_cs")).where("_cs is not null").select(key, F.col("_cs.state").alias("state"), place_key(F.col("_cs.city")).alias("place"))
    return parts.join(centroids, ["state", "place"]).select(key, "lat", "lon", F.lit("place").alias("precision"))


def enrich(events: DataFrame, cache: DataFrame, zips: DataFrame, places: DataFrame, now: Column, geocode: Callable[[DataFrame], DataFrame] | None = None, budget: int = LOOKUP_BUDGET) -> DataFrame:
    """(address_key, lat, lon, precision): the best answer for each address that events lack.

    geocode(keys) -> (address_key, lat, lon) is asked for the budgeted addresses alone.
    """
    plan = lookup_plan(missing_locations(events, now), cache, now)
    keys = plan.select("address_key")
    answers = [plan.where("plan = 'cached'").select("address_key", "lat", "lon", "precision", F.lit(0).alias("rank"))]
    if geocode:
        answers.append(geocode(budgeted(plan, budget).select("address_key")).where("lat is not null").select("address_key", "lat", "lon", F.lit("address").alias("precision"), F.lit(1).alias("rank")))
    for rank, found in ((2, postal_points(keys, zips)), (3, place_points(keys, places))):
        answers.append(found.withColumn("rank", F.lit(rank)))
    all_answers = answers[0]
    for more in answers[1:]:
        all_answers = all_answers.unionByName(more)
    best = all_answers.groupBy("address_key").agg(F.min_by(F.struct("lat", "lon", "precision"), "rank").alias("b"))
    return best.select("address_key", "b.lat", "b.lon", "b.precision")
