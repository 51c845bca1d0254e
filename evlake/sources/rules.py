"""Configuration tables, and all that is wrong with them at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_SCHEMA = "source_id string, adapter string, enabled boolean, priority int, default_kinds array<string>, keep_region string, default_tz string"
PROFILE_SCHEMA = "profile_id string, region_id string, topic_id string, sources array<string>, trust array<string>"

#: Source adapters by name: raw records to drafts.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_source(name: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    """Makes an adapter known; a name is registered once."""
    if name in ADAPTERS:
        raise ValueError(f"adapter {name!r} is registered already")
    ADAPTERS[name] = parse


def parse_each(raw: DataFrame, parse: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Drafts of a plain Python parser, called for each record, with error and native_id where it failed: one bad record stops no other."""
    names = [f.name for f in raw.sparkSession.createDataFrame([], schema).schema.fields]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                try:
                    out += [{**{n: None for n in names}, **draft, "native_id": record["native_id"], "error": None} for draft in parse(record)]
                except Exception as error:  # noqa: BLE001  a parser may fail in any way
                    out.append({**{n: None for n in names}, "native_id": record["native_id"], "error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(out, columns=[*[n for n in names if n != "native_id"], "native_id", "error"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raw.sparkSession.createDataFrame([], schema).schema.fields if f.name != "native_id")
    return raw.mapInPandas(rows, f"{fields}, native_id string, error string")


def source_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def profile_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def check_rules(sources: DataFrame, profiles: DataFrame, regions: DataFrame, topics: DataFrame, adapters: list[str]) -> DataFrame:
    """(subject, problem): repeated sources, unknown adapters, and names that profiles and sources use but nothing defines."""
    known = sources.select("source_id").distinct()
    twice = sources.groupBy("source_id").count().where("count > 1").select(F.col("source_id").alias("subject"), F.lit("repeated source").alias("problem"))
    strange = sources.where(~F.col("adapter").isin(adapters)).select(F.col("source_id").alias("subject"), F.concat(F.lit("unknown adapter "), "adapter").alias("problem"))

    def missing(users: DataFrame, subject: str, name: F.Column, defined: DataFrame, what: str) -> DataFrame:
        used = users.select(F.col(subject).alias("subject"), name.alias("_name")).where("_name is not null")
        return used.join(defined.toDF("_name"), "_name", "left_anti").select("subject", F.concat(F.lit(f"unknown {what} "), "_name").alias("problem"))

    parts = [
        strange, missing(sources, "source_id", F.col("keep_region"), regions.select("region_id"), "region"), missing(profiles, "profile_id", F.col("region_id"), regions.select("region_id"), "region"),
        missing(profiles, "profile_id", F.col("topic_id"), topics.select("topic_id"), "topic"), missing(profiles, "profile_id", F.explode("sources"), known, "source"), missing(profiles, "profile_id", F.explode("trust"), known, "trusted source"),
    ]
    out = twice
    for part in parts:
        out = out.unionByName(part)
    return out.distinct()
