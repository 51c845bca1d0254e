"""Commits in shared storage: what a folder holds is what its last version says, and versions appear whole or not at all."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import discard

#: Versions that stay readable.
KEPT = 20


def _all(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("value string, version long").text(f"{path}/_versions", wholetext=True)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, value) of the last version; (0, {}) if nothing was ever committed."""
    found = _all(spark, path)
    last = found.orderBy(F.desc("version")).limit(1).collect() if found is not None else []
    return (last[0].version, json.loads(last[0].value)) if last else (0, {})


def commit(spark: SparkSession, path: str, after: int, value: dict) -> int:
    """Makes value the version that follows after; fails if another writer was first.

    A version is one small file that Spark's committer moves into place, so a reader sees the version
    before until this one is whole.
    """
    number = after + 1
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("error").text(f"{path}/_versions/version={number}")
    if number > KEPT:
        discard(spark, f"{path}/_versions/version={number - KEPT}")
    return number
