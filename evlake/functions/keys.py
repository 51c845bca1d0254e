"""Digests and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(payload: Column) -> Column:
    """SHA-256 of a JSON text whose key order doesn't matter."""
    return F.sha2(F.to_json(F.parse_json(payload)), 256)


def row_hash(*columns: str) -> Column:
    """SHA-256 of named columns, whatever their order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def record_key(source: Column, native: Column) -> Column:
    return F.concat_ws(":", source, native)


def event_id(first_seen: Column, source_index: Column, position: Column) -> Column:
    """An identifier that sorts by creation: time, then source, then place within its batch."""
    return F.concat(F.date_format(first_seen, "yyyyMMddHHmmssSSS"), F.lpad(source_index.cast("string"), 5, "0"), F.lpad(position.cast("string"), 19, "0"))
