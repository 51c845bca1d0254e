"""Line deduplication: hashed line keys, documents per key, and texts put together again without the repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ASCII_LOWER, SPACE, arrow_map, written

#: Shorter keys are never dropped.
MIN_CHARS = 10
#: A key in so many documents loses its lines in all of them but one.
MIN_DOCS = 2


def line_keys(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """The 16-byte hash of each different key of a text's lines, with the places of these lines; short keys are left out."""
    out: dict[bytes, list[int]] = {}
    for place, line in enumerate((text or "").split("\n")):
        key = line.strip(SPACE)
        if len(key) >= min_chars:
            out.setdefault(xxhash.xxh3_128_digest(key.translate(ASCII_LOWER).encode("utf-8", "surrogatepass")), []).append(place)
    return out


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t, h, g, places) of docs(doc_id, t, text): the 128-bit hash of each different line key of each row, and where it stands."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, places, ends, counts = [], [], [0], []
        for text in batch.column("text").to_pylist():
            keys = line_keys(text, min_chars)
            counts.append(len(keys))
            hashes.extend(keys)
            for at in keys.values():
                places.extend(at)
                ends.append(len(places))
        halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        of = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("t").take(of), pa.array(halves[:, 0]), pa.array(halves[:, 1]), at], ["doc_id", "t", "h", "g", "places"])

    return arrow_map(docs.select("doc_id", "t", "text"), rows, "doc_id long, t long, h long, g long, places array<int>")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines dropped whose key min_docs documents have, but for the one of the smallest doc_id; and n_lines (before), n_dropped (long).

    docs needs doc_id and text; other columns stay as they are, but for n_lines and n_dropped, which
    are replaced. A null or empty text is one empty line (its text becomes ""). Rows with equal ids
    are one document; a null id is the smallest of all. Empty input: no rows.

    Lines travel as hashes with their places; texts are put together again by the places that go.
    """
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    found = written(lines(keyed, min_chars), "lines")
    holders = found.select("h", "g", "doc_id").distinct().groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))
    # read from storage, so that Spark can split the rows of a line that many documents have
    repeated = written(holders.where(F.col("n") >= min_docs).drop("n"), "repeated")
    # rows that repeat have the same places, which count once
    gone = found.join(repeated, ["h", "g"]).where("doc_id > keeper").groupBy("doc_id", "t").agg(F.flatten(F.collect_set("places")).alias("gone"))
    joined = keyed.select("doc_id", "t", "row").join(written(gone, "gone"), ["doc_id", "t"], "left").select("row", "gone")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_dropped = [], [], []
        row = batch.column("row")
        for text, drop in zip(row.field("text").to_pylist(), batch.column("gone").to_pylist()):
            parts = (text or "").split("\n")
            n_lines.append(len(parts))
            if drop:
                places = set(drop)
                parts = [p for k, p in enumerate(parts) if k not in places]
            n_dropped.append(n_lines[-1] - len(parts))
            texts.append("\n".join(parts))
        columns = [pa.array(texts, pa.string()) if n == "text" else row.field(n) for n in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return arrow_map(joined, rows, ", ".join(f"`{n}` {types[n]}" for n in names) + ", n_lines long, n_dropped long")
