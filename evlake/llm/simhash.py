"""SimHash near-duplicates: a segment-popcount embedding, a grid join under Manhattan distance, exact checks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evlake.operators.components import connected_components, joined_components

from ._shared import arrow_map, keyed, shuffles_dropped, written

#: Bits in which linked fingerprints may differ, at most.
MAX_BITS = 4
#: Fingerprints that meet in a cell by chance, about; more groups of segments keep it so as a corpus grows.
CELL_ROWS = 32
#: Shingles whose bits are added up at a time.
_BLOCK = 1 << 16
#: The lower bit of each of the 32 two-bit segments, as a signed long.
_LOW = 0x5555555555555555


def fingerprint(text: str | None, words: int) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 if it has no word."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - words)
    starts = np.concatenate(([0], gaps + 1))[:n].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, ends)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.ascontiguousarray(hashes[at : at + _BLOCK])
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text as a signed long; null and wordless texts get 0."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(keyed(docs, id_col, text_col), rows, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each count written in unary within its own two bits.

    So the Manhattan distance of two count vectors is the number of differing bits of two embeddings.
    """
    next_bit = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(next_bit).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(_LOW))
    return either.bitwiseOR(F.shiftleft(both, 1))


def grid_groups(n: int, max_bits: int = MAX_BITS) -> int:
    """Into how many groups the segments of n fingerprints are parted, so that a cell holds few of them by chance.

    Vectors within max_bits agree on all groups but max_bits at least. A group more lets them agree on
    one more, which makes cells smaller and grids more; no number of groups loses a pair. Two random
    segments agree with a probability of 3/8.
    """
    groups = max_bits + 3
    while groups < 12 and n * 0.375 ** (32 * (groups - max_bits) / groups) > CELL_ROWS:
        groups += 1
    return groups


def _masks(max_bits: int, groups: int) -> list[int]:
    """The grids: masks over all choices of groups - max_bits of the groups."""
    parts = [sum(3 << 2 * s for s in part.tolist()) for part in np.array_split(np.arange(32), groups)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(chosen) for chosen in combinations(parts, groups - max_bits))]


def _near(a: Column, b: Column, max_bits: int) -> Column:
    """The Manhattan distance of the embeddings, a lower bound, and then the distance itself."""
    distance = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    return (distance(embedding(a), embedding(b)) <= max_bits) & (distance(a, b) <= max_bits)


def _cells(rows: DataFrame, masks: list[int]) -> DataFrame:
    """rows with each of their cells; joins of these hint that they be merged, as Spark sizes an exploded table by what it was before, and would broadcast it."""
    vector = embedding(F.col("fp"))
    return rows.select("*", F.posexplode(F.array(*[vector.bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"))


_IN_CELL = "x.grid = y.grid and x.cell = y.cell"


def stars(fps: DataFrame, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame, list[int]]:
    """(a, b): each fingerprint of fps(fp) with the least one of each of its cells, if they differ in max_bits or fewer bits.

    Nothing but such links leaves the join. Also gives the different fingerprints, and the grids.
    """
    different = written(fps.select("fp").where("fp is not null").distinct(), "different")
    masks = _masks(max_bits, grid_groups(different.count(), max_bits))
    least = written(_cells(different, masks).groupBy("grid", "cell").agg(F.min("fp").alias("least"), F.max("fp").alias("last")).where("least < last").drop("last"), "least")
    near = F.expr(_IN_CELL) & (F.col("x.fp") != F.col("y.least")) & _near(F.col("y.least"), F.col("x.fp"), max_bits)
    met = _cells(different, masks).alias("x").hint("merge").join(least.alias("y"), near)
    return written(met.select(F.col("y.least").alias("a"), F.col("x.fp").alias("b")).distinct(), "stars"), different, masks


def _apart(rooted: DataFrame, masks: list[int], max_bits: int) -> DataFrame:
    """Pairs x, y of rows of rooted(fp, root) in a cell, near each other and not connected yet."""
    others = F.expr(_IN_CELL + " and x.fp < y.fp and x.root <> y.root") & _near(F.col("x.fp"), F.col("y.fp"), max_bits)
    return _cells(rooted, masks).alias("x").hint("merge").join(_cells(rooted, masks).alias("y"), others)


def components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for each different fingerprint of fps(fp): root is the least one that links of max_bits or fewer differing bits reach.

    Only different fingerprints meet, by the cells of grids over their bit counts. First each meets the
    least one of each of its cells; then only those of a cell meet that this has not connected. So a
    dense group gives a row for each member and cell, and not for each pair.
    """
    found, different, masks = stars(fps, max_bits)
    roots = connected_components(found, "a", "b").withColumnRenamed("node", "fp")
    rooted = written(different.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")
    more = _apart(rooted, masks, max_bits).select(F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct()
    return joined_components(rooted.withColumnRenamed("fp", "node"), more, "a", "b").withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row for each input row.

    component_id is the smallest id that links of max_bits or fewer differing bits reach, the row's own
    included. Equal fingerprints are one node, whatever their number. Rows with a null id take part and
    never give a component its name (null if all its ids are null). Empty input: no rows.
    """
    with shuffles_dropped(docs.sparkSession):
        found = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
        rooted = written(components(found, max_bits), "components")
        first = found.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(rooted, "fp")
        named = written(first.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
        of_fp = written(rooted.join(named, "root").select("fp", "component_id"), "of_fp")
    return found.join(of_fp, "fp").select("doc_id", "fp", "component_id")
