"""Removal of byte strings that occur twice or more, anywhere in a corpus.

Windows of WIDTH bytes are induced from sampled suffixes. A window's sample is the place of its least
k-gram hash, so equal windows have their samples at the same distance. Sampled places are sorted and
grouped by Spark (an external sort with spill) by the bytes around them: at each level of a recursion
over the distance, places are compared by the bytes common to all windows of a node (unlike: no window
is shared), then by the bytes of all its windows (alike: every window is shared); what is neither goes
one level down, at last to single windows. What a place is compared by is a 64-bit hash of the common
bytes, which only brings places together, and a 128-bit digest of the bytes themselves, which alone
decides. Neither all windows nor pairs of copies are ever written out.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, discard, shared_dir, shuffles_dropped, written, written_at

WIDTH = 200
GRAM = 32
#: Bytes of texts that are hashed at a time; longer texts are cut into overlapping parts.
_BLOCK = 1 << 21
_PLACE = np.uint64((1 << 22) - 1)
#: Node sizes of the recursion over a window's distance from its sample.
SIZES = (216, 36, 6, 1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@functools.cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd base and of its inverse, modulo 2**64."""
    base = _BASES[which]
    numbers = np.random.default_rng(which + 1).integers(0, 1 << 64, 256, np.uint64)
    return numbers, *(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b % (1 << 64), np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))


class Rolling:
    """Hashes of all substrings of a byte array, equal for equal strings wherever they stand."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        size = max(_BLOCK * 2, 1 << (len(data) + 1).bit_length())
        numbers, powers, self.inverse = _powers(which, size)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers[data] * powers[: len(data)])))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def grams(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length]


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width keys in a row, from least values to the left and right of block borders."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def samples(parts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Part, place, k-gram hash, least and greatest distance of the windows that each sample stands for, in order."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    nothing = np.zeros(0, np.int64)
    if len(data) < width:
        return nothing, nothing, np.zeros(0, np.uint64), nothing, nothing
    grams = Rolling(data, 0).grams(gram)
    keys = grams * np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0x94D049BB133111EB)
    keys = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    at = (_sliding_least(keys, width - gram + 1) & _PLACE).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), lengths)[: len(at)]
    ends = np.cumsum(lengths)
    window = np.flatnonzero(ends[part] - np.arange(len(at)) >= width)
    at, part = at[window], part[window]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    last = np.append(first[1:], True)[: len(at)]
    place = at[first]
    return part[first], place - (ends - lengths)[part[first]], grams[place], place - window[last], place - window[first]


def _packed(a: np.ndarray, low: np.ndarray, high: np.ndarray, node: np.ndarray | int = 0) -> np.ndarray:
    """A place, the distances of its own windows and a node in one number."""
    return (a << 24) | (low << 16) | (high << 8) | node


def _sampled(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Samples of each text of (doc, row, text); long texts in parts that overlap by a window."""
    parts, owners, offsets = [], [], []
    for i, text in enumerate(batch.column("text").to_pylist()):
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(len(data) - WIDTH + 1, 0), _BLOCK - WIDTH + 1):
            parts.append(data[at : at + _BLOCK])
            owners.append(i)
            offsets.append(at)
    found, block, begin, size = [], [], 0, 0
    for k, p in enumerate([*parts, None]):
        if block and (p is None or size + len(p) > _BLOCK + WIDTH):
            part, *rest = samples(block)
            found.append((part + begin, *rest))
            block, begin, size = [], k, 0
        if p is not None:
            block.append(p)
            size += len(p)
    if not found:
        return None
    part, a, grams, low, high = (np.concatenate(x) for x in zip(*found))
    of, a = np.array(owners, np.int64)[part], a + np.array(offsets, np.int64)[part]
    # neighbouring parts of one text may share a sample, with some of its windows each
    twice = np.flatnonzero((of[1:] == of[:-1]) & (a[1:] == a[:-1])) + 1
    low[twice - 1], high[twice - 1] = np.minimum(low[twice - 1], low[twice]), np.maximum(high[twice - 1], high[twice])
    of, a, grams, low, high = (np.delete(x, twice) for x in (of, a, grams, low, high))
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of)) for k in KEY), pa.array(_packed(a, low, high)), pa.array(grams.view(np.int64))], [*KEY, "place", "core"])


def _compared(level: int):
    """For children at a level of the places of (doc, row, text, places): the hash of their core and the digest of their full bytes.

    A node is a range of distances of a window's start before its sample. Its core are the bytes common
    to all windows of the range, its full bytes those of the place's own windows in it. Equal windows
    have equal cores; equal full bytes at equal distances have equal windows.
    """
    size, above = SIZES[level], SIZES[max(level - 1, 0)]
    fan = above // size

    def compared(data: bytes, packed: np.ndarray, before: int) -> tuple[np.ndarray, ...]:
        """For places within a part of a text that begins before bytes into it."""
        own = np.repeat(packed, fan)
        a, own_low, own_high = (own >> 24) - before, own >> 16 & 255, own >> 8 & 255
        node = (own & 255) * fan + np.tile(np.arange(fan), len(packed))
        bottom = node * size
        top = np.minimum(bottom + size, WIDTH - GRAM + 1) - 1
        low, high = np.maximum(bottom, own_low), np.minimum(top, own_high)
        some = low <= high
        a, own_low, own_high, node, bottom, top, low, high = (x[some] for x in (a, own_low, own_high, node, bottom, top, low, high))
        mixed = node.astype(np.uint64) * np.uint64(_BASES[1])
        core = Rolling(np.frombuffer(data, np.uint8), 0).of(a - bottom, WIDTH - (top - bottom)) ^ mixed
        digest = xxhash.xxh3_128_digest
        full = b"".join([digest(data[i:j], k) for i, j, k in zip((a - high).tolist(), (a - low + WIDTH).tolist(), (low << 8 | high).tolist())])
        halves = np.frombuffer(full, np.int64).reshape(-1, 2)
        return _packed(a + before, own_low, own_high, node), core.view(np.int64), halves[:, 0], halves[:, 1]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, counts = [], []
        lists = batch.column("places")
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy()
        for text, first, last in zip(batch.column("text").to_pylist(), ends.tolist(), ends[1:].tolist()):
            data, packed = text.encode("utf-8", "surrogatepass"), values[first:last]
            n = 0
            for k in range(0, len(data), _BLOCK):
                part = packed[(packed >> 24) // _BLOCK == k // _BLOCK] if len(data) > _BLOCK else packed
                if len(part):
                    begin = max(0, k - WIDTH)
                    out.append(compared(data[begin : k + _BLOCK + WIDTH], part, begin))
                    n += len(out[-1][0])
            counts.append(n)
        columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
        of = pa.array(np.repeat(np.arange(len(counts)), counts))
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in KEY), *columns], [*KEY, "place", "core", "f", "g"])

    return rows


#: What names a document: its id, and a hash of its text in case the id repeats.
KEY = ["doc", "row"]


def row_key(doc_id: F.Column, text: F.Column) -> tuple[F.Column, F.Column]:
    """The KEY columns of a document: rows share them only if they have equal ids and texts, and so are copies of each other."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The byte spans of docs that lie in strings of WIDTH bytes which start anywhere else too.

    Returns (texts, spans): texts(doc, row, text) those that may hold repeats, spans(doc, row, start,
    end) byte ranges that may overlap; doc and row are row_key(). Null texts are empty; texts shorter
    than WIDTH have no spans. Empty input: no rows.

    What a step has written is discarded once the next is written, and its shuffle files go with it:
    space follows the largest step, not their sum. Tables of one row for each core or class are written
    before they are joined, so that Spark can split the places of a very common string among tasks.
    """
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        return _spans(docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text")).where(F.octet_length("text") >= WIDTH))


def _spans(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = keyed.sparkSession
    sampled, old = written_at(arrow_map(keyed, _sampled, "doc long, row long, place long, core long"), "samples")
    common, counted = written_at(sampled.groupBy("core").count().where("count > 1").select("core"), "common")
    places, now = written_at(sampled.join(common, "core").select(*KEY, "place"), "places")
    discard(spark, old)
    discard(spark, counted)

    # the texts that hold places, by bucket: the joins of the levels move only places
    name, buckets = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    keyed.join(places.select(*KEY).distinct(), KEY, "left_semi").write.bucketBy(buckets, *KEY).option("path", path).saveAsTable(name)
    texts = spark.table(name)
    spans = []
    try:
        for level, size in enumerate(SIZES):
            listed = places.groupBy(*KEY).agg(F.collect_set("place").alias("places"))
            nodes, old = written_at(arrow_map(texts.join(listed, KEY), _compared(level), "doc long, row long, place long, core long, f long, g long"), "nodes")
            discard(spark, now)
            # most cores are of one place, or all alike: only the others need their classes counted
            differ = (F.min("f") < F.max("f")) | (F.min("g") < F.max("g"))
            cores, counted = written_at(nodes.groupBy("core").agg(F.count("*").alias("total"), differ.alias("mixed")).where("total > 1").select("core", "mixed"), "cores")
            met, now = written_at(nodes.join(cores, "core"), "met")
            discard(spark, old)
            discard(spark, counted)
            mixed, at = met.where("mixed"), F.xxhash64(*KEY, "place")
            classes, counted = written_at(mixed.groupBy("core", "f", "g").agg(F.count("*").alias("n"), F.min(at).alias("first")), "classes")
            below = (F.col("n") == 1) | (F.col("first") == at)
            judged, old = written_at(mixed.join(classes, ["core", "f", "g"]).select(*KEY, "place", (F.col("n") > 1).alias("alike"), below.alias("below")), "judged")
            discard(spark, counted)
            alike = met.where("not mixed").select(*KEY, "place").unionByName(judged.where("alike").select(*KEY, "place"))
            a, node = F.shiftright("place", 24), F.col("place").bitwiseAND(255)
            low = F.greatest(node * size, F.shiftright("place", 16).bitwiseAND(255))
            high = F.least(node * size + (size - 1), F.shiftright("place", 8).bitwiseAND(255))
            spans.append(written(alike.select(*KEY, (a - high).alias("start"), (a - low + WIDTH).alias("end")), "spans"))
            discard(spark, now)
            places, now = judged.where("below").select(*KEY, "place"), old
        discard(spark, now)
        texts = spark.read.schema(texts.schema).parquet(path)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay, as results read them
    return texts, functools.reduce(DataFrame.unionByName, spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, as maximal ranges in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, spans, kept) of documents that lose bytes: the maximal removed byte ranges, and the remaining bytes, concatenated.

    doc and row are row_key(); rows that share it are cut alike, each for itself. Documents without a row
    here stay whole. The cases of repeated_spans() hold.
    """
    texts, spans = repeated_spans(docs, id_col, text_col)
    listed = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("found"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranges, kept = [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            ranges.append(merged([(s["start"], s["end"]) for s in found]))
            edges = [0, *(x for r in ranges[-1] for x in r), len(data)]
            kept.append(b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2])))
        spans = pa.array([[{"start": s, "end": e} for s, e in r] for r in ranges], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), spans, pa.array(kept, pa.binary())], [*KEY, "spans", "kept"])

    return arrow_map(texts.join(listed, KEY), cut, "doc long, row long, spans array<struct<start: bigint, end: bigint>>, kept binary")
