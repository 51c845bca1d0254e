"""Packing of documents into training sequences, filled with lexical neighbours from a sharded BM25 index."""

from __future__ import annotations

import functools
import os
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._shared import arrow_map, keyed, written

WINDOW = 2048
#: Ids of a shard of the index, about: what one task holds at a time.
SHARD_IDS = 2_000_000
#: Terms in more than this share of a shard's pieces are kept as a row of all pieces, which adds up faster; it changes no score.
DENSE_SHARE = 1 / 8
K1, B = 1.2, 0.75
#: Clusters by which rests are dealt to shards, at most, and rests that these are fitted on.
MAX_CLUSTERS, FIT_RESTS = 64, 2000
#: Terms by which a piece is dealt to its cluster, those whose weights differ most among clusters.
TELLING_TERMS = 4096
#: Words whose ids a worker keeps, the first it meets; others are encoded where they occur.
CACHE_WORDS = 1_000_000
#: Bytes of texts whose words are looked up together, about; the more, the fewer look-ups.
TEXT_BYTES = 4 << 20
#: Neighbours that are sorted at first; where they don't fill a window, all are.
FEW = 32


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next from U+0100 on."""
    visible = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b) if seen else chr(256 + visible[:b].count(False)) for b, seen in enumerate(visible)]


_BYTE_LETTERS = dict(enumerate(_byte_letters()))
#: Marks that one pre-token holds all of, if they follow a word's letters: no sign of a special token, and no apostrophe.
CLOSING_MARKS = b".,!?;:#*$%&"
_WHITE = b" \t\n\x0b\x0c\r"
#: Of each byte: 1 white space, 2 a letter a-z, 3 a closing mark, 0 any other.
_KINDS = bytes(1 if b in _WHITE else 2 if 97 <= b <= 122 else 3 if b in CLOSING_MARKS else 0 for b in range(256))
#: Whether a unit begins at a byte, by 4 times the kind before it and its own: after white space, and between a letter and a mark.
_BEGINS = bytes(own != 1 and (before == 1 or {before, own} == {2, 3}) for before in range(4) for own in range(4)).ljust(256, b"\0")


class WordIds(dict):
    """Ids of white-space separated words, by word; these are independent, as the pre-tokeniser never joins across white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.kind, self.merges = self.type[1:].replace("u2", "H").replace("u4", "I"), self.tokenizer.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        """Encodes a new word, and keeps it if there is room."""
        # letters before closing marks are a word of their own to the pre-tokeniser
        bare = word.rstrip(CLOSING_MARKS)
        if len(bare) < len(word) and bare and self.letters(bare) is not None:
            ids = self[bare] + self[word[len(bare) :]]
        elif (letters := self.letters(word)) is not None:
            # one pre-token, which goes straight to the merges
            ids = array(self.kind, [t.id for t in self.merges(letters)]).tobytes()
        else:
            ids = array(self.kind, self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if len(self) < CACHE_WORDS and len(word) <= 64:
            self[word] = ids
        return ids

    def letters(self, word: bytes) -> str | None:
        """A word of letters alone as the merges read it, a character for each byte; else None."""
        if word.isalpha() and word.islower():
            return word.decode()
        text = word.decode("utf-8", "replace")
        if not (text.lower() == text and unicodedata.is_normalized("NFC", text)):
            text = self.tokenizer.normalizer.normalize_str(text)
        return text.encode().decode("latin-1").translate(_BYTE_LETTERS) if text.isalpha() else None

    def ids(self, text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        # the tokenizer lowers case itself; its special tokens are read before that
        return b"".join(map(self.__getitem__, (data if b"<|" in data else data.lower()).split()))

    def looked_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words; the new ones are merged one after the other, which takes less time than between look-ups."""
        found = list(map(self.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        ids, ends = array(self.kind), [0]
        for i in new:
            if (letters := self.letters(words[i])) is not None:
                ids.extend([t.id for t in self.merges(letters)])
            ends.append(len(ids))
        data, width = ids.tobytes(), ids.itemsize
        for i, begin, end in zip(new, ends, ends[1:]):
            found[i] = data[width * begin : width * end] if begin < end else self[words[i]]
            if len(self) < CACHE_WORDS and len(words[i]) <= 64:
                self[words[i]] = found[i]
        return found

    def ids_of(self, texts: pa.Array) -> list[bytes]:
        """ids() of each text, null as empty; what several texts have in common is looked up once for all of them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = pc.match_substring(texts, "<|")
        whole = {i: self.ids(texts[i].as_py()) for i in np.flatnonzero(special).tolist()}
        if whole:
            texts = pc.if_else(special, "", texts)
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = memoryview(data or b"")[ends[0] : ends[-1]].tobytes().lower()
        ends = ends - ends[0]
        kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
        begins = np.empty(len(data), bool)
        begins[1:] = np.frombuffer((kinds[:-1] << 2 | kinds[1:]).tobytes().translate(_BEGINS), bool)
        first = ends[:-1][np.diff(ends) > 0]
        begins[first] = kinds[first] != 1
        at = np.flatnonzero(begins)
        units = data.translate(None, _WHITE)
        # the places of units without white space, and of the texts among units
        places = np.append(np.cumsum(kinds != 1, dtype=np.int32 if len(data) < 1 << 31 else np.int64)[at] - 1, len(units)).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(units)]).dictionary_encode()
        _, bounds, units = found.dictionary.buffers()
        bounds, units = np.frombuffer(bounds, np.int64)[: len(found.dictionary) + 1].tolist(), (units or b"") and units.to_pybytes()
        known = pa.array(self.looked_up([units[a:b] for a, b in zip(bounds, bounds[1:])]), pa.large_binary())
        _, places, ids = known.take(found.indices).buffers()
        cuts = np.frombuffer(places, np.int64)[np.searchsorted(at, ends)].tolist()
        ids = memoryview(ids or b"")
        return [whole[i] if i in whole else ids[a:b].tobytes() for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each document's ids with end_id, cut every window ids.

    ids is binary, in unsigned 16- or 32-bit little-endian numbers by the size of the vocabulary. A null
    or empty text is end_id alone.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = word_ids(tokenizer_path)
        width, end = np.dtype(words.type).itemsize, np.array([end_id], words.type).tobytes()
        of, starts, lengths, totals, ids = [], [], [], [], []
        for i, data in enumerate(words.ids_of(batch.column("text"))):
            data += end
            n = len(data) // width
            for at in range(0, n, window):
                of.append(i)
                starts.append(at)
                lengths.append(min(window, n - at))
                totals.append(n)
                ids.append(data[at * width : (at + window) * width])
        columns = [batch.column("doc_id").take(pa.array(of)), *(pa.array(x, pa.int64()) for x in (starts, lengths, totals)), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])

    return arrow_map(keyed(docs, id_col, text_col), rows, "doc_id long, start long, length long, doc_tokens long, ids binary", TEXT_BYTES)


def document_frequencies(pieces: DataFrame, number_type: str, n_terms: int) -> np.ndarray:
    """In how many pieces each id occurs; its length is the vocabulary's, whatever the corpus."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, last = np.zeros(n_terms, np.int64), np.empty(n_terms, np.int64)
        for data in batch.column("ids").to_pylist():
            ids = np.frombuffer(data, number_type)
            places = np.arange(len(ids))
            last[ids] = places
            counts[ids[last[ids] == places]] += 1  # each id once, where it comes last
        terms = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts[terms])], ["term", "n"])

    found = arrow_map(pieces.select("ids"), rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_terms, np.int64)
    out[found["term"].to_numpy(int)] = found["n"].to_numpy(int)
    return out


class Dealer:
    """Deals pieces to shards by their words, so that the neighbours of a seed are mostly in its own shard.

    Clusters of BM25 vectors by cosine, fitted on a sample; what each holds is counted over all pieces
    before they are dealt, and a cluster that holds more than a shard is parted by number.
    """

    def __init__(self, sample: list[np.ndarray], idf: np.ndarray, mean_length: float, n_ids: int, shard_ids: int) -> None:
        self.idf, self.mean_length = idf, mean_length
        k = max(1, min(MAX_CLUSTERS, -(-n_ids // shard_ids), len(sample)))
        vectors = [self.vector(x) for x in sample]
        self.centers = np.zeros((len(idf), k), np.float32)
        rng = np.random.default_rng(0)
        for j, i in enumerate(rng.choice(len(sample), k, replace=False) if sample else []):
            self.centers[vectors[i][0], j] = vectors[i][1]
        of = np.zeros(len(sample), int)
        for _ in range(6 if k > 1 else 0):
            of = np.array([self.nearest(v) for v in vectors])
            sums = np.zeros_like(self.centers)
            for (terms, weights), j in zip(vectors, of):
                sums[terms, j] += weights
            self.centers = sums / np.maximum(np.linalg.norm(sums, axis=0), 1e-9)
        # only terms that tell clusters apart are looked up for all pieces
        weights = idf[:, None] * self.centers
        telling = np.argsort(-np.ptp(weights, axis=1), kind="stable")[:TELLING_TERMS]
        self.row = np.full(len(idf), -1, np.int32)
        self.row[telling] = np.arange(len(telling))
        self.weights = np.ascontiguousarray(weights[telling])

    def vector(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        terms, tf = np.unique(ids, return_counts=True)
        weights = self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / self.mean_length))
        return terms, (weights / max(np.linalg.norm(weights), 1e-9)).astype(np.float32)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray]) -> int:
        return int((vector[1] @ self.centers[vector[0]]).argmax())

    def cluster(self, ids: np.ndarray) -> int:
        if self.weights.shape[1] == 1:
            return 0
        rows = self.row.take(ids)
        return int(self.weights.take(rows[rows >= 0], 0).sum(0).argmax())


def shards_of(clusters: DataFrame, shard_ids: int) -> DataFrame:
    """clusters(cluster, number, length, ...) with shard: each cluster in as many parts as it needs, counted over all its rows.

    The counts are a row for each cluster, MAX_CLUSTERS at most.
    """
    held = {r.cluster: r.n for r in clusters.groupBy("cluster").agg(F.sum("length").alias("n")).collect()}
    parts = [max(1, -(-held.get(j, 0) // shard_ids)) for j in range(max(held, default=0) + 1)]
    first = np.cumsum([0, *parts[:-1]]).tolist()
    of = lambda values: F.element_at(F.array(*map(F.lit, values)).cast("array<bigint>"), F.col("cluster") + 1)
    return clusters.withColumn("shard", of(first) + F.pmod(F.xxhash64("number"), of(parts))).drop("cluster")


class Bm25Shard:
    """The inverted index of a shard's pieces, weights ready to add."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n_terms = len(idf)
        pairs, tf = np.unique(np.concatenate(ids).astype(np.int64) + np.repeat(np.arange(len(ids)), lengths) * n_terms, return_counts=True)
        docs, terms = np.divmod(pairs, n_terms)
        weights = (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs] / mean_length))).astype(np.float32)
        self.own = np.searchsorted(docs, np.arange(len(ids) + 1))
        self.terms, self.weights = terms, weights
        order = np.argsort(terms, kind="stable")
        self.docs, self.by_term = docs[order].astype(np.int32), weights[order]
        self.begin = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.n = len(ids)
        held = np.diff(self.begin)
        common = np.flatnonzero(held > max(1, DENSE_SHARE * self.n))
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        for row, t in zip(self.rows, common.tolist()):
            at = slice(self.begin[t], self.begin[t + 1])
            row[self.docs[at]] = self.by_term[at]

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> np.ndarray:
        """Unused pieces that share a term with the seed, by BM25 over all its terms, the best first, ties by place.

        With most, at least so many of the best, if there are so many.
        """
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        row = self.row[terms]
        scores = np.add.reduce(self.rows[row[row >= 0]], 0)
        rare = terms[row < 0]
        if len(rare):
            begin, held = self.begin[rare], self.begin[rare + 1] - self.begin[rare]
            # the places of all the rare terms' postings, one after the other
            at = np.arange(held.sum()) + np.repeat(begin - np.cumsum(held) + held, held)
            scores += np.bincount(self.docs[at], self.by_term[at], self.n).astype(np.float32)
        found = np.flatnonzero((scores > 0) & unused)
        if most and len(found) > 2 * most:
            found = found[scores[found] >= np.partition(scores[found], len(found) - most)[len(found) - most]]
        return found[np.argsort(-scores[found], kind="stable")]


def fill(lengths: list[int], neighbours: Callable[..., np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start within it, length, sequence, offset): pieces dealt to windows, a seed and its neighbours each.

    neighbours(seed, unused) are the pieces to fill up with, the best first; with a number as a third
    argument it may leave out all but so many of them. A neighbour that doesn't fit is cut; its rest stays
    for later. The last window is dealt out over sequences whose lengths are powers of two, so nothing needs
    padding.
    """
    out, sequence = [], 0
    rest, unused = np.array(lengths, np.int64), np.ones(len(lengths), bool)
    left = sum(lengths)
    seed = 0

    def queued(seed: int, room: int) -> list[int]:
        """Unused pieces that fill the room, the last of them perhaps in part: neighbours, then the next in order."""
        for most in (FEW, None):
            found = neighbours(seed, unused, most)
            held = np.cumsum(rest[found])
            if len(found) and held[-1] >= room:
                return found[: np.searchsorted(held, room) + 1].tolist()
        others = unused.copy()
        others[found] = False
        return [*found.tolist(), *np.flatnonzero(others)[:room].tolist()]

    while left:
        while not unused[seed]:
            seed += 1
        room = size = window if left >= window else 1 << (left.bit_length() - 1)
        queue = [seed]
        while room:
            for piece in queue:
                n = min(int(rest[piece]), room)
                out.append((piece, lengths[piece] - int(rest[piece]), n, sequence, size - room))
                rest[piece] -= n
                room -= n
                unused[piece] = rest[piece] > 0
                if not room:
                    break
            if room:
                queue = queued(seed, room)
        left -= size
        sequence += 1
    return out


def rests(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(whole windows, rests) of all documents, each piece with a number of its own, written to shared storage."""
    pieces = tokenised(docs, tokenizer_path, end_id, window, id_col, text_col).withColumn("number", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    return pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)


def dealer_of(left: DataFrame, number_type: str, n_terms: int, shard_ids: int) -> Dealer:
    """The Dealer of rests(), with the term statistics of all of them and clusters of a sample."""
    n_rests, n_ids = left.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    seen = document_frequencies(left, number_type, n_terms)
    idf = np.log1p((n_rests - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    sample = left.orderBy(F.xxhash64("number")).limit(FIT_RESTS).select("ids").toArrow() if n_ids > shard_ids else None
    texts = [np.frombuffer(x.as_py(), number_type) for x in sample["ids"]] if sample else []
    return Dealer(texts, idf, max(n_ids / max(n_rests, 1), 1.0), n_ids, shard_ids)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): every id of every document in exactly one piece.

    Whole windows of long documents are sequences of their own; the rest of each document is dealt by
    its words to a shard, and only there are neighbours sought. What clusters of words hold is counted over
    all rests, so a shard has about shard_ids ids at most, whatever the sample met. Term statistics are
    those of all rests. ids is binary, unsigned 32-bit little-endian.
    Null and empty texts are end_id alone; repeated rows, and rows without an id, are packed as often as
    they come, wherever there is room; empty input: no rows.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    words = word_ids(tokenizer_path)
    number_type, n_terms = words.type, max(words.tokenizer.get_vocab_size(), end_id + 1)
    whole, left = rests(docs, tokenizer_path, end_id, window, id_col, text_col)
    dealer = docs.sparkSession.sparkContext.broadcast(dealer_of(left, number_type, n_terms, shard_ids))

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column("cluster", pa.array([dealer.value.cluster(np.frombuffer(x, number_type)) for x in batch.column("ids").to_pylist()], pa.int32()))

    def packed(found: pa.Table) -> pa.Table:
        found = found.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("number", "ascending")]).combine_chunks()
        ids = [np.frombuffer(x, number_type) for x in found["ids"].to_pylist()]
        index = Bm25Shard(ids, dealer.value.idf, dealer.value.mean_length)
        rows = fill([len(x) for x in ids], index.neighbours, window)
        of, at, length, sequence, offset = np.array(rows, np.int64).T
        shard = found["shard"][0].as_py()
        return pa.table({
            "doc_id": found["doc_id"].take(pa.array(of)), "start": pa.array(found["start"].to_numpy()[of] + at), "length": pa.array(length), "doc_tokens": found["doc_tokens"].take(pa.array(of)),
            "ids": pa.array([ids[i][a : a + n].astype("<u4").tobytes() for i, a, n in zip(of.tolist(), at.tolist(), length.tolist())], pa.binary()),
            "sequence_id": pa.array(2 * (shard << 32 | sequence) + 1), "offset": pa.array(offset),
        })

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    columns = "doc_id long, start long, length long, doc_tokens long, ids binary, number long, cluster int"
    clusters = written(arrow_map(left, placed, columns), "clusters")
    dealt = shards_of(clusters, shard_ids).groupBy("shard").applyInArrow(packed, schema)

    def widened(batch: pa.RecordBatch) -> pa.RecordBatch:
        wide = pa.array([np.frombuffer(x, number_type).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()], pa.binary())
        return batch.set_column(batch.schema.get_field_index("ids"), "ids", wide)

    numbered = whole.withColumn("sequence_id", 2 * F.col("number")).withColumn("offset", F.lit(0).cast("long")).drop("number")
    return dealt.unionByName(arrow_map(numbered, widened, schema))
