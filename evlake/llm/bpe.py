"""Byte-level BPE: pre-tokens by an associative scan over codepoint classes, cached pair merging, exact decoding."""

from __future__ import annotations

import base64
import functools
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, keyed

#: Words whose ids a worker keeps; beyond, it starts anew.
CACHE_WORDS = 600_000
#: Code points, about, that are classified at a time.
_BLOCK = 1 << 20

# Symbols of the pre-tokeniser. Letters that can continue an apostrophe have symbols of their own;
# r, v and l only if followed by the letter that completes 're, 've or 'll.
_SPACE, _BLANK, _LETTER, _NUMBER, _OTHER, _QUOTE, _SHORT, _PAIR, _CUT = range(9)
# States: what the last code point belongs to. QUOTED: a ' that begins a token; HALF: the first
# of two letters after it; DONE: a complete contraction; GLUE: a single space before what follows.
_START, _WHITE, _GLUE, _WORD, _DIGITS, _MARKS, _QUOTED, _HALF, _DONE = range(9)


def _step(state: int, symbol: int) -> int:
    """The state after a code point; _CUT is the end of a block of texts, where everything starts anew."""
    if state == _HALF:
        return _DONE
    if state == _QUOTED and symbol in (_SHORT, _PAIR):
        return _DONE if symbol == _SHORT else _HALF
    if symbol == _QUOTE:
        return _MARKS if state in (_GLUE, _MARKS, _QUOTED) else _QUOTED
    return {_SPACE: _GLUE, _BLANK: _WHITE, _LETTER: _WORD, _SHORT: _WORD, _PAIR: _WORD, _NUMBER: _DIGITS, _OTHER: _MARKS, _CUT: _START}[symbol]


def _begins(state: int, symbol: int) -> bool:
    """Whether a token begins at a code point, given the state before it; white space is settled later."""
    if state == _HALF or state == _QUOTED and symbol in (_SHORT, _PAIR):
        return False
    kind = {_LETTER: 0, _SHORT: 0, _PAIR: 0, _NUMBER: 1, _OTHER: 2, _QUOTE: 2, _SPACE: 3, _BLANK: 3, _CUT: 4}[symbol]
    return {_START: True, _DONE: True, _GLUE: False, _WHITE: kind != 3, _WORD: kind != 0, _DIGITS: kind != 1, _MARKS: kind != 2, _QUOTED: kind != 2}[state]


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions that symbols generate, under composition.

    Returns the element of each symbol, the product table (first, then), the element's state from
    START, and the begin table (state, symbol).
    """
    symbols = [tuple(_step(s, c) for s in range(9)) for c in range(9)]
    elements = [tuple(range(9)), *dict.fromkeys(symbols)]
    known = {e: i for i, e in enumerate(elements)}
    for e in elements:  # grows while it is read
        for c in symbols:
            made = tuple(c[s] for s in e)
            if made not in known:
                known[made] = len(elements)
                elements.append(made)
    product = np.array([[known[tuple(b[s] for s in a)] for b in elements] for a in elements], np.uint8)
    begins = np.array([[_begins(s, c) for c in range(9)] for s in range(9)])
    return np.array([known[c] for c in symbols], np.uint8), product, np.array([e[_START] for e in elements], np.uint8), begins


def _scan(elements: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inclusive prefix products, work-efficient: rows are scanned side by side, then their totals."""
    n = len(elements)
    if n <= 64:
        out = elements.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    width = 64
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)  # element 0 is the identity
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, size = product.ravel(), product.shape[0]
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.int32) * size + grid[i]]
    before = np.zeros(rows, np.uint8)
    before[1:] = _scan(grid[-1], product)[:-1]
    grid = flat[before.astype(np.int32)[None, :] * size + grid]
    return grid.T.ravel()[:n]


def _members(pattern: str, points: np.ndarray) -> np.ndarray:
    """Those of the code points that a class matches, by the Unicode tables of the library whose ids are wanted.

    With a token for each byte, that library's encoder gives back what the pattern matches and nothing else.
    """
    encoder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return np.frombuffer(bytes(encoder.encode_ordinary(text)).decode().encode("utf-32-le"), np.uint32)


@functools.cache
def _classes() -> np.ndarray:
    """The symbol of every code point: Unicode categories L and N, and white space."""
    points = np.arange(sys.maxunicode + 1)
    points = points[(points < 0xD800) | (points > 0xDFFF)]
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for pattern, symbol in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _BLANK)):
        out[_members(pattern, points)] = symbol
    out[0x20] = _SPACE
    out[ord("'")] = _QUOTE
    out[[ord(c) for c in "stmd"]] = _SHORT
    return out


def pre_tokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts with a code point after each, where tokens begin in that string, and where the added code points are.

    Tokens are contractions, an optional space with letters, numbers or marks, and white space. White
    space before a token keeps its last code point apart: a space joins what follows, another code point
    stands alone. An added code point counts as a beginning.
    """
    joined = "\0".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    symbols = _classes()[points]
    letters = symbols == _LETTER
    for first, second in (("r", "e"), ("v", "e"), ("l", "l")):
        symbols[:-1][(points[:-1] == ord(first)) & (points[1:] == ord(second)) & letters[:-1]] = _PAIR
    symbols[cuts] = _CUT
    of_symbol, product, from_start, begins = _monoid()
    states = from_start[_scan(of_symbol[symbols], product)]
    at = begins.ravel()[np.append(np.uint8(_START), states[:-1]) * np.uint8(9) + symbols]
    # The last of two or more white code points before a token begins one of its own or a glued one.
    white = symbols <= _BLANK
    at[:-1] |= white[:-1] & ~white[1:] & (symbols[1:] != _CUT)
    at[cuts] = True
    return joined, np.flatnonzero(at), cuts


class Vocabulary:
    """Ranks of byte strings, and the ids of words seen before."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Merges the pair of least rank, the leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if word in ranks:
            return (ranks[word],)
        if not word:
            return ()
        if len(word) > 400:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) != _NONE:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges by a heap over a linked list, for words of thousands of bytes."""
        import heapq

        n, ranks = len(word), self.ranks
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank_of = lambda i: ranks.get(word[i : end[end[i]]], _NONE) if end[i] < n else _NONE
        now = [rank_of(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(now) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or now[i] != rank:
                continue
            gone = end[i]
            end[i], alive[gone] = end[gone], False
            if end[i] < n:
                before[end[i]] = i
            for j in (before[i], i):
                if j >= 0:
                    now[j] = rank_of(j)
                    if now[j] != _NONE:
                        heapq.heappush(heap, (now[j], j))
        return tuple(ranks[word[i : end[i]]] for i in range(n) if alive[i])

    def ids(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            found = self.merge(word.encode("utf-8", "replace"))
            if len(word) <= 64:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found


_NONE = 1 << 60


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the code point offset in its text and the number of ids of each pre-token, and each text's number of ids and of pre-tokens."""
    joined, starts, cuts = pre_tokens(texts)
    bounds = [*starts.tolist(), len(joined)]
    is_cut = np.zeros(len(starts), bool)
    at = np.searchsorted(starts, cuts)
    is_cut[at] = True
    words = [joined[i:j] for i, j in zip(bounds, bounds[1:])]
    for i in at.tolist():
        words[i] = ""
    found = list(map(vocab.words.get, words))
    for i in [i for i, f in enumerate(found) if f is None]:
        found[i] = vocab.ids(words[i])
    counts = np.fromiter(map(len, found), np.int32, len(found))
    flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum()))
    text_of = np.cumsum(is_cut) - is_cut
    per_text = np.bincount(text_of, weights=counts, minlength=len(texts)).astype(np.int64)
    begin = np.concatenate(([0], cuts[:-1] + 1))
    own = ~is_cut
    return flat, (starts - begin[text_of])[own].astype(np.int32), counts[own], per_text, np.bincount(text_of[own], minlength=len(texts))


def _blocks(texts: list[str]) -> list[list[str]]:
    """Texts in order, in blocks of about a million code points, so that a block's arrays stay small."""
    out, size = [[]], 0
    for text in texts:
        if size > _BLOCK:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out


def _lists(values: list[np.ndarray], lengths: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.concatenate(lengths)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), pa.int32()))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(doc_id, ids array<int>[, offsets array<int>, counts array<int>]) for each row, whole texts.

    offsets holds the code point at which each pre-token begins, counts its number of ids. A null or
    empty text has empty arrays. Text that isn't valid UTF-8 has U+FFFD in its place. Rows repeat as
    they come. ranks_path is a file of base64 byte strings and ranks that every executor has.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(ranks_path)
        parts = [encode_texts(block, vocab) for block in _blocks([t or "" for t in batch.column("text").to_pylist()])]
        flat, starts, counts, n_ids, n_words = map(list, zip(*parts))
        columns = [_lists(flat, n_ids)] + ([_lists(starts, n_words), _lists(counts, n_words)] if offsets else [])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "ids", "offsets", "counts"][: 1 + len(columns)])

    schema = "doc_id long, ids array<int>" + ", offsets array<int>, counts array<int>" * offsets
    return arrow_map(keyed(docs, id_col, text_col), rows, schema)


class _Pieces(dict):
    """The bytes of the pre-tokens seen so far, by the bytes of their ids."""

    def __init__(self, bytes_of: list[bytes]) -> None:
        self.bytes_of = bytes_of

    def __missing__(self, ids: bytes) -> bytes:
        found = b"".join([self.bytes_of[i] for i in np.frombuffer(ids, np.int32).tolist()])
        if len(self) >= CACHE_WORDS // 4:
            self.clear()
        if len(ids) <= 32:
            self[ids] = found
        return found


@functools.cache
def _pieces(path: str) -> _Pieces:
    return _Pieces(vocabulary(path).bytes_of)


def decode(ids: Column, ranks_path: str, counts: Column | None = None) -> Column:
    """The bytes of an array of ids; null for null. An unknown id fails the job.

    With counts, the number of ids of each pre-token, what a pre-token decodes to is looked up as a whole.
    """

    def cut(values: np.ndarray, sizes: np.ndarray | None) -> bytes:
        if sizes is None:
            bytes_of = vocabulary(ranks_path).bytes_of
            return b"".join([bytes_of[i] for i in values.tolist()])
        data, ends = values.astype(np.int32).tobytes(), (4 * np.cumsum(sizes)).tolist()
        return b"".join(map(_pieces(ranks_path).__getitem__, [data[a:b] for a, b in zip([0, *ends], ends)]))

    def lists(batch: pa.Array) -> Iterator[np.ndarray]:
        values, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
        return (values[a:b] for a, b in zip(ends, ends[1:]))

    if counts is None:

        @F.arrow_udf("binary")
        def joined(batch: pa.Array) -> pa.Array:
            return pa.array([None if gone else cut(x, None) for x, gone in zip(lists(batch), batch.is_null().to_pylist())], pa.binary())

        return joined(ids)

    @F.arrow_udf("binary")
    def by_piece(batch: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([None if gone else cut(x, n) for x, n, gone in zip(lists(batch), lists(sizes), batch.is_null().to_pylist())], pa.binary())

    return by_piece(ids, counts)


def pre_token_text(text: Column, offsets: Column, place: Column) -> Column:
    """The pre-token at a place, from 0, of a text, by the offsets of encode(); null beyond the last."""
    start = F.get(offsets, place)
    end = F.coalesce(F.get(offsets, place + 1), F.length(text))
    return F.substring(text, start + 1, end - start)
