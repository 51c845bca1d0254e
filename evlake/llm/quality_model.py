"""A quality classifier: an additive model of binned features and pairs, cyclically boosted, scored by table look-ups."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, keyed

#: Labelled rows that a model is fitted on, at most: the least by a hash of their ids.
MAX_LABELS = 20_000
MAX_BINS = 32
PAIR_BINS = 8
N_PAIRS = 6
ROUNDS = 120
RATE = 0.2
#: Least Hessian weight of a leaf.
LEAF_WEIGHT = 2.0

FEATURES = (
    "log_words", "word_bytes", "unique_words", "same_as_before", "top_word", "unique_lines", "line_words",
    "upper", "digits", "marks", "symbols", "exclamations", "white", "high_bytes", "byte_entropy", "long_words",
)

_UPPER, _LOWER, _DIGIT = (np.array([chr(i) in s for i in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
_WHITE = np.array([i in (32, 9, 10, 11, 12, 13) for i in range(256)])
_HIGH = np.arange(256) >= 128
_SYMBOLS = np.array([chr(i) in "#*$%&|<>" for i in range(256)])
_MARKS = ~(_UPPER | _LOWER | _DIGIT | _WHITE | _HIGH)
_CLASSES = np.array([_UPPER, _DIGIT, _MARKS, _SYMBOLS, np.arange(256) == ord("!"), _WHITE, _HIGH]).astype(float)


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; shares are of its bytes, words or lines, and 0 where it has none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, lines = max(len(words), 1), [x for x in data.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / max(len(data), 1)
    upper, digits, marks, symbols, exclamations, white, high = (_CLASSES @ share).tolist()
    some = share[share > 0]
    different = Counter(words)
    top = max(different.values(), default=0) / n
    return [
        math.log1p(len(words)), (len(data) - white * len(data)) / n, len(different) / n, sum(map(eq, words, words[1:])) / n, top,
        len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1), upper, digits, marks, symbols, exclamations, white, high,
        float(-(some * np.log2(some)).sum()), sum(len(w) > 12 for w in different) / n,
    ]


@dataclass
class AdditiveModel:
    """Bin edges, one table for each feature and one for each pair, and their common offset."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    offset: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    #: How many rows it was fitted on.
    rows: int = 0
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1, from additions of table entries."""
        total = np.full(len(x), self.offset)
        for column, edges, values in zip(x.T, self.edges, self.tables):
            total += values[np.searchsorted(edges, column, side="right")]
        for (i, j), values in zip(self.pairs, self.pair_tables):
            total += values[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + LEAF_WEIGHT)


def _tree(g: np.ndarray, h: np.ndarray, splits: int = 3) -> np.ndarray:
    """Leaf values by bin of a shallow tree: the best split, then the best of its parts, splits times in all."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    for _ in range(splits):
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            if b - a < 2:
                continue
            gain = gs[:-1] ** 2 / (hs[:-1] + LEAF_WEIGHT) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + LEAF_WEIGHT) - gs[-1] ** 2 / (hs[-1] + LEAF_WEIGHT)
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), k, a + at + 1))
        if not best[2]:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the leaf values by cell of the best tree that cuts each of two features once."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for s in (gs, hs):
        low = s[:-1, :-1]
        parts.append((low, s[:-1, -1:] - low, s[-1:, :-1] - low, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + low))
    gain = sum(a**2 / (b + LEAF_WEIGHT) for a, b in zip(*parts))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for rows, columns, a, b in zip((slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)), *parts):
        out[rows, columns] = _leaf(a[i, j], b[i, j])
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boosts single features in turn, round after round, then the pairs that most reduce what is left.

    Without rows the score is 0.5 everywhere, with one class near that class.
    """
    width = len(FEATURES)
    if not len(x):
        return AdditiveModel([np.zeros(0)] * width, [np.zeros(0)] * width, 0.0, [np.zeros(1)] * width)
    model = AdditiveModel([_edges(c, MAX_BINS) for c in x.T], [_edges(c, PAIR_BINS) for c in x.T])
    rate = (y.sum() + 1) / (len(y) + 2)
    model.offset = float(np.log(rate / (1 - rate)))
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.offset)
    model.rows = len(y)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, values in zip(bins, model.tables):
            g, h = (np.bincount(b, weights=w, minlength=len(values)) for w in slopes())
            step = RATE * _tree(g, h)
            values += step
            total += step[b]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grids(i: int, j: int) -> list[np.ndarray]:
        return [np.bincount(coarse[i] * sizes[j] + coarse[j], weights=w, minlength=sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for w in slopes()]

    gains = sorted(((-_quadrants(*grids(i, j))[0], i, j) for i in range(width) for j in range(i)))[:N_PAIRS]
    model.pairs = [(i, j) for _, i, j in gains]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(ROUNDS // 4):
        for (i, j), values in zip(model.pairs, model.pair_tables):
            step = RATE * _quadrants(*grids(i, j))[1]
            values += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row's label is kept from fitting: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _measured(texts: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features(t) for t in batch.column("text").to_pylist()])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "x"])

    return arrow_map(texts, rows, "label double, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labels: int = MAX_LABELS) -> AdditiveModel:
    """Fits on at most max_labels labelled documents that aren't held out, the same ones in every run.

    Null labels and ids, and labels without a document, are left out. The sample's ids are broadcast
    and its features are brought to the driver; max_labels bounds both.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labels)
    texts = keyed(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    found = _measured(texts).toPandas()
    order = found["x"].map(tuple).argsort(kind="stable") if len(found) else []
    x = np.array([list(v) for v in found["x"]], float).reshape(-1, len(FEATURES))[order]
    return fit(x, found["label"].to_numpy()[order])


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """docs with score (double): the model's probability that a text is good; other columns stay, but for score.

    Null and empty texts have the score of features that are all 0. Row by row, without a shuffle.
    """
    docs = docs.drop("score")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], [*names, "score"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return arrow_map(docs, rows, ", ".join(f"`{n}` {types[n]}" for n in names) + ", score double")
