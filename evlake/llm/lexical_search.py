"""Ranked lexical search by two trees: item nodes and document nodes hold coordinate maxima, whose products bound whole batches of scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import arrow_map, slices, small_batches, written

#: Lowers A-Z and blanks all other ASCII but digits and a-z; bytes beyond ASCII stay.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of an item.
TOP = 50
#: Bytes of terms of the items that one pass over the documents takes; more items take more passes.
MAX_BLOCK_BYTES = 8 << 20
#: Terms of items that share one tree, and cells of a batch of documents by these terms.
TREE_TERMS, MAX_CELLS = 8192, 1 << 20
#: Items of a leaf, documents of a leaf, children of a node.
ITEM_LEAF, DOC_LEAF, FAN = 8, 16, 8
#: One in so many documents is scored first, for the scores that the others have to reach; results don't depend on it.
FIRST_OF = 64


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): the different terms of each item, in order; rows that share an id are one item."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [list(set(words(t))) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    texts = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = texts.schema["item_id"].dataType.simpleString()
    return arrow_map(texts, rows, f"item_id {kind}, terms array<binary>").select("item_id", F.explode("terms").alias("term")).distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def _blocks(rows: Iterable) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in lists of at most MAX_BLOCK_BYTES of terms, or of one item."""
    block, size = [], 0
    for row in rows:
        terms = [bytes(t) for t in row.terms]
        own = sum(len(t) + 64 for t in terms)
        if block and size + own > MAX_BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.item_id, terms))
        size += own
    if block:
        yield block


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its length, and which terms of the vocabulary it holds how often."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = known.value
        kept, lengths, terms, counts, ends = [], [], [], [], [0]
        for k, text in enumerate(batch.column("text").to_pylist()):
            found = words(text)
            if found:
                hits = Counter(filter(of.__contains__, found))
                kept.append(k)
                lengths.append(len(found))
                terms.extend(map(of.__getitem__, hits))
                counts.extend(hits.values())
                ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return arrow_map(docs, rows, "doc_id long, n long, terms array<int>, tfs array<int>")


class ItemNode:
    """Items of a tree: the greatest weight of each of their terms; a leaf also has each item's weights."""

    def __init__(self, items: list[int], weights: list[dict[int, int]], children: list[ItemNode]) -> None:
        self.items, self.children = np.array(items), children
        terms = sorted({t for i in items for t in weights[i]})
        self.terms = np.array(terms, np.int64)
        at = {t: k for k, t in enumerate(terms)}
        each = np.zeros((len(items), len(terms)))
        for k, i in enumerate(items):
            for t, w in weights[i].items():
                each[k, at[t]] = w
        self.most = each.max(0) if len(items) else each.sum(0)
        self.each = None if children else each


def item_tree(items: list[int], weights: list[dict[int, int]]) -> ItemNode:
    """Leaves of items in order of their most common terms, so that items of one language lie together."""
    order = sorted(items, key=lambda i: sorted(weights[i].items(), key=lambda x: (x[1], x[0])))
    nodes = [ItemNode(order[k : k + ITEM_LEAF], weights, []) for k in range(0, len(order), ITEM_LEAF)]
    while len(nodes) > 1:
        nodes = [ItemNode([i for n in nodes[k : k + FAN] for i in n.items.tolist()], weights, nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]
    return nodes[0]


class Best:
    """The k best (score, doc_id) of each item so far, and the score that a document has to reach; equal scores go to the smaller id."""

    def __init__(self, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.scores = [np.zeros(0, np.int64) for _ in least]
        self.docs = [np.zeros(0, np.int64) for _ in least]

    def take(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores[item], scores]), np.concatenate([self.docs[item], docs])
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores[item], self.docs[item] = scores[order], docs[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], self.scores[item][-1])


class DocTree:
    """A batch of documents by the terms of a tree of items; level 0 are the documents, each level above holds maxima of FAN (at first DOC_LEAF) nodes."""

    def __init__(self, ids: np.ndarray, of: np.ndarray, terms: np.ndarray, gains: np.ndarray, n_terms: int, root: ItemNode) -> None:
        table = np.zeros((len(ids), n_terms))
        table[of, terms] = gains
        tops = np.stack([table[:, n.terms] @ n.most for n in root.children or [root]])
        order = np.lexsort((-tops.max(0), tops.argmax(0)))  # documents that suit the same items lie together
        self.ids, self.levels, self.fans = ids[order], [table[order]], []
        while len(self.levels[-1]) > 1:
            self.fans.append(DOC_LEAF if not self.fans else FAN)
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), self.fans[-1]), axis=0))


def _visit(tree: DocTree, node: ItemNode, level: int, at: np.ndarray, best: Best) -> int:
    rows = tree.levels[level][np.ix_(at, node.terms)]
    at = at[rows @ node.most >= best.least[node.items].min()]
    if not len(at):
        return 0
    if level:
        fan = tree.fans[level - 1]
        below = (at[:, None] * fan + np.arange(fan)).ravel()
        below = below[below < len(tree.levels[level - 1])]
        return sum(_visit(tree, child, level - 1, below, best) for child in node.children or [node])
    if node.children:
        return sum(_visit(tree, child, 0, at, best) for child in node.children)
    scores = tree.levels[0][np.ix_(at, node.terms)] @ node.each.T
    for k, item in enumerate(node.items):
        good = np.flatnonzero(scores[:, k] >= best.least[item])
        if len(good):
            best.take(item, scores[good, k].astype(np.int64), tree.ids[at[good]])
    return scores.size


def search_batch(tree: DocTree, root: ItemNode, best: Best) -> int:
    """Takes what the batch's documents score into best; the number of scores worked out.

    A pair of nodes is left when the product of its maxima is below the weakest score that one of its
    items asks for. A product that equals it is kept, as a tie may fall to a smaller id.
    """
    return _visit(tree, root, len(tree.levels) - 1, np.arange(len(tree.levels[-1])), best)


def _trees(block: list[tuple[object, list[bytes]]], ids: dict[bytes, int], weights: dict[int, int]) -> list[tuple[np.ndarray, ItemNode]]:
    """(terms, root) of trees of at most TREE_TERMS terms, or of one item; a tree numbers its own terms."""
    parts, items, known = [], [], set()
    for k, (_, terms) in enumerate(block):
        own = {ids[t] for t in terms if ids[t] in weights}
        if items and len(known | own) > TREE_TERMS:
            parts.append((items, known))
            items, known = [], set()
        if own:
            items.append(k)
            known |= own
    if items:
        parts.append((items, known))
    found = []
    for items, known in parts:
        terms = np.array(sorted(known))
        number = {t: k for k, t in enumerate(terms.tolist())}
        rows: list[dict[int, int]] = [{} for _ in block]
        for i in items:
            rows[i] = {number[ids[t]]: weights[ids[t]] for t in block[i][1] if ids[t] in number}
        found.append((terms, item_tree(items, rows)))
    return found


def _scored(vectors: DataFrame, trees: object, n_docs: int, n_terms: int, k: int, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): of each task the best k of each item, as far as they reach the least scores; equal ones included."""
    sent = vectors.sparkSession.sparkContext.broadcast(least)
    small_batches(vectors.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, sent.value)
        for batch in batches:
            for part in slices(batch) if batch.num_rows else ():
                ids, n = part.column("doc_id").to_numpy(), part.column("n").to_numpy()
                lists = part.column("terms")
                ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
                terms, tf = lists.flatten().to_numpy(), part.column("tfs").flatten().to_numpy().astype(np.int64)
                of = np.repeat(np.arange(len(ids)), np.diff(ends))
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                gains = (1_000_000_000 * tf) // (1000 * tf + 20 * m[of])
                for own, root in trees.value:
                    at = np.searchsorted(own, terms)
                    at[at == len(own)] = 0
                    hit = own[at] == terms
                    step = max(DOC_LEAF, MAX_CELLS // len(own))
                    for x in range(0, len(ids), step):
                        y = min(x + step, len(ids))
                        mine = np.flatnonzero(hit[ends[x] : ends[y]]) + ends[x]
                        search_batch(DocTree(ids[x:y], of[mine] - x, at[mine], gains[mine], len(own), root), root, best)
        items = np.repeat(np.arange(len(best.docs)), [len(d) for d in best.docs])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(np.concatenate(best.docs)), pa.array(np.concatenate(best.scores))], ["item", "doc_id", "score"])

    return vectors.mapInArrow(over, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, of scores above 0; equal scores by doc_id.

    docs needs doc_id and text. A null or empty text has no term, and isn't counted among the documents;
    rows are documents each, whatever ids they share, and a null id comes before all others. Rows of
    items that share an id are one item with the terms of all of them; one without terms finds nothing.

    Items are taken in blocks, each in one pass over all documents, whose tasks join the two trees and
    send on their best. Scores are whole numbers below 2**53, so products of floats are exact; an item
    of over 100,000 terms is refused.
    """
    spark = docs.sparkSession
    # the least id stands for none, so ids stay numbers in the tasks
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = items.schema[id_col].dataType.simpleString()
    total = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(item_terms(items, id_col, text_col).toLocalIterator()):
        if max(len(terms) for _, terms in block) > 100_000:
            raise ValueError("an item has over 100,000 different terms")
        ids = {t: k for k, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        vectors = written(_vectors(texts, ids), "vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        df = {r.term: r["count"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # a row for each term of the block
        weights = {t: w for t, n in df.items() if (w := math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))) > 0}
        trees = _trees(block, ids, weights)
        if not trees:
            continue
        shared = spark.sparkContext.broadcast(trees)
        least = np.ones(len(block))
        first = _scored(vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST_OF)) == 0), shared, n_docs, n_terms, k, least)
        for r in _ranked(first, k).where(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the block
            least[r.item] = r.score
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"item int, item_id {kind}")
        ranked = _ranked(_scored(vectors, shared, n_docs, n_terms, k, least), k)
        total = total.unionByName(ranked.join(names, "item").select("item_id", "rank", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")).alias("doc_id"), "score"))
    return total
