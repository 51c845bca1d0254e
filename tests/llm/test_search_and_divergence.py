"""Divergence of sources and lexical search against plain Python, on hostile rows too."""

import collections
import math
import random
import re

import numpy as np
import pytest

from evlake.llm import divergence, lexical_search

SCHEMA = "doc_id long, text string, lang string, source string, n int, total int, terms string, item string, value int, rank int, p int, score int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x", "x", 1, 1, 1, 1) for r in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def slow_divergence(rows, min_docs=3, top=200):
    rows = [(lang or "", source or "", [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, all_counts, groups = collections.Counter(), collections.Counter(), {}
        for _, source, words in (r for r in rows if r[0] == lang):
            df.update(set(words))
            all_counts.update(words)
            groups.setdefault(source, collections.Counter()).update(words)
        kept = sorted(t for t in df if df[t] >= min_docs)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        own, base = {s: shares(c) for s, c in groups.items()}, shares(all_counts)
        for s, p in own.items():
            pairs = [(b, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for b, q in own.items() if b != s]
            terms = [(t, (p[t] - base[t]) ** 2 // base[t]) for t in kept if groups[s][t] and p[t] > base[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def word_rows(rng, n):
    words = ["Äpfel", "the", "THE", "of", "x9y", "naïve", "zebra", "日本", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))]
    return [(i, rng.choice([None, "", " ".join(rng.choices(words, [9] * 8 + [1] * 81, k=rng.randint(0, 60)))]), rng.choice([None, "", "en", "en", "de"]), rng.choice([None, "", "a", "a", "a", "b", "c", "d"])) for i in range(n)]


@pytest.mark.parametrize("cells", [8, 1 << 19])
def test_divergence(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "MAX_CELLS", cells)
    monkeypatch.setattr(divergence, "MAX_HELD", 40)
    rows = word_rows(random.Random(3), 300) + [(7, "one only", "xx", "q"), (8, None, "zz", "q"), (8, None, "zz", "r"), (8, None, "zz", "r")]
    got = divergence.divergence(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == slow_divergence(rows)
    assert divergence.divergence(docs_of(spark, rows), min_docs=1, top=4).count() == len(slow_divergence(rows, 1, 4))
    assert divergence.divergence(docs_of(spark, [])).collect() == []


def test_large_counts_stay_exact(spark):
    row = spark.createDataFrame([(3 * 10**15, 10**16)], "tf long, n long").select(divergence._share("tf", "n").alias("p")).first()
    assert row.p == 1 + 10**9 * (3 * 10**15 + 1) // 10**16


def slow_search(docs, items, k):
    words = lambda t: [lower(x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(i, w) for i, t, *_ in docs if (w := words(t))]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(words(text))
    out = []
    for item, ts in terms.items():
        found = []
        for i, w in docs:
            m = 50 + 50 * len(w) * n // total
            tf = collections.Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in ts if t in tf)
            if score > 0:
                found.append((-score, -(2**63) if i is None else i))
        out += [(item, r + 1, None if d == -(2**63) else d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [True, False])
def test_search(spark, monkeypatch, small):
    if small:  # many blocks, trees, batches and levels
        for name, value in {"MAX_BLOCK_BYTES": 1500, "TREE_TERMS": 9, "MAX_CELLS": 400, "ITEM_LEAF": 2, "DOC_LEAF": 3, "FAN": 2}.items():
            monkeypatch.setattr(lexical_search, name, value)
    monkeypatch.setattr(lexical_search, "FIRST_OF", 3)
    rng = random.Random(5)
    docs = word_rows(rng, 400)
    docs += docs[:40] + [(None, "the zebra of äpfel", None, None), (None, "the zebra of äpfel", None, None), (900, "zebra " * 5000, "en", "a")]
    items = [(i, t) for i, t, *_ in word_rows(rng, 30)] + [(2, "zebra 日本"), (None, "THE x9y x9y"), (50, "nothing like it"), (51, None), (52, " ".join(f"t{i}" for i in range(3000)) + " zebra")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in lexical_search.search(docs_of(spark, docs), table, k=5).collect()), key=repr)
    assert got == slow_search(docs, items, 5)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(docs_of(spark, []), items).collect() == []
    assert lexical_search.search(docs_of(spark, [(1, "the cat", "en", "a")]), items.limit(0)).collect() == []
    assert lexical_search.search(docs_of(spark, [(1, None, "en", "a"), (2, "...", "en", "a")]), items).collect() == []


def test_bounds_prune_whole_batches():
    """Documents of another language are left without a score being worked out, and the result is that of all scores."""
    rng = np.random.default_rng(1)
    weights = [{int(t): 1000 for t in rng.choice(40, 6, replace=False) + 40 * (i % 2)} for i in range(32)]
    root = lexical_search.item_tree(list(range(32)), weights)
    best = lexical_search.Best(3, np.ones(32))
    done, everything = 0, [[] for _ in range(32)]
    for batch in range(8):
        of, terms = np.repeat(np.arange(512), 10), (rng.integers(0, 40, 5120) + 40 * np.repeat(rng.integers(0, 2, 512), 10))
        gains = rng.integers(1, 900, 5120)
        ids = np.arange(512) + 512 * batch
        table = np.zeros((512, 80))
        table[of, terms] = gains
        for i, own in enumerate(weights):
            scores = sum(table[:, t] * w for t, w in own.items())
            everything[i] += [(-int(s), int(d)) for s, d in zip(scores, ids) if s > 0]
        done += lexical_search.search_batch(lexical_search.DocTree(ids, of, terms, gains, 80, root), root, best)
    assert [[(-int(s), int(d)) for s, d in zip(best.scores[i], best.docs[i])] for i in range(32)] == [sorted(e)[:3] for e in everything]
    assert done < 0.5 * 32 * 512 * 8
