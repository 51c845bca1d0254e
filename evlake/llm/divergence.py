"""Source divergence audit: how far the words of each source lie from those of its language's other sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import slices, small_batches, written

#: Lowers A-Z and blanks all other ASCII but a-z; bytes beyond ASCII stay, so that UTF-8 survives.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A term counts in a language if so many of its documents have it.
MIN_DOCS = 3
#: Ranks of the terms' part.
TOP_TERMS = 200
#: A task's counters are sent on when they hold so many terms.
MAX_HELD = 400_000
#: Cells of a block of terms by sources in a task.
MAX_CELLS = 1 << 19


def _group(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, tf, df) of docs(lang, source, text), in parts that are still to be summed.

    A document's Counter goes into its group's; a task sends them on before they outgrow its memory.
    """
    small_batches(docs.sparkSession)

    def sent(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (df, more) in held.items():
            terms = list(df)
            for k in range(0, len(terms), 1 << 16):
                part = terms[k : k + (1 << 16)]
                in_docs = np.fromiter((df[t] for t in part), np.int64, len(part))
                extra = np.fromiter((more.get(t, 0) for t in part), np.int64, len(part))
                columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).view(pa.string()), pa.array(in_docs + extra), pa.array(in_docs)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "tf", "df"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = text.translate(LETTERS).split()
                    if words:
                        counts = Counter(words)
                        df, more = held.setdefault((lang, source), (Counter(), Counter()))
                        df.update(counts.keys())
                        if len(counts) < len(words):
                            more.update({t: n - 1 for t, n in counts.items() if n > 1})
                if sum(len(df) for df, _ in held.values()) > MAX_HELD:
                    yield from sent(held)
                    held = {}
        yield from sent(held)

    texts = docs.select(*_group(docs), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(over, "lang string, source string, term string, tf long, df long")


def _share(count: str, total: str) -> Column:
    """1 + floor(10**9 (count + 1) / total), in decimals: the product of large counts exceeds 64 bits."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0))) div cast(greatest({total}, 1) as decimal(20, 0))")


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _overlaps(vectors: DataFrame) -> DataFrame:
    """(lang, a, b, value) of vectors(lang, entries of (source, p, p0)), to be summed.

    Of terms that both a and b have: f(p, q) less what the sums over the terms of a alone and of b
    alone say of them. In a block of terms, a source without a term stands with p0, and adds nothing.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], int] = {}

        def sent() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(held.values()), pa.int64())], ["lang", "a", "b", "value"])

        def block(lang: str, names: list[str], zero: np.ndarray, t: np.ndarray, s: np.ndarray, p: np.ndarray, n_terms: int) -> None:
            table = np.repeat(zero[None], n_terms, 0)
            table[t, s] = p
            for a in range(len(names)):
                mine = t[s == a]
                if not len(mine):
                    continue
                q, own = table[mine], table[mine, a][:, None]
                value = ((own - q) ** 2 // q).sum(0) - ((own - zero) ** 2 // zero).sum(0) - ((zero[a] - q) ** 2 // q).sum(0) + len(mine) * ((zero[a] - zero) ** 2 // zero)
                for b in np.flatnonzero(value):
                    if b != a:
                        key = (lang, names[a], names[b])
                        held[key] = held.get(key, 0) + int(value[b])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("entries")
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            langs = batch.column("lang").dictionary_encode()
            lang_of = langs.indices.to_numpy()[of]
            p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                at = np.flatnonzero(lang_of == k)
                found = flat.field("source").take(pa.array(at)).dictionary_encode()
                names, s = found.dictionary.to_pylist(), found.indices.to_numpy()
                zero = np.zeros(len(names), np.int64)
                zero[s] = p0[at]
                t = np.unique(of[at], return_inverse=True)[1]
                step = max(1, MAX_CELLS // len(names))
                cuts = np.searchsorted(t, np.arange(0, t[-1] + 1 + step, step))
                for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    if x < y:
                        block(lang, names, zero, t[x:y] - i * step, s[x:y], p[at[x:y]], int(t[y - 1]) - i * step + 1)
                    if len(held) > MAX_CELLS:
                        yield sent()
                        held.clear()
        if held:
            yield sent()

    small_batches(vectors.sparkSession)
    return vectors.mapInArrow(over, "lang string, a string, b string, value long")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the other sources of its language, and its telling terms.

    docs needs text, lang and source; other columns are passed over, rows that repeat count each, nulls
    are empty strings. Terms are runs of ASCII letters (A-Z lowered) and of characters beyond ASCII. A
    language keeps the terms of min_docs documents. A group gives a term p = 1 + floor(10**9 (count + 1)
    / (N + V)), and lies from q by floor((p - q)**2 / q). Part pair sums this over all kept terms, for
    each other source of the language; part term has the top terms that the source uses more than its
    language does, by this against the language's own p. A group without kept terms has its pairs; a
    language with one source has none; no rows give no rows.

    Pairs are summed without a row for each pair and term: terms that neither source has differ alike,
    those of one source alone are taken by how many share a p, and only terms of both are worked out,
    in blocks, of which a task sends on the sums.
    """
    groups = docs.select(*_group(docs)).distinct()
    summed = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    kept = summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("n"), F.collect_list(F.struct("source", "tf")).alias("entries"))
    kept = written(kept.where(F.col("df") >= min_docs).drop("df"), "terms")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n").alias("lang_total"))
    used = kept.select("lang", "term", "n", F.inline("entries"))
    of_group = used.groupBy("lang", "source").agg(F.sum("tf").alias("total"))
    stats = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "n_terms", "lang_total"])
    stats = written(stats.withColumn("p0", _share("0", "total + n_terms")), "groups")

    shares = used.join(stats, ["lang", "source"]).withColumns({"p": _share("tf", "total + n_terms"), "q": _share("n", "lang_total + n_terms")})
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    a = stats.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "n_terms")
    b = stats.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").where("a <> b")
    bins = written(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).join(stats.select("lang", "source", "p0"), ["lang", "source"]), "shares")
    of_a = bins.select("lang", F.col("source").alias("a"), "p", "n", F.col("p0").alias("a0")).join(b, "lang").where("a <> b")
    of_b = bins.select("lang", F.col("source").alias("b"), "p", "n", F.col("p0").alias("b0")).join(a.drop("n_terms"), "lang").where("a <> b")
    vectors = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries")).where("size(entries) > 1")
    none = _gap("a0", "b0")
    parts = [
        pairs.select("lang", "a", "b", F.expr(f"n_terms * ({none})").alias("value")),
        of_a.select("lang", "a", "b", F.expr(f"n * ({_gap('p', 'b0')} - {none})").alias("value")),
        of_b.select("lang", "a", "b", F.expr(f"n * ({_gap('a0', 'p')} - {none})").alias("value")),
        _overlaps(vectors.select("lang", "entries")),
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    total = total.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    others = total.withColumn("rank", F.row_number().over(ranked))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return others.withColumn("part", F.lit("pair")).select(*names).unionByName(terms.withColumn("part", F.lit("term")).select(*names))
