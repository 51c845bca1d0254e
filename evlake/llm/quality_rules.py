"""Quality rules for documents, and for their hosts by shrunken failure rates; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .columns import SPACES, let, words_of

MIN_WORDS = 50
#: A text fails if more than this share of its words, in percent, lies in repeated three-word windows.
MAX_REPEAT_PERCENT = 50
#: A host fails as a whole if its shrunken failure rate is above this.
MAX_HOST_RATE = 0.75
#: Strict limits, for documents of hosts that fail a rule: words in repeated windows, symbols and repeated lines, for 100 words.
STRICT_REPEAT_PERCENT, STRICT_SYMBOL_PERCENT, STRICT_LINE_PERCENT = 25, 10, 5
#: Prior strength, in documents, where the hosts' rates don't differ or there is one host.
_EVEN_STRENGTH = 1e6


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that a text has twice or more."""

    def window(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))

    def repeated(found: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            return F.coalesce(x["w"] == F.get(found, k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(found, k + 1)["w"], F.lit(False))

        return F.sort_array(F.transform(F.filter(found, again), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(let(F.sort_array(windows), repeated), covered))


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), one row for each row.

    Row by row, without a shuffle. A null text has no words and one empty line; it fails by its length.
    """
    split = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(text_col, F.lit("")).alias("text")
    ).withColumns({"words": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    found = split.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def strict_failures(rules: DataFrame) -> dict[str, Column]:
    """The rules that are aggregated by host, each with a stricter limit than a document alone is held to."""
    n = F.col("n_words")
    return {
        "repeats": 100 * F.col("n_repeat_words") > STRICT_REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > STRICT_SYMBOL_PERCENT * n,
        "lines": 100 * F.col("n_dup_lines") > STRICT_LINE_PERCENT * n,
    }


def _prior(mean: float | None, variance: float | None) -> tuple[float, float, float]:
    """(mean, strength, limit) of the beta distribution with the mean and variance of the hosts' rates; limit is a standard deviation above its mean."""
    if not variance:
        return mean or 0.0, _EVEN_STRENGTH, 1.0
    return mean, max(mean * (1 - mean) / variance - 1, 0.0), mean + variance**0.5


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, shrunk_rate, host_failed, and for each strict rule its shrunk rate and whether the host fails it) from document_rules() rows.

    For base_failed and for each of strict_failures() a beta prior is fitted to the hosts' failure rates;
    a host's rate is the posterior mean, so hosts with few documents lean on all others. A host fails a
    strict rule if this is over a standard deviation of the prior above its mean, and fails as a whole
    above max_rate. If all hosts are alike, none fails a rule. A null host is one host. Two numbers of
    each prior are all that reaches the driver.
    """
    failures = {"base": F.col("base_failed"), **strict_failures(rules)}
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(f).alias(f"n_{k}") for k, f in failures.items()])
    hosts = written(hosts.withColumns({f"rate_{k}": F.col(f"n_{k}") / F.col("n_docs") for k in failures}), "hosts")
    found = hosts.agg(*[f(f"rate_{k}").alias(f"{name}_{k}") for k in failures for name, f in (("mean", F.avg), ("variance", F.var_pop))]).first()
    out, limits = {}, {}
    for k in failures:
        mean, strength, limits[k] = _prior(found[f"mean_{k}"], found[f"variance_{k}"])
        out[k] = (F.col(f"n_{k}") + mean * strength) / (F.col("n_docs") + strength)
    verdicts = [c for k in list(failures)[1:] for c in (out[k].alias(f"shrunk_{k}"), (out[k] > limits[k]).alias(f"fails_{k}"))]
    return hosts.select("host", "n_docs", out["base"].alias("shrunk_rate"), (out["base"] > max_rate).alias("host_failed"), *verdicts)


def quality_verdicts(docs: DataFrame, max_rate: float = MAX_HOST_RATE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """document_rules() with kept: false if the document failed, if its host failed as a whole, or if it fails a strict rule that its host fails. Empty input: no rows."""
    rules = written(document_rules(docs, id_col, text_col, host_col), "rules")
    # read from storage, so that Spark can split the documents of a large host among tasks
    verdicts = written(host_verdicts(rules, max_rate).withColumnRenamed("host", "_host"), "verdicts")
    joined = rules.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    failed = F.col("base_failed") | F.col("host_failed")
    for k, f in strict_failures(rules).items():
        failed |= f & F.col(f"fails_{k}")
    return joined.withColumn("kept", ~F.coalesce(failed, F.col("base_failed"))).select(*rules.columns, "kept")
