"""Nulls, empty and repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evlake.llm import bpe, fingerprint, jaccard, line_dedup, packing, pii, quality_model, quality_rules, simhash, substring_dedup, url_filter

BYTE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, fp long, ids int, n_lines string, score string, kept string, row long, place int, bucket string, digest int, t int, gone string, places int, _found string, _new int, _line_doc int, node string, rid int, shard string"
ROWS = [(1, "same text here for all of us\nanother line of text"), (1, "same text here for all of us\nanother line of text"), (2, None), (3, ""), (None, "same text here for all of us"), (None, None), (4, "x" * 5000), (5, " \n\t "), (6, "same text here for all of us\nanother line of text")]


def table(spark, rows):
    return spark.createDataFrame([(*r, *["s" if "string" in c else 1 for c in SCHEMA.split(", ")[2:]]) for r in rows], SCHEMA)


OPERATORS = {
    "simhash": lambda d: simhash.near_duplicates(d),
    "bpe": lambda d: bpe.encode(d, BYTE).withColumn("decoded", bpe.decode(F.col("ids"), BYTE)),
    "rules": lambda d: quality_rules.quality_verdicts(d),
    "fingerprints": lambda d: fingerprint.fingerprints(d),
    "edited": lambda d: fingerprint.edited_fingerprints(d),
    "scores": lambda d: quality_model.score(d, quality_model.train(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "groups": lambda d: jaccard.grouped(d),
    "private": lambda d: pii.pseudonymised(d, "key"),
    "packed": lambda d: packing.pack(d, WORD),
    "urls": lambda d: url_filter.url_verdicts(d, [("allow", "a", "/")], id_col="doc_id", url_col="text"),
    "cut": lambda d: substring_dedup.without_repeats(d),
}
ONE_ROW_EACH = set(OPERATORS) - {"packed", "cut"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    got = OPERATORS[name](table(spark, ROWS)).collect()
    if name in ONE_ROW_EACH:
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


def test_defined_results(spark):
    docs = table(spark, ROWS)
    near = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert near[(2, 0)] == near[(3, 0)] == near[(5, 0)] == near[(None, 0)] == 2
    lines = sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    # the null id is the smallest: it keeps the first line, of the others the smallest id keeps the second
    assert lines == [(0, 1, 0), (0, 1, 0), (1, 2, 1), (1, 2, 1), (2, 1, 0), (3, 1, 0), (4, 1, 0), (5, 2, 0), (6, 2, 2)]
    names = [r.fingerprint for r in fingerprint.fingerprints(docs).orderBy("doc_id").collect()]
    assert len(set(names)) == 4
    packed = packing.pack(docs, WORD).collect()
    assert sum(r.length for r in packed if r.start == 0) >= len(ROWS)
    cut = substring_dedup.without_repeats(docs).collect()
    # a run of x repeats itself; copies shorter than the width are left alone
    assert [(s.start, s.end) for r in cut for s in r.spans] == [(0, 5000)]
