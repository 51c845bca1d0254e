import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evlake.llm import queries, stages
from evlake.llm._shared import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage was given and what it kept, by doc_id."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(kept):
    for name in list(kept)[:-1]:
        assert kept[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_drops_bad_documents_only(spark, kept):
    before, after = map(texts, kept["quality"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(before[d] == t for d, t in after.items())
    assert sum(labels[d] == 1 for d in labels if d not in after) <= 1 and sum(labels[d] == 0 for d in labels if d in after) <= 1


def test_lines_by_brute_force(kept):
    before, after = map(texts, kept["lines"])
    keeper, want = {}, {}
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for d in sorted(before):
        for line in before[d].split("\n"):
            keeper.setdefault(key(line), d)
    for d, t in before.items():
        want[d] = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or keeper[key(x)] == d)
    assert after == want


def word_sets(text):
    found = text.lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_one_document_of_each_group_stays(kept):
    before, after = map(texts, kept["near_duplicates"])
    sets = {d: word_sets(t) for d, t in before.items()}
    root = {d: d for d in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in before:
        for b in before:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= stages.NEAR_PERCENT * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert after == {d: before[d] for d in before if find(d) == d}


def test_private_data_goes(kept):
    before, after = map(texts, kept["private"])
    assert before.keys() == after.keys()
    for d, t in before.items():
        assert not [x for x in re.findall(r"[\w.]+@[\w.]+\.com", t) if x in after[d]]
        if not re.search("[0-9@]", t):
            assert after[d] == t


def test_every_id_is_packed_once(kept):
    before, pieces = kept["packed"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENIZER))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts(before).items()}
    got = {r.doc_id: r.n for r in pieces.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert got == want


def test_run_has_the_stages_rows(spark, kept):
    columns = ["doc_id", "start", "length", "doc_tokens"]
    total = lambda df: df.selectExpr("sum(length) n", "count(distinct doc_id) d").first()
    assert total(corpus_pipeline.run(spark, SF).select(columns)) == total(kept["packed"][1].select(columns))
