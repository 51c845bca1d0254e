"""Retrieval of the packing operator against plain BM25."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from evlake.llm import packing


def bm25(ids, idf, mean, seed, d):
    total = 0.0
    for t in np.unique(ids[seed]):
        tf = int((ids[d] == t).sum())
        total += float(idf[t]) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids[d]) / mean))
    return total


def test_all_terms_of_long_seeds_count():
    rng = np.random.default_rng(5)
    n, n_terms = 60, 4000
    weights = 1 / np.arange(1, n_terms + 1)
    ids = [rng.choice(n_terms, rng.integers(500, 1500), p=weights / weights.sum()).astype("<u2") for _ in range(n)]
    assert min(len(np.unique(x)) for x in ids) > 200
    seen = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=n_terms)
    idf = np.log1p((n - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    mean = float(np.mean([len(x) for x in ids]))
    index = packing.Bm25Shard(ids, idf, mean)
    assert 0 < (index.row >= 0).sum() < (seen > 0).sum()
    for seed in range(0, n, 7):
        unused = np.ones(n, bool)
        unused[[seed, (seed + 1) % n]] = False
        want = {d: bm25(ids, idf, mean, seed, d) for d in range(n) if unused[d]}
        got = index.neighbours(seed, unused).tolist()
        assert sorted(got) == sorted(d for d in want if want[d] > 0)
        scores = [want[d] for d in got]
        assert all(a >= b - 1e-4 * a for a, b in zip(scores, scores[1:]))


def test_shards_stay_within_their_size(spark, monkeypatch):
    """Topics that the sample hardly meets, one that holds half of all, and rests without a telling term."""
    monkeypatch.setattr(packing, "FIT_RESTS", 40)
    monkeypatch.setattr(packing, "TELLING_TERMS", 64)
    rng = np.random.default_rng(3)
    words = [[f"{chr(97 + t % 26)}{chr(97 + t // 26)}{w}word" for w in "abcdefghij"] for t in range(60)]
    of = np.where(rng.random(4000) < 0.5, 0, rng.integers(0, 60, 4000))
    rows = [(i, " ".join(rng.choice(words[t], 25)) if i % 9 else "the") for i, t in enumerate(of.tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), shard_ids=20_000).selectExpr("(sequence_id - 1) div 2 >> 32 as shard", "length").groupBy("shard").sum("length").collect()
    sizes = [r[1] for r in got]
    assert max(sizes) <= 1.1 * 20_000 and len(sizes) > sum(sizes) / 20_000 > 5


def test_only_the_best_neighbours_are_sorted_and_the_windows_stay(monkeypatch):
    """Windows are as with whole rankings, where few neighbours fill a window and where all of them don't."""
    monkeypatch.setattr(packing, "FEW", 4)

    def plain(lengths, ranked, window):
        rest, out, left = list(lengths), [], sum(lengths)
        while left:
            seed = next(i for i, n in enumerate(rest) if n)
            room = size = min(window, 1 << (left.bit_length() - 1))
            queue = [seed, *[i for i in ranked[seed] if i != seed], *[i for i in range(len(rest)) if i != seed and i not in ranked[seed]]]
            for i in queue:
                n = min(rest[i], room)
                if n:
                    out.append((i, lengths[i] - rest[i], n, size - room))
                    rest[i] -= n
                    room -= n
            left -= size
        return out

    rng = np.random.default_rng(8)
    asked = set()
    for longest in (3, 20, 63):
        lengths = rng.integers(1, longest + 1, 90).tolist()
        ranked = [rng.permutation(90)[: rng.integers(0, 90)].tolist() for _ in lengths]

        def neighbours(seed, unused, most=None):
            asked.add(most)
            return np.array([i for i in ranked[seed] if unused[i]][:most], np.int64)

        got = packing.fill(lengths, neighbours, 64)
        assert [(p, a, n, o) for p, a, n, _, o in got] == plain(lengths, ranked, 64)
    assert asked == {4, None}


def test_the_best_alone_are_the_first_of_all():
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 30, rng.integers(3, 9)).astype("<u2") for _ in range(120)]
    ids += ids[:40]  # equal pieces have equal scores
    index = packing.Bm25Shard(ids, np.linspace(1, 2, 30).astype(np.float32), 5.5)
    for seed in range(0, 160, 9):
        unused = np.ones(160, bool)
        unused[seed] = False
        all_of_them, best = index.neighbours(seed, unused).tolist(), index.neighbours(seed, unused, 10).tolist()
        assert 10 <= len(best) < len(all_of_them) and best == all_of_them[: len(best)]


def test_marks_after_letters_are_words_of_their_own():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["salt### Öl,$$$ salt.*** salt?!;: salt's. salt's'. don't!! 12.3% a.b&& ... salt", "SALT### <|endoftext|> <|x|>. É! é! #salt# salt###salt."]:
        assert np.frombuffer(words.ids(text), words.type).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert {b"salt", b"###", b"salt###"} <= set(words)


def test_words_beyond_the_cache_are_encoded_where_they_occur(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    text = "one two. three### four, five one two. three### " + "x" * 70 + " " + "x" * 70
    for _ in range(2):
        assert np.frombuffer(words.ids(text), words.type).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(words) == 3


def encoded(words, text):
    return words.tokenizer.encode(text, add_special_tokens=False).ids


ODD_TEXTS = [
    None, "", " ", "\n\t \x0b\x0c\r", "Salt, pepper;\tSALT. salt\r\nsalt", " .a. a.b,c ...x!y?", "don't #'s a'.s .'s '.s x's's. 'll ''re", "12.3% a1,2b 1a#2",
    "É, é. e\u0301, e.\u0301 a\u0301b .\u0301a n\u0303#\u0303", "\u1100\u1161, \u212b. \u0130! \u1e9e; \ufb01, \u03a3\u03c2.", "a\x1cb.\x85c,\u00a0d \u2028. \u3000, e", "<|endoftext|> A. <|x|>, B", "a <| B,c. |> D", "<|ENDOFTEXT|> e,",
    "x" * 5000 + ", " + "y." * 70, "日本語,かな. \U0001f600! a\U0001f600.b", "\0a.\0, \x01", ",", "a", "salt.", ".salt",
]


def test_ids_of_many_texts_are_those_of_each(monkeypatch):
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(4)
    signs = list("abzAZ  \n\t.,;#'!-1é\u0301\u00a0ßİ<|日")
    texts = ODD_TEXTS + ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(800)]
    want = [encoded(words, t or "") for t in texts]
    for room in (packing.CACHE_WORDS, 5):
        monkeypatch.setattr(packing, "CACHE_WORDS", room)
        words.clear()
        for kind in (pa.string(), pa.large_string()):
            got = words.ids_of(pa.array(["before", *texts, "after"], kind).slice(1, len(texts)))
            assert [np.frombuffer(x, words.type).tolist() for x in got] == want
    for texts in ([None], [""], ["", None, " "], ["<|endoftext|>"]):
        assert [np.frombuffer(x, words.type).tolist() for x in words.ids_of(pa.array(texts, pa.string()))] == [encoded(words, t or "") for t in texts]


def test_a_word_of_several_texts_is_looked_up_once():
    asked = []

    class Words(packing.WordIds):
        def get(self, word, default=None):
            asked.append(word)
            return super().get(word, default)

        def __missing__(self, word):
            asked.append(word)
            return super().__missing__(word)

    words = Words(public_tokenizers.path("word_bpe_49k.json"))
    words.ids_of(pa.array(["Salt and pepper, salt.", "salt; pepper. SALT\nand salt"]))
    assert sorted(w for w in asked if w.isalpha()) == [b"and", b"pepper", b"salt"]
    assert len(asked) <= 2 * len(words)


def test_frequencies_count_a_piece_once(spark):
    pieces = [np.array(x, "<u2").tobytes() for x in ([1, 2, 1, 1], [2], [5, 5], [1, 5, 2])]
    frame = spark.createDataFrame([(bytearray(p),) for p in pieces], "ids binary").coalesce(1)
    assert packing.document_frequencies(frame, "<u2", 7).tolist() == [0, 2, 3, 0, 0, 2, 0]
