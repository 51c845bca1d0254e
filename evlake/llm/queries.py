"""The registered queries of this subpackage: thin forms of its operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, fingerprint, lexical_search, line_dedup, packing, pii, quality_model, quality_rules, simhash, substring_dedup, url_filter, warc
from ._shared import table

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_RANKS)
    found = bpe.encode(table(spark, sf_dir, "documents"), path)
    found = found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), bpe.decode(F.col("ids"), path, F.col("counts")).alias("decoded"))
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).drop("host")


OP3_SQL = """
with t as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from t),
f as (select doc_id, source, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  words from w),
g as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from f),
h as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as win from g),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from h) where n >= 2),
c as (select doc_id, count(distinct pos) as n from (select doc_id, unnest([i, i + 1, i + 2]) as pos from r) group by doc_id),
b as (select f.doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
  n_words < 50 or 100 * coalesce(c.n, 0) > 50 * n_words as base_failed from f left join c using (doc_id)),
x as (select *, 100 * n_repeat_words > 25 * n_words as f1, 100 * n_symbols > 10 * n_words as f2, 100 * n_dup_lines > 5 * n_words as f3 from b),
s as (select source, count(*) as n, count(*) filter (where base_failed) as b0, count(*) filter (where f1) as b1, count(*) filter (where f2) as b2, count(*) filter (where f3) as b3 from x group by source),
e as (select source, n, unnest([0, 1, 2, 3]) as k, unnest([b0, b1, b2, b3]) as bad from s),
m as (select k, avg(bad / n) as mean, var_pop(bad / n) as v from e group by k),
p as (select k, mean, case when v > 0 then greatest(mean * (1 - mean) / v - 1, 0) else 1e6 end as strength, case when k = 0 then 0.75 when v > 0 then mean + sqrt(v) else 1.0 end as limit_ from m),
d as (select source, list(k) filter (where (bad + mean * strength) / (n + strength) > limit_) as fails from e join p using (k) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or coalesce(list_contains(fails, 0) or (f1 and list_contains(fails, 1)) or (f2 and list_contains(fails, 2)) or (f3 and list_contains(fails, 3)), false)) as kept
from x join d on x.source is not distinct from d.source
"""


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = substring_dedup.without_repeats(docs)
    lost = cut.select(*substring_dedup.KEY, F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("lost"), F.size("spans").cast("long").alias("n_cut"), F.sha2("kept", 256).alias("cut_sha")).dropDuplicates(substring_dedup.KEY)
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", *substring_dedup.row_key(F.col("doc_id"), F.col("text")), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    joined = whole.join(lost, substring_dedup.KEY, "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("lost", F.lit(0)).alias("n_removed"), F.coalesce("n_cut", F.lit(0)).alias("n_spans"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))


#: Scores from here on predict label 1.
GOOD_SCORE = 0.7


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    found = quality_model.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (select doc_id, unnest(range(1, len(parts) + 1)) as pos, unnest(parts) as line from t),
k as (select *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, min(doc_id) as keeper from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
d as (select k.*, r.keeper is not null and k.doc_id <> r.keeper as gone from k left join r using (key))
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from d group by doc_id
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), end_id=1, window=2048)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES, default="allow")


OP10_SQL = """
with rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
s as (select page_id, url, coalesce(substr(url, nullif(strpos(url, '://'), 0) + 3), '') as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from s),
m as (select p.*, rhost || rpath as rule, verdict, row_number() over (partition by page_id order by length(rhost) desc nulls last, length(rpath) desc) as rn
  from p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where rn = 1
"""

def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP12_SQL = """
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as id from documents),
g as (select distinct lang, source from d),
w as (select lang, source, id, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
k as (select lang, term, count(*) as c from w group by lang, term having count(distinct id) >= 3),
t as (select lang, count(*) as v, sum(c) as n from k group by lang),
s as (select w.lang, w.source, w.term, count(*) as c from w join k using (lang, term) group by w.lang, w.source, w.term),
h as (select lang, source, sum(c) as n from s group by lang, source),
a as (select g.lang, g.source, k.term, coalesce(s.c, 0) as c, cast(1 + 1000000000::hugeint * (coalesce(s.c, 0) + 1) // (coalesce(h.n, 0)::hugeint + t.v) as bigint) as p,
  cast(1 + 1000000000::hugeint * (k.c + 1) // (t.n::hugeint + t.v) as bigint) as ql
  from g join k on g.lang = k.lang join t on t.lang = g.lang left join h on h.lang = g.lang and h.source = g.source left join s on s.lang = g.lang and s.source = g.source and s.term = k.term),
f as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value from a x join a y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by x.lang, x.source, y.source),
p as (select x.lang, x.source, y.source as item, cast(coalesce(f.value, 0) as bigint) as value from g x join g y on x.lang = y.lang and x.source <> y.source left join f on f.lang = x.lang and f.source = x.source and f.item = y.source),
e as (select lang, source, term as item, (p - ql) * (p - ql) // ql as value from a where c > 0 and p > ql)
select lang, source, 'pair' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as int) as rank from p
union all select lang, source, 'term', item, value, cast(rank as int) from (select *, row_number() over (partition by lang, source order by value desc, item) as rank from e) where rank <= 200
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = """
with terms as (select doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as raw from documents),
w as (select doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from terms),
t as (select doc_id, term, count(*) as tf from w group by doc_id, term),
n as (select doc_id, sum(tf)::bigint as n from t group by doc_id),
c as (select count(*)::bigint as docs, sum(n)::bigint as total from n),
m as (select doc_id, 100 - 50 + (50 * n * docs) // total as m from n, c),
d as (select term, count(*) as df from t group by term),
i as (select distinct item_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from (select item_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as raw from benchmark)),
iw as (select item_id, term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as weight from i join d using (term), c),
s as (select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score from iw join t using (term) join m using (doc_id) group by item_id, doc_id)
select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_fingerprints": op4_fingerprints,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_model": op6_quality_model,
    "op7_line_dedup": op7_line_dedup,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "op11_warc": op11_warc,
    "op12_source_divergence": op12_source_divergence,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op7_line_dedup": OP7_SQL, "op10_url_filter": OP10_SQL, "op12_source_divergence": OP12_SQL, "op13_lexical_search": OP13_SQL}
