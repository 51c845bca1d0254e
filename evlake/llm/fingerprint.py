"""Exact document fingerprints: canonical text, wide xxhash grouping, bytes compared inside equal buckets; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import keyed, written

#: Ids that share a window when neighbours are sought.
WINDOW_IDS = 1024
_NORMALIZER, _CHARACTERS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    """Compatibility composition (NFKC), full case folding, and white space runs as one space, none at the ends; null as empty.

    ASCII texts skip Unicode normalisation, which cannot change them.
    """
    text = F.coalesce(text, F.lit(""))
    wide = F.reflect(F.lit(_NORMALIZER), F.lit("compose"), text, F.lit(True))
    wide = F.reflect(F.lit(_CHARACTERS), F.lit("foldCase"), wide, F.lit(True))
    wide = F.reflect(F.lit(_NORMALIZER), F.lit("compose"), wide, F.lit(True))
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(wide)
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: two xxhash64 runs with different seeds."""
    halves = [F.lower(F.lpad(F.hex(h), 16, "0")) for h in (F.xxhash64(canon), F.xxhash64(F.lit("second seed"), canon))]
    return F.concat(*halves)


def split_buckets(canons: DataFrame) -> DataFrame:
    """Digests of canons(digest, canon) under which different canonical texts lie, found by comparing bytes.

    Copies are combined within each map task, and each different text travels once.
    """
    return canons.distinct().groupBy("digest").count().where("count > 1").select("digest")


def fingerprint_name(digest_col: Column, is_split: Column, canon_sha: Column) -> Column:
    """The digest; where its bucket holds different texts, with the text's SHA-256 besides."""
    return F.when(is_split, F.concat(digest_col, F.lit("-"), canon_sha)).otherwise(digest_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): equal exactly where canonical texts are equal; a null text counts as empty. Empty input: no rows."""
    canons = keyed(docs, id_col, text_col).select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("digest", digest(F.col("canon")))
    slim = canons.select("doc_id", "digest", F.sha2("canon", 256).alias("sha"))
    split = split_buckets(canons.select("digest", "canon")).withColumnRenamed("digest", "_split")
    return slim.join(split, F.col("digest") == F.col("_split"), "left").select("doc_id", fingerprint_name(F.col("digest"), F.col("_split").isNotNull(), F.col("sha")).alias("fingerprint"))


#: Rows of a last window, at most: so many numbers are left when ids are shifted often enough.
LAST_WINDOW = 1024


def _next_bucket(buckets: DataFrame, span: int) -> DataFrame:
    """(chain, bucket, next_bucket): for each different bucket of a chain the next lower one, null for the lowest.

    Windows of WINDOW_IDS numbers first; what is last in its window gets the highest bucket of the next
    lower window, found in the same way until no more than LAST_WINDOW numbers are left, however the
    buckets are spread over a range of span. So no window holds more.
    """
    if span <= LAST_WINDOW:
        everywhere = Window.partitionBy("chain").orderBy(F.desc("bucket"))
        return buckets.select("chain", "bucket", F.lead("bucket").over(everywhere).alias("next_bucket"))
    # shiftright floors where integer division would round towards zero
    grouped = buckets.withColumn("above", F.shiftright("bucket", 10))
    inside = grouped.withColumn("lower", F.lead("bucket").over(Window.partitionBy("chain", "above").orderBy(F.desc("bucket"))))
    tops = grouped.groupBy("chain", "above").agg(F.max("bucket").alias("top"))
    after = _next_bucket(tops.select("chain", F.col("above").alias("bucket")), (span >> 10) + 1).select("chain", F.col("bucket").alias("above"), F.col("next_bucket").alias("next_above"))
    nexts = after.join(tops.select("chain", F.col("above").alias("next_above"), F.col("top").alias("next_top")), ["chain", "next_above"], "left").select("chain", "above", "next_top")
    return inside.join(nexts, ["chain", "above"]).select("chain", "bucket", F.coalesce("lower", "next_top").alias("next_bucket"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with next_text, that of the next row by descending doc_id (after the last: the first).

    A window sees the rows of WINDOW_IDS ids; only the first row of each such bucket travels further,
    to the last of the bucket above. Equal ids follow one another by a hash of their texts and by text.
    Null ids come last, in the order of such hashes, a chain of their own with buckets of hashes.
    """
    # no id and no hash stands alone: both are numbers whose high bits are a bucket
    null_id = F.col("doc_id").isNull()
    placed = docs.withColumn("digest", F.xxhash64("text")).withColumns({"chain": null_id.cast("int"), "number": F.coalesce("doc_id", "digest")}).withColumn("bucket", F.shiftright("number", 10))
    low, high = placed.agg(F.min("bucket"), F.max("bucket")).first()
    order = [F.desc("number"), F.desc("digest"), F.desc("text")]
    within = Window.partitionBy("chain", "bucket").orderBy(*order)
    inner = placed.withColumns({"inner_next": F.lead("text").over(within), "is_last": F.lead(F.lit(True)).over(within).isNull()})
    heads = placed.withColumn("place", F.row_number().over(within)).where("place = 1").select("chain", F.col("bucket").alias("next_bucket"), F.col("text").alias("head"))
    follows = _next_bucket(placed.select("chain", "bucket").distinct(), (high or 0) - (low or 0) + 1)
    # after the last bucket of the ids come the null ids, and after these the ids begin again
    ends = placed.groupBy("chain").agg(F.max("bucket").alias("top"))
    ends = ends.withColumn("after", (F.col("chain") + 1) % 2)
    both = ends.select(F.col("after").alias("next_chain"), F.col("chain").alias("from_chain")).join(ends.select(F.col("chain").alias("next_chain"), "top"), "next_chain")
    own = ends.select(F.col("chain").alias("from_chain"), F.col("chain").alias("own_chain"), F.col("top").alias("own_top"))
    turns = own.join(both, "from_chain", "left").select(F.col("from_chain").alias("chain"), F.coalesce("next_chain", "own_chain").alias("next_chain"), F.coalesce("top", "own_top").alias("first_bucket"))
    linked = follows.join(F.broadcast(turns), "chain").select(
        "chain", "bucket", F.when(F.col("next_bucket").isNull(), F.col("next_chain")).otherwise(F.col("chain")).alias("to_chain"), F.coalesce("next_bucket", "first_bucket").alias("next_bucket"))
    nexts = linked.join(heads.withColumnRenamed("chain", "to_chain"), ["to_chain", "next_bucket"]).select("chain", "bucket", "head")
    return inner.join(nexts, ["chain", "bucket"]).select("doc_id", "text", F.when(F.col("is_last"), F.col("head")).otherwise(F.col("inner_next")).alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside an edited form of itself, whose second half is the beginning of the next text.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    An exact digest knows equal from different alone, so likeness is 1.0 or 0.0, by comparing canonical
    bytes. Buckets of texts are compared by bytes, edited forms with them by SHA-256. A single row is its own next. A null text counts as empty. Empty input: no rows.
    """
    texts = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    both = with_next(texts).select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(edited).alias("edited"), canonical(F.col("next_text")).alias("next"))
    sha = lambda text: F.unhex(F.sha2(text, 256))
    slim = both.select(
        "doc_id", "n_chars", F.unhex("edited_sha256").alias("edited_sha256"), F.unhex(digest(F.col("canon"))).alias("digest"), F.unhex(digest(F.col("edited"))).alias("edited_digest"),
        sha("canon").alias("sha"), sha("edited").alias("edited_sha"), (F.col("canon") == F.col("edited")).cast("double").alias("near_edited"), (F.col("canon") == F.col("next")).cast("double").alias("near_next"))
    slim = written(slim, "digests")
    canons = texts.select(canonical(F.col("text")).alias("canon"))
    split = split_buckets(canons.select(F.unhex(digest(F.col("canon"))).alias("digest"), "canon"))
    named = slim.select("digest", "sha").unionByName(slim.select(F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("sha")))
    split = written(split.unionByName(named.distinct().groupBy("digest").count().where("count > 1").select("digest")).distinct(), "split")
    if split.isEmpty():  # as for all but made-up texts: every digest is a name
        slim = slim.withColumns({"digest_split": F.lit(None).cast("binary"), "edited_digest_split": F.lit(None).cast("binary")})
    else:
        for name in ("digest", "edited_digest"):
            slim = slim.join(split.select(F.col("digest").alias(f"{name}_split")), F.col(name) == F.col(f"{name}_split"), "left")
    text_of = lambda c: F.lower(F.hex(c))
    return slim.select(
        "doc_id", "n_chars", text_of("edited_sha256").alias("edited_sha256"),
        fingerprint_name(text_of("digest"), F.col("digest_split").isNotNull(), text_of("sha")).alias("fingerprint"),
        fingerprint_name(text_of("edited_digest"), F.col("edited_digest_split").isNotNull(), text_of("edited_sha")).alias("edited_fingerprint"),
        "near_edited", "near_next")
