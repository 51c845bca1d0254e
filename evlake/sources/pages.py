"""Links and candidate pages from HTML tables, and what to fetch again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import kept
from ..functions.text import unescape
from ..functions.urls import canonical_url, refresh_due, url_join

_HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def page_links(pages: DataFrame, page: str = "url", html: str = "html") -> DataFrame:
    """(page, pos, url): http(s) links of each page, resolved against it, once each at their first place."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(_HREF), F.lit(0)), lambda a: F.concat_ws("", *[F.regexp_extract(a, _HREF, i) for i in (1, 2, 3)]))
    found = pages.select(F.col(page).alias("page"), F.posexplode(hrefs).alias("pos", "_href"))
    joined = found.select("page", "pos", kept(url_join(F.col("page"), unescape(F.col("_href"))), lambda u: u.rlike("^(?i)https?://")).alias("url"))
    return joined.groupBy("page", "url").agg(F.min("pos").alias("pos")).select("page", "pos", "url")


def candidates(links: DataFrame, items: DataFrame | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """Candidate pages in one table: links, then item lists and fixed urls of (source_id, page, page_ord, pos, url[, item]).

    On one page items come before links and fixed urls before both, each in its own order.
    """
    out = links.withColumn("_rank", F.lit(2)).withColumn("item", F.lit(None).cast("string"))
    for rank, more in ((1, items), (0, fixed)):
        if more is not None:
            out = out.unionByName(more.withColumn("_rank", F.lit(rank)), allowMissingColumns=True)
    return out.withColumn("pos", F.col("_rank").cast("long") * F.lit(1 << 48) + F.col("pos")).drop("_rank")


def frontier(links: DataFrame, pattern: str, cap: int) -> DataFrame:
    """(source_id, url, place[, item]) of links(source_id, page, page_ord, pos, url[, item]): canonical pages that match pattern, first come first, at most cap for a source.

    The listing page itself is left out. item is that of the first place that has the page. cap is the
    source's own request limit.
    """
    ready = links.select("*", kept(canonical_url(F.col("url")), lambda u: u.rlike(pattern) & (u != canonical_url(F.col("page")))).alias("_url"))
    at = F.struct("page_ord", "pos")
    item = [F.min_by("item", at).alias("item")] if "item" in links.columns else []
    first = ready.groupBy("source_id", F.col("_url").alias("url")).agg(F.min(at).alias("_at"), *item)
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("_at", "url")))
    return placed.where(F.col("place") <= cap).drop("_at")


def refresh_plan(candidates: DataFrame, stored: DataFrame, day: Column, every: int) -> DataFrame:
    """candidates(source_id, url, listing, signals) with action: reuse, reuse_with_new_signals or fetch.

    A stored page is used again while its listing is the same and its day hasn't come.
    """
    old = stored.select("source_id", "url", F.col("listing").alias("_listing"), F.col("signals").alias("_signals"), F.lit(True).alias("_stored"))
    joined = candidates.join(old, ["source_id", "url"], "left")
    same = F.col("_stored").isNotNull() & F.col("listing").eqNullSafe(F.col("_listing")) & ~refresh_due(F.col("url"), day, every)
    action = F.when(same & F.col("signals").eqNullSafe(F.col("_signals")), "reuse").when(same, "reuse_with_new_signals").otherwise("fetch")
    return joined.withColumn("action", action).drop("_listing", "_signals", "_stored")


def failed_sources(fetches: DataFrame, least: int = 3) -> DataFrame:
    """Sources whose fetches (source_id, ok) all failed, of least at least."""
    counted = fetches.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    return counted.where((F.col("n") >= least) & (F.col("n_ok") == 0)).select("source_id")
