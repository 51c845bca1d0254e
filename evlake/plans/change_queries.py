"""Queries on fetches and on what changes from run to run: outcomes, delays, the raw log, and the table of latest hashes."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, urls
from ..operators import browse, changes
from ..operators.hash_table import HashTable
from ..operators.storage import shared_dir, written
from ..sources import ics, pages, robots
from . import run as daily
from .registry import query, table
from .run_queries import NOW, _CUSTOMERS, _empty, _records, _reference


@query("""
select event_id, case when event_type = 'signup' or event_id % 7 = 3 or (event_id % 2 = 0 and status = 202) then 'challenge' when status in (429, 503) then 'retry' when status >= 400 then 'error' else 'ok' end as outcome
from (select *, case event_id % 5 when 0 then 200 when 1 then 202 when 2 then 404 when 3 then 429 else 503 end as status from events)
""")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a fetch log, with the headers of challenge pages in other letter case."""
    status = F.element_at(F.array(*map(F.lit, (200, 202, 404, 429, 503))), (F.col("event_id") % 5 + 1).cast("int"))
    headers = F.when(F.col("event_type") == "signup", F.create_map(F.lit("CF-Mitigated"), F.lit("challenge"))).when(F.col("event_id") % 7 == 3, F.create_map(F.lit("x-amzn-WAF-action"), F.lit("captcha"))).otherwise(F.create_map(F.lit("server"), F.lit("x")))
    method = F.when(F.col("event_id") % 2 == 0, F.lit("GET")).otherwise("POST")
    return table(spark, sf_dir, "events").select("event_id", changes.fetch_outcome(status, headers, method).alias("outcome"))


@query("select cast(user_id as varchar) || ' ' || cast(ts as date) as source_id from events group by 1 having count(*) >= 3 and bool_and(event_type in ('error', 'view'))")
def failed_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days as sources: those whose fetches all failed."""
    fetches = table(spark, sf_dir, "events").select(F.concat_ws(" ", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("source_id"), (~F.col("event_type").isin("error", "view")).alias("ok"))
    return pages.failed_sources(fetches)


@query("""
with h as (select distinct lower(regexp_extract(url, '://([^/?#]*)', 1)) as host from pages)
select host, case when length(host) % 3 <> 0 then false end as allow, case when length(host) % 3 <> 0 then '/x' end as pattern, case when length(host) % 2 = 0 then 2.5::double end as delay from h where length(host) % 3 <> 0 or length(host) % 2 = 0
""")
def crawl_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages with a delay, with path rules, with both, or with neither."""
    host = urls.host(F.col("url")).alias("host")
    n = F.length("host")
    lines = F.array_compact(F.array(F.lit("User-agent: *"), F.when(n % 2 == 0, F.lit("Crawl-delay: 2.5")), F.when(n % 3 != 0, F.lit("Disallow: /x")), F.lit("Sitemap: https://s.test/")))
    return robots.read_robots(table(spark, sf_dir, "pages").select(host).distinct().withColumn("body", F.array_join(lines, "\r\n")), "crawler")


@query("select s_suppkey, s_name || ' Falls' as place from supplier")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names as gazetteer names of every legal type, some in capitals, some (balance)."""
    ends = [*(f" {t}" for t in geo.PLACE_TYPES), *(f" {t.upper()}" for t in geo.PLACE_TYPES), *(f" {t} (balance)" for t in geo.PLACE_TYPES), " (balance)", "  (Balance)", ""]
    end = F.element_at(F.array(*map(F.lit, ends)), (F.col("s_suppkey") % len(ends) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", geo.place_name(F.concat("s_name", F.lit(" Falls"), end)).alias("place"))


@query("with " + _CUSTOMERS + """
select 'cal-' || s as source_id, cast(k as varchar) as native_id, 'r1' as run_id from c union all select 'cal-' || s, cast(k as varchar), 'r2' from c where k % 5 = 0 and not bad
""")
def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log of two days, the second of them tried twice: what was new or had changed, found by the table of hashes."""
    reference, folder = _reference(spark), f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    reference.raw_path, reference.hash_path = f"{folder}/raw", f"{folder}/hashes"
    first, _, _ = daily.ingest(_empty(spark), _records(spark, sf_dir, 1), ics.parse_ics, reference, NOW, "r1")
    for _ in range(2):
        state, _, _ = daily.ingest(first, _records(spark, sf_dir, 2), ics.parse_ics, reference, NOW + dt.timedelta(days=1), "r2")
    return state.raw.select("source_id", "native_id", "run_id")


_WEEKS = 5


@query("""
with r as (select event_type as source_id, cast(user_id as varchar) as native_id, cast(cast(floor(value / 20) as bigint) as varchar) as content_hash, ts, cast(floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 604800) as int) as week from events),
l as (select source_id, native_id, week, arg_max(content_hash, {'t': ts, 'h': content_hash}) as content_hash from r where week < 5 group by all)
select source_id, native_id, week, case when lag(content_hash) over w is null then 'new' when lag(content_hash) over w = content_hash then 'unchanged' else 'changed' end as change from l window w as (partition by source_id, native_id order by week)
""")
def hash_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of events as fetches, each against the table of hashes that the weeks before left."""
    week = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 604800).cast("int")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("native_id"), F.floor(F.col("value") / 20).cast("string").alias("content_hash"), F.col("ts").alias("fetched_at"), week.alias("week"))
    weekly = rows.groupBy("source_id", "native_id", "week").agg(F.max(F.struct("fetched_at", "content_hash")).alias("r")).select("source_id", "native_id", "week", "r.*")
    hashes = HashTable(spark, f"{shared_dir(spark)}/hashes-{uuid.uuid4().hex}", ["source_id", "native_id"], buckets=16)
    found = None
    for k in range(_WEEKS):
        told = written(hashes.detect(weekly.where(F.col("week") == k), f"week{k}"), "week")
        hashes.append(told.where("change <> 'unchanged'"), f"week{k}")
        found = told if found is None else found.unionByName(told)
    return found.select("source_id", "native_id", "week", "change")


@query("select o_orderkey, place, cast(420 as int) as page from (select o_orderkey, row_number() over (order by o_orderpriority, o_orderdate desc, o_orderkey) as place from orders) where place between 419 * 25 + 1 and 420 * 25")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 420 of all orders by priority, from a ranked table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    ranked = browse.Ranked.write(orders, ["o_orderpriority", F.desc("o_orderdate"), "o_orderkey"], f"{shared_dir(spark)}/ranked-{uuid.uuid4().hex}", 32)
    return ranked.page("25", 420).select("o_orderkey", "place", "page")
