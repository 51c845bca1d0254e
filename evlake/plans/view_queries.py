"""Queries on places, topics, profiles, health, feeds and browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, times
from ..operators import browse, changes, classify, health, locate, publish, spatial
from ..sources import gazetteer, geojson
from .record_queries import _RUNS, _runs
from .registry import query, table, ts

# --- places ---------------------------------------------------------------------

#: Two regions; the first has a hole, and the second overlaps it.
REGIONS = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "properties": {"name": "West"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [6, 0], [6, 6], [0, 6], [0, 0]], [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]]}},
 {"type": "Feature", "properties": {"name": "East"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 1], [9, 1], [9, 5], [5, 5]]]]}}]}"""

_POINTS = "p as (select event_id, (user_id % 100) / 10.0 + value / 100000 as lon, (event_id % 70) / 10.0 + 0.013 as lat from events)"
_EDGES = """
e(poly, name, x1, y1, x2, y2) as (values (0,'West',0,0,6,0),(0,'West',6,0,6,6),(0,'West',6,6,0,6),(0,'West',0,6,0,0),(0,'West',2,2,4,2),(0,'West',4,2,4,4),(0,'West',4,4,2,4),(0,'West',2,4,2,2),
  (1,'East',5,1,9,1),(1,'East',9,1,9,5),(1,'East',9,5,5,5),(1,'East',5,5,5,1)),
h as (select event_id, poly, name from p join e on (y1 > lat) <> (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (nullif(y2 - y1, 0)) group by 1, 2, 3 having count(*) % 2 = 1)
"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100 / 10.0 + F.col("value") / 100000).alias("lon"), (F.col("event_id") % 70 / 10.0 + 0.013).alias("lat"))


def _polygons(spark: SparkSession) -> DataFrame:
    return geojson.polygons(spark.createDataFrame([("area", REGIONS)], "region_id string, body string"))


@query("with " + _POINTS + "," + _EDGES + " select distinct event_id, 'area' as region_id from h")
def region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.region_members(_points(spark, sf_dir), _polygons(spark), ["event_id"])


@query("with " + _POINTS + "," + _EDGES + " select p.event_id, arg_min(name, poly) as area from p left join h using (event_id) group by 1")
def area_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.area_labels(_points(spark, sf_dir), _polygons(spark), ["event_id"]).select("event_id", "area")


_ADDRESS = "a as (select o_orderkey, lower('Suite ' || (o_custkey % 300) || ', Springfield, ' || (['IL', 'California', 'Texas'])[o_custkey % 3 + 1] || ' ' || (10000 + o_custkey % 40)) as k, o_orderdate as start from orders)"


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(F.lit("IL"), F.lit("California"), F.lit("Texas")), (F.col("o_custkey") % 3 + 1).cast("int"))
    address = F.concat(F.lit("Suite  "), F.col("o_custkey") % 300, F.lit(" ,Springfield,  "), state, F.lit(" "), 10000 + F.col("o_custkey") % 40)
    return table(spark, sf_dir, "orders").select("o_orderkey", address.alias("address"), F.col("o_orderdate").alias("start_utc"))


@query("with " + _ADDRESS + """,
d as (select k as address_key, min(start) as first_start, min(cast(regexp_extract(k, 'suite (\\d+)', 1) as int)) as n from a group by 1)
select address_key, first_start, case when n % 4 = 0 then 'cached' when n % 4 = 1 then 'offline' else 'needs_lookup' end as plan, case when n % 4 = 0 then n::double end as lat from d
""")
def geocode_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different addresses of orders against a cache that knows some, and knows others as missing."""
    events = _addresses(spark, sf_dir)
    key = geo.address_key(F.col("address"))
    n = F.regexp_extract("address_key", r"suite (\d+)", 1).cast("int")
    cache = events.select(key.alias("address_key")).distinct().where(n % 4 != 3).select(
        "address_key", F.when(n % 4 == 0, n.cast("double")).alias("lat"), F.when(n % 4 == 0, F.lit(1.0)).alias("lon"), F.lit(None).cast("string").alias("precision"),
        F.when(n % 4 == 2, ts("2026-01-01")).otherwise(ts("2026-09-30")).alias("looked_up_at"))
    return locate.lookup_plan(events, cache, ts("2026-10-01")).select("address_key", "first_start", "plan", "lat")


@query("with " + _ADDRESS + """,
d as (select distinct k, regexp_extract(k, ' ([a-z]+) (\\d{5})$', 1) as st, regexp_extract(k, '(\\d{5})$', 1) as zip from a)
select k as address_key, case when zip::int % 3 = 0 then zip::double / 1000 else 39.0 end as lat, case when zip::int % 3 = 0 then 'postal' else 'place' end as precision
from d where st = 'il' or st = 'california'
""")
def zip_place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by postal code where the code is known, else by state and city."""
    keys = _addresses(spark, sf_dir).select(geo.address_key(F.col("address")).alias("address_key")).distinct()
    zips = spark.range(10000, 10040).where("id % 3 = 0").select(F.col("id").cast("string").alias("zip"), (F.col("id") / 1000).alias("lat"), F.lit(1.0).alias("lon"))
    places = spark.createDataFrame([("IL", "springfield", 39.0, 1.0), ("CA", "springfield", 39.0, 2.0)], "state string, place string, lat double, lon double")
    both = locate.postal_points(keys, zips).withColumn("rank", F.lit(0)).unionByName(locate.place_points(keys, places).withColumn("rank", F.lit(1)))
    best = both.groupBy("address_key").agg(F.min_by(F.struct("lat", "precision"), "rank").alias("b"))
    return best.select("address_key", "b.lat", "b.precision")


@query("""
with c as (select ['CA', 'TX', 'NY'][p_partkey % 3 + 1] as state, split_part(p_name, ' ', 2) as place, p_size as aland, p_partkey from part)
select state, place, arg_max(round(p_partkey / 100000.0, 5), row(aland, -p_partkey)) as lat from c group by 1, 2
""")
def centroid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a gazetteer: the largest of each (state, place)."""
    state = F.element_at(F.array(F.lit("CA"), F.lit("TX"), F.lit("NY")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(state.alias("USPS"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" city")).alias("NAME"), F.col("p_size").alias("ALAND"), F.col("p_partkey").alias("GEOID"), (F.col("p_partkey") / 100000.0).alias("INTPTLAT"), F.lit(0.0).alias("INTPTLONG"))
    return gazetteer.place_centroids(rows).select("state", "place", "lat")


# --- topics and profiles ------------------------------------------------------------

TOPIC = classify.Topic(keywords=["the of", "and", "der", "les"], exclude_keywords=["ertion"], description_min_matches=3, trusted_description_min_matches=2)
KINDS = {"talk": ["that", "this"], "workshop": ["of the", "was"], "meetup": ["und", "de la"]}

_DOCS = "t as (select doc_id, source, lower(coalesce(split_part(text, chr(10), 1), '')) as title, lower(coalesce(text, '')) as body from documents)"


def _hit(column: str, phrase: str) -> str:
    spelled = phrase.replace(" ", r"[\s\-]+")
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_]){spelled}($|[^\p{{L}}\p{{M}}\p{{N}}_])')"


_TOPIC = (
    "m as (select doc_id, source, not (" + _hit("title", "ertion") + ") and ((" + " or ".join(_hit("title", p) for p in TOPIC.keywords) + ") or ("
    + " + ".join(f"cast({_hit('body', p)} as int)" for p in TOPIC.keywords) + ") >= case when source in ('src1', 'src2') then 2 else 3 end) as matches from t)"
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"), "text")


@query("with " + _DOCS + "," + _TOPIC + " select doc_id, matches from m")
def topic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", classify.topic_match(F.col("title"), F.col("text"), F.col("source").isin("src1", "src2"), TOPIC).alias("matches"))


@query("with " + _DOCS + ", k as (select doc_id, source, list_filter([" + ", ".join(f"case when {' or '.join(_hit('title', p) for p in KINDS[k])} then '{k}' end" for k in sorted(KINDS)) + """], lambda x: x is not null) as ruled from t)
select doc_id, case when len(ruled) > 0 then ruled when cast(substr(source, 4) as int) % 2 = 0 then ['conference', 'talk'] else [] end as kinds from k
""")
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by title, else those of the document's source."""
    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "event_id")
    links = docs.select("event_id", F.col("source").alias("source_id"))
    even = F.substring("source_id", 4, 9).cast("int") % 2 == 0
    defaults = links.select("source_id").distinct().where(even).withColumn("default_kinds", F.array(F.lit("talk"), F.lit("conference")))
    return classify.classified(docs, links, defaults, KINDS).select(F.col("event_id").alias("doc_id"), F.col("rule_kinds").alias("kinds"))


_PROFILE = """
q as (select m.doc_id, m.source, case when m.doc_id % 6 = 0 then false when m.doc_id % 5 <> 0 then m.doc_id % 3 = 0 else m.source in ('src1', 'src3') end as placed, matches or m.source = 'src4' as topical from m where cast(substr(m.source, 4) as int) < 10)
"""


def _profile_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(considered, qualifying) documents of a profile over the first ten sources."""
    profile = classify.Profile("p", "area", TOPIC, [f"src{i}" for i in range(10)], trust_region=["src1", "src3"], trust_topic=["src1", "src2"], topic_always=["src4"])
    docs = _docs(spark, sf_dir).withColumnRenamed("doc_id", "event_id")
    considered = classify.events_of_sources(docs, docs.select("event_id", F.col("source").alias("source_id")), profile.sources)
    n = F.col("event_id")
    mode = F.when(n % 6 == 0, F.lit("online")).otherwise(F.lit("in_person"))
    return considered, considered.where(classify.admits(profile, F.array("source"), n % 3 == 0, n % 5 != 0, mode, F.col("title"), F.col("text")))


@query("with " + _DOCS + "," + _TOPIC + "," + _PROFILE + " select doc_id from q where placed and topical")
def profile_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_rows(spark, sf_dir)[1].select(F.col("event_id").alias("doc_id"))


@query("with " + _DOCS + "," + _TOPIC + "," + _PROFILE + """,
old as (select doc_id from documents where doc_id % 4 = 1)
select doc_id, timestamp '2026-01-01' as first_seen from old where doc_id not in (select doc_id from q where not (placed and topical))
union all select doc_id, timestamp '2026-10-01' from q where placed and topical and doc_id not in (select doc_id from old)
""")
def profile_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members after a run: old ones who weren't considered or still qualify, and new ones."""
    considered, qualifying = _profile_rows(spark, sf_dir)
    members = table(spark, sf_dir, "documents").where("doc_id % 4 = 1").select(F.col("doc_id").alias("event_id"), ts("2026-01-01").alias("first_seen"))
    return classify.sync_members(members, considered, qualifying, ts("2026-10-01"))[0].select(F.col("event_id").alias("doc_id"), "first_seen")


@query("with " + _DOCS + "," + _TOPIC + """,
j as (select cast(matches as int) as p, quality as y from m join labels using (doc_id))
select coalesce(count(*) filter (where p = 1 and y = 1) / nullif(count(*) filter (where p = 1), 0), 1.0) as precision, coalesce(count(*) filter (where p = 1 and y = 1) / nullif(count(*) filter (where y = 1), 0), 1.0) as recall,
  count(*) filter (where p = y) / nullif(count(*), 0) as accuracy, cast(count(*) filter (where p = 1 and y = 1) as bigint) as tp, cast(count(*) filter (where p = 1 and y = 0) as bigint) as fp, cast(count(*) filter (where p = 0 and y = 1) as bigint) as fn from j
""")
def label_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = topic_match(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("matches").cast("int").alias("predicted"), F.col("quality").alias("label"))
    return classify.label_metrics(predicted)


@query("select c_custkey as event_id, list_sort(list(o_orderpriority || '/' || o_orderkey || '/' || o_orderstatus) filter (where o_orderkey is not null)) as sources, list_sort(list(distinct o_orderpriority) filter (where o_orderpriority is not null)) as source_ids from customer left join orders on c_custkey = o_custkey group by 1")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with all their orders nested, and the different priorities among them."""
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderpriority").alias("source_id"), F.col("o_orderkey").cast("string").alias("native_id"), F.col("o_orderstatus").alias("url"))
    nested = publish.with_sources(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id")), links)
    return nested.withColumn("sources", F.array_sort(F.transform("sources", lambda s: F.concat_ws("/", s["source_id"], s["native_id"], s["url"]))))


# --- health -------------------------------------------------------------------------

_VERDICTS = _RUNS + """,
b as (select r.source_id, r.started_at, count(h.fetched) as n, median(h.fetched) as typical from runs r left join runs h on h.source_id = r.source_id and h.status = 'ok' and h.started_at < r.started_at and h.started_at >= r.started_at - interval 7 day group by 1, 2),
v as (select r.*, b.typical, cast(b.n as bigint) as n_history, list_filter([case when status <> 'ok' then 'fetch failed: ' || status end,
  case when parsed + parse_errors > 0 and parse_errors / (parsed + parse_errors) > 0.06 then parse_errors || ' of ' || (parsed + parse_errors) || ' changed records failed to parse' end,
  case when status = 'ok' and b.n >= 3 and typical > 0 and fetched < 0.9 * typical then 'fetched ' || fetched || ' records, typical is ' || regexp_replace(cast(typical as varchar), '\\.0$', '') end], lambda x: x is not null) as reasons from runs r join b using (source_id, started_at))
"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.verdicts(_runs(spark, sf_dir), min_yield=0.9, window_days=7, min_history=3, max_errors=0.06)


@query("with " + _VERDICTS + " select source_id, started_at, typical, n_history, reasons from v")
def health_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("source_id", "started_at", "typical", "n_history", "reasons")


@query("with " + _VERDICTS + """,
i as (select *, len(reasons) = 0 as healthy, sum(case when len(reasons) = 0 then 1 else 0 end) over (partition by source_id order by started_at) as island from v),
s as (select *, sum(case when healthy then 0 else 1 end) over (partition by source_id, island order by started_at) as streak, min(case when not healthy then started_at end) over (partition by source_id, island order by started_at) as first_bad from i),
l as (select *, coalesce(lag(streak) over (partition by source_id order by started_at), 0) as before from s)
select source_id, started_at, cast(streak as bigint) as unhealthy_runs, case when not healthy then first_bad end as since, case when healthy then 'healthy' when streak >= 4 then 'disabled' else 'unhealthy' end as state,
  case when not healthy and streak in (2, 4) then 'alert' when healthy and before >= 2 then 'resolve' end as action from l
""")
def health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.states(_verdicts(spark, sf_dir), alert_after=2, disable_after=4).select("source_id", "started_at", "unhealthy_runs", "since", "state", "action")


# --- feeds and browsing ---------------------------------------------------------------

_FEED = "f as (select cast(o_orderkey as varchar) as event_id, n_name as profile_id, o_orderdate + interval 1 day * (o_orderkey % 30) as start_utc, o_orderdate as first_seen, case when o_orderstatus = 'F' then 'cancelled' else 'scheduled' end as status from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events, their customers' nations as profiles."""
    events = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"), (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"))).alias("start_utc"), F.lit(None).cast("timestamp").alias("end_utc"), "o_custkey",
        F.col("o_orderdate").alias("first_seen"), F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("scheduled").alias("status"))
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    members = events.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("event_id", F.col("n_name").alias("profile_id"), "first_seen")
    return publish.profile_events(events.drop("o_custkey"), members, ts("1998-06-01"))


@query("with " + _FEED + " select profile_id, cast(count(*) as bigint) as upcoming, cast(count(*) filter (where first_seen >= timestamp '1998-05-25') as bigint) as new from f where start_utc >= timestamp '1998-06-01' group by 1")
def feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.feed_counts(_feed(spark, sf_dir), ts("1998-06-01"))


@query("with " + _FEED + " select profile_id, event_id from f where first_seen >= timestamp '1998-06-01' and first_seen < timestamp '1998-06-15' and start_utc > timestamp '1998-06-01' and status <> 'cancelled'")
def feed_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.added_between(_feed(spark, sf_dir), ts("1998-06-01"), ts("1998-06-15"), ts("1998-06-01")).select("profile_id", "event_id")


@query("with " + _FEED + ", r as (select profile_id, event_id, row_number() over (partition by profile_id order by first_seen desc, event_id desc) as place from f where start_utc >= timestamp '1998-06-01') select profile_id, event_id, cast(place as int) as place from r where place <= 100")
def feed_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.newest(_feed(spark, sf_dir)).select("profile_id", "event_id", "place")


@query("""
with m as (select c_custkey, c_name, c_mktsegment, row_number() over (order by lower(c_mktsegment), c_custkey) as k, count(*) over () as matched from customer where contains(lower(c_name || ' ' || c_mktsegment), 'cust') and contains(lower(c_name || ' ' || c_mktsegment), '1'))
select c_custkey, cast(3 as int) as page, cast(ceil(matched / 25.0) as int) as pages, cast(matched as int) as matched from m where k between 51 and 75
""")
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = browse.search(table(spark, sf_dir, "customer"), "CUST 1", ["c_name", "c_mktsegment"])
    shown = browse.page(found, browse.heading_order(F.col("c_mktsegment"), "c_custkey"), "25", 3)
    return shown.select("c_custkey", "page", "pages", "matched")


@query("""
with h as (select doc_id, case when doc_id % 2 = 0 then upper(source) else source end as heading from documents)
select arg_min(heading, doc_id) as heading, cast(count(*) as bigint) as n from h group by lower(heading)
""")
def browse_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under their sources, however spelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("source"))
    return browse.groups(docs, F.col("source"), ["doc_id"])


@query("select event_id, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%Y-%m-%d') as day, extract(year from timezone('America/Los_Angeles', timezone('UTC', ts)) + interval 6 month)::int as season from events")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the day and season of their home zone."""
    day = times.local_day(F.col("ts"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(day, "yyyy-MM-dd").alias("day"), times.season_of(day).alias("season"))
