"""The daily run over Parquet tables: ingest, locate, judge, resolve, classify, select, publish."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import address_key
from ..functions.urls import canonical_url
from ..operators import changes, classify, folds, hash_table, health, locate, publish, resolve, spatial, upsert
from ..operators.storage import sized_as_rows, spread, written

PRUNE_DAYS = 30
#: Days after its end from which an event is closed: no step of a run looks at it of itself any more.
CLOSED_DAYS = 2
#: Tables whose rows belong to an event, and close with it.
SPLIT = ("events", "links", "members")


@dataclass
class Closed:
    """Rows of closed events, which a run leaves where they lie; each has closed_in, the version of the store that closed it."""

    events: DataFrame
    links: DataFrame
    members: DataFrame


@dataclass
class State:
    """The tables that a run reads and replaces."""

    events: DataFrame
    links: DataFrame
    raw: DataFrame
    runs: DataFrame
    members: DataFrame
    aliases: DataFrame
    #: Rows of closed events, where a store keeps them apart; and which of them this run has opened again.
    closed: Closed | None = None
    reopened: DataFrame | None = None


@dataclass
class Reference:
    """Configuration and reference tables."""

    sources: DataFrame
    polygons: DataFrame
    cache: DataFrame
    zips: DataFrame
    places: DataFrame
    profiles: list[classify.Profile] = field(default_factory=list)
    kinds: dict[str, list[str]] = field(default_factory=dict)
    #: Polygons of time zones, and a service for addresses, where there are any.
    zones: DataFrame | None = None
    geocode: Callable[[DataFrame], DataFrame] | None = None
    #: (profile_id, name), and the page that feeds link to.
    names: DataFrame | None = None
    site: str = ""
    #: Folder of the raw log, to which each run appends; without one the log is a union of written tables.
    raw_path: str = ""
    #: Folder of the table of latest hashes, by which changes are found; without one they are found from the log.
    hash_path: str = ""


@dataclass
class Report:
    """What a run says besides its state: each source's figures, rejected drafts, alerts, and records of unhealthy sources."""

    published: bool
    metrics: DataFrame
    rejects: DataFrame
    alerts: DataFrame
    drift: DataFrame


def drafts_of_adapters(adapters: dict[str, Callable[[DataFrame], DataFrame]], sources: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A parser of raw records of many sources: each source's records by its own adapter, drafts in one table."""

    def parse(raw: DataFrame) -> DataFrame:
        named = raw.join(F.broadcast(sources.select("source_id", "adapter")), "source_id")
        parts = [adapters[name](named.where(F.col("adapter") == name).drop("adapter")) for name in sorted(adapters)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out

    return parse


def keep_region(drafts: DataFrame, sources: DataFrame, polygons: DataFrame, border: bool = False) -> DataFrame:
    """Drafts but those of sources bound to a region that lie outside it, or nowhere; with border those on all sides of its border stay."""
    bound = sources.where("keep_region is not null").select("source_id", "keep_region")
    hits = spatial.region_members(drafts.join(bound.select("source_id"), "source_id", "left_semi"), polygons, ["source_id", "native_id"], border=border).withColumnRenamed("region_id", "keep_region").withColumn("_in", F.lit(True))
    joined = drafts.join(bound, "source_id", "left").join(hits, ["source_id", "native_id", "keep_region"], "left")
    return joined.where("keep_region is null or _in").drop("keep_region", "_in")


def is_closed(now: Column) -> Column:
    return F.coalesce(F.coalesce("end_utc", "start_utc") < now - F.make_dt_interval(F.lit(CLOSED_DAYS)), F.lit(False))


def with_touched(state: State, records: DataFrame, drafts: DataFrame) -> State:
    """state with the closed events that a run touches among its open ones: those that its records link to, and those of its drafts' pages and days."""
    closed = state.closed
    linked = closed.links.join(records.select("source_id", "native_id").distinct(), ["source_id", "native_id"], "left_semi").select("event_id", "closed_in")
    pages = drafts.where("url is not null").select("url", F.to_date("start_utc").alias("_day")).distinct()
    paged = closed.events.select("event_id", "closed_in", "url", F.to_date("start_utc").alias("_day")).join(pages, ["url", "_day"], "left_semi").select("event_id", "closed_in")
    back = written(linked.unionByName(paged).distinct(), "reopened")
    rows = [getattr(state, n).unionByName(getattr(closed, n).join(back, ["event_id", "closed_in"], "left_semi").select(*getattr(state, n).columns)) for n in SPLIT]
    events, links, members = (written(r, n) for r, n in zip(rows, SPLIT))
    return State(events, links, state.raw, state.runs, members, state.aliases, closed, back)


def ingest(state: State, incoming: DataFrame, drafts_of, reference: Reference, now, run_id: str, replay: bool = False, active: DataFrame | None = None) -> tuple[State, DataFrame, DataFrame]:
    """(state, this run's metrics, rejects) after incoming raw records; replay parses unchanged ones too.

    drafts_of(raw) gives drafts with reason for those that couldn't be parsed. Unchanged records only say
    that their events were seen. active(source_id) are the sources that were fetched; without it all
    enabled ones. Of the raw log only what is new is written; prune_raw() shortens it.
    """
    keys = ["source_id", "native_id"]
    sized_as_rows(incoming.sparkSession)  # files of records and events are a small part of their rows
    incoming = written(incoming, "incoming")  # several steps read it, and records may be dear to make
    hashes = hash_table.HashTable(incoming.sparkSession, reference.hash_path, keys) if reference.hash_path else None
    told = hashes.detect(incoming, run_id) if hashes else changes.detect_changes(incoming, changes.latest_hashes(state.raw, keys, "fetched_at"), keys)
    compared = written(told, "compared")
    fresh = compared if replay else compared.where("change <> 'unchanged'")
    parsed = drafts_of(spread(fresh)).withColumn("url", canonical_url(F.col("url")))
    reasons = F.array_distinct(F.concat(changes.draft_reasons(), F.array_compact(F.array("reason"))))
    # ranges keep the order of sources and records, whatever the size of a source; finding them reads the drafts once more, so they are parsed before
    in_order = written(parsed.withColumn("reasons", reasons), "parsed").repartitionByRange("source_id", "native_id").sortWithinPartitions("source_id", "native_id")
    judged = written(in_order.withColumn("pos", F.monotonically_increasing_id()), "drafts")
    valid, rejects = judged.where("size(reasons) = 0").drop("reasons", "reason"), judged.where("size(reasons) > 0").drop("pos")
    kept = keep_region(valid, reference.sources, reference.polygons)
    if state.closed is not None:
        state = with_touched(state, compared, kept)
    # a row for each configured source
    index = reference.sources.select("source_id").distinct().withColumn("source_index", F.dense_rank().over(Window.orderBy("source_id")))
    ordered = kept.join(F.broadcast(index), "source_id", "left").withColumn("source_index", F.coalesce("source_index", F.lit(0)))
    events, links = upsert.upsert(ordered, state.events, state.links, reference.sources, now)
    seen = compared.where("change = 'unchanged'").select(*keys).join(links, keys).select("event_id").distinct().withColumn("_seen", F.lit(True))
    events = events.join(seen, "event_id", "left").withColumn("last_seen", F.when(F.col("_seen"), F.lit(now).cast("timestamp")).otherwise(F.col("last_seen"))).select(*state.events.columns)
    outcome = judged.select(*keys, (F.size("reasons") == 0).alias("parsed"), (F.size("reasons") > 0).alias("parse_error"))
    records = compared.select(*keys, "change").join(outcome, keys, "left").na.fill(False, ["parsed", "parse_error"])
    active = reference.sources.where("enabled").select("source_id") if active is None else active
    failed = active.join(incoming.select("source_id").distinct(), "source_id", "left_anti").withColumn("error", F.lit("no records"))
    metrics = changes.run_metrics(active, records, failed).withColumns({"run_id": F.lit(run_id), "started_at": F.lit(now).cast("timestamp")})
    log = compared.where("change <> 'unchanged'").select(*[c for c in state.raw.columns if c != "run_id"])
    if reference.raw_path:
        changes.append_raw(log, reference.raw_path, run_id)
        raw = log.sparkSession.read.schema(state.raw.schema).parquet(reference.raw_path).select(*state.raw.columns)
    else:
        raw = state.raw.unionByName(written(log.withColumn("run_id", F.lit(run_id)), "raw").select(*state.raw.columns))
    if hashes:
        hashes.append(log, run_id)
    after = State(written(events, "events"), written(links, "links"), raw, state.runs.unionByName(metrics.select(*state.runs.columns)), state.members, state.aliases, state.closed, state.reopened)
    return after, metrics, rejects


def prune_raw(state: State, now) -> State:
    """The raw log without superseded records that are old, written anew; worth its cost now and then."""
    kept = changes.prune(state.raw, ["source_id", "native_id"], "fetched_at", F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(PRUNE_DAYS)))
    state.raw = written(kept, "raw")
    return state


def located(state: State, reference: Reference, now) -> State:
    """Missing points from addresses, with their precision, and then missing zones from points."""
    moment = F.lit(now).cast("timestamp")
    found = locate.enrich(state.events, reference.cache, reference.zips, reference.places, moment, reference.geocode).select("address_key", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("precision").alias("_precision"))
    wants = F.col("lat").isNull() & (F.col("attendance_mode") != "online") & F.col("_lat").isNotNull()
    joined = state.events.withColumn("address_key", address_key(F.col("address"))).join(found, "address_key", "left")
    filled = joined.withColumns({"geo_precision": F.when(wants, F.nullif("_precision", F.lit("address"))).otherwise(F.col("geo_precision")), "lon": F.when(wants, F.col("_lon")).otherwise(F.col("lon")), "lat": F.when(wants, F.col("_lat")).otherwise(F.col("lat"))})
    filled = filled.select(*state.events.columns)
    if reference.zones is not None:
        zoned = spatial.zone_of_points(locate.missing_zones(filled, moment).select("event_id", "lat", "lon"), reference.zones, ["event_id"]).select("event_id", "found_tz")
        filled = filled.join(zoned, "event_id", "left").withColumn("tz", F.coalesce("tz", "found_tz")).drop("found_tz")
    state.events = written(filled, "events")
    return state


def merged(state: State, reference: Reference, now) -> State:
    """Duplicates merged into the event of the least id; links, memberships and aliases follow."""
    mapping = written(resolve.resolve(state.events, F.lit(now).cast("timestamp")), "mapping")
    ranked = reference.sources.select(F.col("source_id").alias("primary_source"), "priority")
    members = state.events.join(mapping, "event_id").join(ranked, "primary_source", "left").withColumns({"priority": F.coalesce("priority", F.lit(upsert.DEFAULT_PRIORITY)), "source_id": F.col("primary_source")})
    placed = members.withColumn("ord", F.row_number().over(Window.partitionBy("survivor").orderBy("event_id")).cast("bigint"))
    columns = [c for c in upsert.COLUMNS if c != "kinds"] + ["primary_source"]
    one = folds.merge_fold(placed, "survivor", "ord", "source_id", "priority", columns).withColumnRenamed("survivor", "event_id")
    rest = state.events.join(mapping.select("event_id"), "event_id", "left_anti")
    moved = mapping.where("event_id <> survivor")

    def follow(table: DataFrame) -> DataFrame:
        return table.join(moved, "event_id", "left").withColumn("event_id", F.coalesce("survivor", "event_id")).drop("survivor")

    state.events = written(rest.unionByName(one.select(*rest.columns)), "events")
    state.links = written(follow(state.links).select(*state.links.columns), "links")
    state.members = written(follow(state.members).groupBy("event_id", "profile_id").agg(F.min("first_seen").alias("first_seen")), "members")
    merges = moved.select(F.col("event_id").alias("loser"), "survivor", F.lit(now).cast("timestamp").alias("merged_at"))
    state.aliases = written(folds.resolve_aliases(state.aliases, merges), "aliases")
    return state


def classified(state: State, reference: Reference, now) -> State:
    """Rule kinds of upcoming events, worked out anew."""
    upcoming = state.events.where(publish.is_upcoming(F.lit(now).cast("timestamp")))
    defaults = reference.sources.select("source_id", "default_kinds")
    found = classify.classified(upcoming, state.links, defaults, reference.kinds).withColumnRenamed("rule_kinds", "_kinds")
    state.events = written(state.events.join(found, "event_id", "left").withColumn("rule_kinds", F.coalesce("_kinds", "rule_kinds")).select(*state.events.columns), "events")
    return state


def assigned(state: State, reference: Reference, now) -> State:
    """Memberships of all profiles, brought up to date in one pass over the upcoming events."""
    moment = F.lit(now).cast("timestamp")
    profiles = reference.profiles
    if not profiles:
        return state
    upcoming = publish.with_sources(state.events.where(publish.is_upcoming(moment)), state.links)
    wanted = reference.polygons.where(F.col("region_id").isin([p.region_id for p in profiles]))
    inside = spatial.region_members(upcoming, wanted, ["event_id"]).groupBy("event_id").agg(F.collect_set("region_id").alias("_regions"))
    joined = upcoming.join(inside, "event_id", "left")
    named = lambda p: F.lit(p.profile_id)
    takes = lambda p: F.lit(True) if p.sources is None else F.coalesce(F.arrays_overlap("source_ids", F.array(*map(F.lit, p.sources)).cast("array<string>")), F.lit(False))
    admits = lambda p: classify.admits(p, F.col("source_ids"), F.coalesce(F.array_contains("_regions", p.region_id), F.lit(False)), F.col("lat").isNotNull(), F.col("attendance_mode"), F.col("title"), F.col("description"))
    judged = joined.select("event_id", F.explode(F.array_compact(F.array(*[F.when(takes(p), F.struct(named(p).alias("profile_id"), admits(p).alias("member"))) for p in profiles]))).alias("j")).select("event_id", "j.*")
    judged = written(judged, "judged")
    keys = ("event_id", "profile_id")
    members, _ = classify.sync_members(state.members.select(*keys, "first_seen"), judged, judged.where("member"), moment, keys)
    state.members = written(members.select(*state.members.columns), "members")
    return state


def feed(state: State, reference: Reference, now) -> DataFrame:
    """What is published: each profile's upcoming events with area, sources and all kinds."""
    moment = F.lit(now).cast("timestamp")
    rows = publish.with_sources(publish.profile_events(state.events, state.members, moment), state.links)
    return spatial.area_labels(rows, reference.polygons, ["profile_id", "event_id"]).withColumn("kinds", classify.published_kinds(F.col("kinds"), F.col("rule_kinds"))).drop("rule_kinds")


def run(state: State, incoming: DataFrame, drafts_of, reference: Reference, now, run_id: str, path: str) -> tuple[State, Report]:
    """One day, in this order: choose sources, ingest, locate, judge, merge, classify, select, publish. Returns the new state and a report.

    Sources that have been unhealthy for long are passed over but for a weekly probe; they get run rows
    of status disabled.
    """
    sized_as_rows(incoming.sparkSession)
    moment = F.lit(now).cast("timestamp")
    chosen = written(health.select_sources(reference.sources.where("enabled").select("source_id"), health.source_states(state.runs), moment), "chosen")
    active = chosen.where("fetch").select("source_id")
    state, metrics, rejects = ingest(state, incoming.join(F.broadcast(active), "source_id", "left_semi"), drafts_of, reference, now, run_id, active=active)
    state = located(state, reference, now)
    state.runs = written(state.runs.unionByName(health.skipped_runs(chosen, run_id, moment).select(*state.runs.columns)), "runs")
    today = judged_runs(state).where(F.col("run_id") == run_id)
    state = assigned(classified(merged(state, reference, now), reference, now), reference, now)
    of_run = state.runs.where(F.col("run_id") == run_id)
    published = publish.publish(feed(state, reference, now), of_run, run_id, path, moment, reference.names, reference.site)
    drift = health.drift_samples(today.where("not healthy"), state.raw.where(F.col("run_id") == run_id))
    return state, Report(published, metrics, rejects, health.alerts(today), drift)


def judged_runs(state: State) -> DataFrame:
    """Each run of each source with its verdict, streak and alerts."""
    return health.states(health.verdicts(state.runs))


def replay(state: State, source_ids: list[str], drafts_of, reference: Reference, now, run_id: str) -> tuple[State, DataFrame, DataFrame]:
    """Parses the latest stored records of sources again, without reading their feeds."""
    latest = changes.latest_versions(state.raw, ["source_id", "native_id"], "fetched_at").where(F.col("source_id").isin(source_ids))
    return ingest(state, latest.drop("run_id"), drafts_of, reference, now, run_id, replay=True)
