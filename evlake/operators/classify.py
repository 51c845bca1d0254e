"""Topics, kinds and membership of profiles by phrase rules and trust lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrases_found


@dataclass(frozen=True)
class Topic:
    """Phrases that decide a topic: one in the title, or enough different ones in the description."""

    keywords: list[str]
    exclude_keywords: list[str] = field(default_factory=list)
    description_min_matches: int = 3
    trusted_description_min_matches: int = 1


@dataclass(frozen=True)
class Profile:
    """A published view: a region, a topic, and which sources are trusted for them."""

    profile_id: str
    region_id: str
    topic: Topic
    sources: list[str] | None = None
    trust_region: list[str] = field(default_factory=list)
    trust_topic: list[str] = field(default_factory=list)
    topic_always: list[str] = field(default_factory=list)
    include_online: bool = False


def topic_match(title: Column, description: Column, trusted: Column, topic: Topic) -> Column:
    vetoed = F.size(phrases_found(title, topic.exclude_keywords)) > 0
    need = F.when(trusted, F.lit(topic.trusted_description_min_matches)).otherwise(F.lit(topic.description_min_matches))
    return F.when(vetoed, False).when(F.size(phrases_found(title, topic.keywords)) > 0, True).otherwise(F.size(phrases_found(description, topic.keywords)) >= need)


def title_kinds(title: Column, kinds: dict[str, list[str]]) -> Column:
    """Every kind with a phrase in the title, sorted."""
    return F.array_compact(F.array(*[F.when(F.size(phrases_found(title, kinds[k])) > 0, F.lit(k)) for k in sorted(kinds)]))


def classified(events: DataFrame, event_sources: DataFrame, default_kinds: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """(event_id, rule_kinds): kinds of the title, else the union of the default kinds of the event's sources."""
    ruled = events.select("event_id", title_kinds(F.col("title"), kinds).alias("_ruled"))
    fallback = event_sources.select("event_id", "source_id").distinct().join(default_kinds, "source_id").groupBy("event_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("default_kinds")))).alias("_default"))
    chosen = F.when(F.size("_ruled") > 0, F.col("_ruled")).otherwise(F.coalesce("_default", F.array().cast("array<string>")))
    return ruled.join(fallback, "event_id", "left").select("event_id", chosen.alias("rule_kinds"))


def published_kinds(kinds: Column, rule_kinds: Column) -> Column:
    """Kinds of an event's sources and of the rules together, sorted; null counts as none."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(kinds, none), F.coalesce(rule_kinds, none)))


def admits(profile: Profile, sources: Column, in_region: Column, located: Column, mode: Column, title: Column, description: Column) -> Column:
    """Whether a profile takes an event: online ones only if wanted, without a region; others by region or a trusted source; then by topic."""
    trusts = lambda names: F.arrays_overlap(sources, F.array(*map(F.lit, names))) if names else F.lit(False)
    place = F.when(mode == "online", F.lit(profile.include_online)).when(located, in_region).otherwise(trusts(profile.trust_region))
    topical = trusts(profile.topic_always) | topic_match(title, description, trusts(profile.trust_topic), profile.topic)
    return F.coalesce(place, F.lit(False)) & F.coalesce(topical, F.lit(False))


def events_of_sources(events: DataFrame, event_sources: DataFrame, names: list[str] | None) -> DataFrame:
    """Events with a record of any of the sources; all of them for None."""
    if names is None:
        return events
    return events.join(event_sources.where(F.col("source_id").isin(names)).select("event_id"), "event_id", "left_semi")


def sync_members(members: DataFrame, considered: DataFrame, qualifying: DataFrame, now: Column, keys: tuple[str, ...] = ("event_id",)) -> tuple[DataFrame, DataFrame]:
    """(members, counts) after a run: first_seen of those who stay is kept, those considered who no longer qualify go.

    members(keys, first_seen); members who weren't considered stay. With a profile among the keys, all
    profiles are brought up to date at once.
    """
    by = list(keys)
    new = qualifying.select(*by).distinct().join(members, by, "left_anti").withColumn("first_seen", now)
    gone = considered.select(*by).distinct().join(qualifying, by, "left_anti")
    left = members.join(gone, by, "left_anti")
    removed = members.join(gone, by, "left_semi")
    marked = new.select(F.lit(1).alias("n"), F.lit(0).alias("g")).unionByName(removed.select(F.lit(0).alias("n"), F.lit(1).alias("g")))
    counts = marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("added"), F.coalesce(F.sum("g"), F.lit(0)).alias("removed"))
    return left.unionByName(new.select(*left.columns)), counts


def label_metrics(predicted: DataFrame, prediction: str = "predicted", label: str = "label") -> DataFrame:
    """precision (1.0 if nothing is predicted), recall, accuracy and counts of 0/1 predictions against labels."""
    p, y = F.col(prediction) == 1, F.col(label) == 1
    tp, fp, fn, right = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~p & y), F.count_if(p == y)
    return predicted.agg(
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0)).alias("recall"),
        F.try_divide(right, F.count("*")).alias("accuracy"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
