"""Crawl rules as a table, and which urls they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host, part


def read_robots(files: DataFrame, agent: str) -> DataFrame:
    """(host, allow, pattern, delay) of files(host, body): the groups that name agent, else those of *.

    A group names an agent if one of its agent lines is the agent's product name (what stands before /),
    whatever the case. Agent lines share the rules after them; an allow, disallow or delay line closes
    the list, an empty Disallow too, which forbids nothing. Lines of other fields are passed over. A host
    with a delay and no path rule has one row, without allow and pattern.
    """
    product = agent.split("/")[0].strip().lower()
    lines = files.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"#.*$", "")))
    split = lines.select("host", "n", F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    order = Window.partitionBy("host").orderBy("n")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = split.withColumn("_opens", opens.cast("int")).withColumn("group", F.sum("_opens").over(order))
    agents = grouped.where("field = 'user-agent'").select("host", "group", F.when(F.col("value") == "*", 0).when(F.lower("value") == product, 1).alias("specific")).where("specific is not null")
    ranked = agents.withColumn("_best", F.max("specific").over(Window.partitionBy("host"))).where("specific = _best").select("host", "group").distinct()
    rules = grouped.where("field <> 'user-agent'").join(ranked, ["host", "group"])
    delay = rules.where("field = 'crawl-delay'").groupBy("host").agg(F.max(F.col("value").try_cast("double")).alias("delay"))
    paths = rules.where("field <> 'crawl-delay' and value <> ''").select("host", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    # a host may have a delay and forbid nothing
    return paths.join(delay, "host", "full")


def pattern_regex(pattern: F.Column) -> F.Column:
    """A rule's path, with * for anything and a closing $ for the end, as a regular expression."""
    quoted = F.regexp_replace(pattern, r"([.+?^(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$"))


def crawl_decisions(urls: DataFrame, rules: DataFrame, unavailable: DataFrame | None = None, url: str = "url") -> DataFrame:
    """urls with allowed: by the longest rule of the host that fits, Allow before Disallow of the same length; without one, true.

    unavailable(host) are hosts whose rules could not be had: nothing of theirs is allowed. rules are
    joined by host, so a host's few rules meet its own urls alone.
    """
    query = part(F.col(url), 4)
    path = F.concat(F.when(part(F.col(url), 3) == "", F.lit("/")).otherwise(part(F.col(url), 3)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    keyed = urls.select(url).distinct().select(url, host(F.col(url)).alias("host"), path.alias("_path"))
    fits = keyed.join(rules.where("pattern is not null").select("host", "allow", "pattern"), "host").where(F.regexp_like("_path", pattern_regex(F.col("pattern"))))
    best = fits.groupBy(url).agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("_allow"))
    out = urls.join(best, url, "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")
    if unavailable is not None:
        out = out.withColumn("_host", host(F.col(url))).join(unavailable.select(F.col("host").alias("_host"), F.lit(True).alias("_gone")), "_host", "left")
        out = out.withColumn("allowed", F.col("allowed") & F.col("_gone").isNull()).drop("_gone", "_host")
    return out
