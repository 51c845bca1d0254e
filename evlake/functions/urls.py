"""URL functions: canonical form, redaction, resolving, registrable domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

# Query parameters that don't identify a page.
TRACKING = ["aff", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source"]
# Query parameters whose values are secret.
SECRET = ["access_token", "api_key", "apikey", "auth", "client_secret", "key", "password", "secret", "sig", "token"]
# Second-level labels under two-letter top labels.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
# Hosts of online meetings.
MEETING_HOSTS = ["zoom.us", "meet.google.com", "teams.microsoft.com"]

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, index: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where there is none."""
    return F.regexp_extract(F.trim(url), _PARTS, index)


def host(url: Column) -> Column:
    """The lower-case host without user information or port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def _pairs(query: Column) -> Column:
    """Decoded (name, value) structs of a query; a name without = has an empty value."""

    def pair(p: Column) -> Column:
        decoded = lambda text: F.coalesce(F.try_url_decode(text), text)
        return F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v"))

    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)


def _encoded(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """One spelling for all links to a page: lower scheme and host, no user, default port, fragment or tracking, sorted query.

    Null stays null; text without an authority is only trimmed. Each part is worked out once a row.
    """

    def tracked(p: Column) -> Column:
        return let(F.lower(p["k"]), lambda k: k.isin(TRACKING) | k.startswith("utm_"))

    def joined(u: Column) -> Column:
        bare = F.regexp_replace(F.lower(F.regexp_replace(u["authority"], r"^.*@", "")), r":$", "")
        port = F.when(u["scheme"] == "http", F.lit(":80$")).when(u["scheme"] == "https", F.lit(":443$")).otherwise(F.lit(":$"))
        query = F.regexp_replace(F.concat(F.lit("?"), _encoded(F.array_sort(F.filter(_pairs(u["query"]), lambda p: ~tracked(p))))), r"^\?$", "")
        full = F.concat(u["scheme"], F.lit("://"), F.regexp_replace(bare, port, ""), F.regexp_replace(u["path"], "^$", "/"), query)
        return F.when(u["authority"] == "", u["text"]).otherwise(full)

    def split(text: Column) -> Column:
        part_of = lambda i: F.regexp_extract(text, _PARTS, i)
        return let(F.struct(text.alias("text"), F.lower(part_of(1)).alias("scheme"), part_of(2).alias("authority"), part_of(3).alias("path"), part_of(4).alias("query")), joined)

    return let(F.trim(url), split)


def redact_url(url: Column) -> Column:
    """The url with user information and the values of secret parameters as ***."""
    no_user = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1***@")
    return F.regexp_replace(no_user, r"(?i)([?&](?:" + "|".join(SECRET) + r")=)[^&#]*", "$1***")


def site_key(url: Column) -> Column:
    """About the registrable domain: the last two labels, three below a known second level of a country."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    country = (F.length(F.element_at(labels, -1)) == 2) & F.coalesce(F.get(labels, n - 2).isin(SECOND_LEVEL), F.lit(False))
    take = F.when(country, F.lit(3)).otherwise(F.lit(2))
    return F.array_join(F.slice(labels, F.greatest(n - take + 1, F.lit(1)), take), ".")


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/")

    def step(acc: Column, p: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(p == ".", acc).when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.lit([]).cast("array<string>"), step)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(""))


def url_join(base: Column, link: Column) -> Column:
    """link as seen from the page base. Both are worked out once a row."""

    def joined(link: Column) -> Column:
        root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
        folder = F.regexp_replace(F.when(part(base, 3) == "", F.lit("/")).otherwise(part(base, 3)), r"[^/]*$", "")
        tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
        own_path = F.regexp_extract(link, r"^([^?#]*)", 1)
        base_query = F.when(part(base, 4) != "", F.concat(F.lit("?"), part(base, 4))).otherwise("")
        return (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link))
            .when(link == "", F.concat(root, part(base, 3), base_query))
            .when(link.startswith("#"), F.concat(root, part(base, 3), base_query, link))
            .when(link.startswith("?"), F.concat(root, part(base, 3), link))
            .when(link.startswith("/"), F.concat(root, let(own_path, _without_dots), tail))
            .otherwise(F.concat(root, let(F.concat(folder, own_path), _without_dots), tail))
        )

    return let(F.trim(link), joined)


def first_url(text: Column) -> Column:
    """The first http(s) link of a text, closing punctuation left off; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"https?://[^\s<>\"]+", 0), r"[.,;]+$", ""), F.lit(""))


def is_url(text: Column) -> Column:
    return F.trim(text).rlike(r"^https?://\S+$")


def is_meeting_url(url: Column) -> Column:
    return is_url(url) & F.exists(F.array(*map(F.lit, MEETING_HOSTS)), lambda h: F.contains(F.lower(url), h))


def refresh_due(key: Column, day: Column, every: int) -> Column:
    """Whether a key's turn is on a day: one day in every, spread by a digest of the key."""
    turn = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % every
    return turn == (F.datediff(day, F.lit("0001-01-01").cast("date")) + 1) % every


def query_pairs(url: Column) -> Column:
    return let(part(url, 4), _pairs)
