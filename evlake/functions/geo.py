"""Distances, coordinates, addresses and place names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import blank_to_null, compact_join, literal_map

EARTH_KM = 6371.0
# States, their district and territory, by postal abbreviation.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida",
    "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine",
    "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "PR": "Puerto Rico",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming",
}
# Spellings of the country.
COUNTRY = ["us", "usa", "u.s.", "u.s.a.", "united states"]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), 2)
    return EARTH_KM * 2 * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """x, y, z of a point on the unit sphere, for within_km(); null where degrees are too large for their rounding to be small."""
    good = lat.between(-360, 360) & lon.between(-360, 360)
    round_, up, around = F.cos(F.radians(lat)), F.sin(F.radians(lat)), F.radians(lon)
    return [F.when(good, c) for c in (round_ * F.cos(around), round_ * F.sin(around), up)]


def within_km(p: list[Column], q: list[Column], km: float, exact: Column) -> Column:
    """Whether exact, the haversine_km of two points, is at most km; only worked out for those about that far apart.

    p and q are the points by on_sphere(); the square of their chord tells all others, by products alone.
    """
    x, y, z = [b - a for a, b in zip(p, q)]
    limit = 4 * math.sin(km / EARTH_KM / 2) ** 2
    # a null chord tells nothing, as one at the limit; chords and distances round by far less than 1e-9 of the least limit
    chord = F.coalesce(x * x + y * y + z * z, F.lit(limit))
    slack = 1e-9 * limit + 1e-14
    return (chord < limit - slack) | ((chord <= limit + slack) & (exact <= km))


def round_half_up(value: Column, digits: int) -> Column:
    """A double of ordinary size rounded as its binary product with 10**digits says, halves up: SQL's round() in doubles, not in decimals."""
    scaled = value * 10.0**digits
    whole = F.floor(scaled)
    return (whole + (scaled - whole >= 0.5).cast("int")) / F.lit(10.0**digits)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """struct(lat, lon), both null unless both are numbers in range."""
    x, y = lat.try_cast("double"), lon.try_cast("double")
    good = x.between(-90, 90) & y.between(-180, 180)
    return F.struct(F.when(good, x).alias("lat"), F.when(good, y).alias("lon"))


def address_key(address: Column) -> Column:
    """An address for look-ups: lower case, one space, commas followed by a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(address), r"\s*,[\s,]*", ", "), r"\s+", " "))


def state_abbr(name: Column) -> Column:
    """The abbreviation of a state given by abbreviation or full name; null if it is none."""
    known = {k: k for k in STATES} | {v.upper(): k for k, v in STATES.items()}
    return F.try_element_at(literal_map(known), F.upper(F.regexp_replace(F.trim(name), r"\s+", " ")))


def address_parts(address: Column) -> Column:
    return F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")


def _without_zip(part: Column) -> Column:
    return F.trim(F.regexp_replace(part, r"\b\d{5}(?:-\d{4})?\s*$", ""))


def without_country(parts: Column) -> Column:
    """Address parts without a trailing name of the country."""
    return F.when(F.lower(F.try_element_at(parts, F.lit(-1))).isin(COUNTRY), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def with_state(address: Column, state: Column) -> Column:
    """The address with a state before the country's name, unless some part names a state."""
    parts = address_parts(address)
    named = F.exists(parts, lambda p: state_abbr(_without_zip(p)).isNotNull())
    foreign = F.size(without_country(parts)) == F.size(parts)
    inserted = F.concat(without_country(parts), F.array(state), F.slice(parts, F.size(parts), F.lit(1)))
    return F.when(state.isNull() | named | foreign | (F.size(parts) < 1), address).otherwise(F.array_join(inserted, ", "))


def place_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


# Legal types that gazetteer names end in.
PLACE_TYPES = ["city and borough", "city", "town", "village", "borough", "CDP", "comunidad", "zona urbana", "municipality", "corporation", "urban county", "unified government", "consolidated government", "metropolitan government"]


def place_name(name: Column) -> Column:
    """A gazetteer name without its legal type, in any letter case, and without (balance), with a type or alone."""
    kind, rest = "|".join(PLACE_TYPES), r"\(balance\)"
    return F.trim(F.regexp_replace(F.trim(name), rf"(?i)\s+(?:(?:{kind})(?:\s+{rest})?|{rest})$", ""))


def city_state(address: Column) -> Column:
    """struct(state, city) of the last two parts of an address; null if the last isn't a state."""
    parts = without_country(address_parts(address))
    state = state_abbr(_without_zip(F.try_element_at(parts, F.lit(-1))))
    city = F.try_element_at(parts, F.lit(-2))
    return F.when(state.isNotNull() & city.isNotNull(), F.struct(state.alias("state"), city.alias("city")))


def _shown_state(part: Column) -> Column:
    """Whether an address part is a state as addresses show it: a state's abbreviation (not the district's) or California, perhaps with a postal code."""
    name = F.upper(F.regexp_extract(part, r"(?i)^([a-z]{2}|california)(?:\s+\d{5}(?:-\d{4})?)?$", 1))
    return name.isin("CALIFORNIA", *[s for s in STATES if s != "DC"])


def city_of(address: Column) -> Column:
    """The last 'City, ST' of an address whose city isn't itself a state or the country and doesn't begin with five digits."""
    parts = F.transform(F.split(address, ","), lambda p: F.trim(p))
    pairs = F.transform(parts, lambda p, i: F.struct(F.get(parts, i - 1).alias("city"), _shown_state(p).alias("state")))
    fits = lambda x: x["state"] & (F.coalesce(x["city"], F.lit("")) != "") & ~_shown_state(x["city"]) & ~x["city"].rlike(r"(?i)^(?:us|usa|u\.s\.a?\.?|united states)$") & ~x["city"].rlike(r"^\d{5}")
    return F.try_element_at(F.filter(pairs, fits), F.lit(-1))["city"]


def place_label(mode: Column, venue: Column, address: Column, area: Column) -> Column:
    parts = F.array_distinct(F.array_compact(F.array(blank_to_null(venue), F.coalesce(city_of(address), area))))
    return F.when(mode == "online", F.lit("Online")).when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise(F.try_element_at(address_parts(address), F.lit(1)))


def area_of_event(mode: Column, address: Column, area: Column) -> Column:
    return F.when(mode == "online", F.lit("Online")).otherwise(F.coalesce(city_of(address), blank_to_null(area), F.lit("Location not listed")))


def joined_address(*parts: Column) -> Column:
    return compact_join(list(parts), ", ")


def postal_address(*parts: Column) -> Column:
    """Parts joined by commas, without those that stand in an earlier one as whole words."""
    some = F.filter(F.transform(F.array(*parts), lambda p: F.trim(p)), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), p, F.lit(r"\E(?!\w)"))
        return F.when(acc == "", p).when(F.regexp_like(acc, quoted), acc).otherwise(F.concat(acc, F.lit(", "), p))

    return F.nullif(F.aggregate(some, F.lit(""), step), F.lit(""))


def location_rank(lat: Column, precision: Column) -> Column:
    """0 exact or of unknown precision, 1 postal centroid, 2 place centroid, 3 without a location."""
    return F.when(lat.isNull(), 3).when(precision == "postal", 1).when(precision == "place", 2).otherwise(0)


def platform_name(source_id: Column, prefixes: dict[str, str]) -> Column:
    """A platform by the longest known prefix of a source's id, else the id."""
    out = F.lit(None).cast("string")
    for prefix in sorted(prefixes, key=len):
        out = F.when(source_id.startswith(prefix), F.lit(prefixes[prefix])).otherwise(out)
    return F.coalesce(out, source_id)


def platforms(source_ids: Column, prefixes: dict[str, str]) -> Column:
    """The different platforms of an event's sources, in their order."""
    return F.array_distinct(F.transform(source_ids, lambda s: platform_name(s, prefixes)))


def platform_of(source_ids: Column, prefixes: dict[str, str]) -> Column:
    """The platform that an event is listed under: its first."""
    return F.coalesce(F.get(platforms(source_ids, prefixes), F.lit(0)), F.lit("Other"))


def attendance_mode(declared: Column, physical: Column, virtual: Column) -> Column:
    """The declared mode, else what its places say."""
    # Declared modes.
    known = {"OfflineEventAttendanceMode": "in_person", "OnlineEventAttendanceMode": "online", "MixedEventAttendanceMode": "hybrid"}
    told = F.try_element_at(literal_map(known), F.substring_index(declared, "/", -1))
    seen = F.when(physical & virtual, F.lit("hybrid")).when(virtual, F.lit("online")).when(physical, F.lit("in_person")).otherwise(F.lit("unknown"))
    return F.coalesce(told, seen)


def location_fields(places: Column) -> Column:
    """Of array<struct<type, name, address, lat, lon>>: whether one is virtual, and the first venue, address and valid point.

    A venue equal to the address is left out.
    """
    first = lambda xs: F.try_element_at(F.filter(xs, lambda x: x.isNotNull()), F.lit(1))
    real = F.filter(places, lambda p: F.coalesce(p["type"], F.lit("")) != "VirtualLocation")
    venue, address = first(F.transform(real, lambda p: blank_to_null(p["name"]))), first(F.transform(real, lambda p: blank_to_null(p["address"])))
    point = first(F.transform(real, lambda p: F.when(valid_coordinates(p["lat"], p["lon"])["lat"].isNotNull(), valid_coordinates(p["lat"], p["lon"]))))
    return F.struct(
        (F.size(real) < F.size(places)).alias("virtual"), (F.size(real) > 0).alias("physical"),
        F.when(F.coalesce(F.lower(venue) != F.lower(address), F.lit(True)), venue).alias("venue"), address.alias("address"), point["lat"].alias("lat"), point["lon"].alias("lon"))


def organization_name(organizers: Column) -> Column:
    """The first organizer that is an organization, never a person."""
    return F.try_element_at(F.filter(organizers, lambda o: o["type"] == "Organization"), F.lit(1))["name"]


def capacity(value: Column) -> Column:
    number = value.try_cast("bigint")
    return F.when(number >= 0, number)
