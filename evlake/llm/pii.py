"""Personal data under format-preserving Feistel pseudonyms; DataFrame functions only.

A pseudonym is a keyed permutation of its kind's format: a valid card number becomes a valid card
number, a date a date, and equal values become equal ones in every document.
"""

from __future__ import annotations

import functools
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import let, unused_name

ROUNDS = 8
#: Dates from 1900-01-01 on, as many as 128 * 571: two Feistel halves that fill the range.
_FIRST_DAY, _DATE_HALVES = "1900-01-01", (128, 571)
#: Area, group and serial numbers of a social security number, without the invalid ones.
_SSN_PARTS = (898, 99, 9999)

_NATIONAL = r"(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
#: Formats, in the order in which they claim a place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "iso_date": r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)",
    "us_date": r"(?<!\d)\d{2}/\d{2}/\d{4}(?!\d)",
    "dot_date": r"(?<!\d)\d{2}\.\d{2}\.\d{4}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![0-9A-Za-z])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?" + _NATIONAL + r"(?!\d)",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{18,64}|[0-9A-F]{18,64})(?![0-9A-Za-z])",
}
_ANY = "|".join(f"(?:{p})" for p in FORMATS.values())
_DATES = {"iso_date": "yyyy-MM-dd", "us_date": "MM/dd/yyyy", "dot_date": "dd.MM.yyyy"}


def feistel(values: Column, radices: Column, key: Column) -> Column:
    """A keyed permutation of digit lists with these radices: in turn, one half is shifted by a digest of the other."""
    return let(radices, lambda r: let(values.cast("array<bigint>"), lambda v: let(key, lambda k: _turns(v, r, k))))


def _turns(values: Column, radices: Column, key: Column) -> Column:
    half = F.floor(F.size(values) / 2)

    def turn(now: Column, at: Column) -> Column:
        left = at % 2 == 0
        other = F.when(left, F.slice(now, half + 1, F.size(now))).otherwise(F.slice(now, F.lit(1), half))

        def shifted(seed: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                block = F.sha2(F.concat_ws(":", seed, F.floor(i / 8)), 256)
                shift = F.conv(F.substring(block, (i % 8) * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
                return F.when((i < half) == left, (v + shift) % F.get(radices, i)).otherwise(v)

            return F.transform(now, one)

        seed = F.concat_ws(",", key, at, F.size(now), other.cast("array<string>"))
        return let(seed, shifted).cast("array<bigint>")

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def _luhn(digits: Column, shift: int = 0) -> Column:
    """The Luhn sum, digits counted from the right, from place shift on."""
    doubled = lambda d, i: F.when((F.size(digits) - 1 - i + shift) % 2 == 1, d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(d)
    return F.aggregate(F.transform(digits, doubled), F.lit(0).cast("bigint"), lambda total, d: total + d)


def _digits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d"), F.lit(0)).cast("array<bigint>")


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)).cast("array<bigint>")


def _kind(found: Column) -> Column:
    """The format of a match, if it is valid: octets, dates, number ranges and check digits."""
    numbers = _numbers(found)
    day = {k: F.datediff(F.to_date(F.try_to_timestamp(found, F.lit(f))), F.lit(_FIRST_DAY).cast("date")) for k, f in _DATES.items()}
    valid = {
        "email": F.lit(True),
        "ip": F.forall(numbers, lambda n: n <= 255),
        **{k: d.between(0, _DATE_HALVES[0] * _DATE_HALVES[1] - 1) for k, d in day.items()},
        "ssn": (F.get(numbers, F.lit(0)).between(1, 899)) & (F.get(numbers, F.lit(0)) != 666) & (F.get(numbers, F.lit(1)) > 0) & (F.get(numbers, F.lit(2)) > 0),
        "card": let(_digits(found), lambda d: _luhn(d) % 10 == 0),
        "phone": F.lit(True),
        "secret": F.lit(True),
    }
    return F.coalesce(*[F.when(found.rlike(f"^(?:{pattern})$") & valid[name], F.lit(name)) for name, pattern in FORMATS.items()])


def _by_characters(found: Column, kind: Column, key: Column) -> Column:
    """Letters and digits are permuted where they stand, each within its own class (hexadecimal ones as one class).

    Kept as they are: the last label of an address, a country code, a key's prefix. A card's last digit
    follows from the others.
    """
    country = F.regexp_extract(found, r"^(\+\d{1,3}[ .-]?)(?=" + _NATIONAL + "$)", 1)
    prefix = F.when(kind == "phone", country).when(found.startswith("AKIA"), F.lit("AKIA")).otherwise(F.lit(""))
    suffix = F.when(kind == "email", F.regexp_extract(found, r"\.[^.]*$", 0)).when(kind == "card", F.right(found, F.lit(1))).otherwise(F.lit(""))
    is_hex = (kind == "secret") & ~found.startswith("AKIA")

    def number(c: Column) -> Column:
        letter = F.when(is_hex, F.lit(10)).otherwise(F.lit(0))
        return F.when(c.between("0", "9"), F.ascii(c) - 48).when(c.between("a", "z"), F.ascii(c) - 97 + letter).otherwise(F.ascii(c) - 65 + letter)

    def radix(c: Column) -> Column:
        return F.when(is_hex, F.lit(16)).when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(26))

    def character(n: Column, was: Column) -> Column:
        lower = F.lower(found) == found
        plain = F.when(was.between("0", "9"), n + 48).when(was.between("a", "z"), n + 97).otherwise(n + 65)
        return F.chr(F.when(is_hex, F.when(n < 10, n + 48).otherwise(n - 10 + F.when(lower, F.lit(97)).otherwise(F.lit(65)))).otherwise(plain))

    def body(text: Column) -> Column:
        classed = F.regexp_extract_all(text, F.lit("[0-9A-Za-z]"), F.lit(0))

        def joined(made: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                place = F.length(F.regexp_replace(F.substring(text, F.lit(1), i), "[^0-9A-Za-z]", ""))
                return F.when(c.rlike("^[0-9A-Za-z]$"), character(F.get(made, place), c)).otherwise(c)

            return F.array_join(F.transform(F.split(text, ""), one), "")

        return let(feistel(F.transform(classed, number), F.transform(classed, radix), key), joined)

    def ended(made: Column) -> Column:
        check = let(_digits(made), lambda d: (10 - _luhn(d, shift=1) % 10) % 10).cast("string")
        return F.concat(prefix, made, F.when(kind == "card", check).otherwise(suffix))

    # the body is what lies between prefix and suffix
    inner = F.substring(found, F.length(prefix) + 1, F.length(found) - F.length(prefix) - F.length(suffix))
    return let(let(inner, body), ended)


def pseudonym(found: Column, key: Column) -> Column:
    """The pseudonym of a match; null if it isn't valid."""

    def made(kind: Column) -> Column:
        own = F.concat_ws(":", key, kind)
        numbers = _numbers(found)
        octets = F.array_join(feistel(numbers, F.array_repeat(F.lit(256), 4), own).cast("array<string>"), ".")
        out = F.when(kind.isin("email", "card", "phone", "secret"), _by_characters(found, kind, own)).when(kind == "ip", octets)
        date_key = F.concat_ws(":", key, F.lit("date"))
        for name, form in _DATES.items():
            day = F.datediff(F.to_date(F.try_to_timestamp(found, F.lit(form))), F.lit(_FIRST_DAY).cast("date"))
            halves = F.array(F.floor(day / _DATE_HALVES[1]), day % _DATE_HALVES[1])
            dated = let(feistel(halves, F.array(*map(F.lit, _DATE_HALVES)), date_key), lambda p: F.date_add(F.lit(_FIRST_DAY).cast("date"), (F.get(p, F.lit(0)) * _DATE_HALVES[1] + F.get(p, F.lit(1))).cast("int")))
            out = out.when(kind == name, F.date_format(dated, form))
        area = F.get(numbers, F.lit(0))
        parts = F.array(area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1)), F.get(numbers, F.lit(1)) - 1, F.get(numbers, F.lit(2)) - 1)
        ssn = let(feistel(parts, F.array(*map(F.lit, _SSN_PARTS)), own), lambda p: F.format_string("%03d-%02d-%04d", F.get(p, F.lit(0)) + F.when(F.get(p, F.lit(0)) >= 665, F.lit(2)).otherwise(F.lit(1)), F.get(p, F.lit(1)) + 1, F.get(p, F.lit(2)) + 1))
        return out.when(kind == "ssn", ssn)

    return let(_kind(found), made)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with every valid e-mail and IP address, date, social security, card and phone number and key in text under its pseudonym.

    Adds n_private (long), how many were found. Other columns stay, but for n_private, which is replaced.
    A null text stays null, with none found; an invalid number stays as it is. Row by row, without a
    shuffle; texts without a digit or @ are passed on. key is a secret that whoever holds can link by;
    it is read by a subquery over a table of one row, so that no plan, page or log of Spark's prints it.
    """
    text = F.col(f"`{text_col}`")
    docs = docs.drop("n_private")
    found, new, own = (unused_name(docs, n) for n in ("found", "new", "own"))
    secret = docs.sparkSession.createDataFrame([(key,)], "value string").scalar()
    matches = F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))
    with_found = docs.withColumns({found: F.when(text.rlike("[0-9@]"), matches), own: secret})
    with_new = with_found.withColumn(new, F.transform(found, lambda m: pseudonym(m, F.col(own))))

    def piece(between: Column, i: Column) -> Column:
        return F.concat(between, F.coalesce(F.get(F.col(new), i), F.get(F.col(found), i), F.lit("")))

    rebuilt = F.array_join(F.transform(F.split(text, _ANY, -1), piece), "")
    n = F.when(F.size(found) > 0, F.size(F.array_compact(new))).otherwise(0).cast("long")
    return with_new.withColumn("n_private", n).withColumn(text_col, F.when(F.col("n_private") > 0, rebuilt).otherwise(text)).drop(found, new, own)


@functools.cache
def _own_key() -> str:
    return secrets.token_hex(16)


def session_key(spark: SparkSession) -> str:
    """The secret that spark.evlake.pseudonym.key names; without it one drawn for this driver process, under which no other run's pseudonyms link."""
    return spark.conf.get("spark.evlake.pseudonym.key", None) or _own_key()
